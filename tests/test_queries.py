"""Every registered query of the domain tables against its SQL, and the entry module."""

import pytest

import __spark_entry__ as entry
from rillmark.plans import catalog

from .compare import connection, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, con, name):
    same(catalog.QUERIES[name](spark, SF), con, catalog.ORACLES[name])


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_values_are_cleaned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("text IS NOT NULL")
    got = catalog.QUERIES["H8_clean_username"](spark, SF)
    assert got.agg({"n": "sum"}).head()[0] == sum(len(r.text.encode().split()) for r in docs.collect())
    assert catalog.QUERIES["H8_clean_whole_texts"](spark, SF).filter("name IS NULL").count() > 0


def test_toggles_start_from_the_subscriptions_there_are(spark):
    old = {(r.user_id, r.username): r for r in catalog.T.Tables(spark, SF).subscriptions.collect()}
    new = {(r.user_id, r.username): r for r in catalog.QUERIES["I17_subscription_toggles"](spark, SF).collect()}
    assert old.keys() < new.keys()
    same_row = lambda a, b: (a.enabled, a.notify_type, a.guild_id) == (b.enabled, b.notify_type, b.guild_id)
    both = [(old[k], new[k]) for k in old]
    assert any(same_row(a, b) for a, b in both)
    assert any(a.enabled and not b.enabled and same_row(a, b.__class__(**(b.asDict() | {"enabled": True}))) for a, b in both)
    assert any(not a.enabled and b.enabled for a, b in both)


def test_no_chunk_or_detection_is_left_out(spark):
    t = catalog.T.Tables(spark, SF)
    assert catalog.QUERIES["E7_frame_clock"](spark, SF).count() == t.chunks.filter("end_seconds > start_seconds").count()
    few = t.chunks.filter("chunk_index > 0").orderBy("id").limit(3)
    want = sorted((r.id, k, r.start_seconds + 2 * k) for r in few.collect() for k in range((r.end_seconds - r.start_seconds) // 2))
    assert sorted(map(tuple, catalog.A.frame_times(few, 0.5).collect())) == want
    assert catalog.QUERIES["F6_by_index"](spark, SF).count() == t.chunks.count()
    hit = catalog.QUERIES["I1_notifications"](spark, SF).select("detection_id").distinct()
    lines = t.detections.withColumnRenamed("id", "detection_id").join(hit, "detection_id").selectExpr("chunk_id % 10 AS line").distinct()
    assert lines.count() > 1
    assert catalog.QUERIES["J11_simulate_plan"](spark, SF).filter("vod_id % 2 = 0").count() > 0


@pytest.mark.parametrize("name", ["J7_pending_chunks", "J16_queued_chunks", "I12_admission_near_the_limit", "J13_search_command", "I11_expired_leases", "J10_auto_queue_switch"])
def test_compared_queries_are_not_empty(con, name):
    assert len(con.execute(catalog.ORACLES[name]).fetchall()) > 0


def test_answers_to_a_search(spark):
    t, J = catalog.T.Tables(spark, SF), catalog.J
    lines = [r.line for r in J.search_command(t, catalog.NOW, catalog.NAME, exact=True, count="all").orderBy("position").collect()]
    assert any("<t:0:f>" in x for x in lines)  # no date
    assert all(x.startswith("**Customer#") and "h" in x.rsplit("?t=")[1] and "None" not in x and "null" not in x for x in lines)
    many = J.search_message(t, catalog.NOW, catalog.NAME, exact=True, count="all").collect()
    assert [r.content for r in many] == [f'**Results for "{catalog.NAME}":**\n' + "\n".join(lines)]
    assert [r.content for r in J.search_message(t, catalog.NOW, "nobody at all").collect()] == ["No results found for **nobody at all**"]


def test_a_batch_that_is_written_again_replaces_itself(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, username string")
    for batch in ("x", "y", "x"):
        catalog.T.append_detections(rows, str(tmp_path / "d"), batch)
    assert spark.read.parquet(str(tmp_path / "d")).count() == 2


def test_thinning_streams_any_number_of_times(spark):
    import random

    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.randrange(5000) if r.random() > 0.01 else None) for _ in range(8000)]
    want = []
    for key in ("a", "b", None):
        last = 0
        for x in sorted({t for k, t in rows if k == key and t is not None}):
            if x - last >= 10:
                last = x
                want.append((key, x))
    got = [tuple(x) for x in catalog.A.thin(spark.createDataFrame(rows, "k string, ts int"), "k", "ts").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_frame_sums_equal_the_frames_without_a_row_for_each(spark):
    rows = [(1, 0, 1800), (2, 1800, 1801), (2, 7, 12), (3, 5, 5), (4, 9, 2), (5, None, 3), (6, -9, 40), (7, 3, 3604)]
    few = spark.createDataFrame(rows, "id long, start_seconds int, end_seconds int")
    for rate in (0.5, 1.0, 0.3, 2.0, 0.0):
        frames = catalog.A.frame_times(few, rate).selectExpr("id", "CAST(k AS LONG) AS k", "ts").groupBy("id")
        want = frames.agg(catalog.F.expr("count(*)"), catalog.F.min("ts"), catalog.F.max("ts"), catalog.F.expr("sum(CAST(ts AS LONG))"), catalog.F.expr("sum(k * ts)"))
        got = catalog.A.frame_sums(few, rate)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Generate" not in catalog.QUERIES["E7_frame_clock"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def scans(df, column):
    """How many tables with a column the optimized plan of df reads."""
    return sum("Relation" in x and f"{column}#" in x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines())


@pytest.mark.parametrize("name", ["J2_fuzzy_search_debug", "J4_fuzzy_search_first"])
def test_a_search_finds_names_before_detections_meet_recordings(spark, name):
    assert scans(catalog.QUERIES[name](spark, SF), "l_orderkey") == 1


@pytest.mark.parametrize("name", ["J4_without_a_query", "J5_top_streamers"])
def test_only_what_comes_first_is_looked_up_whole(spark, name):
    assert scans(catalog.QUERIES[name](spark, SF), "o_orderkey") == 0


def test_first_rows_keep_copies_and_ties(spark):
    t = catalog.T.Tables(spark, SF)
    twice = catalog.G.With(t, detections=t.detections.unionByName(t.detections))
    for limit in (1, 5, 30):
        got = [tuple(r) for r in catalog.J.fuzzy_search_debug(twice, catalog.NOW, limit=limit).collect()]
        whole = catalog.J._found(twice, None, None, "all", 0.2, catalog.NOW, (), 0.0)
        want = whole.orderBy(*catalog.J._order(None)).limit(limit).select(*catalog.V.SEARCH_COLUMNS, "similarity_score", "truncated")
        assert got == [tuple(r) for r in want.collect()]


def test_distinct_detections_are_counted_without_maps_of_ids(spark):
    t = catalog.T.Tables(spark, SF)
    rows = catalog.A.streamers_with_detections(t)
    assert "distinct" not in rows._jdf.queryExecution().optimizedPlan().toString()
    twice = catalog.A.streamers_with_detections(catalog.G.With(t, detections=t.detections.unionByName(t.detections)))
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, twice.collect()))


def test_batches_of_a_rollup_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    folders = iter(str(tmp_path / n) for n in "abc")
    monkeypatch.setattr(catalog.S, "shared_dir", lambda _: next(folders))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        catalog.QUERIES["I3_rollup_stream"](spark, SF)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(len(list((tmp_path / "b" / f"b={b}").glob("*.parquet"))) > 1 for b in range(3))


def test_documents_are_written_where_they_are(spark, tmp_path):
    rows = spark.range(0, 400, 1, 4).selectExpr("id AS chunk_id", "CONCAT('document ', id) AS document")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        catalog.T.write_summaries(rows, str(tmp_path / "out"), 3)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(p.name for p in (tmp_path / "out").glob("part=*")) == ["part=0", "part=1", "part=2"]
    assert all(len(list((tmp_path / "out" / f"part={n}").glob("*.txt"))) == 4 for n in range(3))  # one of each task
    assert {r.value for r in spark.read.text(str(tmp_path / "out")).collect()} == {f"document {i}" for i in range(400)}


@pytest.mark.parametrize("name", ["J18_refresh_counts", "J18_refreshed_streamers", "J18_refreshed_vods", "J18_catalogue_refresh"])
def test_a_refresh_reads_its_feed_once(spark, name):
    assert scans(catalog.QUERIES[name](spark, SF), "l_linenumber") == 1


def test_markers_are_read_in_their_row_in_order(spark):
    """Markers in no order, of one time, with no time or game, of recordings that come twice."""
    kind = "array<struct<positionMilliseconds:bigint,type:string,game:struct<id:string,displayName:string>>>"
    mark = lambda ms, game: (ms, "GAME", game and ("1", game))
    rows = [("a", [mark(9_900, "Game R"), mark(1_500, "Game R"), mark(4_000, None), mark(4_000, "Game R")], None), ("b", [], "Game R"), ("c", None, "Game R"), ("d", [mark(5, "Other")], None), ("e", [mark(None, "Game R"), mark(7_000, None)], None), ("a", [mark(2_000, "Game R")], None)]
    feed = spark.createDataFrame([(k, "t", 20, g, m) for k, m, g in rows], f"id string, title string, length_seconds int, game string, moments {kind}")
    got = sorted((x.source_id, x.chapters) for x in catalog.J.catalogue_updates(feed, "none", "game r").collect())
    assert got == [("a", [1, 4, 4, 9, 9, 20]), ("a", [2, 20]), ("b", [0, 20]), ("c", [0, 20]), ("e", [None, 7])]


def test_written_summaries_are_stored_compressed_and_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog.S, "shared_dir", lambda _: str(tmp_path / "out"))
    writers = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    got = {r.chunk_id: r.document for r in catalog.QUERIES["A9_written_summaries"](spark, SF).collect()}
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == writers
    t = catalog.T.Tables(spark, SF)
    assert got.keys() == {r.id for r in t.chunks.select("id").collect()}
    stored = sum(p.stat().st_size for p in (tmp_path / "out").rglob("part-*"))
    assert 0 < stored * 3 < sum(len(x.encode()) for x in got.values())

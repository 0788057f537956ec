"""The registered queries over the star schema's domain tables, each beside its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import aggregates as A
from ..operators import changes as G
from ..operators import distinct as N
from ..operators import intervals as I
from ..operators import vectors as K
from ..operators import views as V
from ..sources import snapshots as P
from ..sources import tables as T
from ..streaming import jobs as S
from ..streaming import rollups as R
from . import api as J

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NOW, NOW_SQL = datetime(2001, 8, 1), "TIMESTAMP '2001-08-01 00:00:00'"
EVENTS_NOW, EVENTS_NOW_SQL = datetime(2024, 1, 31), "TIMESTAMP '2024-01-31 00:00:00'"
QUERY = "smallring11"
URL = C.WATCH_URL


def domain(select: str, ctes: str = "", recursive: bool = False) -> str:
    """DuckDB SQL with the domain tables that select and ctes name."""
    found = T.bindings("[{}]")
    used = [n for n in found if re.search(rf"\b{n}\b", f"{select} {ctes}")]
    parts = [f"{n} AS ({found[n]})" for n in used] + ([ctes] if ctes else [])
    return ("WITH " + "RECURSIVE " * recursive + ", ".join(parts) + " " if parts else "") + select


def q(sql: str | None = None) -> Callable[[Callable[[T.Tables], DataFrame]], Callable[[T.Tables], DataFrame]]:
    def register(f: Callable[[T.Tables], DataFrame]) -> Callable[[T.Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(T.Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def tri(x: str) -> str:
    """The trigrams of a text in DuckDB."""
    return rf"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def sim(x: str, y: str) -> str:
    return f"CAST(len(list_intersect({x}, {y}))::DOUBLE / len(list_distinct(list_concat({x}, {y}))) AS FLOAT)"


def search_cte(min_conf: float = 0.7) -> str:
    return f"""ds AS (SELECT d.id AS detection_id, d.username, d.frame_time_seconds, d.confidence, d.rank, d.no_right_edge, d.truncated, v.id AS vod_id, v.source_id AS vod_source_id, v.published_at + to_seconds(d.frame_time_seconds) AS actual_timestamp,
 s.id AS streamer_id, s.login AS streamer_login, s.display_name AS streamer_display_name, s.profile_image_url AS streamer_avatar, '{URL}' || v.source_id || '?t=' || d.frame_time_seconds || 's' AS vod_url
 FROM detections d JOIN vods v ON d.vod_id = v.id JOIN streamers s ON v.streamer_id = s.id WHERE v.availability = 'available' AND d.confidence > {min_conf})"""


OUT = ", ".join(V.SEARCH_COLUMNS)
ROLLUP = """st AS (SELECT vod_id, count(*) AS n, count(*) FILTER (status = 'pending') AS p, count(*) FILTER (status = 'queued') AS qu, count(*) FILTER (status = 'processing') AS pr, count(*) FILTER (status = 'completed') AS co, count(*) FILTER (status = 'failed') AS fa FROM chunks GROUP BY vod_id),
ro AS (SELECT v.id AS vod_id, CASE WHEN coalesce(n, 0) = 0 OR n = p THEN 'pending' WHEN qu > 0 OR pr > 0 THEN 'processing' WHEN n = co THEN 'completed' WHEN n = fa THEN 'failed' ELSE 'partial' END AS status FROM vods v LEFT JOIN st ON st.vod_id = v.id)"""
ELIGIBLE = "el AS (SELECT v.* FROM vods v WHERE ready_for_processing AND availability = 'available' AND EXISTS (SELECT 1 FROM streamers s WHERE s.id = v.streamer_id AND s.processing_enabled) AND EXISTS (SELECT 1 FROM chunks c WHERE c.vod_id = v.id AND c.status = 'pending'))"
PENDING = ELIGIBLE + ", pe AS (SELECT el.id AS vod_id, el.source_id, el.published_at, count(*) AS pending_chunks, min(c.attempt_count) AS mac FROM el JOIN chunks c ON c.vod_id = el.id AND c.status = 'pending' GROUP BY ALL)"
SEGMENTS = """ar AS (SELECT id AS vod_id, duration_seconds AS d, CASE WHEN len(chapters) > 0 THEN chapters ELSE [0, duration_seconds] END AS a FROM vods),
pa AS (SELECT vod_id, d, unnest(range(0, len(a) // 2)) AS segment, a FROM ar),
seg AS (SELECT vod_id, segment::INT AS segment, greatest(0, least(a[2 * segment + 1], d)) AS segment_start, greatest(0, least(a[2 * segment + 2], d)) AS segment_end FROM pa),
sg AS (SELECT * FROM seg WHERE segment_end - segment_start >= 300)"""
GAPS = """cl AS (SELECT sg.*, greatest(c.start_seconds, segment_start) AS s, least(c.end_seconds, segment_end) AS e FROM sg JOIN chunks c ON c.vod_id = sg.vod_id AND c.start_seconds < segment_end AND segment_start < c.end_seconds UNION ALL SELECT sg.*, segment_end, segment_end FROM sg),
rn AS (SELECT *, coalesce(max(e) OVER (PARTITION BY vod_id, segment ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), segment_start) AS gap_start FROM cl),
gp AS (SELECT vod_id, segment, segment_start, segment_end, gap_start, s AS gap_end FROM rn WHERE s > gap_start)"""
PIECES = """g1 AS (SELECT *, gap_end - gap_start AS g FROM gp WHERE gap_end - gap_start >= 300),
g2 AS (SELECT *, greatest(g // 3600, 1) AS n FROM g1), g3 AS (SELECT *, CAST(ceil(g / n::DOUBLE) AS BIGINT) AS d FROM g2),
g4 AS (SELECT *, CASE WHEN g <= 3600 THEN 1 ELSE least(n, (g - 3600) // d + 1) END AS k FROM g3), g5 AS (SELECT *, unnest(range(0, k)) AS piece FROM g4),
pl AS (SELECT vod_id, segment, segment_start, segment_end, gap_start, gap_end, piece::INT AS piece, (gap_start + piece * d)::INT AS start_seconds, (CASE WHEN piece = k - 1 THEN gap_end ELSE gap_start + (piece + 1) * d END)::INT AS end_seconds FROM g5)"""


# --- A: tables


@q("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def A1_typed_scan(t):
    return T.load(t.spark, t.sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])


def _feed(t) -> DataFrame:
    """A page of nested JSON for each customer: its orders as videos, their lines as moments, every fifth without any."""
    game = lambda flag: F.when(F.col(flag) != "A", F.struct(F.col(flag).alias("id"), F.concat(F.lit("Game "), F.col(flag)).alias("displayName")))
    m = t.lineitem.filter("l_orderkey % 5 <> 0").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("f"))
    m = m.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.struct((F.col("l_linenumber") * 600_500).alias("positionMilliseconds"), F.lit("GAME").alias("type"), game("f").alias("game")).alias("node"))).alias("edges"))
    o = t.orders.join(m, t.orders["o_orderkey"] == m["l_orderkey"], "left").withColumn("g", F.when(F.col("o_orderstatus") == "O", "R").otherwise("A"))
    node = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("title"), F.floor(F.col("o_totalprice") / 25).cast("int").alias("lengthSeconds"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("publishedAt"), game("g").alias("game"), F.when(F.col("edges").isNotNull(), F.struct("edges")).alias("moments"))
    pages = o.groupBy("o_custkey").agg(F.collect_list(F.struct(node.alias("node"))).alias("edges"))
    return T.flatten_pages(pages.select(F.to_json(F.struct(F.struct(F.struct("edges").alias("videos")).alias("user"))).alias("body")))


FEED = """mk AS (SELECT l_orderkey AS k, l_linenumber AS i, max(l_returnflag) AS f FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY ALL),
fd AS (SELECT o_orderkey::STRING AS id, o_orderpriority AS title, floor(o_totalprice / 25)::INT AS length_seconds, strftime(o_orderdate, '%Y-%m-%d') AS published_at, CASE WHEN o_orderstatus = 'O' THEN 'Game R' END AS game, o_orderkey AS k FROM orders)"""


@q(f"WITH {FEED} SELECT id, title, length_seconds, published_at, game, (SELECT count(*) FROM mk WHERE mk.k = fd.k) AS moments FROM fd")
def A3_flatten_pages(t):
    return _feed(t).withColumn("moments", F.size("moments").cast("long"))


@q("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 3")
def A4_newest_per_key(t):
    return T.newest_per_key(t.orders, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@q(domain("SELECT id, username FROM detections WHERE chunk_id % 3 <> 0"))
def A5_batched_append(t):
    path = S.shared_dir(t.spark)
    rows = t.detections.select("id", F.when(F.col("chunk_id") % 3 != 0, F.col("username")).alias("username"), (F.col("chunk_id") % 2).alias("half"))
    for half in (0, 1, 0):  # the first batch is tried again
        T.append_detections(rows.filter(F.col("half") == half).drop("half"), path, half)
    return t.spark.read.parquet(path).drop("batch")


@q(domain("SELECT id, streamer_id, CASE WHEN id % 5 = 0 THEN 'changed' ELSE title END AS title, CASE WHEN id % 5 = 0 THEN duration_seconds + 1 ELSE duration_seconds END AS duration_seconds FROM vods UNION ALL SELECT id + 1000000000000, NULL, 'changed', duration_seconds + 1 FROM vods WHERE id % 5 = 0"))
def A6_upsert(t):
    base = t.vods.select("id", "streamer_id", "title", "duration_seconds")
    up = base.filter("id % 5 = 0").select(F.explode(F.array("id", F.col("id") + 1_000_000_000_000)).alias("id"), F.lit("changed").alias("title"), (F.col("duration_seconds") + 1).alias("duration_seconds"))
    return T.merge_snapshot(base, up, ["id"], ["title", "duration_seconds"])


@q(ORACLES["A6_upsert"])
def A6_snapshot_upsert(t):
    """The same on a stored table, of which only the partitions of the updated keys are rewritten; done twice."""
    path = S.shared_dir(t.spark)
    base = t.vods.select("id", "streamer_id", "title", "duration_seconds")
    P.write_snapshot(base, path, "id", 32)
    up = base.filter("id % 5 = 0").select(F.explode(F.array("id", F.col("id") + 1_000_000_000_000)).alias("id"), F.lit("changed").alias("title"), (F.col("duration_seconds") + 1).alias("duration_seconds"))
    for _ in range(2):
        P.upsert(t.spark, path, up, "id", ["title", "duration_seconds"], 32)
    return P.read_snapshot(t.spark, path).drop(P.BUCKET)


@q(domain("SELECT 'streamers' AS name, count(*) AS n FROM streamers WHERE id % 10 <> 0 UNION ALL SELECT 'vods', count(*) FROM lv UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE vod_id NOT IN (SELECT id FROM gv) UNION ALL SELECT 'detections', count(*) FROM detections WHERE vod_id NOT IN (SELECT id FROM gv)", "gv AS (SELECT id FROM vods WHERE streamer_id % 10 = 0), lv AS (SELECT id FROM vods WHERE streamer_id % 10 <> 0)"))
def A7_delete_cascade(t):
    left = T.delete_cascade({n: getattr(t, n) for n in ("streamers", "vods", "chunks", "detections")}, t.streamers.filter("id % 10 = 0"))
    return I.union_pages(*(df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n, df in left.items()))


@q(domain("SELECT id, vod_id, status FROM chunks WHERE vod_id % 7 <> 0 UNION ALL SELECT id, vod_id, 'pending' FROM chunks WHERE vod_id % 7 = 0 AND chunk_index = 0 UNION ALL SELECT id, vod_id, status FROM chunks WHERE vod_id % 7 = 0 AND vod_id NOT IN (SELECT vod_id FROM chunks WHERE chunk_index = 0)"))
def A8_replace_partition(t):
    base = t.chunks.select("id", "vod_id", "status")
    return T.replace_partition(base, t.chunks.filter("vod_id % 7 = 0 AND chunk_index = 0").select("id", "vod_id", F.lit("pending").alias("status")), "vod_id")


@q("SELECT o_orderkey, CASE WHEN month(o_orderdate) = 3 THEN 0 ELSE o_totalprice END AS o_totalprice, month(o_orderdate)::INT AS part FROM orders WHERE month(o_orderdate) <> 3 OR o_orderkey % 2 = 0")
def A8_overwritten_partitions(t):
    """A table by month of which one month is written anew, twice: that partition is replaced, the others are not touched."""
    path = S.shared_dir(t.spark)
    base = t.orders.select("o_orderkey", "o_totalprice", F.month("o_orderdate").alias("part"))
    base.repartition("part").write.partitionBy("part").parquet(path)
    march = base.filter("part = 3 AND o_orderkey % 2 = 0").withColumn("o_totalprice", F.lit(0.0).cast(base.schema["o_totalprice"].dataType))
    for _ in range(2):
        P.overwrite_partitions(march, path, "part")
    return t.spark.read.parquet(path)


@q(domain("SELECT chunk_id, to_json({chunk_id: chunk_id, detections_count: count(*), detections: list({timestamp: frame_time_seconds, username: username, rank: rank} ORDER BY frame_time_seconds, id)})::STRING AS document FROM detections GROUP BY chunk_id"))
def A9_summary_export(t):
    return T.export_summary(t.detections)


@q("SELECT user_id AS vod_id, event_id AS chunk_id, event_type AS event, 'u' || user_id AS username, 'gold' AS rank, (event_id % 100)::INT AS frames FROM events WHERE event_id % 4 <> 0")
def A10_event_log(t):
    inner = F.to_json(F.struct(F.col("event_type").alias("event"), F.concat(F.lit("u"), "user_id").alias("username"), F.lit("gold").alias("rank"), (F.col("event_id") % 100).alias("frames")))
    message = F.when(F.col("event_id") % 4 == 0, F.lit("plain text")).otherwise(inner)
    lines = t.events.select(F.to_json(F.struct(F.lit("INFO").alias("level"), message.alias("message"), F.col("user_id").alias("vod_id"), F.col("event_id").alias("chunk_id"))).alias("line"))
    return T.parse_event_log(lines)


@q(domain("SELECT id, '/detections/' || vod_id || '/' || frame_time_seconds || '.jpg' AS frame, '/detections/test/480p/' || vod_id || '/' || frame_time_seconds || '.jpg' AS test, vod_id || '/plate_' || frame_time_seconds || '.jpg' AS plate FROM detections"))
def A11_object_paths(t):
    s, k = F.col("vod_id").cast("string"), F.col("frame_time_seconds")
    return t.detections.select("id", C.storage_path(s, k).alias("frame"), C.storage_path(s, k, test_quality="480p").alias("test"), C.storage_path(s, k, "plate").alias("plate"))


# --- B: filters


@q(domain(f"SELECT {OUT}, truncated FROM ds", search_cte()))
def B1_detection_search(t):
    return V.detection_search(t).select(*V.SEARCH_COLUMNS, "truncated")


@q(domain(f"SELECT {OUT}, truncated FROM ds", search_cte(0.0)))
def B2_detection_search_debug(t):
    return V.detection_search(t, 0.0).select(*V.SEARCH_COLUMNS, "truncated")


@q(" UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS n FROM events WHERE {f'ts >= {EVENTS_NOW_SQL} - INTERVAL {n} DAY' if n else b}" for k, n, b in [("all", 0, "true"), ("day", 1, ""), ("week", 7, ""), ("month", 30, ""), ("year", 365, ""), ("decade", 0, "false")]))
def B3_date_range(t):
    return I.union_pages(*(V.date_range(t.events, "ts", k, EVENTS_NOW).agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n")) for k in ("all", "day", "week", "month", "year", "decade")))


@q("SELECT event_id, user_id FROM events WHERE user_id = 7")
def B4_optional_filter(t):
    return V.opt_filter(V.opt_filter(t.events, "event_type", ""), "user_id", 7).select("event_id", "user_id")


@q(domain("SELECT 'rank' AS rule, id AS key FROM detections WHERE rank NOT IN ('bronze', 'silver', 'gold') UNION ALL SELECT 'confidence', id FROM detections WHERE confidence < 0.65 UNION ALL SELECT 'unique streamer, title', streamer_id || '|' || title FROM vods GROUP BY streamer_id, title HAVING count(*) > 1 UNION ALL SELECT 'vod exists', id FROM detections WHERE vod_id NOT IN (SELECT id FROM vods WHERE id % 3 = 0)"))
def B5_audit(t):
    rules = {"rank": F.col("rank").isin("bronze", "silver", "gold"), "confidence": F.col("confidence") >= 0.65}
    lost = V.audit_foreign(t.detections, "vod_id", t.vods.filter("id % 3 = 0"), "id", "id", "vod exists")
    return I.union_pages(V.audit(t.detections, "id", rules), V.audit_unique(t.vods, ["streamer_id", "title"], "unique streamer, title"), lost)


@q("SELECT event_id, a, b, a IS DISTINCT FROM b AS changed FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS a, CASE WHEN event_id % 2 = 0 THEN NULL ELSE event_type END AS b FROM events)")
def B6_change_predicate(t):
    rows = t.events.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("a"), F.when(F.col("event_id") % 2 != 0, F.col("event_type")).alias("b"))
    return rows.withColumn("changed", C.changed(F.col("a"), F.col("b")))


@q(domain("SELECT id, vod_id FROM detections WHERE vod_id IN (SELECT id FROM vods WHERE availability = 'available')"))
def B7_row_visibility(t):
    return V.visible_detections(t).select("id", "vod_id")


@q(domain("SELECT id FROM el", ELIGIBLE))
def B8_eligible_vods(t):
    return V.eligible_vods(t).select("id")


def _dated_streamers(t) -> DataFrame:
    at = F.lit(NOW).cast("timestamp_ntz")
    return t.streamers.withColumn("created_at", at - F.make_dt_interval(F.lit(0), F.lit(40))).withColumn("updated_at", at - F.make_dt_interval(F.lit(0), (F.col("id") % 41).cast("int")))


@q(domain("SELECT id FROM streamers WHERE processing_enabled AND (has_vods OR id % 41 = 40 OR has_vods IS NULL) AND id % 41 >= 6"))
def B9_stale_streamers(t):
    return V.stale_streamers(_dated_streamers(t), NOW, C.as_interval(F.lit("nonsense"))).select("id")


@q(domain("SELECT id, published_at <= TIMESTAMP '1998-01-01' AS old_templates FROM vods"))
def B10_era_flag(t):
    return t.vods.select("id", (F.col("published_at") <= F.lit(datetime(1998, 1, 1)).cast("timestamp_ntz")).alias("old_templates"))


@q("SELECT p_partkey, coalesce(p_brand = 'Brand#11', false) OR coalesce(contains(lower(p_name), 'small'), false) AS wanted FROM part")
def B11_category(t):
    return t.part.select("p_partkey", C.is_category(F.col("p_brand"), F.col("p_name"), "Brand#11", "small").alias("wanted"))


# --- C: joins


@q(domain("SELECT id FROM (SELECT DISTINCT o_custkey + 3 AS id FROM orders) WHERE id NOT IN (SELECT id FROM streamers WHERE id % 2 = 0)"))
def C5_new_streamers(t):
    return V.new_streamers(t.orders.select((F.col("o_custkey") + 3).alias("id")).distinct(), t.streamers.filter("id % 2 = 0"))


@q(domain("SELECT c.vod_id, c.id, segment_start, segment_end, c.start_seconds, c.end_seconds FROM chunks c JOIN sg ON sg.vod_id = c.vod_id AND c.start_seconds < segment_end AND segment_start < c.end_seconds", SEGMENTS))
def C7_overlap_join(t):
    a = t.chunks.select("vod_id", "id", F.col("start_seconds").alias("start"), F.col("end_seconds").alias("end"))
    b = I.segments(t.vods).select("vod_id", F.col("segment_start").alias("start"), F.col("segment_end").alias("end"))
    return V.overlap_join(a, b, "vod_id").select("vod_id", F.col("a_id").alias("id"), F.col("b_start").alias("segment_start"), F.col("b_end").alias("segment_end"), F.col("a_start").alias("start_seconds"), F.col("a_end").alias("end_seconds"))


@q(domain(f"SELECT a.u AS a_value, b.u AS b_value, {sim('a.g', 'b.g')} AS similarity FROM (SELECT a, b FROM ax JOIN bx ON ax.x = bx.x GROUP BY a, b HAVING count(*) >= 3) p JOIN da a ON a.u = p.a JOIN db b ON b.u = p.b WHERE {sim('a.g', 'b.g')}::DOUBLE >= 0.6", f"da AS (SELECT u, {tri('u')} AS g FROM (SELECT DISTINCT username AS u FROM detections)), db AS (SELECT u, {tri('u')} AS g FROM (SELECT DISTINCT username AS u FROM subscriptions)), ax AS (SELECT u AS a, unnest(g) AS x FROM da), bx AS (SELECT u AS b, unnest(g) AS x FROM db)"))
def C8_fuzzy_join(t):
    return V.fuzzy_join(t.detections, t.subscriptions, "username", 0.6)


@q(domain("SELECT event_id, coalesce(a.id, b.id) AS streamer_id FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id END AS id, 'customer#' || lpad(user_id::STRING, 9, '0') AS login FROM events) e LEFT JOIN streamers a ON a.id = e.id LEFT JOIN streamers b ON b.login = e.login"))
def C9_lookup_fallback(t):
    ev = t.events.select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("id"), F.concat(F.lit("customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("login"))
    return V.lookup_fallback(ev, t.streamers.select("id", "login"), "id", "login").select("event_id", F.col("found.id").alias("streamer_id"))


@q(domain("SELECT v.id, s.login AS login FROM vods v LEFT JOIN (SELECT * FROM streamers WHERE processing_enabled) s ON s.id = v.streamer_id"))
def C10_embedded_join(t):
    return V.embed(t.vods.select("id", "streamer_id"), t.streamers.filter("processing_enabled").select("id", "login"), "streamer_id", "id", "streamer").select("id", F.col("streamer.login").alias("login"))


@q(domain("SELECT DISTINCT id, id % 3 = 0 AS available FROM vods"))
def C12_presence(t):
    return V.presence(t.vods, t.vods.filter("id % 3 = 0"), "id")


PROFILES = "pf AS (SELECT r_regionkey AS id, CASE WHEN r_regionkey > 0 THEN make_timestamp(1992 + r_regionkey, 1, 1, 0, 0, 0) END AS f, CASE WHEN r_regionkey < 3 THEN make_timestamp(1994 + r_regionkey, 1, 1, 0, 0, 0) END AS u FROM region)"


@q(domain("SELECT v.id, (SELECT max_by(pf.id, coalesce(f, TIMESTAMP '1900-01-01')) FROM pf WHERE (f IS NULL OR f <= v.published_at) AND (u IS NULL OR v.published_at < u)) AS profile_id FROM vods v", PROFILES))
def C13_effective_profile(t):
    year = lambda n: F.make_timestamp_ntz(F.lit(n) + F.col("r_regionkey").cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    p = t.region.select(F.col("r_regionkey").alias("id"), F.when(F.col("r_regionkey") > 0, year(1992)).alias("from_date"), F.when(F.col("r_regionkey") < 3, year(1994)).alias("to_date"))
    return V.effective_profile(t.vods.select("id", "published_at"), p).select("id", "profile_id")


@q(domain("SELECT v.id AS vod_id, p.profile_name FROM vods v JOIN streamers s ON s.id = v.streamer_id JOIN profiles p ON p.id = coalesce(s.profile_id, 1)"))
def C14_profile_lookup(t):
    return V.profile_for(t).select("vod_id", "profile_name")


# --- D: aggregates


@q(domain("SELECT count(DISTINCT streamer_id) AS streamers, count(DISTINCT vod_id) AS vods, count(*) AS detections FROM ds", search_cte()))
def D1_global_stats(t):
    return A.global_stats(t)


@q(domain("SELECT vod_id, n AS chunks, p AS pending, qu AS queued, pr AS processing, co AS completed, fa AS failed FROM st", ROLLUP))
def D2_status_counts(t):
    return A.status_counts(t.chunks)


@q(domain("SELECT streamer_id, streamer_login, streamer_display_name, streamer_avatar, count(DISTINCT detection_id) AS detection_count, count(DISTINCT vod_id) AS vod_count, max(actual_timestamp) AS latest_detection FROM ds GROUP BY ALL", search_cte()))
def D6_streamers_with_detections(t):
    return A.streamers_with_detections(t)


@q(domain("SELECT s.id AS streamer_id, s.login, count(d.id) AS total_detections, round(avg(d.confidence), 9) AS avg_confidence, count(d.id) FILTER (d.no_right_edge) AS no_right_edge_count, " + ", ".join(f"count(DISTINCT v.id) FILTER (ro.status = '{x}') AS vods_{x}" for x in ("pending", "processing", "completed", "partial", "failed")) + ", count(DISTINCT v.id) AS total_vods, CASE WHEN count(DISTINCT v.id) > 0 THEN round(count(d.id)::DECIMAL(18, 6) / count(DISTINCT v.id), 2)::DOUBLE ELSE 0 END AS avg_detections_per_vod FROM streamers s LEFT JOIN vods v ON v.streamer_id = s.id LEFT JOIN ro ON ro.vod_id = v.id LEFT JOIN detections d ON d.vod_id = v.id GROUP BY s.id, s.login", ROLLUP))
def D7_streamer_detection_stats(t):
    return A.streamer_detection_stats(t)


@q(domain("SELECT v.id AS vod_id, s.display_name AS streamer, ro.status, coalesce(c.n, 0) AS chunk_count, coalesce(d.n, 0) AS total_detections, round(d.a, 9) AS avg_confidence, CASE WHEN ro.status <> 'pending' THEN c.q END AS quality FROM vods v JOIN ro ON ro.vod_id = v.id LEFT JOIN cq c ON c.vod_id = v.id LEFT JOIN (SELECT vod_id, count(*) AS n, avg(confidence) AS a FROM detections GROUP BY 1) d ON d.vod_id = v.id LEFT JOIN streamers s ON s.id = v.streamer_id", ROLLUP + ", cq AS (SELECT vod_id, count(*) AS n, CASE WHEN count(DISTINCT quality) = 1 AND count(quality) = count(*) THEN max(quality) END AS q FROM chunks GROUP BY 1)"))
def D8_vod_stats(t):
    return A.vod_stats(t)


@q(domain("SELECT vod_id, status FROM ro", ROLLUP))
def D10_status_rollup(t):
    return A.rollup_status(t)


@q(domain("SELECT count(*) AS total_vods, sum(pending_chunks)::BIGINT AS total_pending_chunks, count(*) AS ready_vods FROM pe", PENDING))
def D11_pending_vods_count(t):
    return A.pending_vods_count(t)


@q(domain("SELECT vod_id, source_id, pending_chunks FROM pe ORDER BY mac, published_at DESC NULLS FIRST, vod_id LIMIT 5", PENDING))
def D12_pending_vods(t):
    return A.pending_vods(t, 5)


@q("SELECT k, min(s) AS s, max(e) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM (SELECT l_suppkey AS k, l_partkey * 7 AS s, l_partkey * 7 + l_quantity::INT AS e FROM lineitem))) GROUP BY k, i")
def D13_interval_union(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("k"), (F.col("l_partkey") * 7).alias("s"), (F.col("l_partkey") * 7 + F.col("l_quantity").cast("int")).alias("e"))
    return I.range_agg(rows, "k", "s", "e")


@q("SELECT user_id AS k, score, i, event_type AS text FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, i) AS r FROM (SELECT user_id, event_id AS i, event_type, round(value, 0) AS score FROM events)) WHERE r = 1 AND score >= 0.5")
def D15_argmax(t):
    rows = t.events.select(F.col("user_id").alias("k"), F.col("event_id").alias("i"), F.col("event_type").alias("text"), F.round("value", 0).alias("score"))
    return A.argmax(rows, "k", "score", "i", 0.5)


@q("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def D16_first_seen(t):
    return T.first_seen(t.events, "user_id", [F.asc("ts"), F.asc("event_id")]).select("user_id", "event_id")


@q(domain("SELECT name, attr, count(*) AS total FROM metrics GROUP BY ALL"))
def D17_counters(t):
    return A.counter(t.metrics.withColumn("d", F.lit(1)), ["name", "attr"], "d")


@q(domain(f"SELECT name, len(list_filter({A.BOUNDS}::DOUBLE[], lambda b: v > b))::INT AS bucket, count(*) AS count, round(sum(v), 6) AS sum FROM (SELECT name, value / 100 AS v FROM metrics) GROUP BY ALL"))
def D18_histogram(t):
    rows = A.histogram(t.metrics.select("name", (F.col("value") / 100).alias("v")), ["name"], "v")
    return rows.withColumn("sum", F.round("sum", 6))


@q("SELECT event_id, sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS value FROM events")
def D19_gauge(t):
    rows = t.events.select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 == 0, -1).otherwise(1).alias("d"))
    return A.gauge(rows, "user_id", ["ts", "event_id"], "d").select("event_id", "value")


@q(domain("SELECT streamer_id, count(*) > 1 AS has_vods, CASE WHEN count(*) > 1 THEN count(*) ELSE 0 END AS num_vods, CASE WHEN count(*) > 1 THEN count(*) FILTER (chapters IS NOT NULL) ELSE 0 END AS num_matching, CASE WHEN count(*) > 1 THEN min(published_at) END AS oldest_vod FROM vods GROUP BY 1"))
def D20_streamer_refresh(t):
    return A.refresh_streamers(t.vods.select("streamer_id", "published_at", F.col("chapters").isNotNull().alias("matching")))


@q("SELECT a AS found_a, b AS found_b, ab AS found_both, m AS mismatched, d AS differing, CASE WHEN ab > 0 THEN round((ab - m) / ab::DOUBLE, 4) ELSE 0 END AS agreed_share FROM (SELECT count(x) AS a, count(y) AS b, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS ab, count(*) FILTER (x <> y) AS m, count(*) FILTER (x IS DISTINCT FROM y) AS d FROM (SELECT event_id, event_type AS x FROM events WHERE event_id % 3 <> 0) a FULL JOIN (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'view' ELSE event_type END AS y FROM events WHERE event_id % 5 <> 0) b USING (event_id))")
def D21_agreement(t):
    a = t.events.filter("event_id % 3 <> 0").select("event_id", F.col("event_type").alias("label"))
    b = t.events.filter("event_id % 5 <> 0").select("event_id", F.when(F.col("event_id") % 7 == 0, "view").otherwise(F.col("event_type")).alias("label"))
    return A.agreement(a, b, "event_id", "label")


@q("SELECT chunk_id, n AS frames, m AS matches, d AS duration_ms, CASE WHEN d > 0 THEN round(n / (d / 1000), 2) ELSE 0 END AS fps FROM (SELECT user_id AS chunk_id, count(*) AS n, count(*) FILTER (event_type = 'view') AS m, round(sum(event_id % 17), 2)::DOUBLE AS d FROM events GROUP BY 1)")
def D22_run_summary(t):
    return A.chunk_summary(t.events.select(F.col("user_id").alias("chunk_id"), (F.col("event_type") == "view").alias("matched"), (F.col("event_id") % 17).cast("double").alias("ms")))


# --- E, F: windows, order, pages


@q(domain("SELECT streamer_id, detection_id, r AS row_num FROM (SELECT *, row_number() OVER (PARTITION BY streamer_id ORDER BY actual_timestamp DESC NULLS FIRST, detection_id) AS r FROM ds) WHERE r <= 3", search_cte()))
def E1_topk_per_group(t):
    return A.topk_per_group(V.detection_search(t).select("streamer_id", "detection_id", "actual_timestamp"), "streamer_id", [F.desc_nulls_first("actual_timestamp"), F.asc("detection_id")], 3).drop("actual_timestamp")


@q("SELECT user_id, start_seconds, end_seconds FROM (SELECT user_id, event_type, floor(ms / 1000)::BIGINT AS start_seconds, coalesce(floor(lead(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) / 1000)::BIGINT, 2678400) AS end_seconds FROM (SELECT *, date_diff('millisecond', TIMESTAMP '2024-01-01', ts) AS ms FROM events)) WHERE event_type = 'view'")
def E3_lead_intervals(t):
    rows = t.events.withColumn("ms", F.timestamp_diff("MILLISECOND", F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz"), F.col("ts"))).withColumn("length", F.lit(2678400))
    return I.intervals_from_markers(rows, "user_id", "ms", "event_id", "length", "event_type = 'view'")


@q(domain("SELECT id, (coalesce(m, -1) + row_number() OVER (PARTITION BY vod_id ORDER BY start_seconds))::INT AS chunk_index FROM chunks LEFT JOIN (SELECT vod_id AS k, max(chunk_index) AS m FROM chunks WHERE chunk_index < 3 GROUP BY 1) ON k = vod_id WHERE chunk_index >= 3"))
def E4_allocate_index(t):
    new = t.chunks.filter("chunk_index >= 3").drop("chunk_index")
    return A.allocate_index(new, t.chunks.filter("chunk_index < 3"), "vod_id", ["start_seconds"]).select("id", F.col("chunk_index").cast("int").alias("chunk_index"))


def _frames(t) -> DataFrame:
    ts = F.floor(F.timestamp_diff("SECOND", F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz"), F.col("ts")) / 600).cast("long")
    return t.events.select(F.col("event_id").alias("frame_id"), F.col("user_id").alias("chunk_id"), ts.alias("ts"))


FRAMES = "fr AS (SELECT event_id AS frame_id, user_id AS chunk_id, date_diff('second', TIMESTAMP '2024-01-01', ts) // 600 AS ts FROM events)"
THIN = "th AS (SELECT chunk_id, unnest(list_reduce(list_prepend([0::BIGINT], list_transform(list_sort(list(ts)), lambda x: [x])), lambda a, x: CASE WHEN x[1] - a[-1] >= 10 THEN list_concat(a, x) ELSE a END)[2:]) AS ts FROM {} GROUP BY chunk_id)"


@q(f"WITH {FRAMES}, {THIN.format('fr')} SELECT chunk_id, ts FROM th")
def E6_thinning(t):
    return A.thin(_frames(t), "chunk_id", "ts", 10)


@q(domain("SELECT id, count(*) AS frames, min(ts) AS first, max(ts) AS last, sum(ts)::BIGINT AS total, sum(k * ts)::BIGINT AS moment FROM (SELECT id, k, (start_seconds + k * 2)::INT AS ts FROM (SELECT id, start_seconds, unnest(range(0, 900)) AS k FROM chunks)) GROUP BY id"))
def E7_frame_clock(t):
    """The frame times of all chunks, summed up by chunk."""
    return A.frame_sums(t.chunks, 0.5)


@q(domain(f"SELECT id, source_id, last_availability_check FROM vods WHERE availability = 'available' AND (last_availability_check IS NULL OR last_availability_check < {NOW_SQL} - INTERVAL 24 HOUR) ORDER BY last_availability_check NULLS FIRST, id LIMIT 100"))
def F3_vods_to_check(t):
    return J.vods_to_check(t, NOW)


@q(domain("SELECT id, vod_id, priority, scheduled_for FROM chunks WHERE status = 'pending' AND priority >= 1 ORDER BY priority DESC, scheduled_for, id LIMIT 100"))
def F4_next_chunks(t):
    return J.next_chunks(t, 100, 1)


# --- G: intervals


@q(domain("SELECT vod_id, segment, segment_start, segment_end FROM sg", SEGMENTS))
def G1_segments(t):
    return I.segments(t.vods)


@q(domain("SELECT * FROM gp", f"{SEGMENTS}, {GAPS}"))
def G2_range_difference(t):
    return I.subtract_ranges(I.segments(t.vods, crossing=True), t.chunks)


@q("WITH gp AS (SELECT o_orderkey AS vod_id, 0 AS segment, 0 AS segment_start, 0 AS segment_end, 0 AS gap_start, floor(o_totalprice / 10)::INT AS gap_end FROM orders), " + PIECES + " SELECT vod_id, piece, start_seconds, end_seconds FROM pl")
def G3_split_gaps(t):
    return I.split_gaps(t.orders.select(F.col("o_orderkey").alias("vod_id"), F.lit(0).alias("gap_start"), F.floor(F.col("o_totalprice") / 10).cast("int").alias("gap_end"))).select("vod_id", "piece", "start_seconds", "end_seconds")


@q(domain("SELECT * FROM pl", f"{SEGMENTS}, {GAPS}, {PIECES}"))
def G4_plan(t):
    return I.simulate_chunk_plan(t)


@q(domain("SELECT pl.vod_id, (coalesce(m, -1) + row_number() OVER (PARTITION BY pl.vod_id ORDER BY segment, start_seconds))::INT AS chunk_index, start_seconds, end_seconds FROM pl LEFT JOIN (SELECT vod_id, max(chunk_index) AS m FROM chunks GROUP BY 1) c ON c.vod_id = pl.vod_id", f"{SEGMENTS}, {GAPS}, {PIECES}"))
def G5_create_missing_chunks(t):
    return I.create_missing_chunks(t)


LEGACY = """l0 AS (SELECT id AS vod_id, duration_seconds AS d, CASE WHEN len(chapters) > 0 THEN chapters ELSE [0, duration_seconds] END AS a FROM vods WHERE duration_seconds >= 600),
l1 AS (SELECT vod_id, i, a[2 * i + 1] AS s, a[2 * i + 2] AS e FROM (SELECT *, unnest(range(0, len(a) // 2)) AS i FROM l0)),
l2 AS (SELECT *, e - s AS g, CASE WHEN e - s <= 3600 THEN 1 WHEN (e - s) % 3600 > 0 AND ceil((e - s) / 3600.0) > 1 THEN ceil((e - s) / 3600.0) - 1 ELSE ceil((e - s) / 3600.0) END::INT AS n FROM l1 WHERE e - s >= 600),
l3 AS (SELECT *, ceil(g / n::DOUBLE)::INT AS z, unnest(range(0, n)) AS j FROM l2),
l4 AS (SELECT vod_id, (row_number() OVER (PARTITION BY vod_id ORDER BY i, j) - 1)::INT AS chunk_index, least(s + j * z, e)::INT AS start_seconds, (CASE WHEN j = n - 1 THEN e ELSE least(s + (j + 1) * z, e) END)::INT AS end_seconds FROM l3)"""


@q(domain("SELECT * FROM l4 WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.vod_id = l4.vod_id AND c.chunk_index = l4.chunk_index)", LEGACY))
def G6_legacy_splitter(t):
    return I.legacy_chunks(t).select("vod_id", F.col("chunk_index").cast("int").alias("chunk_index"), "start_seconds", "end_seconds")


@q(domain("SELECT vod_id, id, start_seconds, b AS covered_to FROM (SELECT *, max(end_seconds) OVER (PARTITION BY vod_id ORDER BY start_seconds, end_seconds, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT id, vod_id, start_seconds - CASE WHEN id % 3 = 0 THEN 5 ELSE 0 END AS start_seconds, end_seconds FROM chunks)) WHERE start_seconds < b"))
def G7_overlap_violations(t):
    return I.overlap_violations(t.chunks.withColumn("start_seconds", F.col("start_seconds") - F.when(F.col("id") % 3 == 0, 5).otherwise(0)))


@q(domain("SELECT s.vod_id, coalesce(c.covered, 0)::BIGINT AS covered, s.total::BIGINT AS total, round(coalesce(c.covered, 0) / s.total, 6) AS share FROM (SELECT vod_id, sum(segment_end - segment_start) AS total FROM seg WHERE segment_end > segment_start GROUP BY 1) s LEFT JOIN (SELECT seg.vod_id, sum(least(end_seconds, segment_end) - greatest(start_seconds, segment_start)) AS covered FROM seg JOIN chunks c ON c.vod_id = seg.vod_id AND status = 'completed' AND start_seconds < segment_end AND segment_start < end_seconds WHERE segment_end > segment_start GROUP BY 1) c ON c.vod_id = s.vod_id", SEGMENTS))
def G8_coverage(t):
    return I.coverage(t).select("vod_id", F.col("covered").cast("long").alias("covered"), F.col("total").cast("long").alias("total"), "share")


@q(domain("SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY streamer_id ORDER BY published_at DESC NULLS LAST, id DESC) AS r FROM vods) WHERE streamer_id % 4 <> 0 OR r > 1"))
def G10_skip_live(t):
    return I.skip_live(t.vods, t.streamers.filter("id % 4 = 0").select(F.col("id").alias("streamer_id"))).select("id")


# --- H: functions


@q(f"SELECT p_partkey, {sim(tri('p_name'), tri('p_type'))} AS score FROM part")
def H1_similarity(t):
    return t.part.select("p_partkey", C.similarity(F.col("p_name"), F.col("p_type")).alias("score"))


@q(domain("SELECT id, (duration_seconds // 3600) || 'h' || (duration_seconds % 3600 // 60) || 'm' || (duration_seconds % 60) || 's' AS hms, duration_seconds::BIGINT AS back, epoch(published_at)::BIGINT AS at FROM vods"))
def H5_time_text(t):
    rows = t.vods.withColumn("hms", C.hms(F.col("duration_seconds")))
    return rows.select("id", "hms", C.parse_hms(F.col("hms")).alias("back"), C.epoch_seconds(F.col("published_at")).alias("at"))


CLEANED = r"CASE WHEN length(b) BETWEEN 4 AND 25 AND regexp_matches(b, '^[a-zA-Z0-9]') THEN b END AS name"


@q(rf"SELECT doc_id, {CLEANED}, count(*) AS n FROM (SELECT doc_id, regexp_replace(w, '[^a-zA-Z0-9_\-.]', '', 'g') AS b FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[\x20\x09-\x0D]+')) AS w FROM documents) WHERE w <> '') GROUP BY ALL")
def H8_clean_username(t):
    """Every word of every whole text."""
    words = t.documents.select("doc_id", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("w")).filter("w <> ''")
    return words.groupBy("doc_id", C.clean_username(F.col("w")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@q(rf"SELECT doc_id, {CLEANED} FROM (SELECT doc_id, regexp_replace(text, '[^a-zA-Z0-9_\-.]', '', 'g') AS b FROM documents)")
def H8_clean_whole_texts(t):
    """Texts of more than 25 characters that stay give null."""
    return t.documents.select("doc_id", C.clean_username(F.col("text")).alias("name"))


@q("SELECT p_partkey, least(ceil(0.3 * w), w - x)::INT AS w, least(ceil(0.2 * h), h - y)::INT AS h, x, y FROM (SELECT *, least(floor(0.25 * w), w - 1)::INT AS x, least(floor(0.6 * h), h - 1)::INT AS y FROM (SELECT p_partkey, p_size * 16 AS w, p_size * 9 AS h FROM part))")
def H18_pixel_box(t):
    lit = F.lit
    rows = t.part.select("p_partkey", C.pixel_box(lit(0.25), lit(0.6), lit(0.3), lit(0.2), F.col("p_size") * 16, F.col("p_size") * 9).alias("b"))
    return rows.select("p_partkey", "b.*")


@q("SELECT p_partkey, CASE WHEN small THEN 0 ELSE 40 END AS x, CASE WHEN small THEN 0 ELSE m END AS y, CASE WHEN small THEN w ELSE w - 40 END AS w, CASE WHEN small THEN h ELSE h - 2 * m END AS h FROM (SELECT *, h - 2 * m < 20 OR w - 40 < 50 AS small FROM (SELECT p_partkey, p_size * 4 AS w, p_size * 2 AS h, floor(p_size * 2 * 0.24)::INT AS m FROM part))")
def H19_plate_box(t):
    return t.part.select("p_partkey", C.plate_box(F.col("p_size") * 4, F.col("p_size") * 2, F.lit(40)).alias("b")).select("p_partkey", "b.*")


@q(domain("SELECT v.id, CASE WHEN p.opaque_edge THEN floor(v.duration_seconds * p.custom_edge) WHEN v.id % 2 = 0 THEN 9 ELSE floor(v.duration_seconds * p.custom_edge) END::INT AS x, NOT p.opaque_edge AND v.id % 2 <> 0 AS no_right_edge, p.opaque_edge OR v.id % 2 <> 0 AS truncated FROM vods v JOIN streamers s ON s.id = v.streamer_id JOIN profiles p ON p.id = s.profile_id"))
def H20_right_edge(t):
    p = V.profile_for(t)
    rows = p.join(t.vods.select(F.col("id").alias("vod_id"), "duration_seconds"), "vod_id")
    edge = C.right_edge(F.col("duration_seconds"), F.col("custom_edge"), F.col("opaque_edge"), F.when(F.col("vod_id") % 2 == 0, F.lit(9)))
    return rows.select(F.col("vod_id").alias("id"), edge.alias("e")).select("id", "e.*")


@q("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size || 'p60' ELSE p_size || 'p' END AS label FROM part")
def H21_quality_label(t):
    return t.part.select("p_partkey", C.quality_label(F.concat(F.col("p_size").cast("string"), F.lit("p")), F.when(F.col("p_size") % 2 == 0, 60).otherwise(30)).alias("label"))


def _pad(x: int) -> str:
    return "unhex('" + bytes(b ^ x for b in b"a secret".ljust(64, b"\0")).hex() + "')"


@q(f"SELECT event_id, 'sha256=' || sha256({_pad(0x5C)} || unhex(sha256({_pad(0x36)} || encode(event_id || props)))) AS signature FROM events")
def H24_signature(t):
    return t.events.select("event_id", C.signature("a secret", F.concat(F.col("event_id").cast("string"), F.col("props"))).alias("signature"))


# --- I: changes and streams


NOTES = """hit AS (SELECT d.id AS detection_id, s.* FROM detections d JOIN subscriptions s ON s.username = d.username AND s.enabled)"""


@q(domain("SELECT detection_id, 'dm' AS kind, user_id AS target, user_id AS users FROM hit WHERE notify_type IN ('dm', 'both') UNION ALL SELECT detection_id, 'server', channel_id, string_agg(DISTINCT user_id, ' ' ORDER BY user_id) FROM hit JOIN channels USING (guild_id) WHERE notify_type IN ('server', 'both') GROUP BY detection_id, channel_id", NOTES))
def I1_notifications(t):
    return G.notifications(t.detections, t.subscriptions, t.channels)


@q(domain("SELECT username, user_id, count(*) AS n FROM hit GROUP BY ALL", NOTES))
def I2_notification_counts(t):
    return G.notification_counts(t.detections, t.subscriptions)


@q(domain("SELECT user_id, username, enabled, user_id::BIGINT % 7 + coalesce(n, 0) AS notification_count FROM subscriptions LEFT JOIN (SELECT username, user_id, count(*) AS n FROM hit GROUP BY ALL) USING (user_id, username)", NOTES))
def I2_stored_counts(t):
    """The counts that subscriptions hold, with a batch of detections added."""
    stored = t.subscriptions.select("user_id", "username", "enabled", (F.col("user_id").cast("long") % 7).alias("notification_count"))
    return G.count_notifications(stored, t.detections)


@q(domain("SELECT vod_id, status FROM ro WHERE vod_id % 3 = 0 AND status IS DISTINCT FROM CASE WHEN vod_id % 2 = 0 THEN 'pending' END", ROLLUP))
def I3_changed_rollups(t):
    before = t.vods.select(F.col("id").alias("vod_id"), F.when(F.col("id") % 2 == 0, "pending").alias("status"))
    return G.changed_rollups(before, before.filter("vod_id % 3 = 0"), t)


MOVED = "mv AS (SELECT id, vod_id, CASE WHEN id % 5 = 4 THEN NULL WHEN id % 5 < 3 AND status = 'pending' THEN 'queued' WHEN id % 5 < 3 AND status = 'queued' THEN 'processing' WHEN id % 5 < 3 AND status = 'processing' THEN 'completed' ELSE status END AS status FROM chunks)"


@q(domain("SELECT vod_id, chunks, pending, queued, processing, completed, failed, CASE WHEN chunks = 0 OR chunks = pending THEN 'pending' WHEN queued > 0 OR processing > 0 THEN 'processing' WHEN chunks = completed THEN 'completed' WHEN chunks = failed THEN 'failed' ELSE 'partial' END AS status FROM (SELECT vod_id, count(status) AS chunks, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM mv GROUP BY 1)", MOVED))
def I3_rollup_stream(t):
    """Counts stored of all chunks, then three batches in which chunks move on or go: the stored counts after them."""
    state, path, folder = (S.shared_dir(t.spark) for _ in range(3))
    R.start_rollups(t.chunks, state)
    row = F.struct("vod_id", "status")
    nxt = F.when(F.col("status") == "pending", "queued").when(F.col("status") == "queued", "processing").when(F.col("status") == "processing", "completed").otherwise(F.col("status"))
    changes = t.chunks.select(F.col("id"), row.alias("old"), F.when(F.col("id") % 5 != 4, F.struct("vod_id", nxt.alias("status"))).alias("new")).filter("id % 5 <> 3")
    changes.withColumn("b", F.col("id") % 3).write.partitionBy("b").parquet(path)
    for b in range(3):
        R.apply_batch(t.spark, state, t.spark.read.parquet(f"{path}/b={b}"), b)
    R.apply_batch(t.spark, state, t.spark.read.parquet(f"{path}/b=2"), 2)  # a batch that comes again changes nothing
    return R.stored_status(t.spark, state)


RECHUNK = "pl2 AS (SELECT pl.* FROM pl JOIN vods v ON v.id = pl.vod_id JOIN streamers s ON s.id = v.streamer_id WHERE s.processing_enabled {}), nx AS (SELECT p.vod_id, (coalesce(m, -1) + row_number() OVER (PARTITION BY p.vod_id ORDER BY segment, start_seconds))::INT AS chunk_index, start_seconds, end_seconds FROM pl2 p LEFT JOIN (SELECT vod_id, max(chunk_index) AS m FROM chunks GROUP BY 1) c ON c.vod_id = p.vod_id)"


@q(domain("SELECT * FROM nx", f"{SEGMENTS}, {GAPS}, {PIECES}, {RECHUNK.format('AND v.duration_seconds >= 600 AND v.id % 4 IN (0, 1)')}"))
def I4_rechunk_changed(t):
    row = F.struct("id", F.col("ready_for_processing").alias("ready"), "duration_seconds", "chapters")
    old = F.when(F.col("id") % 4 == 1, F.struct("id", F.col("ready_for_processing").alias("ready"), (F.col("duration_seconds") + 1).alias("duration_seconds"), "chapters")).when(F.col("id") % 4 > 1, row)
    changes = t.vods.select(F.when(F.col("id") % 4 == 0, "insert").otherwise("update").alias("op"), old.alias("old"), row.alias("new"))
    return G.rechunk(t, changes)


@q(domain("SELECT * FROM nx", f"{SEGMENTS}, {GAPS}, {PIECES}, {RECHUNK.format('AND v.ready_for_processing AND s.id % 3 = 0')}"))
def I5_chunk_enabled(t):
    return G.chunk_enabled(t, V.enabled(t).filter("streamer_id % 3 = 0"))


@q(domain("SELECT id, CASE WHEN vod_id % 6 = 0 THEN 'failed' ELSE status END AS status FROM chunks"))
def I6_fail_cascade(t):
    return G.fail_chunks(t.chunks, t.vods.filter("id % 6 = 0").select(F.col("id").alias("vod_id"))).select("id", "status")


@q(domain("SELECT c.id FROM chunks c WHERE status NOT IN ('pending', 'processing') OR EXISTS (SELECT 1 FROM vods v JOIN streamers s ON s.id = v.streamer_id WHERE v.id = c.vod_id AND v.ready_for_processing AND s.processing_enabled)"))
def I7_drop_work(t):
    return G.drop_work(t).select("id")


@q(f"WITH {FRAMES}, {THIN.format('fr')} SELECT chunk_id, ts FROM th")
def I8_debounce_stream(t):
    """Frames of five batches of files that overlap by days, in no order within, closed by a frame of no key."""
    path = S.shared_dir(t.spark)
    day = F.dayofmonth("ts") - F.pmod(F.xxhash64("event_id"), F.lit(5))  # a frame comes up to four days late
    seconds = F.timestamp_diff("SECOND", F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz"), F.col("ts"))
    frames = t.events.select(F.col("user_id").alias("chunk_id"), F.floor(seconds / 600).cast("long").alias("ts"), F.greatest(F.lit(0), F.least(F.lit(4), F.floor((day + 4) / 7))).cast("int").alias("b"))
    last = t.spark.range(1).select(F.lit(None).cast("long").alias("chunk_id"), F.lit(100_000).cast("long").alias("ts"))
    for b in range(5):  # five batches of two files each
        frames.filter(F.col("b") == b).drop("b").repartition(2, "chunk_id").write.mode("append").parquet(path)
    last.unionByName(last).repartition(2).write.mode("append").parquet(path)
    return S.drain(S.debounce(S.source(t.spark, path, files_per_batch=2), "chunk_id", "ts", late=10 * 144, unit=600))


def _commands(t) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ["processing", "pending", "completed", "failed", "archived"])), (F.col("event_id") % 5 + 1).cast("int"))
    chunk = (F.col("user_id") + 1) * 10 + 1 + F.col("user_id") % 7
    return t.events.select(F.col("event_id").alias("seq"), chunk.alias("id"), kind.alias("status"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("e"), "event_id")).alias("error"), F.col("ts").alias("at"))


CMD = "cm AS (SELECT event_id AS seq, (user_id + 1) * 10 + 1 + user_id % 7 AS id, (['processing', 'pending', 'completed', 'failed', 'archived'])[event_id % 5 + 1] AS status, CASE WHEN event_id % 3 = 0 THEN 'e' || event_id END AS error, ts AS tm FROM events), ok AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS back FROM cm WHERE status <> 'archived')"


@q(domain("SELECT l.id, l.status, s.started_at, CASE WHEN l.status IN ('completed', 'failed') THEN l.tm END AS completed_at, (c.attempt_count + a.n)::INT AS attempt_count, e.last_error FROM ok l JOIN chunks c ON c.id = l.id JOIN (SELECT id, count(*) FILTER (status IN ('pending', 'failed')) AS n FROM ok GROUP BY 1) a ON a.id = l.id JOIN (SELECT id, max_by(CASE WHEN status = 'processing' THEN {v: tm} ELSE {v: NULL::TIMESTAMP} END, seq)['v'] AS started_at FROM (SELECT * FROM ok WHERE status IN ('processing', 'pending') UNION ALL SELECT -1, id, 'pending', NULL, NULL, 0 FROM ok) GROUP BY 1) s ON s.id = l.id JOIN (SELECT id, max_by({v: CASE WHEN status IN ('pending', 'failed') THEN error END}, seq)['v'] AS last_error FROM (SELECT * FROM ok WHERE status IN ('processing', 'completed') OR error IS NOT NULL UNION ALL SELECT -1, id, 'completed', NULL, NULL, 0 FROM ok) GROUP BY 1) e ON e.id = l.id WHERE l.back = 1", CMD))
def I9_status_commands(t):
    return G.apply_status_commands(_commands(t), t.chunks)


@q(domain("SELECT seq, cm.id, cm.status <> 'archived' AND c.id IS NOT NULL AS success, CASE WHEN cm.status = 'archived' THEN 'Invalid status: archived. Must be one of: pending, processing, completed, failed' WHEN c.id IS NULL THEN 'Chunk with ID ' || cm.id || ' not found' END AS error FROM cm LEFT JOIN chunks c ON c.id = cm.id", CMD))
def I9_command_results(t):
    return G.command_results(_commands(t), t.chunks)


@q(domain("SELECT w.id, max_by(w.status, seq) AS status, max_by(tm, seq) FILTER (w.status = 'processing') AS started_at, max_by(tm, seq) FILTER (w.status = 'completed') AS completed_at, (CASE WHEN p.p IS NOT NULL THEN 1 + count(*) FILTER (w.status = 'pending' AND seq > p.p) ELSE c.attempt_count + count(*) FILTER (w.status = 'pending') END)::INT AS attempt_count, max_by(error, seq) FILTER (error IS NOT NULL) AS last_error FROM ok w JOIN chunks c ON c.id = w.id JOIN (SELECT id, max(seq) FILTER (status = 'processing') AS p FROM ok GROUP BY 1) p ON p.id = w.id GROUP BY w.id, p.p, c.attempt_count", CMD))
def I10_worker_commands(t):
    return G.apply_worker_commands(_commands(t).filter("status <> 'archived'"), t.chunks)


@q(domain("SELECT id AS chunk_id, w AS worker, tm + INTERVAL 30 MINUTE AS lease_expires_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tm, w) AS r FROM (SELECT c.id, e.event_id AS w, e.ts AS tm FROM events e JOIN chunks c ON c.id = (e.user_id + 1) * 10 + 1 + e.user_id % 7 AND c.status = 'pending')) WHERE r = 1"))
def I11_claims(t):
    claims = t.events.select(((F.col("user_id") + 1) * 10 + 1 + F.col("user_id") % 7).alias("chunk_id"), F.col("event_id").alias("worker"), F.col("ts").alias("at"))
    return G.claim(claims, t.chunks)


@q(f"{ORACLES['I11_claims'].replace('SELECT id AS chunk_id', 'SELECT * FROM (SELECT id AS chunk_id', 1)}) WHERE lease_expires_at < {EVENTS_NOW_SQL} - INTERVAL 20 DAY")
def I11_expired_leases(t):
    """Leases that have run out ten days after the first events."""
    return G.expired(I11_claims(t), datetime(2024, 1, 11))


@q(domain(f"SELECT id, CASE WHEN status = 'pending' AND vod_id % 9 = 0 THEN 'queued' ELSE status END AS status, CASE WHEN status = 'pending' AND vod_id % 9 = 0 THEN {NOW_SQL} END AS queued_at FROM chunks"))
def I13_queue(t):
    return G.queue(t.chunks, t.vods.filter("id % 9 = 0").select(F.col("id").alias("vod_id")), NOW).select("id", "status", "queued_at")


def _messages(t) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ["notification", "webhook_callback_verification", "revocation", "other"])), (F.col("event_id") % 4 + 1).cast("int"))
    event = F.when(F.col("event_type") == "view", "stream.offline").otherwise("stream.online")
    rows = t.events.select(F.when(F.col("event_id") % 11 != 0, F.col("event_id").cast("string")).alias("message_id"), F.col("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("sent"), F.col("ts").cast("timestamp").alias("received"), kind.alias("message_type"), F.to_json(F.struct(F.struct(event.alias("type")).alias("subscription"))).alias("body"))
    signed = C.signature("a secret", F.concat("message_id", "sent", "body"))
    return rows.withColumn("signature", F.when(F.col("event_id") % 7 == 0, F.lit("sha256=00")).otherwise(signed))


ROUTES = "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'missing_header' WHEN event_id % 7 = 0 THEN 'bad_signature' WHEN event_id % 4 = 1 THEN 'challenge' WHEN event_id % 4 = 2 THEN 'revoked' WHEN event_id % 4 = 0 AND event_type = 'view' THEN 'process' ELSE 'ignored' END AS route, CASE WHEN event_id % 11 = 0 THEN 400 WHEN event_id % 7 = 0 THEN 403 ELSE 200 END AS code FROM events"


@q(ROUTES)
def I14_webhook_router(t):
    return G.route(_messages(t), "a secret").select("event_id", "route", "code")


@q(domain("SELECT e.event_id, CASE WHEN s.id IS NULL THEN 'not_found' WHEN NOT s.processing_enabled THEN 'disabled' WHEN NOT EXISTS (SELECT 1 FROM vods v WHERE v.streamer_id = s.id AND v.chapters IS NOT NULL) THEN 'no_chapters' ELSE 'processed' END AS reason FROM (SELECT event_id, user_id * 20 AS k FROM events) e LEFT JOIN streamers s ON s.id = e.k"))
def I15_offline_events(t):
    ev = t.events.select("event_id", (F.col("user_id") * 20).alias("id"), F.lit("nobody").alias("login"))
    return G.classify_offline(ev, t)


def _toggles(t) -> DataFrame:
    where = F.element_at(F.array(*map(F.lit, ["dm", "server", "both"])), (F.col("event_id") % 3 + 1).cast("int"))
    return t.events.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("user_id"), F.lit("name").alias("username"), where.alias("notify_type"), F.when(F.col("event_id") % 4 != 0, (F.col("user_id") % 25).cast("string")).alias("guild_id"))


KNOWN_TOGGLES = "own AS (SELECT user_id, min(username) AS name FROM subscriptions GROUP BY 1), kt AS (SELECT * FROM (SELECT event_id AS seq, e.user_id::STRING AS user_id, CASE WHEN event_id % 11 = 0 THEN coalesce(own.name, 'name') ELSE 'name' END AS username, (['dm', 'server', 'both'])[event_id % 3 + 1] AS k, CASE WHEN event_id % 4 <> 0 THEN (e.user_id % 25)::STRING END AS g FROM events e LEFT JOIN own ON own.user_id = e.user_id::STRING) WHERE k = 'dm' OR g IN (SELECT guild_id FROM channels)), kn AS (SELECT kt.*, row_number() OVER (PARTITION BY kt.user_id, kt.username ORDER BY seq) + coalesce(s.enabled, false)::INT AS n FROM kt LEFT JOIN subscriptions s ON s.user_id = kt.user_id AND s.username = kt.username), kf AS (SELECT user_id, username, max(n) % 2 = 1 AS enabled, max_by({k: k, g: CASE WHEN k <> 'dm' THEN g END}, n) FILTER (n % 2 = 1) AS l FROM kn GROUP BY ALL)"


@q(domain("SELECT coalesce(f.user_id, s.user_id) AS user_id, coalesce(f.username, s.username) AS username, coalesce(f.enabled, s.enabled) AS enabled, CASE WHEN f.l IS NULL THEN s.notify_type ELSE f.l['k'] END AS notify_type, CASE WHEN f.l IS NULL THEN s.guild_id ELSE f.l['g'] END AS guild_id FROM kf f FULL JOIN subscriptions s ON s.user_id = f.user_id AND s.username = f.username", KNOWN_TOGGLES))
def I17_subscription_toggles(t):
    """Toggles of new pairs and of the subscriptions there are, all of which are carried through."""
    own = t.subscriptions.groupBy("user_id").agg(F.min("username").alias("own"))
    rows = _toggles(t).join(own, "user_id", "left").withColumn("username", F.when(F.col("seq") % 11 == 0, F.coalesce("own", "username")).otherwise(F.col("username"))).drop("own")
    return G.toggle_subscriptions(rows, t.subscriptions, t.channels)


@q("SELECT (user_id % 25)::STRING AS guild_id, c AS channel_id FROM (SELECT user_id % 25 AS user_id, max_by({v: CASE WHEN event_id % 5 <> 0 THEN 'c' || event_id END}, event_id).v AS c FROM events GROUP BY 1) WHERE c IS NOT NULL")
def I18_channel_commands(t):
    rows = t.events.select(F.col("event_id").alias("seq"), (F.col("user_id") % 25).cast("string").alias("guild_id"), F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("c"), "event_id")).alias("channel_id"))
    return G.set_channels(rows)


@q("SELECT w AS window_start, name, attr, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT time_bucket(INTERVAL 10 SECOND, ts) AS w, event_type AS name, user_id % 4 AS attr, value FROM events) WHERE w + INTERVAL 10 SECOND <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM events) GROUP BY ALL")
def I19_metric_windows(t):
    """Windows that the watermark has closed when the stream has read all there is."""
    ev = S.source(t.spark, f"{t.sf_dir}/events.parquet*")
    rows = S.drain(S.metric_windows(ev.select("ts", F.col("event_type").alias("name"), (F.col("user_id") % 4).alias("attr"), "value")))
    return rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("total", F.round("total", 6))


EDGES = [10.0, 25.0, 50.0, 75.0, 90.0]


@q("SELECT w AS window_start, name, attr, count(*) AS n, round(sum(value), 6) AS total, [" + ", ".join(f"count(*) FILTER (len(list_filter({EDGES}::DOUBLE[], lambda b: value > b)) = {i})" for i in range(len(EDGES) + 1)) + "] AS buckets FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, event_type AS name, user_id % 4 AS attr, value FROM events WHERE value IS NOT NULL) WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM events) GROUP BY ALL")
def I19_histogram_windows(t):
    """Bucket counts of the hours that the watermark has closed."""
    ev = S.source(t.spark, f"{t.sf_dir}/events.parquet*")
    rows = S.drain(S.histogram_windows(ev.select("ts", F.col("event_type").alias("name"), (F.col("user_id") % 4).alias("attr"), "value"), EDGES, "1 hour"))
    return rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("total", F.round("total", 6))


@q("SELECT seq, name, attr, round(CASE WHEN cum >= lag(cum) OVER w THEN cum - lag(cum) OVER w ELSE cum END, 6) AS delta FROM (SELECT event_id AS seq, event_type AS name, user_id % 4 AS attr, ts, sum(abs(value)) OVER (PARTITION BY event_type, user_id % 4, day(ts) ORDER BY ts, event_id) AS cum FROM events WHERE value IS NOT NULL) WINDOW w AS (PARTITION BY name, attr ORDER BY ts, seq)")
def I19_delta_sums(t):
    """Cumulative counters that start anew every day, in three batches of files that overlap by days, as what each grew by."""
    path = S.shared_dir(t.spark)
    points = t.events.filter("value IS NOT NULL").select(F.col("event_type").alias("name"), (F.col("user_id") % 4).alias("attr"), "ts", F.col("event_id").alias("seq"), F.abs("value").alias("v"), F.dayofmonth("ts").alias("day"))
    cum = A.gauge(points.withColumn("k", F.concat_ws("/", "name", "attr", "day")), "k", ["ts", "seq"], "v")
    cum = cum.select("name", "attr", "ts", "seq", "value", F.greatest(F.lit(0), F.least(F.lit(2), F.floor((F.col("day") - F.col("seq") % 4) / 10))).cast("int").alias("b"))
    closing = t.spark.range(1).select(F.lit(None).cast("string").alias("name"), F.lit(None).cast(cum.schema["attr"].dataType).alias("attr"), F.lit(datetime(2030, 1, 1)).cast(cum.schema["ts"].dataType).alias("ts"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("double").alias("value"))
    for b in range(3):
        cum.filter(F.col("b") == b).drop("b").coalesce(1).write.mode("append").parquet(path)
    closing.coalesce(1).write.mode("append").parquet(path)
    out = S.drain(S.delta_sums(S.source(t.spark, path, files_per_batch=1), "5 days"))
    return out.select("seq", "name", "attr", F.round("delta", 6).alias("delta"))


@q(ROUTES)
def I16_routed_stream(t):
    """Signed messages, written as a table and read as a stream, routed once each."""
    path = S.shared_dir(t.spark)
    _messages(t).write.parquet(path)
    return S.drain(S.routed(S.source(t.spark, path), "a secret", "40 days").select("event_id", "route", "code"))


@q(domain(f"SELECT id, CASE WHEN id % 3 = 0 THEN availability ELSE 'unavailable' END AS availability, CASE WHEN id % 3 <> 0 THEN {NOW_SQL} END AS unavailable_since, {NOW_SQL} AS last_check FROM vods WHERE id % 2 = 0"))
def I20_availability_sweep(t):
    return G.sweep(t.vods, t.vods.filter("id % 2 = 0"), t.vods.filter("id % 3 = 0"), NOW)


@q(domain("SELECT v.id AS vod_id, v.availability = 'available' AS success, CASE WHEN v.availability = 'available' THEN coalesce(c.n, 0) ELSE 0 END AS chunks_deleted, CASE WHEN v.availability = 'available' THEN coalesce(d.n, 0) ELSE 0 END AS detections_deleted, CASE WHEN v.availability = 'available' THEN coalesce(p.n, 0) ELSE 0 END AS chunks_created FROM vods v LEFT JOIN (SELECT vod_id, count(*) AS n FROM chunks GROUP BY 1) c ON c.vod_id = v.id LEFT JOIN (SELECT vod_id, count(*) AS n FROM detections GROUP BY 1) d ON d.vod_id = v.id LEFT JOIN (SELECT vod_id, count(*) AS n FROM pl GROUP BY 1) p ON p.vod_id = v.id WHERE v.id % 8 = 0", f"{SEGMENTS}, gp AS (SELECT vod_id, segment, segment_start, segment_end, segment_start AS gap_start, segment_end AS gap_end FROM sg), {PIECES}"))
def I22_force_reprocess(t):
    return G.reprocess(t, t.vods.filter("id % 8 = 0").select(F.col("id").alias("vod_id")))


# --- J: entry points


def page_sql(columns: str, min_conf: float, where: str, order: str, tail: str, total: bool) -> str:
    ctes = f"{search_cte(min_conf)}, qq AS (SELECT {tri(f"'{QUERY}'")} AS g), sc AS (SELECT ds.*, {sim(tri('username'), 'qq.g')} AS similarity_score FROM ds, qq), ft AS (SELECT * FROM sc WHERE {where})"
    return domain(f"SELECT {columns}{', (SELECT count(*) FROM ft) AS total_count' * total} FROM ft ORDER BY {order} {tail}", ctes)


RANKED = "similarity_score DESC, actual_timestamp DESC NULLS FIRST, detection_id"


@q(page_sql(f"{OUT}, similarity_score, truncated", 0.7, "similarity_score::DOUBLE >= 0.2", RANKED, "LIMIT 100 OFFSET 10", True))
def J1_fuzzy_search(t):
    return J.fuzzy_search(t, NOW, QUERY, threshold=0.2, limit=100, offset=10)


@q(page_sql(f"{OUT}, similarity_score, truncated", 0.0, f"similarity_score::DOUBLE >= 0.3 AND actual_timestamp >= {NOW_SQL} - INTERVAL 365 DAY", RANKED, "LIMIT 50", False))
def J2_fuzzy_search_debug(t):
    return J.fuzzy_search_debug(t, NOW, QUERY, kind="year", threshold=0.3, limit=50)


@q(page_sql(f"{OUT}, similarity_score, truncated", 0.7, "similarity_score::DOUBLE >= 0.4 AND streamer_id % 1 = 0", RANKED, "LIMIT 100", True))
def J3_fuzzy_search_test(t):
    return J.fuzzy_search(t, NOW, QUERY, threshold=0.4)


@q(page_sql(f"{OUT}, similarity_score", 0.7, "similarity_score::DOUBLE >= 0.2", RANKED, "LIMIT 100", False))
def J4_fuzzy_search_first(t):
    return J.fuzzy_search_first(t, NOW, QUERY)


@q(domain(f"SELECT {OUT}, 1.0::FLOAT AS similarity_score FROM ds ORDER BY actual_timestamp DESC NULLS FIRST, detection_id LIMIT 100", search_cte()))
def J4_without_a_query(t):
    return J.fuzzy_search_first(t, NOW)


@q(domain("SELECT streamer_id, streamer_login, streamer_display_name, streamer_avatar, total_detections, total_vods, detection_id, username, frame_time_seconds, confidence, rank, vod_id, vod_source_id, vod_url, actual_timestamp, r AS detection_row_num, truncated FROM (SELECT ds.*, tp.total_detections, tp.total_vods, row_number() OVER (PARTITION BY ds.streamer_id ORDER BY actual_timestamp DESC NULLS FIRST, detection_id) AS r FROM ds JOIN tp USING (streamer_id)) WHERE r <= 3", search_cte() + ", tp AS (SELECT streamer_id, count(*) AS total_detections, count(DISTINCT vod_id) AS total_vods FROM ds GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)"))
def J5_top_streamers(t):
    return J.top_streamers(t)


@q(domain("SELECT to_json({streamers: count(DISTINCT streamer_id), vods: count(DISTINCT vod_id), detections: count(*)})::STRING AS stats FROM ds", search_cte()))
def J6_global_stats(t):
    return J.global_stats_json(t)


@q(domain("SELECT c.id AS chunk_id, c.vod_id, v.source_id, c.chunk_index, c.start_seconds, c.end_seconds, c.status, c.attempt_count FROM chunks c JOIN vods v ON v.id = c.vod_id WHERE v.id = 9 AND c.status = 'pending' AND v.availability = 'available' AND v.ready_for_processing AND EXISTS (SELECT 1 FROM streamers s WHERE s.id = v.streamer_id AND s.processing_enabled)"))
def J7_pending_chunks(t):
    return J.pending_chunks(t, vod_id=9, source_id="9")


@q(domain("SELECT count(*) AS total_vods, sum(pending_chunks)::BIGINT AS total_pending_chunks, count(*) AS ready_vods FROM pe", PENDING))
def J8_pending_vods_count(t):
    return A.pending_vods_count(t)


ACTIVE = "(SELECT count(*) FROM chunks WHERE status IN ('queued', 'processing'))"


@q(domain(f"SELECT vod_id, source_id, pending_chunks FROM pe WHERE {ACTIVE} < 10000000 ORDER BY mac, published_at DESC NULLS FIRST, vod_id LIMIT 5", PENDING))
def J9_process_pending(t):
    return G.admitted(t, 10_000_000, 10, 5, by_attempts=True)


@q(domain("SELECT vod_id, source_id, pending_chunks FROM pe WHERE vod_id IN (SELECT vod_id FROM ro WHERE status = 'pending') ORDER BY published_at NULLS LAST, vod_id LIMIT 1", f"{PENDING}, {ROLLUP}"))
def J10_auto_queue(t):
    return G.admitted(t, None)


@q(ORACLES["J10_auto_queue"].replace("SELECT vod_id, source_id", "SELECT true AS switch, vod_id, source_id", 1))
def J10_auto_queue_switch(t):
    """The next recording with the switch on and off; off gives none."""
    return I.union_pages(*(G.admitted(t, None, switched_on=on).select(F.lit(on).alias("switch"), "*") for on in (True, False)))


@q(domain("SELECT * FROM pl", f"{SEGMENTS}, {GAPS}, {PIECES}"))
def J11_simulate_plan(t):
    return I.simulate_chunk_plan(t)


#: A name with several detections, one of them of a recording without a date.
NAME = "bluering40"


def command_sql(threshold: float, limit: int, select: str) -> str:
    ctes = f"""{search_cte()}, qq AS (SELECT {tri(f"'{NAME}'")} AS g), sc AS (SELECT ds.*, {sim(tri('username'), 'qq.g')} AS similarity_score FROM ds, qq),
ln AS (SELECT detection_id, row_number() OVER (ORDER BY {RANKED})::INT AS position, '**' || streamer_display_name || '** - <t:' || coalesce(epoch(actual_timestamp)::BIGINT, 0) || ':f> - [Watch]({URL}' || vod_source_id || '?t=' || frame_time_seconds // 3600 || 'h' || frame_time_seconds % 3600 // 60 || 'm' || frame_time_seconds % 60 || 's)' AS line FROM sc WHERE similarity_score::DOUBLE >= {threshold} ORDER BY position LIMIT {limit})"""
    return domain(select, ctes)


@q(command_sql(1.0, 10, "SELECT * FROM ln"))
def J13_search_command(t):
    return J.search_command(t, NOW, NAME, exact=True, count="all")


@q(command_sql(0.2, 1, f"SELECT CASE WHEN count(*) = 0 THEN 'No results found for **{NAME}**' ELSE '**Latest result for \"{NAME}\":**' || chr(10) || string_agg(line, chr(10) ORDER BY position) END AS content FROM ln"))
def J13_search_message(t):
    return J.search_message(t, NOW, NAME)


@q(domain("SELECT user_id, username FROM subscriptions WHERE enabled"))
def J14_list_subscriptions(t):
    return t.subscriptions.filter("enabled").select("user_id", "username").orderBy("user_id")


@q(domain("SELECT el.id AS vod_id, el.source_id, string_agg(c.id::STRING, ',' ORDER BY c.chunk_index) AS chunk_ids, el.published_at <= TIMESTAMP '1998-01-01' AS old_templates, first(to_json({profile_id: p.id, profile_name: p.profile_name})::STRING) AS profile FROM el JOIN chunks c ON c.vod_id = el.id AND c.status = 'pending' LEFT JOIN streamers s ON s.id = el.streamer_id LEFT JOIN profiles p ON p.id = s.profile_id GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY el.id, el.source_id, el.published_at"), ELIGIBLE))
def J15_dispatch_plan(t):
    return J.dispatch_plan(t, datetime(1998, 1, 1))


@q(domain("SELECT id, chunk_index, start_seconds, end_seconds FROM chunks WHERE vod_id = 43 AND status = 'queued'"))
def J16_queued_chunks(t):
    return J.queued_chunks(t, 43)


@q(domain("SELECT id FROM streamers WHERE processing_enabled AND (has_vods OR id % 41 = 40 OR has_vods IS NULL) AND id % 41 >= 12 ORDER BY id % 41 DESC, id LIMIT 10"))
def J17_stale_batch(t):
    rows = V.stale_streamers(_dated_streamers(t), NOW, C.as_interval(F.lit("12 hours")))
    return rows.orderBy("updated_at", "id").limit(10).select("id")


CATALOGUE = FEED + """, mm AS (SELECT fd.id, fd.length_seconds, mk.i, floor(mk.i * 600500 / 1000)::INT AS s, coalesce(floor(lead(mk.i * 600500) OVER (PARTITION BY fd.id ORDER BY mk.i) / 1000)::INT, fd.length_seconds) AS e, f FROM fd JOIN mk ON mk.k = fd.k),
ch AS (SELECT id, flatten(list([s, e] ORDER BY s, e)) AS a FROM mm WHERE f = 'R' GROUP BY id),
up AS (SELECT fd.id, fd.title, fd.length_seconds, CASE WHEN ch.a IS NOT NULL THEN ch.a WHEN fd.game = 'Game R' THEN [0, fd.length_seconds] END AS a FROM fd LEFT JOIN ch USING (id))"""


@q(domain("SELECT v.source_id, CASE WHEN up.a IS NOT NULL THEN up.length_seconds ELSE v.duration_seconds END AS duration_seconds, array_to_string(CASE WHEN up.a IS NOT NULL THEN up.a ELSE v.chapters END, ',') AS chapters FROM vods v LEFT JOIN up ON up.id = v.source_id", CATALOGUE))
def J18_catalogue_refresh(t):
    out = J.refresh_catalogue(_feed(t), t.vods.select("source_id", "title", "duration_seconds", "chapters"), "none", "game r")
    return out.select("source_id", "duration_seconds", F.array_join(F.transform("chapters", lambda x: x.cast("string")), ",").alias("chapters"))


@q(domain("SELECT o_custkey AS id, p AS page, true AS processing_enabled FROM (SELECT o_custkey, min(o_orderkey // 100)::BIGINT AS p FROM orders GROUP BY 1) WHERE o_custkey NOT IN (SELECT id FROM streamers WHERE id % 3 <> 0)"))
def J19_discovery(t):
    videos = t.orders.select(F.col("o_custkey").alias("streamer_id"), F.floor(F.col("o_orderkey") / 100).alias("page"), F.col("o_orderkey").alias("video_id"))
    return J.discover(videos, t.streamers.filter("id % 3 <> 0"))


@q(f"WITH {FRAMES}, rk AS (SELECT frame_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY s DESC, p) AS r FROM (SELECT frame_id, rank, p, (frame_id * 37 + p * 53) % 100 AS s FROM (SELECT frame_id, unnest({list(A.RANKS)}) AS rank, unnest(range(5)) AS p FROM fr))) WHERE r = 1 AND s >= 95), hit AS (SELECT fr.*, rank FROM fr JOIN rk USING (frame_id)), {THIN.format('hit')}, one AS (SELECT h.*, row_number() OVER (PARTITION BY h.chunk_id, h.ts ORDER BY frame_id) AS r FROM hit h JOIN th ON th.chunk_id = h.chunk_id AND th.ts = h.ts) SELECT one.chunk_id, one.ts AS frame_time_seconds, event_type || '_' || user_id AS username, 0.9 AS confidence, rank FROM one JOIN events ON event_id = frame_id WHERE r = 1 AND length(event_type || user_id) >= 3")
def J20_frames_to_detections(t):
    frames = _frames(t)
    ranks = frames.select("frame_id", F.posexplode(F.array(*map(F.lit, A.RANKS))).alias("position", "rank")).withColumn("score", (F.col("frame_id") * 37 + F.col("position") * 53) % 100)
    texts = t.events.select(F.col("event_id").alias("frame_id"), F.lit(0).alias("idx"), F.concat("event_type", F.lit("_ "), "user_id").alias("text"), F.lit(0.9).alias("score"))
    return J.frames_to_detections(frames, ranks, texts, threshold=95)


# --- K: vectors


TEMPLATES = "tp AS (SELECT label, list(x ORDER BY i) AS t FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i) GROUP BY label), ce AS (SELECT vec_id, tp.label, list_transform(embedding, lambda x: x::DOUBLE - list_avg(list_transform(embedding, lambda y: y::DOUBLE))) AS a, list_transform(t, lambda x: x - list_avg(t)) AS b FROM embeddings, tp), sc AS (SELECT vec_id, label, list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)) AS score FROM ce)"


@q(f"WITH {TEMPLATES} SELECT vec_id, round(score, 6) AS score FROM sc WHERE label = 0")
def K1_correlation(t):
    e = t.embeddings
    tp = K.mean_template(e, "label", "embedding").filter("label = 0").select(F.col("template").alias("t"))
    rows = e.crossJoin(F.broadcast(tp))  # one row
    return rows.select("vec_id", F.round(K.correlation(F.col("embedding"), F.col("t")), 6).alias("score"))


@q("SELECT e.vec_id, round(1 - least(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: pow(e.embedding[i]::DOUBLE - z.embedding[i]::DOUBLE, 2))) / (len(e.embedding) * 4.0), 1.0), 6) AS confidence FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) z")
def K2_difference_confidence(t):
    z = t.embeddings.filter("vec_id = 0").select(F.col("embedding").alias("z"))
    return t.embeddings.crossJoin(F.broadcast(z)).select("vec_id", F.round(K.difference_confidence(F.col("embedding"), F.col("z"), 2.0), 6).alias("confidence"))  # one row


@q(f"WITH {TEMPLATES} SELECT vec_id, CASE WHEN score >= 0.5 THEN label END AS label, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS r FROM sc) WHERE r = 1")
def K3_classify(t):
    tp = K.mean_template(t.embeddings, "label", "embedding")
    return K.classify(t.embeddings, tp, "vec_id", "embedding", "label", 0.5).withColumn("score", F.round("score", 6))


# --- parts of the above on their own


@q(domain("SELECT status, label, count(*) AS n FROM chunks JOIN (VALUES ('pending', 'open'), ('queued', 'open'), ('failed', 'shut')) l(s, label) ON s = status GROUP BY ALL"))
def A2_inline_values(t):
    words = T.values(t.spark, [("pending", "open"), ("queued", "open"), ("failed", "shut")], "status string, label string")
    return t.chunks.join(F.broadcast(words), "status").groupBy("status", "label").agg(F.count(F.lit(1)).alias("n"))  # three rows


@q(domain("SELECT id, vod_id FROM chunks ORDER BY id LIMIT 1000"))
def A12_row_cap(t):
    return T.cap_rows(t.chunks.select("id", "vod_id").orderBy("id"))


@q(domain("SELECT s.id AS streamer_id, count(*) AS n FROM detections d JOIN vods v ON v.id = d.vod_id JOIN streamers s ON s.id = v.streamer_id GROUP BY 1"))
def C1_inner_chain(t):
    v, s = t.vods.select(F.col("id").alias("vod_id"), "streamer_id"), t.streamers.select(F.col("id").alias("streamer_id"))
    return t.detections.join(v, "vod_id").join(s, "streamer_id").groupBy("streamer_id").agg(F.count(F.lit(1)).alias("n"))


@q(domain("SELECT s.id AS streamer_id, count(d.id) AS detections, count(DISTINCT v.id) AS vods FROM streamers s LEFT JOIN vods v ON v.streamer_id = s.id LEFT JOIN detections d ON d.vod_id = v.id GROUP BY 1"))
def C2_left_chain(t):
    v, d = t.vods.select(F.col("id").alias("vod_id"), "streamer_id"), t.detections.select("vod_id", F.col("id").alias("d"))
    rows = t.streamers.select(F.col("id").alias("streamer_id")).join(v, "streamer_id", "left").join(d, "vod_id", "left")
    return rows.groupBy("streamer_id").agg(F.count("d").alias("detections"), F.countDistinct("vod_id").alias("vods"))


LATERAL = "SELECT v.id, c.n, f.first FROM {vods} v LEFT JOIN LATERAL (SELECT count(*) AS n FROM {chunks} c WHERE c.vod_id = v.id) c ON true LEFT JOIN LATERAL (SELECT min(d.frame_time_seconds) AS first FROM {detections} d WHERE d.vod_id = v.id) f ON true"


@q(domain(LATERAL.format(vods="vods", chunks="chunks", detections="detections")))
def C3_lateral(t):
    return t.spark.sql(LATERAL, vods=t.vods, chunks=t.chunks, detections=t.detections)


@q(domain("SELECT id FROM vods v WHERE EXISTS (SELECT 1 FROM chunks c WHERE c.vod_id = v.id AND c.status = 'pending')"))
def C4_exists(t):
    return t.vods.join(t.chunks.filter("status = 'pending'").select(F.col("vod_id").alias("id")), "id", "left_semi").select("id")


@q(domain("SELECT id FROM chunks WHERE vod_id IN (SELECT id FROM vods WHERE streamer_id IN (SELECT id FROM streamers WHERE NOT processing_enabled))"))
def C6_in_subquery(t):
    off = t.streamers.filter("NOT processing_enabled").select(F.col("id").alias("streamer_id"))
    v = t.vods.join(off, "streamer_id", "left_semi").select(F.col("id").alias("vod_id"))
    return t.chunks.join(v, "vod_id", "left_semi").select("id")


@q(ORACLES["I1_notifications"])
def C11_stream_enrichment(t):
    """I1 over detections that arrive as files, a batch at a time, joined to the tables as they stand."""
    path = S.shared_dir(t.spark)
    t.detections.select("id", "username").write.parquet(path)
    return S.notify(S.source(t.spark, path), t.subscriptions, t.channels)


@q(domain("SELECT v.streamer_id, count(DISTINCT v.id) FILTER (ro.status = 'completed') AS completed, count(DISTINCT v.id) FILTER (ro.status <> 'completed') AS other FROM vods v JOIN ro ON ro.vod_id = v.id GROUP BY 1", ROLLUP))
def D3_distinct_conditional_counts(t):
    rows = t.vods.select(F.col("id").alias("vod_id"), "streamer_id").join(A.rollup_status(t), "vod_id")
    done = F.col("status") == "completed"
    return rows.groupBy("streamer_id").agg(F.countDistinct(F.when(done, F.col("vod_id"))).alias("completed"), F.countDistinct(F.when(~done, F.col("vod_id"))).alias("other"))


@q(domain("SELECT vod_id, round(avg(confidence), 9) AS mean, max(frame_time_seconds) AS latest, min(frame_time_seconds) AS earliest FROM detections GROUP BY 1"))
def D4_avg_max_min(t):
    return t.detections.groupBy("vod_id").agg(F.round(F.avg("confidence"), 9).alias("mean"), F.max("frame_time_seconds").alias("latest"), F.min("frame_time_seconds").alias("earliest"))


@q(domain("SELECT vod_id, CASE WHEN q > 0 THEN round(n::DECIMAL(18, 6) / q, 2)::DOUBLE ELSE 0 END AS each FROM (SELECT vod_id, count(*) AS n, count(quality) AS q FROM chunks GROUP BY 1)"))
def D5_safe_ratio(t):
    rows = t.chunks.groupBy("vod_id").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("q"))
    return rows.select("vod_id", C.ratio(F.col("n"), F.col("q")).cast("double").alias("each"))


@q(domain("SELECT vod_id, CASE WHEN count(DISTINCT quality) = 1 AND count(quality) = count(*) THEN max(quality) END AS quality FROM chunks GROUP BY 1"))
def D9_singleton_collapse(t):
    return t.chunks.groupBy("vod_id").agg(A.only_value("quality").alias("quality"))


@q(domain("SELECT guild_id, string_agg('<@' || user_id || '>', ' ' ORDER BY user_id) AS mentions FROM (SELECT DISTINCT guild_id, user_id FROM subscriptions WHERE enabled) GROUP BY 1"))
def D14_grouped_list(t):
    users = F.sort_array(F.collect_set("user_id"))
    return t.subscriptions.filter("enabled").groupBy("guild_id").agg(F.array_join(F.transform(users, lambda u: F.concat(F.lit("<@"), u, F.lit(">"))), " ").alias("mentions"))


@q(domain("SELECT id, (SELECT count(*) FROM vods WHERE availability = 'available') AS total_count FROM vods WHERE availability = 'available' ORDER BY id LIMIT 20 OFFSET 5"))
def E2_total_over_page(t):
    rows = t.vods.filter("availability = 'available'").select("id")
    return A.with_total(rows.orderBy("id").offset(5).limit(20), rows)


@q(domain("SELECT vod_id, b AS hole_start, start_seconds AS hole_end FROM (SELECT vod_id, start_seconds, coalesce(max(end_seconds) OVER (PARTITION BY vod_id ORDER BY start_seconds, end_seconds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM chunks) WHERE start_seconds > b"))
def E5_gap_scan(t):
    return I.holes(t.chunks, "vod_id", "start_seconds", "end_seconds")


@q(domain("SELECT streamer_id, count(*) AS n FROM ds GROUP BY 1 ORDER BY n DESC, streamer_id LIMIT 10", search_cte()))
def F2_top_groups(t):
    return V.detection_search(t).groupBy("streamer_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "streamer_id").limit(10)


@q(domain("SELECT id, chunk_index FROM chunks"))
def F6_by_index(t):
    return t.chunks.select("id", "chunk_index").orderBy("chunk_index", "id")


@q("SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0")
def G9_page_union(t):
    return I.union_pages(t.orders.filter("o_orderkey % 2 = 0").select("o_orderkey"), t.orders.filter("o_orderkey % 3 = 0").select("o_orderkey"))


@q(f"SELECT p_partkey FROM part WHERE {sim(tri('p_name'), tri('p_type'))}::DOUBLE >= 0.05")
def H2_similar(t):
    return t.part.filter(C.similar(C.similarity(F.col("p_name"), F.col("p_type")), 0.05)).select("p_partkey")


@q(domain(f"SELECT id, published_at + to_seconds(duration_seconds) AS ends, '{URL}' || source_id || '?t=' || duration_seconds || 's' AS url FROM vods"))
def H3_H4_time_and_url(t):
    return t.vods.select("id", C.plus_seconds(F.col("published_at"), F.col("duration_seconds")).alias("ends"), C.watch_url(F.col("source_id"), F.col("duration_seconds")).alias("url"))


@q("SELECT o_orderkey, greatest(a, b) AS g, least(a, b) AS l, a % 7 AS m, a // 7 AS d, ceil(a / 7.0)::BIGINT AS c, coalesce(nullif(a % 3, 0), -1) AS z, len([a, b]) AS n FROM (SELECT o_orderkey, o_orderkey AS a, o_custkey AS b FROM orders)")
def H10_arithmetic(t):
    a, b = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select("o_orderkey", F.greatest(a, b).alias("g"), F.least(a, b).alias("l"), (a % 7).alias("m"), F.expr("o_orderkey div 7").alias("d"), F.ceil(a / 7).alias("c"), F.coalesce(F.nullif(a % 3, F.lit(0)), F.lit(-1)).alias("z"), F.size(F.array(a, b)).cast("long").alias("n"))


@q("SELECT event_id, (props::JSON->>'k')::BIGINT AS k, to_json({id: event_id, kind: event_type})::STRING AS doc, 'event ' || event_id || ' is ' || event_type AS text FROM events")
def H14_json_and_format(t):
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("doc"), F.format_string("event %d is %s", "event_id", "event_type").alias("text"))


@q("SELECT c_custkey, TRY_CAST(x AS INT) AS i, coalesce(TRY_CAST(x AS INT), 1) AS one, CASE WHEN x = 'all' THEN 10 ELSE coalesce(TRY_CAST(x AS INT), 1) END AS n FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'none' ELSE c_custkey::STRING END AS x FROM customer)")
def H17_config_cast(t):
    x = F.when(F.col("c_custkey") % 3 == 0, "all").when(F.col("c_custkey") % 3 == 1, "none").otherwise(F.col("c_custkey").cast("string"))
    return t.customer.select("c_custkey", C.as_int(x).alias("i"), C.as_int(x, 1).alias("one"), C.result_count(x).alias("n"))


@q(domain("SELECT user_id, CASE notify_type WHEN 'dm' THEN 'direct message' WHEN 'server' THEN 'server channel' ELSE 'direct message and server channel' END AS label, '**' || username || '** - <t:' || user_id || ':f> - [Watch](u)' AS line FROM subscriptions"))
def H23_H26_text_lines(t):
    return t.subscriptions.select("user_id", C.notify_label(F.col("notify_type")).alias("label"), C.result_line(F.col("username"), F.col("user_id").cast("long"), F.lit("u")).alias("line"))


@q(domain(f"SELECT vod_id, source_id, pending_chunks FROM pe WHERE {ACTIVE} < 50 ORDER BY mac, published_at DESC NULLS FIRST, vod_id LIMIT 5", PENDING))
def I12_admission_full(t):
    """At capacity nothing is taken."""
    return G.admitted(t, 50, 10, 5, by_attempts=True)


@q(domain(f"SELECT vod_id, source_id, pending_chunks, {ACTIVE} AS active FROM pe ORDER BY mac, published_at DESC NULLS FIRST, vod_id LIMIT 5", PENDING))
def I12_admission_near_the_limit(t):
    """One chunk below the limit, whole recordings are taken, past it; at the limit none is."""
    active = t.chunks.filter("status IN ('queued', 'processing')").count()
    taken = [G.admitted(t, active + more, 10, 5, by_attempts=True) for more in (1, 0)]
    return I.union_pages(*taken).withColumn("active", F.lit(active).cast("long"))


@q(domain(f"SELECT id, CASE WHEN id % 5 = 0 THEN 'changed' ELSE title END AS title, CASE WHEN id % 5 = 0 THEN {NOW_SQL} ELSE published_at END AS updated_at FROM vods"))
def I21_updated_at(t):
    base = t.vods.select("id", "title", F.col("published_at").alias("updated_at"))
    return T.stamped(base, base.filter("id % 5 = 0").select("id", F.lit("changed").alias("title")), ["id"], ["title"], NOW)


@q(domain("""SELECT v.request_id, v.vod_id, v.error IS NULL AS success, CASE WHEN v.error IS NULL THEN to_json({success: true, vod_id: v.vod_id, deleted_chunks: coalesce(c.n, 0), deleted_detections: coalesce(d.n, 0), created_chunks: coalesce(p.n, 0), message: 'Force-processed VOD ' || v.vod_id || ': deleted ' || coalesce(c.n, 0) || ' chunks/' || coalesce(d.n, 0) || ' detections, created ' || coalesce(p.n, 0) || ' new chunks'})::VARCHAR ELSE to_json({success: false, error: v.error, vod_id: v.vod_id})::VARCHAR END AS answer
FROM an v LEFT JOIN (SELECT vod_id, count(*) AS n FROM chunks GROUP BY 1) c ON c.vod_id = v.vod_id LEFT JOIN (SELECT vod_id, count(*) AS n FROM detections GROUP BY 1) d ON d.vod_id = v.vod_id LEFT JOIN (SELECT vod_id, count(*) AS n FROM pl GROUP BY 1) p ON p.vod_id = v.vod_id""", f"""{SEGMENTS}, gp AS (SELECT vod_id, segment, segment_start, segment_end, segment_start AS gap_start, segment_end AS gap_end FROM sg), {PIECES},
rq AS (SELECT id AS request_id, CASE WHEN id % 5 IN (1, 2) THEN id WHEN id % 5 = 3 THEN -id END AS vod_id, CASE WHEN id % 5 = 4 THEN source_id WHEN id % 5 = 2 AND id % 2 = 0 THEN 'none' WHEN id % 5 = 0 AND id % 2 = 0 THEN 'x' || source_id END AS source_id FROM vods WHERE id % 6 = 0),
an AS (SELECT request_id, vod_id, CASE WHEN asked IS NULL AND q.source_id IS NULL THEN 'Must provide either p_vod_id or p_source_id' WHEN vod_id IS NULL THEN 'VOD not found with source_id: ' || q.source_id WHEN v.id IS NULL THEN 'VOD not found with id: ' || vod_id WHEN v.availability <> 'available' THEN 'VOD ' || vod_id || ' is not available (status: ' || v.availability || ')' END AS error
  FROM (SELECT rq.request_id, rq.vod_id AS asked, rq.source_id, coalesce(rq.vod_id, w.id) AS vod_id FROM rq LEFT JOIN vods w ON w.source_id = rq.source_id) q LEFT JOIN vods v ON v.id = q.vod_id)"""))
def J12_force_process(t):
    """Requests by id, by source id, by both, by neither; of recordings that are there, unknown or not available."""
    k = F.col("id") % 5
    source = F.when(k == 4, F.col("source_id")).when((k == 2) & (F.col("id") % 2 == 0), "none").when((k == 0) & (F.col("id") % 2 == 0), F.concat(F.lit("x"), "source_id"))
    requests = t.vods.filter("id % 6 = 0").select(F.col("id").alias("request_id"), F.when(k.isin(1, 2), F.col("id")).when(k == 3, -F.col("id")).alias("vod_id"), source.alias("source_id"))
    return J.force_process(t, requests)


# --- the plainest functions, each by itself


@q(domain(f"SELECT id, published_at FROM vods ORDER BY published_at DESC NULLS FIRST, id LIMIT 20 OFFSET 40"))
def F1_ranked_page(t):
    return t.vods.select("id", "published_at").orderBy(F.desc_nulls_first("published_at"), "id").offset(40).limit(20)


@q(domain("SELECT streamer_id, n, r FROM (SELECT streamer_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, streamer_id)::INT AS r FROM vods GROUP BY 1) ORDER BY r LIMIT 50"))
def F5_final_order(t):
    """The largest groups in order; r is a row's place in the ordered output."""
    top = t.vods.groupBy("streamer_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "streamer_id").limit(50)
    return top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "streamer_id")))  # fifty rows


@q("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN a * 3600 + b * 60 + c WHEN 1 THEN b * 60 WHEN 2 THEN 0 END::BIGINT AS seconds FROM (SELECT o_orderkey, o_custkey % 30 AS a, o_orderkey % 60 AS b, o_custkey % 60 AS c FROM orders)")
def H6_parse_hms(t):
    a, b, c = F.col("o_custkey") % 30, F.col("o_orderkey") % 60, F.col("o_custkey") % 60
    text = F.when(F.col("o_orderkey") % 4 == 0, F.format_string("%dh%dm%ds", a, b, c)).when(F.col("o_orderkey") % 4 == 1, F.format_string("about %dm", b)).when(F.col("o_orderkey") % 4 == 2, "no time")
    return t.orders.select("o_orderkey", C.parse_hms(text).alias("seconds"))


@q(domain("SELECT d.id, epoch(v.published_at + to_seconds(d.frame_time_seconds))::BIGINT AS at FROM detections d JOIN vods v ON v.id = d.vod_id"))
def H7_epoch_seconds(t):
    v = t.vods.select(F.col("id").alias("vod_id"), "published_at")
    return t.detections.join(v, "vod_id").select("id", C.epoch_seconds(C.plus_seconds(F.col("published_at"), F.col("frame_time_seconds"))).alias("at"))


@q("SELECT p_partkey, lower(p_name) AS low, contains(lower(p_type), 'steel') AS steel FROM part")
def H9_lower_contains(t):
    return t.part.select("p_partkey", F.lower("p_name").alias("low"), F.contains(F.lower("p_type"), F.lit("steel")).alias("steel"))


@q(domain("SELECT id, coalesce(quality, status) AS c, nullif(status, 'pending') AS n, CASE WHEN quality IS NULL THEN 'none' WHEN quality = '480p' THEN 'high' ELSE 'low' END AS k FROM chunks"))
def H11_null_handling(t):
    q_ = F.col("quality")
    return t.chunks.select("id", F.coalesce(q_, "status").alias("c"), F.nullif(F.col("status"), F.lit("pending")).alias("n"), F.when(q_.isNull(), "none").when(q_ == "480p", "high").otherwise("low").alias("k"))


@q("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, ((round(l_extendedprice * 100)::BIGINT * 2 + 8) // 16) / 100.0::DOUBLE AS r FROM lineitem")
def H12_round_half_away(t):
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.round(price / F.lit(8).cast("decimal(18,0)"), 2).cast("double").alias("r"))


@q(domain("SELECT id, len(chapters) AS n, chapters[1] AS first, chapters[len(chapters)] AS last, chapters[9] AS beyond, [id, duration_seconds] AS built FROM vods"))
def H13_arrays(t):
    c = F.col("chapters")
    n = F.when(c.isNotNull(), F.size(c)).cast("long")
    return t.vods.select("id", n.alias("n"), F.get(c, F.lit(0)).alias("first"), F.get(c, (n - 1).cast("int")).alias("last"), F.get(c, F.lit(8)).alias("beyond"), F.array("id", F.col("duration_seconds").cast("long")).alias("built"))


@q("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN (props::JSON->>'k')::BIGINT END AS k FROM events")
def H15_json_parse(t):
    """A body that is no JSON gives nulls."""
    body = F.when(F.col("event_id") % 5 == 0, F.lit("{broken")).otherwise(F.col("props"))
    return t.events.select("event_id", F.from_json(body, "k bigint")["k"].alias("k"))


@q(domain("SELECT id, 'chunk ' || id || ' of ' || vod_id || ' is ' || status AS text FROM chunks"))
def H16_format(t):
    return t.chunks.select("id", F.format_string("chunk %d of %d is %s", "id", "vod_id", "status").alias("text"))


@q(domain(f"SELECT count(*) AS rows, count(*) AS ids, count(*) AS well_formed, {NOW_SQL} AS now FROM chunks"))
def H22_default_ids_and_clock(t):
    """A new id for each chunk: all different, all version 4; the clock is given."""
    rows = t.chunks.select(F.uuid().alias("u"))
    good = F.col("u").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("u").alias("ids"), F.count_if(good).alias("well_formed")).withColumn("now", F.lit(NOW).cast("timestamp_ntz"))


@q("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 10 WHEN 1 THEN 10 WHEN 2 THEN user_id::INT ELSE 1 END AS n FROM events")
def H25_result_count(t):
    i = F.col("event_id") % 4
    return t.events.select("event_id", C.result_count(F.when(i == 0, "all").when(i == 1, "ALL").when(i == 2, F.col("user_id").cast("string")).otherwise("some")).alias("n"))


@q("SELECT vec_id, round(1 - least(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: CASE WHEN i % 2 = 1 THEN pow(e.embedding[i]::DOUBLE - z.embedding[i]::DOUBLE, 2) ELSE 0 END)) / (len(e.embedding) * 4.0), 1.0), 6) AS confidence FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) z")
def K2_masked_confidence(t):
    """Every second element masked out: it adds no difference, but counts in what is possible."""
    z = t.embeddings.filter("vec_id = 0").select(F.col("embedding").alias("z"))
    mask = F.transform("embedding", lambda x, i: F.when(i % 2 == 0, 1.0).otherwise(0.0))
    return t.embeddings.crossJoin(F.broadcast(z)).select("vec_id", F.round(K.difference_confidence(F.col("embedding"), F.col("z"), 2.0, mask), 6).alias("confidence"))  # one row


# --- what users ask of the above as a whole


@q("SELECT o_orderkey, o_custkey, NULL::VARCHAR AS o_note FROM orders")
def A1_declared_schema(t):
    """A scan by a declared schema: two columns of the file, and one that it lacks."""
    return T.load_declared(t.spark, t.sf_dir, "orders", "o_orderkey bigint, o_custkey bigint, o_note string")


@q("SELECT o_custkey, o_orderkey, ((r - 1) // 2 + 1)::INT AS page FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 6")
def A4_fetched_pages(t):
    """Up to three pages of two rows for each key."""
    return T.fetched_pages(t.orders, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], page=2, pages=3).select("o_custkey", "o_orderkey", "page")


@q(domain("SELECT c.id AS chunk_id, to_json({vod_id: c.vod_id, chunk_id: c.id, chunk_index: c.chunk_index, start_seconds: c.start_seconds, end_seconds: c.end_seconds, quality: c.quality, detections_count: count(d.id), detections: coalesce(list({timestamp: frame_time_seconds, username: username, confidence: round(confidence, 6), rank: rank} ORDER BY frame_time_seconds, d.id) FILTER (d.id IS NOT NULL), [])})::STRING AS document FROM chunks c LEFT JOIN detections d ON d.chunk_id = c.id GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY c.id, c.vod_id, c.chunk_index, c.start_seconds, c.end_seconds, c.quality")))
def A9_written_summaries(t):
    """Documents of all chunks, written by partition as compressed texts and read again."""
    path = S.shared_dir(t.spark)
    T.write_summaries(T.export_summary(t.detections, t.chunks.select("id", "vod_id", "chunk_index", "start_seconds", "end_seconds", "quality")), path, compression="gzip")
    return t.spark.read.text(path).select(F.get_json_object("value", "$.chunk_id").cast("bigint").alias("chunk_id"), F.col("value").alias("document"))


@q("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '360p' WHEN 1 THEN '480p' WHEN 2 THEN '720p60' ELSE 'audio' END AS label, CASE p_size % 4 WHEN 0 THEN '640x360' WHEN 2 THEN '1280x720' ELSE '854x480' END AS resolution FROM part")
def H21_resolution(t):
    """Each quality's label and its resolution; a label that is not known has the default one."""
    k = F.col("p_size") % 4
    label = F.when(k == 0, "360p").when(k == 1, "480p").when(k == 2, C.quality_label(F.lit("720p"), F.lit(60))).otherwise("audio")
    return t.part.select("p_partkey", label.alias("label"), C.resolution(label).alias("resolution"))


@q(domain("SELECT d.id AS detection_id, coalesce(n, 0)::BIGINT AS notified FROM detections d LEFT JOIN (SELECT username, sum((notify_type IN ('dm', 'both'))::INT + (notify_type IN ('server', 'both') AND guild_id IN (SELECT guild_id FROM channels))::INT) AS n FROM subscriptions WHERE enabled GROUP BY 1) s USING (username)"))
def I1_notified(t):
    return G.notified(t.detections, t.subscriptions, t.channels)


@q(f"SELECT route, count(*) AS n FROM ({ROUTES}) GROUP BY 1")
def I14_route_counts(t):
    return G.counted(G.route(_messages(t), "a secret"), "route")


@q(ORACLES["I15_offline_events"].replace("SELECT e.event_id, CASE", "SELECT reason, count(*) AS n FROM (SELECT e.event_id, CASE", 1) + ") GROUP BY 1")
def I15_reason_counts(t):
    return G.counted(I15_offline_events(t), "reason")


@q(domain("SELECT coalesce(l.g, c.guild_id) AS guild_id, CASE WHEN l.g IS NOT NULL THEN l.c ELSE c.channel_id END AS channel_id FROM channels c FULL JOIN (SELECT (user_id % 40)::STRING AS g, max_by({v: CASE WHEN event_id % 5 <> 0 THEN 'c' || event_id END}, event_id).v AS c FROM events WHERE user_id % 40 >= 10 GROUP BY 1) l ON l.g = c.guild_id WHERE CASE WHEN l.g IS NOT NULL THEN l.c ELSE c.channel_id END IS NOT NULL"))
def I18_stored_channels(t):
    """Commands of some guilds folded into the channels that are stored; the others keep theirs."""
    rows = t.events.filter("user_id % 40 >= 10").select(F.col("event_id").alias("seq"), (F.col("user_id") % 40).cast("string").alias("guild_id"), F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("c"), "event_id")).alias("channel_id"))
    return G.set_channels(rows, t.channels)


@q(domain("SELECT count(*) AS checked, count(*) FILTER (id % 3 <> 0) AS marked_unavailable, count(*) FILTER (id % 3 = 0) AS still_available FROM vods WHERE id % 2 = 0"))
def I20_sweep_counts(t):
    return G.sweep_counts(t.vods.filter("id % 2 = 0"), t.vods.filter("id % 3 = 0"))


def _dated_subscriptions(t) -> DataFrame:
    n = F.col("user_id").cast("int")
    return t.subscriptions.select((n % 20).cast("string").alias("user_id"), "username", "enabled", F.date_add(F.lit(datetime(2024, 1, 1)).cast("date"), n % 90).alias("created_at"))


DATED = "sb AS (SELECT (user_id::INT % 20)::STRING AS user_id, username, enabled, DATE '2024-01-01' + (user_id::INT % 90) AS created_at FROM subscriptions)"


@q(domain("SELECT username, created_at FROM sb WHERE user_id = '7' AND enabled ORDER BY created_at, username", DATED))
def J14_user_subscriptions(t):
    return G.list_subscriptions(_dated_subscriptions(t), "7")


@q(domain("SELECT 'Your active subscriptions:' || chr(10) || string_agg('- **' || username || '**', chr(10) ORDER BY created_at, username) AS content FROM sb WHERE user_id = '7' AND enabled", DATED))
def J14_list_message(t):
    return G.list_message(_dated_subscriptions(t), "7")


def _live(t) -> DataFrame:
    return t.streamers.filter("id % 3 = 0").select(F.col("id").alias("streamer_id"))


def _owned_feed(t) -> DataFrame:
    own = t.vods.select(F.col("source_id").alias("id"), "streamer_id", "published_at")
    return _feed(t).drop("published_at").join(own, "id")


REFRESH = CATALOGUE + """, ow AS (SELECT up.*, v.streamer_id, v.published_at, row_number() OVER (PARTITION BY v.streamer_id ORDER BY v.published_at DESC NULLS LAST, up.id DESC) AS r FROM up JOIN vods v ON v.source_id = up.id), rs AS (SELECT * FROM ow WHERE streamer_id % 3 <> 0 OR r > 1)"""


@q(domain("SELECT streamer_id, count(*) AS fetched, count(a) AS upserted, coalesce(sum(len(a) // 2), 0)::BIGINT AS segments, min(published_at) AS oldest FROM rs GROUP BY 1", REFRESH))
def J18_refresh_counts(t):
    """What a refresh of all streamers did, the newest recording of each live one left out."""
    return J.refresh_streamers(_owned_feed(t), _live(t), t.vods.select("source_id", "title", "duration_seconds", "chapters"), "none", "game r")["counts"]


@q(domain("SELECT streamer_id, count(*) > 1 AS has_vods, CASE WHEN count(*) > 1 THEN count(*) ELSE 0 END AS num_vods, CASE WHEN count(*) > 1 THEN count(a) ELSE 0 END AS num_matching, CASE WHEN count(*) > 1 THEN min(published_at) END AS oldest_vod FROM rs GROUP BY 1", REFRESH))
def J18_refreshed_streamers(t):
    return J.refresh_streamers(_owned_feed(t), _live(t), t.vods.select("source_id", "title", "duration_seconds", "chapters"), "none", "game r")["streamers"]


@q(domain("SELECT v.source_id, CASE WHEN rs.a IS NOT NULL THEN rs.length_seconds ELSE v.duration_seconds END AS duration_seconds, array_to_string(CASE WHEN rs.a IS NOT NULL THEN rs.a ELSE v.chapters END, ',') AS chapters FROM vods v LEFT JOIN rs ON rs.id = v.source_id", REFRESH))
def J18_refreshed_vods(t):
    out = J.refresh_streamers(_owned_feed(t), _live(t), t.vods.select("source_id", "title", "duration_seconds", "chapters"), "none", "game r")["vods"]
    return out.select("source_id", "duration_seconds", F.array_join(F.transform("chapters", lambda x: x.cast("string")), ",").alias("chapters"))


@q(ORACLES["J20_frames_to_detections"].replace(", rank FROM one JOIN events", ", rank, NOT (event_id % 3 = 0) AND event_id % 2 = 0 AS no_right_edge, event_id % 3 = 0 OR (event_id % 2 = 0 AND event_id % 5 <> 0) AS truncated FROM one JOIN events"))
def J20_frames_with_edges(t):
    """Frames with an edge decision: every third is opaque with a custom edge, of the others every second has none
    detected, and one in five of those no custom edge either."""
    e = F.col("event_id")
    frames = _frames(t)
    ranks = frames.select("frame_id", F.posexplode(F.array(*map(F.lit, A.RANKS))).alias("position", "rank")).withColumn("score", (F.col("frame_id") * 37 + F.col("position") * 53) % 100)
    texts = t.events.select(e.alias("frame_id"), F.lit(0).alias("idx"), F.concat("event_type", F.lit("_ "), "user_id").alias("text"), F.lit(0.9).alias("score"))
    edges = t.events.select(e.alias("frame_id"), F.lit(854).alias("width"), F.when((e % 3 == 0) | (e % 5 != 0), 0.8).alias("custom_edge"), (e % 3 == 0).alias("opaque_edge"), F.when(e % 2 == 1, 700).alias("detected_x"))
    return J.frames_to_detections(frames, ranks, texts, threshold=95, edges=edges)


@q(ORACLES["D1_global_stats"])
def D1_kept_up_stats(t):
    """The global counts from stored summaries of three batches of detections, of which the last comes twice."""
    path, seen = S.shared_dir(t.spark), V.detection_search(t).select("streamer_id", "vod_id")
    for b in (0, 1, 2, 2):
        N.summarize(seen.filter(F.col("vod_id") % 3 == b), ["streamer_id", "vod_id"]).write.mode("overwrite").parquet(f"{path}/batch={b}")
    state = N.merge(t.spark.read.parquet(path).drop("batch"))
    return N.counts(state, {"streamer_id": "streamers", "vod_id": "vods", N.ROWS: "detections"})

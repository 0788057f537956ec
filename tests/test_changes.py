"""Folds, toggles, routes and streams."""

from datetime import datetime

from pyspark.sql import functions as F

from rillmark.operators import changes as G
from rillmark.operators import views as V
from rillmark.streaming import jobs as S

AT = [datetime(2024, 1, 1, 0, i) for i in range(10)]


def test_two_state_machines_differ(spark):
    chunks = spark.createDataFrame([(1, "pending", 3)], "id long, status string, attempt_count int")
    cmd = spark.createDataFrame([(1, 1, "failed", "boom", AT[1]), (2, 1, "processing", None, AT[2]), (3, 1, "odd", None, AT[3])], "seq long, id long, status string, error string, at timestamp_ntz")
    a = G.apply_status_commands(cmd, chunks).first()
    assert (a.status, a.attempt_count, a.started_at, a.completed_at, a.last_error) == ("processing", 4, AT[2], None, None)
    b = G.apply_worker_commands(cmd.filter("status <> 'odd'"), chunks).first()
    assert (b.status, b.attempt_count, b.started_at, b.last_error) == ("processing", 1, AT[2], "boom")
    bad = {r.seq: r.success for r in G.command_results(cmd, chunks).collect()}
    assert bad == {1: True, 2: True, 3: False}


def test_toggles(spark):
    schema = "user_id string, username string, enabled boolean, notify_type string, guild_id string"
    have = spark.createDataFrame([("u1", "n", True, "server", "g1")], schema)
    channels = spark.createDataFrame([("g1", "c1"), ("g2", "c2")], "guild_id string, channel_id string")
    cmd = lambda rows: spark.createDataFrame(rows, "seq long, user_id string, username string, notify_type string, guild_id string")
    off = G.toggle_subscriptions(cmd([(1, "u1", "n", "dm", None)]), have, channels).first()
    assert tuple(off) == ("u1", "n", False, "server", "g1")  # switching off keeps kind and guild
    on = G.toggle_subscriptions(cmd([(1, "u1", "n", "dm", None), (2, "u1", "n", "dm", "g2")]), have, channels).first()
    assert tuple(on) == ("u1", "n", True, "dm", None)
    void = G.toggle_subscriptions(cmd([(1, "u1", "n", None, None), (2, "u1", "n", "both", "g9")]), have, channels).first()
    assert void.enabled is True  # no guild, no channel: nothing happens
    new = G.toggle_subscriptions(cmd([(1, "u2", "n", "both", "g2")]), have, channels).filter("user_id = 'u2'").first()
    assert tuple(new) == ("u2", "n", True, "both", "g2")


def test_notifications_match_case_and_count_undelivered(spark):
    subs = spark.createDataFrame([("a", "Name", True, "both", "g1"), ("b", "name", True, "dm", None), ("c", "Name", True, "server", "g9"), ("d", "Name", False, "dm", None)], "user_id string, username string, enabled boolean, notify_type string, guild_id string")
    channels = spark.createDataFrame([("g1", "c1")], "guild_id string, channel_id string")
    det = spark.createDataFrame([("x", "Name")], "id string, username string")
    got = sorted(tuple(r) for r in G.notifications(det, subs, channels).collect())
    assert got == [("x", "dm", "a", "a"), ("x", "server", "c1", "a")]
    assert sorted(r.user_id for r in G.notification_counts(det, subs).collect()) == ["a", "c"]


def test_presence_of_nothing(spark):
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    assert not any(r.available for r in V.presence(ids, ids.limit(0), "id").collect())


def test_audit_takes_null_as_kept(spark):
    df = spark.createDataFrame([(1, "gold"), (2, None), (3, "tin")], "id long, rank string")
    assert [tuple(r) for r in V.audit(df, "id", {"rank": F.col("rank") == "gold"}).collect()] == [("rank", "3")]


def test_fuzzy_join_equals_all_pairs(spark):
    names = ["smallring11", "smallring12", "smalring11", "bigring11", "ring small", "x", "", None, "small ring", "ringsmall"]
    df = spark.createDataFrame([(n,) for n in names], "username string")
    from rillmark.functions import columns as C

    pairs = df.dropna().crossJoin(df.dropna().withColumnRenamed("username", "b"))
    for t in (0.2, 0.5, 1.0):
        want = {(r.username, r.b) for r in pairs.filter(C.similar(C.similarity(F.col("username"), F.col("b")), t)).collect()}
        assert {(r.a_value, r.b_value) for r in V.fuzzy_join(df, df, "username", t).collect()} == want


def test_debounce_over_batches_and_restart(spark, tmp_path):
    src, work = str(tmp_path / "in"), str(tmp_path / "work")
    for part in ([4, 12, 14, 22], [31, 33, 45]):
        spark.createDataFrame([(1, x) for x in part], "k long, ts long").coalesce(1).write.mode("append").parquet(src)
        out = S.drain(S.debounce(S.source(spark, src), "k", "ts"), folder=work)
    assert sorted(r.ts for r in out.collect()) == [12, 22, 33, 45]


def test_notify_stream_equals_batch(spark, tmp_path):
    det = spark.createDataFrame([(f"d{i}", f"n{i % 3}") for i in range(9)], "id string, username string")
    det.repartition(3).write.parquet(str(tmp_path / "in"))
    subs = spark.createDataFrame([("a", "n0", True, "both", "g1"), ("b", "n1", True, "server", "g1")], "user_id string, username string, enabled boolean, notify_type string, guild_id string")
    channels = spark.createDataFrame([("g1", "c1")], "guild_id string, channel_id string")
    want = sorted(tuple(r) for r in G.notifications(det, subs, channels).collect())
    got = S.notify(S.source(spark, str(tmp_path / "in"), 1), subs, channels)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_correlation_and_difference(spark):
    import numpy as np

    from rillmark.operators import vectors as K

    r = np.random.default_rng(0)
    x, y, m = r.normal(size=8), r.normal(size=8), np.array([1, 1, 0, 1, 1, 0, 1, 1])
    df = spark.createDataFrame([(x.tolist(), y.tolist(), m.tolist(), [2.0] * 8)], "x array<double>, y array<double>, m array<int>, c array<double>")
    col = F.col
    got = df.select(K.correlation(col("x"), col("y")), K.correlation(col("x"), col("y"), col("m")), K.correlation(col("x"), col("c")), K.difference_confidence(col("x"), col("y"), 4.0, col("m"))).first()
    keep = m > 0
    want = [np.corrcoef(x, y)[0, 1], np.corrcoef(x[keep], y[keep])[0, 1], 0.0, 1 - ((x - y) ** 2 * m).sum() / (8 * 16)]
    assert np.allclose(list(got), want)


def test_messages_come_name_by_name(spark):
    """Also where messages could be broadcast, each task gives all that a name sends at one place, so that a table of it stays small."""
    from itertools import groupby

    subs = spark.createDataFrame([(str(i), f"n{i % 40}", True, "both", str(i % 3)) for i in range(400)], "user_id string, username string, enabled boolean, notify_type string, guild_id string")
    channels = spark.createDataFrame([("0", "x"), ("1", "y"), ("2", "z")], "guild_id string, channel_id string")
    found = spark.range(0, 2000, 1, 4).selectExpr("CONCAT('d', id) AS id", "CONCAT('n', id * 7919 % 40) AS username")
    rows = G.notifications(found, subs, channels).selectExpr("*", "spark_partition_id() AS task").collect()
    name = {r.id: r.username for r in found.collect()}
    assert len(rows) == 2000 * (10 + 3)
    for _, part in groupby(rows, lambda r: (r.kind, r.task)):
        runs = [k for k, _ in groupby(name[r.detection_id] for r in part)]
        assert len(runs) == len(set(runs))

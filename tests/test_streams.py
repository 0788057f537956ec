"""Streams with late rows, restarts and replays against what a batch gives."""

import os
import random

import pytest
from pyspark.sql import functions as F

from rillmark.operators import aggregates as A
from rillmark.sources import snapshots as P
from rillmark.streaming import jobs as S
from rillmark.streaming import rollups as R

from .test_folds import taken


def files(path):
    """Every data file of a folder with its time of writing, by partition."""
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_late_frames_and_a_restart_equal_thinning(spark, tmp_path):
    """Five batches, each in no order and reaching back behind the one before; stopped after the second and started anew."""
    r = random.Random(6)
    rows = [(k, x) for k in range(12) for x in {r.randrange(2000) for _ in range(90)}]
    batches: list = [[] for _ in range(5)]
    for k, x in rows:
        batches[min(4, max(0, (x - r.randrange(100)) // 400))].append((k, x))
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def add(some):
        r.shuffle(some)
        spark.createDataFrame(some, "k long, t long").coalesce(1).write.mode("append").parquet(src)

    def go():
        return S.drain(S.debounce(S.source(spark, src, files_per_batch=1), "k", "t", 10, late=520), folder=out)

    for b in batches[:2]:
        add(b)
    early = go().count()
    assert 0 < early < len(rows)  # what the watermark has passed is there before the stream ends
    for b in batches[2:]:
        add(b)
    add([(None, 10**7)])
    add([(None, 10**7 + 1000)])  # with the batch behind it, the states of idle keys end
    got = {}
    for x in go().collect():
        got.setdefault(x.k, []).append(x.t)
    assert {k: sorted(v) for k, v in got.items()} == {k: taken([x for j, x in rows if j == k], 10) for k in range(12)}
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(f"{out}/checkpoint")
    assert state("last").count() == 0  # idle keys keep nothing
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{out}/checkpoint")
    assert waiting.count() == 0


STATES = ["pending", "queued", "processing", "completed", "failed"]


def test_rollups_kept_up_equal_counting_anew(spark, tmp_path):
    """Chunks come, move, change their recording and go, batch after batch; each batch comes twice."""
    r = random.Random(9)
    chunks = {i: (r.randrange(60), r.choice(STATES)) for i in range(300)}
    schema = "id long, vod_id long, status string"
    table = lambda: spark.createDataFrame([(i, *c) for i, c in chunks.items()], schema)
    state = str(tmp_path / "state")
    R.start_rollups(table(), state, 16)
    before = {x.vod_id: x.status for x in R.stored_status(spark, state).collect()}
    for n in range(4):
        changes = []
        for _ in range(12):
            i = r.choice([*chunks, 1000 + r.randrange(50)])
            old = chunks.get(i)
            new = None if old and r.random() < 0.3 else (r.choice([7, 8, 9, 61 + n, None]) if r.random() < 0.3 else (old or (5,))[0], r.choice(STATES))
            changes.append((old, new))
            chunks.pop(i, None)
            if new:
                chunks[i] = new
        df = spark.createDataFrame(changes, "old struct<vod_id:long,status:string>, new struct<vod_id:long,status:string>")
        was = files(state)
        told = sorted(map(tuple, R.apply_batch(spark, state, df, n, 16).collect()), key=str)
        touched = {x[P.BUCKET] for x in R.deltas(df).select(P.bucket_of("vod_id", 16).alias(P.BUCKET)).collect()}
        same = {f: t for f, t in files(state).items() if int(f.split(f"{P.BUCKET}=")[1].split("/")[0]) not in touched}
        assert same and all(was[f] == t for f, t in same.items())  # the other partitions are not written
        again = sorted(map(tuple, R.apply_batch(spark, state, df, n, 16).collect()), key=str)
        assert again == told
        got = {x.vod_id: x for x in R.stored_status(spark, state).collect()}
        want = A.status_counts(table().filter("vod_id IS NOT NULL")).select("*", A.status_by_counts().alias("status"))
        want = {x.vod_id: x for x in want.collect()}
        assert {v: tuple(x) for v, x in got.items() if x.chunks} == {v: tuple(x) for v, x in want.items()}
        assert all(x.status == "pending" for x in got.values() if not x.chunks)
        after = {v: x.status for v, x in got.items()}
        assert {(v, s) for v, _, s in told} == {(v, s) for v, s in after.items() if before.get(v) != s}
        before = after


def test_rollups_of_a_stream(spark, tmp_path):
    chunks = spark.createDataFrame([(i, i % 5, "pending") for i in range(40)], "id long, vod_id long, status string")
    state, src = str(tmp_path / "state"), str(tmp_path / "in")
    R.start_rollups(chunks, state, 8)
    for n, (old, new) in enumerate([("pending", "queued"), ("queued", "completed")]):
        rows = chunks.filter("vod_id < 2").select(F.struct("vod_id", F.lit(old).alias("status")).alias("old"), F.struct("vod_id", F.lit(new).alias("status")).alias("new"))
        rows.coalesce(1).write.mode("append").parquet(src)
    out = R.rollup_stream(S.source(spark, src, files_per_batch=1), state, str(tmp_path / "out"), 8)
    assert sorted(map(tuple, out.select("vod_id", "was", "status").collect())) == [(0, "pending", "processing"), (0, "processing", "completed"), (1, "pending", "processing"), (1, "processing", "completed")]
    assert {x.vod_id: x.status for x in R.stored_status(spark, state).collect()} == {0: "completed", 1: "completed", 2: "pending", 3: "pending", 4: "pending"}


@pytest.mark.parametrize("times", [1, 2])
def test_an_upsert_rewrites_only_its_partitions(spark, tmp_path, times):
    base = spark.createDataFrame([(i, f"t{i}", i) for i in range(200)], "id long, title string, n int")
    path = str(tmp_path / "snap")
    P.write_snapshot(base, path, "id", 16)
    was = files(path)
    up = spark.createDataFrame([(3, None), (7, "new"), (1000, "added")], "id long, title string")
    for _ in range(times):
        touched = P.upsert(spark, path, up, "id", ["title"], 16)
    assert 1 <= len(touched) <= 3
    for f, t in files(path).items():
        assert (int(f.split(f"{P.BUCKET}=")[1].split("/")[0]) in touched) == (f not in was or was[f] != t)
    got = {r.id: (r.title, r.n) for r in P.read_snapshot(spark, path).collect()}
    want = {i: (f"t{i}", i) for i in range(200)} | {3: (None, 3), 7: ("new", 7), 1000: ("added", None)}
    assert got == want
    assert P.upsert(spark, path, up.limit(0), "id", ["title"], 16) == []


def test_messages_are_stored_by_name_not_by_match(spark, tmp_path):
    """60 detections of one name with 50 subscribers: a batch stores 60 rows and the name's messages, not 3000 matches."""
    subs = spark.createDataFrame([(str(i), n, i % 10 != 9, ("dm", "server", "both")[i % 3], str(i % 4)) for i in range(50) for n in ("a", "b")], "user_id string, username string, enabled boolean, notify_type string, guild_id string")
    channels = spark.createDataFrame([("0", "x"), ("1", "x"), ("2", "y")], "guild_id string, channel_id string")
    rows = [(f"d{i}", "a") for i in range(60)] + [("two", "a"), ("two", "b"), ("d0", "a"), ("d1", None), ("d2", "nobody")]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, "id string, username string").write.parquet(src)
    on = [(r.user_id, r.username, r.notify_type, r.guild_id) for r in subs.collect() if r.enabled]
    to = {r.guild_id: r.channel_id for r in channels.collect()}
    want, groups = [], {}
    for d, n in rows:
        for u, name, kind, g in on:
            if name == n and kind != "server":
                want.append((d, "dm", u, u))
            if name == n and kind != "dm" and g in to:
                groups.setdefault((d, to[g]), set()).add(u)
    want += [(d, "server", c, " ".join(sorted(us))) for (d, c), us in groups.items()]
    got = S.notify(S.source(spark, src), subs, channels, out)
    assert sorted(map(tuple, got.select("detection_id", "kind", "target", "users").collect())) == sorted(want)
    stored = sum(spark.read.parquet(f"{out}/{what}").count() for what in ("detections", "messages"))
    assert stored < len(rows) + 2 * len(on)


def test_thinning_keeps_one_state_for_many_keys(spark, tmp_path):
    """400 keys in 8 groups: however many keys there are, a batch touches a state for each group, and gives the same."""
    r = random.Random(8)
    rows = [(k * (1 << 52) + 1, x) for k in range(400) for x in r.sample(range(60), 8)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for some in ([x for x in rows if x[1] < 35], [x for x in rows if x[1] >= 35], [(7, None), (None, 5)]):
        r.shuffle(some)
        spark.createDataFrame(some, "k long, t long").coalesce(1).write.mode("append").parquet(src)
    stream = lambda: S.debounce(S.source(spark, src, files_per_batch=1), "k", "t", 10, late=100, groups=8)
    assert S.drain(stream(), folder=out).count() == 0
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{out}/checkpoint")
    assert waiting.select("key").distinct().count() == 8 and waiting.count() <= 16  # a list of two batches each
    spark.createDataFrame([(None, 1000)], "k long, t long").coalesce(1).write.mode("append").parquet(src)
    got = {}
    for x in S.drain(stream(), folder=out).collect():
        got.setdefault(x.k, []).append(x.t)
    frames = {k * (1 << 52) + 1: sorted({x for j, x in rows if j == k * (1 << 52) + 1}) for k in range(400)}
    assert {k: sorted(v) for k, v in got.items()} == {k: t for k, x in frames.items() if (t := taken(x, 10))}


def test_a_streams_messages_come_name_by_name(spark, tmp_path):
    """Stored messages are small enough to be broadcast, but a task gives what a name sends at one place."""
    subs = spark.createDataFrame([(str(i), f"n{i % 40}", True, "both", str(i % 3)) for i in range(400)], "user_id string, username string, enabled boolean, notify_type string, guild_id string")
    channels = spark.createDataFrame([("0", "x"), ("1", "y"), ("2", "z")], "guild_id string, channel_id string")
    found = spark.range(0, 2000, 1, 4).selectExpr("CONCAT('d', id) AS id", "CONCAT('n', id * 7919 % 40) AS username")
    src = str(tmp_path / "in")
    found.write.parquet(src)
    rows = S.notify(S.source(spark, src), subs, channels, str(tmp_path / "out")).selectExpr("*", "spark_partition_id() AS task").collect()
    name = {r.id: r.username for r in found.collect()}
    assert len(rows) == 2000 * (10 + 3)
    for kind in ("dm", "server"):
        for task in {r.task for r in rows}:
            part = [name[r.detection_id] for r in rows if (r.kind, r.task) == (kind, task)]
            assert sum(a != b for a, b in zip(part, part[1:])) == max(0, len(set(part)) - 1)

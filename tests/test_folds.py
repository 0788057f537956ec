"""Thinning in blocks, and command folds in pieces, against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rillmark.operators import aggregates as A
from rillmark.operators import changes as G
from rillmark.operators import distinct as N
from rillmark.operators import scan


def taken(times, gap):
    last, out = 0, []
    for x in sorted(x for x in times if x is not None):
        if x - last >= gap:
            last = x
            out.append(x)
    return out


@pytest.mark.parametrize("gap", [1, 2, 10, 37, 0])
@pytest.mark.parametrize("dense", [True, False])
def test_thinning_in_blocks_equals_the_loop(spark, gap, dense):
    r = random.Random(gap)
    rows = [("hot", x) for x in (range(3000) if dense else [r.randrange(-50, 20_000) for _ in range(4000)])]
    rows += [(f"k{i % 30}", r.randrange(200)) for i in range(900)] + [(None, x) for x in range(0, 900, 3)] + [("k1", None)]
    df = spark.createDataFrame(rows, "k string, t int")
    for hot in (100, 10**9):
        got = {}
        for x in A.thin(df, "k", "t", gap, hot).collect():
            got.setdefault(x.k, []).append(x.t)
        want = {k: taken({t for j, t in rows if j == k}, gap) for k in {k for k, _ in rows}}
        assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_a_hot_key_is_thinned_by_many_tasks(spark):
    df = spark.range(20_000).select(F.lit("one").alias("k"), F.col("id").alias("t"))
    spread = scan.spread(df, ["k"], "t", 1000).groupBy("__block").count().collect()
    assert len(spread) == scan.BLOCKS and max(r["count"] for r in spread) < 700
    assert A.thin(df, "k", "t", 7, 1000).count() == len(taken(range(20_000), 7))


def commands(seed, n):
    r = random.Random(seed)
    at = datetime(2024, 1, 1)
    kinds = ["pending", "processing", "completed", "failed", "archived"]
    return [(i, r.choice([1, 1, 1, 2, 3, 9]), r.choice(kinds), r.choice([None, f"e{i}"]), at + timedelta(seconds=i)) for i in range(n)]


CHUNKS = [(1, "pending", 0), (2, "failed", 3), (3, "completed", 1), (4, "pending", 2)]
SCHEMA = "seq long, id long, status string, error string, at timestamp_ntz"


def database(rows, state):
    s, start, end, n, e = state
    for _, _, st, error, at in sorted(rows):
        if st == "archived":
            continue
        start = at if st == "processing" else None if st == "pending" else start
        end = at if st in ("completed", "failed") else None
        n += st in ("pending", "failed")
        e = None if st in ("processing", "completed") else error or e
        s = st
    return s, start, end, n, e


def worker(rows, state):
    s, start, end, n, e = state
    for _, _, st, error, at in sorted(rows):
        start, end = at if st == "processing" else start, at if st == "completed" else end
        n = 1 if st == "processing" else n + (st == "pending")
        s, e = st, error or e
    return s, start, end, n, e


@pytest.mark.parametrize("apply,loop", [(G.apply_status_commands, database), (G.apply_worker_commands, worker)])
def test_commands_in_pieces_equal_all_at_once(spark, monkeypatch, apply, loop):
    rows = [c for c in commands(3, 400) if loop is database or c[2] != "archived"]
    if loop is worker:
        monkeypatch.setattr(scan.running, "__defaults__", (50, False, None))  # a hot chunk
    chunks = spark.createDataFrame(CHUNKS, "id long, status string, attempt_count int")
    make = lambda some: spark.createDataFrame(some, SCHEMA)
    plain = lambda df: {r.id: tuple(r)[1:] for r in df.collect()}
    whole = plain(apply(make(rows), chunks))
    assert whole == {i: loop([c for c in rows if c[1] == i], (s, None, None, n, None)) for i, s, n in CHUNKS if any(c[1] == i and c[2] != "archived" for c in rows)}
    state = chunks.selectExpr("*", "cast(null as timestamp_ntz) started_at", "cast(null as timestamp_ntz) completed_at", "cast(null as string) last_error")
    for lo in range(0, 400, 130):
        new = apply(make([c for c in rows if lo <= c[0] < lo + 130]), state)
        state = spark.createDataFrame(new.unionByName(state.join(new, "id", "left_anti")).collect(), new.schema)
    assert {k: v for k, v in plain(state.select("id", "status", "started_at", "completed_at", "attempt_count", "last_error")).items() if k in whole} == whole


def test_summaries_of_any_parts_merge(spark):
    rows = commands(5, 300)
    random.Random(1).shuffle(rows)
    parts = [G.summarize_status(spark.createDataFrame(rows[k::3], SCHEMA)) for k in range(3)]
    merged = G.merge_status(parts[2].unionByName(G.merge_status(parts[0].unionByName(parts[1]))))
    at_once = G.summarize_status(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(repr, merged.collect())) == sorted(map(repr, at_once.collect()))


def test_toggles_in_pieces_equal_all_at_once(spark):
    r = random.Random(2)
    rows = [(i, str(r.randrange(4)), r.choice("ab"), r.choice(["dm", "server", "both", None]), r.choice(["g1", "g2", None])) for i in range(200)]
    schema = "seq long, user_id string, username string, notify_type string, guild_id string"
    channels = spark.createDataFrame([("g1", "c1")], "guild_id string, channel_id string")
    old = spark.createDataFrame([("1", "a", True, "dm", None), ("2", "b", False, "server", "g9"), ("8", "z", True, "dm", None)], "user_id string, username string, enabled boolean, notify_type string, guild_id string")
    state = {(x.user_id, x.username): (x.enabled, x.notify_type, x.guild_id) for x in old.collect()}
    for _, user, name, kind, guild in rows:
        kind = kind or "both"
        if kind != "dm" and guild != "g1":
            continue
        on, k, g = state.get((user, name), (False, None, None))
        state[user, name] = (False, k, g) if on else (True, kind, guild if kind != "dm" else None)
    plain = lambda df: {(x.user_id, x.username): (x.enabled, x.notify_type, x.guild_id) for x in df.collect()}
    assert plain(G.toggle_subscriptions(spark.createDataFrame(rows, schema), old, channels)) == state
    now = old
    for lo in range(0, 200, 70):
        now = spark.createDataFrame(G.toggle_subscriptions(spark.createDataFrame(rows[lo : lo + 70], schema), now, channels).collect(), old.schema)
    assert plain(now) == state


def test_no_command_is_gathered(spark):
    cmd, chunks = spark.createDataFrame(commands(1, 5), SCHEMA), spark.createDataFrame(CHUNKS, "id long, status string, attempt_count int")
    for apply in (G.apply_status_commands, G.apply_worker_commands):
        assert "collect_" not in apply(cmd, chunks)._jdf.queryExecution().optimizedPlan().toString()


def test_distinct_counts_of_parts_equal_those_at_once(spark):
    r = random.Random(3)
    rows = [(None if r.random() < 0.1 else r.randrange(100_000), r.choice([5, 32_768, 32_769, -7, None])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "a long, b int")
    names = {"a": "a", "b": "b", N.ROWS: "n"}
    parts = [N.summarize(spark.createDataFrame(rows[k::3], "a long, b int"), ["a", "b"]) for k in range(3)]
    merged = N.merge(N.merge(parts[0].unionByName(parts[2])).unionByName(parts[1]))
    want = (len({a for a, _ in rows} - {None}), len({b for _, b in rows} - {None}), len(rows))
    assert tuple(N.counts(merged, names).first()) == tuple(N.counts(N.summarize(df, ["a", "b"]), names).first()) == want
    assert tuple(N.counts(N.summarize(df.limit(0), ["a", "b"]), names).first()) == (0, 0, 0)
    assert "Expand" not in N.counts(N.summarize(df, ["a", "b"]), names)._jdf.queryExecution().executedPlan().toString()

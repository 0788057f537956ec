"""Dyadic nodes, overlaps, dated profiles and template blocks against brute force."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rillmark.operators import intervals as I
from rillmark.operators import scan
from rillmark.operators import vectors as K
from rillmark.operators import views as V
from rillmark.operators.dyadic import nodes, with_nodes


def test_nodes_are_few_and_cover_a_range_once(spark):
    r = random.Random(1)
    rows = [(lo, lo + n) for lo, n in [(0, 0), (5, -3), (0, 1), (7, 1), (-9, 20), *((r.randrange(-500, 500), r.randrange(1, 700)) for _ in range(200))]]
    for x in spark.createDataFrame(rows, "lo long, hi long").select("lo", "hi", nodes(F.col("lo"), F.col("hi")).alias("n")).collect():
        got = sorted(i for n in x.n for i in range(n.place << n.level, (n.place + 1) << n.level))
        assert got == list(range(x.lo, x.hi)), x
        assert len(x.n) <= max(1, 2 * math.log2(max(2, x.hi - x.lo)))


def test_a_very_long_range_takes_few_rows(spark):
    df = spark.createDataFrame([(1, 0, 1 << 40), (1, 12345, (1 << 40) - 777)], "k long, start long, end long")
    assert with_nodes(df, F.col("start"), F.col("end")).count() <= 2 * 2 * 40
    pairs = V.overlap_join(df, df.withColumn("n", F.lit(1)), "k", width=1, wide=True)
    assert pairs.count() == 4


@pytest.mark.parametrize("width,wide", [(1, True), (7, True), (3600, True), (3600, False)])
def test_overlaps_equal_all_pairs(spark, width, wide):
    r = random.Random(width)
    make = lambda n, p: [(r.randrange(3), f"{p}{i}", s := r.randrange(-300, 3000), s + r.choice([0, 1, 5, 40, 2000, 10**6])) for i in range(n)]
    a, b = make(80, "a"), make(90, "b")
    df = lambda rows: spark.createDataFrame(rows, "k long, id string, start long, end long")
    got = sorted((x.a_id, x.b_id) for x in V.overlap_join(df(a), df(b), "k", width, wide).collect())
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3])
    assert got == want
    assert V.overlap_join(df(a).limit(0), df(b), "k", width, wide).count() == 0


@pytest.mark.parametrize("small", [True, False])
def test_difference_with_long_and_many_ranges(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(scan, "SMALL_BYTES", 0)
    r = random.Random(4)
    seg = [(v, i, i * 40_000, i * 40_000 + 30_000) for v in range(4) for i in range(3)]
    cov = [(r.randrange(5), s := r.randrange(0, 120_000), s + r.choice([10, 500, 9000])) for _ in range(120)]
    got = {tuple(x) for x in I.subtract_ranges(spark.createDataFrame(seg, "vod_id long, segment int, segment_start long, segment_end long"), spark.createDataFrame(cov, "vod_id long, start_seconds long, end_seconds long")).select("vod_id", "segment", "gap_start", "gap_end").collect()}
    want = set()
    for v, i, s, e in seg:
        at = s
        for a, b in [*sorted((max(a, s), min(b, e)) for w, a, b in cov if w == v and a < e and s < b), (e, e)]:
            if a > at:
                want.add((v, i, at, a))
            at = max(at, b)
    assert got == want


def test_difference_sweeps_large_tables_without_a_join(spark, monkeypatch):
    monkeypatch.setattr(scan, "SMALL_BYTES", 0)
    vods = [(v, 9000, c) for v, c in enumerate([None, [0, 4000, 4000, 9000], [500, 2000, 6000, 9100], [0, 5000, 4000, 9000]])]
    cov = spark.createDataFrame([(v, s, e) for v in range(4) for s, e in ((0, 700), (300, 400), (1800, 3600), (4000, 5400), (4000, 4100), (9000, 9500))], "vod_id long, start_seconds int, end_seconds int")
    seg = I.segments(spark.createDataFrame(vods, "id long, duration_seconds int, chapters array<int>"), crossing=True)
    assert {r.vod_id for r in seg.filter("crossing").collect()} == {3}
    plain = I.subtract_ranges(seg.filter("vod_id < 3"), cov)
    assert "level" not in plain._jdf.queryExecution().optimizedPlan().toString()  # no dyadic nodes
    want = {(0, 0, 700, 1800), (0, 0, 3600, 4000), (0, 0, 5400, 9000), (1, 0, 700, 1800), (1, 0, 3600, 4000), (1, 1, 5400, 9000), (2, 0, 700, 1800), (2, 1, 6000, 9000)}
    assert {(r.vod_id, r.segment, r.gap_start, r.gap_end) for r in plain.collect()} == want
    whole = {(r.vod_id, r.segment, r.gap_start, r.gap_end) for r in I.subtract_ranges(seg, cov).collect()}
    assert whole == want | {(3, 0, 700, 1800), (3, 0, 3600, 4000), (3, 1, 5400, 9000)}
    assert whole == {(r.vod_id, r.segment, r.gap_start, r.gap_end) for r in I.subtract_ranges(seg.drop("crossing"), cov).collect()}


def effective(at, profiles):
    fits = [(f is not None, f or datetime(1, 1, 1), t is None, t or datetime(1, 1, 1), i) for i, f, t in profiles if (f is None or (at is not None and f <= at)) and (t is None or (at is not None and at < t)) and not (f and t and t <= f)]
    return max(fits)[-1] if fits else None


def test_profiles_by_date_equal_brute_force(spark):
    r, day = random.Random(7), lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    for n in (0, 1, 5, 60):
        starts = [r.randrange(200) for _ in range(n)]
        profiles = [(i, None if r.random() < 0.1 else day(s), None if r.random() < 0.2 else day(s + r.choice([-2, 0, 3, 30, 150]))) for i, s in enumerate(starts)]
        vods = [(i, None if i % 9 == 0 else day(r.randrange(-20, 260)), "x") for i in range(150)]
        p = spark.createDataFrame(profiles, "id long, from_date timestamp_ntz, to_date timestamp_ntz")
        got = V.effective_profile(spark.createDataFrame(vods, "id long, published_at timestamp_ntz, piece string"), p)
        assert got.columns == ["id", "published_at", "piece", "profile_id"]
        assert {x.id: x.profile_id for x in got.collect()} == {i: effective(at, profiles) for i, at, _ in vods}


def test_a_hundred_thousand_profiles(spark):
    """Consecutive profiles, and one over all of them that starts first."""
    n, ts = 100_000, lambda c: F.timestamp_seconds(c).cast("timestamp_ntz")
    p = spark.range(1, n + 1).select("id", ts(F.col("id") * 10).alias("from_date"), ts(F.col("id") * 10 + F.when(F.col("id") % 2 == 0, 10).otherwise(5)).alias("to_date"))
    p = p.unionByName(spark.range(1).select(F.lit(0).cast("long").alias("id"), ts(F.lit(3)).alias("from_date"), F.lit(None).cast("timestamp_ntz").alias("to_date")))
    vods = spark.range(5000).select("id", ts(F.col("id") * 211 + 1).alias("published_at"))
    for x in V.effective_profile(vods, p).collect():
        at = x.id * 211 + 1
        k, rest = divmod(at, 10)
        want = (k if 1 <= k <= n and (k % 2 == 0 or rest < 5) else 0) if at >= 3 else None
        assert x.profile_id == want


def test_five_thousand_templates_equal_brute_force(spark):
    r = random.Random(11)
    vec = lambda: [r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(6)]
    templates = [(f"t{i:05}", vec()) for i in range(5000)] + [("a flat one", [1.0] * 6)]
    vectors = [(i // 2, vec()) for i in range(60)] + [(99, [2.0] * 6)]

    def unit(v):
        m = sum(v) / len(v)
        n = math.sqrt(sum((x - m) ** 2 for x in v))
        return [(x - m) / n if n > 1e-12 else 0.0 for x in v]

    units = sorted((label, unit(t)) for label, t in templates)
    got = K.classify(spark.createDataFrame(vectors, "k long, v array<double>"), spark.createDataFrame(templates, "label string, template array<double>"), "k", "v", "label", 0.97)
    rows = sorted((x.k, x.score, x.label) for x in got.collect())
    want = []
    for k, v in vectors:
        u = unit(v)
        best = max(sum(a * b for a, b in zip(u, t)) for _, t in units)
        want.append((k, best))
    assert [k for k, _, _ in rows] == [k for k, _ in sorted(want)] and all(abs(s - b) < 1e-9 for (_, s, _), (_, b) in zip(rows, sorted(want)))
    named = dict(units)
    by_key = {k: unit(v) for k, v in vectors}
    assert all((label is None) == (s < 0.97) for _, s, label in rows)
    single = {k for k, _ in vectors if sum(j == k for j, _ in vectors) == 1}
    assert all(abs(sum(a * b for a, b in zip(by_key[k], named[label])) - s) < 1e-9 for k, s, label in rows if label and k in single)


def test_only_dense_keys_take_nodes(spark):
    """Large tables with few ranges a key are joined by key; a key with many, of the second table, is spread over nodes."""
    r = random.Random(5)
    make = lambda keys: [(k, f"{k}-{i}", s := r.randrange(3000), s + r.randrange(300)) for k, n in keys for i in range(n)]
    a, b = make([(k, 3) for k in range(50)] + [(77, 60)]), make([(k, 2) for k in range(50)] + [(77, 40), (78, 30)])
    df = lambda rows: spark.createDataFrame(rows, "k long, id string, start long, end long")
    pairs = lambda b: V.overlap_join(df(a), df(b), "k", 10, wide=True)
    want = lambda b: sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3])
    assert sorted((x.a_id, x.b_id) for x in pairs(b).collect()) == want(b)
    few = pairs([x for x in b if x[0] < 77])
    assert sorted((x.a_id, x.b_id) for x in few.collect()) == want([x for x in b if x[0] < 77])
    few.collect()
    final = few._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Generate" not in final  # no range is taken apart

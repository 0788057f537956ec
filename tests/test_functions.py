"""Column functions against plain Python."""

import hashlib
import hmac
import re

import pytest
from pyspark.sql import functions as F

from rillmark.functions import columns as C


def trigrams(s):
    out = set()
    for w in re.findall(r"[^\W_]+", s.lower()):
        p = f"  {w} "
        out |= {p[i : i + 3] for i in range(len(p) - 2)}
    return out


TEXTS = ["word", "two words", "a-b", "b a", "", "_x.y", "Größe", "aa", "aaaa aaa", None, "日本 語"]


def test_similarity_is_trigram_jaccard(spark):
    pairs = [(a, b) for a in TEXTS for b in TEXTS]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {(r.a, r.b): r.s for r in df.select("a", "b", C.similarity(F.col("a"), F.col("b")).alias("s")).collect()}
    for (a, b), s in got.items():
        if a is None or b is None:
            assert s is None
            continue
        x, y = trigrams(a), trigrams(b)
        assert s == pytest.approx(len(x & y) / len(x | y) if x | y else 0.0, abs=1e-7)
    assert got["word", "two words"] == pytest.approx(0.36363637)
    assert got["a-b", "b a"] == 1.0  # equal sets


def test_float_score_is_compared_widened(spark):
    df = spark.range(1).select(C.similar(F.lit(0.7).cast("float"), 0.7).alias("x"))
    assert df.first().x is False


def test_signature_equals_hmac(spark):
    df = spark.createDataFrame([("m1",), ("übung",), ("",)], "m string")
    for secret in ("s", "k" * 100):
        for r in df.select("m", C.signature(secret, F.col("m")).alias("s")).collect():
            assert r.s == "sha256=" + hmac.new(secret.encode(), r.m.encode(), hashlib.sha256).hexdigest()


def test_time_texts(spark):
    df = spark.createDataFrame([(0,), (59,), (3600,), (3725,), (100000,)], "s int")
    for r in df.select("s", C.hms(F.col("s")).alias("t"), C.parse_hms(C.hms(F.col("s"))).alias("b")).collect():
        assert r.t == f"{r.s // 3600}h{r.s % 3600 // 60}m{r.s % 60}s" and r.b == r.s
    odd = spark.createDataFrame([("2m",), ("1h",), ("7s",), ("none",), (None,)], "t string")
    assert [r[0] for r in odd.select(C.parse_hms(F.col("t"))).collect()] == [120, 3600, 7, 0, None]


def test_clean_username(spark):
    df = spark.createDataFrame([("ab",), ("a" * 26,), ("_abc",), ("x y-z.9",), ("Good_Name",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(C.clean_username(F.col("t"))).collect()] == [None, None, None, "xy-z.9", "Good_Name", None, None]


def test_right_edge_cases(spark):
    cases = [(100, c, o, d) for c in (0.5, None) for o in (True, False) for d in (7, None)]
    df = spark.createDataFrame(cases, "w int, c double, o boolean, d int")
    got = {tuple(r[:4]): tuple(r[4]) for r in df.select("*", C.right_edge(F.col("w"), F.col("c"), F.col("o"), F.col("d"))).collect()}
    assert got[100, 0.5, True, 7] == (50, False, True)
    assert got[100, 0.5, False, 7] == (7, False, False)
    assert got[100, 0.5, False, None] == (50, True, True)
    assert got[100, None, True, None] == (None, True, False)
    assert got[100, None, True, 7] == (7, False, False)


def test_interval_and_count_texts(spark):
    df = spark.createDataFrame([("90 minutes",), ("nonsense",), (None,), ("2 days",)], "t string")
    got = [r[0].total_seconds() for r in df.select(C.as_interval(F.col("t"))).collect()]
    assert got == [5400, 21600, 21600, 172800]
    n = spark.createDataFrame([("all",), ("3",), ("x",), (None,)], "t string")
    assert [r[0] for r in n.select(C.result_count(F.col("t"))).collect()] == [10, 3, 1, 1]


def test_ratio_guards_zero(spark):
    df = spark.createDataFrame([(1, 3), (5, 0), (1, 8)], "a long, n long")
    assert [float(r[0]) for r in df.select(C.ratio(F.col("a"), F.col("n"))).collect()] == [0.33, 0.0, 0.13]


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from rillmark.streaming.jobs import shared_dir

    session = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master))
    assert shared_dir(session("spark://host:7077", "hdfs:///shared")).startswith("hdfs:///shared/")
    assert shared_dir(session("local[*]", None))
    with pytest.raises(ValueError):
        shared_dir(session("yarn", None))


def test_only_texts_that_may_be_names_are_stripped(spark):
    import random

    r = random.Random(4)
    pick = lambda n, chars: "".join(r.choice(chars) for _ in range(n))
    texts = [None, "", " ", "abc", "abcd", "_bcd", "-" * 26, "a" * 25, "a" * 26, "a" * 25 + "\n", "\n" * 9 + "a\r\n b" * 12, "é" * 5000 + "abcd", "😀 " * 3000 + "a" * 25, "a\n" * 25 + "😀" * 99, "a\n" * 26, "x" * 300_000]
    texts += [pick(r.randrange(70), "ab9_-. é😀\n *") for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", C.clean_username(F.col("t")).alias("name"))

    def want(t):
        bare = re.sub(r"[^a-zA-Z0-9_\-.]", "", t or "")
        return bare if 4 <= len(bare) <= 25 and re.match("[a-zA-Z0-9]", bare) else None

    assert [x.name for x in df.orderBy("i").collect()] == [want(t) for t in texts]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(CASE WHEN" in plan and "regexp_replace(t#" not in plan

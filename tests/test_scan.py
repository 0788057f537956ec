"""Running values in blocks against windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rillmark.operators import scan

KINDS = {"total": ("sum", "v"), "nth": ("count", "v"), "highest": ("max_before", "v"), "latest": ("last", "v"), "behind": ("next", "v")}


def windows(df, key, order):
    w = Window.partitionBy(*key).orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({"total": F.sum("v").over(upto), "nth": F.row_number().over(w).cast("long"), "highest": F.max("v").over(before), "latest": F.last("v", ignorenulls=True).over(upto), "behind": F.lead("v").over(w)})


@pytest.fixture(scope="module")
def rows(spark):
    """Half of all rows under one key, and a third under none; nulls in the order and in the values."""
    r = random.Random(3)
    out = []
    for i in range(6000):
        key = 1 if i % 2 else None if i % 3 == 0 else r.randrange(2, 40)
        out.append((key, i % 3, None if r.random() < 0.01 else r.randrange(2000), i, None if r.random() < 0.2 else r.randrange(1000)))
    return spark.createDataFrame(out, "k long, j int, at long, id long, v long")


@pytest.mark.parametrize("hot_rows", [0, 50, 1500, 10**9])
@pytest.mark.parametrize("key", [["k"], ["k", "j"]])
def test_running_values_equal_windows(rows, hot_rows, key):
    got = scan.running(rows, key, ["at", "id"], KINDS, hot_rows)
    want = windows(rows, key, ["at", "id"])
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_a_hot_key_is_spread_and_others_are_not(rows):
    blocks = {r.k: r.n for r in scan.spread(rows, ["k"], "at", 500).groupBy("k").agg(F.countDistinct("__block").alias("n")).collect()}
    assert blocks.pop(1) > 40 and blocks.pop(None) > 40 and set(blocks.values()) == {1}
    largest = scan.spread(rows, ["k"], "at", 500).groupBy("k", "__block").count().agg(F.max("count")).first()[0]
    assert largest < 150


def test_running_values_of_no_rows(rows):
    assert scan.running(rows.limit(0), ["k"], ["at", "id"], KINDS, 0).count() == 0
    assert scan.running_sums(rows.limit(0), [F.col("at"), F.col("id")], {"s": "v"}).count() == 0


def test_running_sums_over_all_rows(rows):
    some = rows.filter("at IS NOT NULL AND v IS NOT NULL")
    got = {r.id: r.s for r in scan.running_sums(some, [-F.col("at"), F.col("id")], {"s": "v"}).collect()}
    want, total = {}, 0
    for r in sorted(some.collect(), key=lambda r: (-r["at"], r["id"])):
        total += r["v"]
        want[r["id"]] = total
    assert got == want

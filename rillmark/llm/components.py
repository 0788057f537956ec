"""Connected components as Spark jobs: union-find within partitions, then star contraction across them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of a partition; gives each node's link to its root, the smallest node."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if kind is not None:
        own = [(x, r) for x in parent if (r := root(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in own], kind), pa.array([x[0] for x in own], kind)], names=["a", "b"])


def connected_components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) of every node of links (a, b); component is the smallest node that links reach.

    Each partition first turns its links into a forest by union-find, then rounds of star contraction across
    partitions (every node's larger neighbours, then its smaller ones, move to its smallest neighbour) run until
    nothing changes: a number of rounds that grows with the logarithm of the longest chain. Links with a null end
    and loops are ignored; repeated links count once.
    """
    kind = links.schema["a"].dataType.simpleString()
    clean = links.select("a", "b").dropna().filter("a <> b")
    forest = clean.mapInArrow(_forest, f"a {kind}, b {kind}")
    now = staged(forest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    mark = None
    for _ in range(max_rounds):
        ways = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = ways.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        before, now = now, staged(small.filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(low.select(F.col("m").alias("a"), "b")).distinct(), "links")
        discard(before)
        was, mark = mark, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == was:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")

"""Ranges of whole numbers as few dyadic nodes: blocks of 2^level numbers that begin at a multiple of their size.

A range is the union of at most 2 log2(length) such nodes, no two of which overlap, so a number in it lies in exactly one.
A join of points with the ranges that hold them thus is a plain equi-join on (level, place), however long ranges are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _shifted(x: Column, k: Column) -> Column:
    return F.call_function("shiftright", x, k)


def nodes(lo: Column, hi: Column) -> Column:
    """The nodes (level, place) of the numbers lo to hi - 1, as an array; empty if there are none."""
    lo, hi = lo.cast("long"), hi.cast("long")

    def at(k: Column) -> Column:
        first, last = _shifted(lo + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k), _shifted(hi, k)
        odd = lambda x: F.pmod(x, F.lit(2)) == 1
        both = F.array(F.when((first < last) & odd(first), first), F.when((first < last) & odd(last), last - 1))
        return F.transform(F.filter(both, lambda p: p.isNotNull()), lambda p: F.struct(k.cast("int").alias("level"), p.alias("place")))

    levels = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(hi - lo, F.lit(1)).cast("double")) + 1e-9).cast("int"))
    return F.when(hi > lo, F.flatten(F.transform(levels, at))).otherwise(F.array().cast("array<struct<level:int,place:bigint>>"))


def with_nodes(df: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """df with level and place, a row for each node of lo to hi - 1."""
    return df.withColumn("__node", F.explode(nodes(lo, hi))).withColumns({"level": F.col("__node.level"), "place": F.col("__node.place")}).drop("__node")


def with_ancestors(df: DataFrame, x: Column, ranges: DataFrame) -> DataFrame:
    """df with level and place, a row for each node that holds x, of the levels that ranges (with_nodes) has."""
    levels = ranges.agg(F.collect_set("level").alias("__levels"))  # at most 64 numbers
    rows = df.crossJoin(F.broadcast(levels)).withColumn("level", F.explode("__levels")).drop("__levels")  # one row
    return rows.withColumn("place", _shifted(x.cast("long"), F.col("level")))


def stab(points: DataFrame, x: Column, ranges: DataFrame, lo: Column, hi: Column, on: list[str]) -> DataFrame:
    """Each row of points with each row of ranges of equal columns on whose lo to hi - 1 hold x; each pair once."""
    some = with_nodes(ranges, lo, hi)
    return with_ancestors(points, x, some).join(some, [*on, "level", "place"]).drop("level", "place")

"""Exact distinct counts that are kept up batch by batch: mergeable bitmaps by bucket of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = "rows"


def summarize(df: DataFrame, ids: list[str]) -> DataFrame:
    """(what, bucket, bits, n): the ids of each column as bitmaps of 32,768 numbers, and under ROWS how many rows there are.

    Bitmaps are built before the shuffle. They suit ids that lie close together, as keys handed out in sequence do: a
    bucket takes 4 KB whatever it holds. Null ids are not counted, but their rows are.
    """
    each = F.array(F.struct(F.lit(ROWS).alias("what"), F.lit(None).cast("long").alias("id")), *(F.struct(F.lit(c).alias("what"), F.col(c).cast("long").alias("id")) for c in ids))
    rows = df.select(F.explode(each).alias("x")).select("x.*").filter(f"what = '{ROWS}' OR id IS NOT NULL")
    return rows.groupBy("what", F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"), F.count(F.lit(1)).alias("n"))


def merge(states: DataFrame) -> DataFrame:
    """One summary from those of any parts of the rows, in any order."""
    return states.groupBy("what", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"), F.sum("n").alias("n"))


def counts(state: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row with the distinct ids of each column, or the number of rows, under their names ({column: name})."""
    own = [F.coalesce(F.sum(F.when(F.col("what") == what, F.col("n") if what == ROWS else F.bitmap_count("bits"))), F.lit(0)).alias(name) for what, name in names.items()]
    return state.agg(*own)

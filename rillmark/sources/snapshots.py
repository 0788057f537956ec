"""Snapshots of which an update rewrites only the partitions that it names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "__bucket"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_snapshot(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """df as a table partitioned by a hash of key, a partition's rows in one task."""
    df.withColumn(BUCKET, bucket_of(key, buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a snapshot, with their partition as BUCKET."""
    return spark.read.parquet(path)


def overwrite_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replaces exactly the partitions of by that df has rows in, each as a whole; a repeat gives the same table."""
    df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def rewrite(spark: SparkSession, path: str, updates: DataFrame, key: str, change: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 64) -> list[int]:
    """Rewrites the partitions that the keys of updates fall into with change(their rows, updates); gives their numbers.

    change gets rows of BUCKET and gives rows of the same columns, in the same partitions. All other partitions are
    neither read nor touched: their numbers, at most buckets, prune the scan. A partition that change leaves without a
    row keeps its old ones, so rows to be deleted must leave a marked row behind, or buckets be few.
    """
    marked = updates.withColumn(BUCKET, bucket_of(key, buckets))
    touched = sorted(r[0] for r in marked.select(BUCKET).distinct().collect())
    if touched:
        own = read_snapshot(spark, path).filter(F.col(BUCKET).isin(touched))
        overwrite_partitions(change(own, marked), path, BUCKET)
    return touched


def upsert(spark: SparkSession, path: str, updates: DataFrame, key: str, cols: list[str], buckets: int = 64) -> list[int]:
    """Sets cols of the rows that updates names by key, and adds those that are new, null in the other columns."""

    def merged(own: DataFrame, new: DataFrame) -> DataFrame:
        fresh = new.select(key, F.col(BUCKET).alias("__b"), F.lit(True).alias("__new"), *(F.col(c).alias(f"__n_{c}") for c in cols))
        both = own.join(fresh, key, "full_outer")
        value = {c: F.when(F.col("__new"), F.col(f"__n_{c}")).otherwise(F.col(c)) for c in cols} | {BUCKET: F.coalesce(BUCKET, "__b")}
        return both.select(*(value.get(c, F.col(c)).alias(c) for c in own.columns))

    return rewrite(spark, path, updates, key, merged, buckets)

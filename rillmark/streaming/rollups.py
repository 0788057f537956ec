"""Roll-ups kept up by what changes: signed counts of chunks by recording and status, merged into a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import STATUSES, status_by_counts, status_counts
from ..sources.snapshots import BUCKET, read_snapshot, rewrite, write_snapshot

COUNTS = ["chunks", *STATUSES]


def start_rollups(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """Stores the counts of all chunks by recording (vod_id), with its status."""
    counts = status_counts(chunks.filter("vod_id IS NOT NULL"))
    rows = counts.select("vod_id", *(F.col(c).cast("long").alias(c) for c in COUNTS), status_by_counts().alias("status"))
    write_snapshot(rows.select("*", F.lit(None).cast("string").alias("was"), F.lit(-1).cast("long").alias("batch"), F.lit(-1).cast("long").alias("applied")), path, "vod_id", buckets)


def deltas(changes: DataFrame) -> DataFrame:
    """(vod_id, status, n) of changes (old, new: structs of vod_id and status, null where a chunk came or went).

    Every change takes one from its old recording and status and gives one to its new; what adds up to nothing goes.
    """
    signed = F.array(F.struct(F.col("old.vod_id").alias("vod_id"), F.col("old.status").alias("status"), F.lit(-1).alias("n")), F.struct(F.col("new.vod_id").alias("vod_id"), F.col("new.status").alias("status"), F.lit(1).alias("n")))
    each = changes.select(F.explode(signed).alias("d")).select("d.*").filter("vod_id IS NOT NULL")
    return each.groupBy("vod_id", "status").agg(F.sum("n").alias("n")).filter("n <> 0")


def apply_batch(spark: SparkSession, path: str, changes: DataFrame, batch: int, buckets: int = 64) -> DataFrame:
    """Merges a batch of changes into the stored counts; (vod_id, was, status) of the recordings whose status it changed.

    Only the partitions with touched recordings are read and rewritten, and no chunk is counted again. A partition
    remembers the last batch applied to it, and a row what it was before: a batch that comes again, whole or where it was
    interrupted, changes nothing twice and tells the same changes.
    """
    wide = deltas(changes).groupBy("vod_id").agg(F.sum("n").alias("d_chunks"), *(F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).alias(f"d_{s}") for s in STATUSES))

    def merged(own: DataFrame, new: DataFrame) -> DataFrame:
        done = own.groupBy(F.col(BUCKET).alias("__d")).agg(F.max("applied").alias("__done"))
        fresh = new.join(F.broadcast(done), F.col(BUCKET) == F.col("__d"), "left").filter(F.coalesce("__done", F.lit(-1)) < batch)  # a row a partition
        both = own.join(fresh.select("vod_id", F.col(BUCKET).alias("__b"), *(f"d_{c}" for c in COUNTS)), "vod_id", "full_outer")
        hit = F.col("__b").isNotNull()
        rows = both.select(
            "vod_id", *((F.coalesce(c, F.lit(0)) + F.coalesce(f"d_{c}", F.lit(0))).alias(c) for c in COUNTS), F.col("status").alias("__old"), "was",
            F.when(hit, F.lit(batch)).otherwise(F.col("batch")).alias("batch"), hit.alias("__hit"), F.coalesce(BUCKET, "__b").alias(BUCKET), F.greatest("applied", F.lit(batch)).cast("long").alias("applied"),
        )
        return rows.select("vod_id", *COUNTS, F.when(F.col("__hit"), status_by_counts()).otherwise(F.col("__old")).alias("status"), F.when(F.col("__hit"), F.col("__old")).otherwise(F.col("was")).alias("was"), F.col("batch").cast("long").alias("batch"), "applied", BUCKET)

    touched = rewrite(spark, path, wide, "vod_id", merged, buckets)
    now = read_snapshot(spark, path).filter(F.col(BUCKET).isin(touched)).filter(F.col("batch") == batch)
    return now.filter(~F.col("was").eqNullSafe(F.col("status"))).select("vod_id", "was", "status")


def rollup_stream(changes: DataFrame, state: str, folder: str, buckets: int = 64) -> DataFrame:
    """Keeps the counts in state up with a stream of changes; gives all changes of status, batch by batch."""
    spark = changes.sparkSession

    def batch(df: DataFrame, n: int) -> None:
        apply_batch(spark, state, df, n, buckets).write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    changes.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("vod_id long, was string, status string, batch int").parquet(f"{folder}/out")


def stored_status(spark: SparkSession, path: str) -> DataFrame:
    return read_snapshot(spark, path).select("vod_id", *COUNTS, "status")



"""Exact deduplication by progressive refinement: length, then a prefix hash, then the full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, without_blanks


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, digest: str = "survivors") -> DataFrame:
    """(id, keep_id, group_size, kept, full_hash), one row per input row; DataFrame operations only.

    Texts are equal when identical without the characters [\\x20\\x09-\\x0D]. Of equal texts the one with the most
    code points, then the smallest id, is kept. Three keys are tried in turn, and each sees only the rows that the
    one before left undecided: rows alone with their length leave at once, rows alone with length and prefix hash
    leave next, and only the rest are compared by SHA-256. What is shuffled is ids and keys, never text (with
    digest="survivors" the text of survivors moves once). digest="all" computes the hash of every row in the first
    scan, for callers that report it; else full_hash is null for rows that an earlier key already told apart.

    Null text counts as empty; empty texts are equal to one another. A null id is kept only if its group has no
    other. Rows that repeat an id share its decision. Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t")).withColumn("n", without_blanks(F.col("t")))
    keys = [
        F.col("id"),
        F.length("t").alias("n_chars"),
        F.length("n").alias("norm_len"),
        F.xxhash64(F.substring("n", 1, prefix_chars)).alias("prefix_hash"),
    ]
    full = F.sha2(F.col("n").cast("binary"), 256)
    fp = staged(rows.select(*keys, *([full.alias("full_hash")] if digest == "all" else [])), "exact-keys")

    def shared(df: DataFrame, *by: str) -> DataFrame:
        again = df.groupBy(*by).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(*by)
        return df.join(again, list(by), "left_semi")

    survivors = shared(shared(fp, "norm_len"), "norm_len", "prefix_hash")
    if digest != "all":
        survivors = staged(survivors, "exact-survivors")
        wanted = survivors.select("id").distinct()
        hashes = rows.join(wanted, rows["id"].eqNullSafe(wanted["id"]), "left_semi").select("id", F.length("t").alias("n_chars"), F.length("n").alias("norm_len"), full.alias("full_hash")).distinct()
        on = survivors["id"].eqNullSafe(hashes["id"]) & (survivors["n_chars"] == hashes["n_chars"]) & (survivors["norm_len"] == hashes["norm_len"])
        survivors = survivors.join(hashes, on).select(survivors["*"], hashes["full_hash"])
        fp = survivors.unionByName(fp.join(survivors.select("norm_len", "prefix_hash").distinct(), ["norm_len", "prefix_hash"], "left_anti").withColumn("full_hash", F.lit(None).cast("string")))
    best = F.min(F.struct(-F.col("n_chars"), F.col("id").isNull(), "id")).alias("best")
    groups = (
        survivors.groupBy("norm_len", "prefix_hash", "full_hash")
        .agg(best, F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select("norm_len", "prefix_hash", "full_hash", F.col("best.id").alias("keep_id"), "group_size")
    )
    joined = fp.join(groups, ["norm_len", "prefix_hash", "full_hash"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        "id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"),
        "full_hash",
    )

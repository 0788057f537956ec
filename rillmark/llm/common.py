"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space of the contracts, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\f\r"


#: A Bloom filter has so many bits for each key, up to MAX_BITS in all (64 MB); beyond, it only lets more rows through.
BITS_PER_KEY, MAX_BITS = 16, 1 << 29


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only where none is set and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of staged tables that nothing still to be run reads."""
    for t in tables:
        context = t.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def whole(df: DataFrame) -> Column:
    """All columns of df as one struct: beside it, an operator's own columns clash with no name of the user's."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns))


def refuse(df: DataFrame, *names: str) -> None:
    """Raises where df has a column of a name that the result needs for its own."""
    taken = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if taken:
        raise ValueError(f"rename these columns, the result has its own of that name: {', '.join(sorted(taken))}")


def _bloom_marked(rows: DataFrame, key: Column, ids: DataFrame) -> DataFrame:
    """(row, hit): every row as a struct, and true where key may be among the one column of ids (never false if it is), or is null.

    The filter has one bit for each hashed id, in pieces of 4 KB that Spark's bitmap functions build in parallel; rows
    look their piece up in a broadcast map of at most MAX_BITS, whatever the number of ids.
    """
    bits = 1 << 15
    wanted = min(MAX_BITS, BITS_PER_KEY * ids.count())
    while bits < wanted:
        bits *= 2
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    at = place(F.col(ids.columns[0]))
    pieces = ids.dropna().groupBy(F.bitmap_bucket_number(at).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = rows.select(whole(rows).alias("row"), place(key).alias("at"), key.isNull().alias("none"))
    out = out.withColumn("piece", F.bitmap_bucket_number("at")).join(F.broadcast(pieces), "piece", "left")
    byte = F.expr("cast(conv(hex(substring(bits, cast(bitmap_bit_position(at) div 8 as int) + 1, 1)), 16, 10) as bigint)")
    hit = F.coalesce(F.getbit(byte, F.expr("cast(bitmap_bit_position(at) % 8 as int)")) == 1, F.lit(False)) | F.col("none")
    return out.select("row", hit.alias("hit"))


def bloom_split(rows: DataFrame, key: Column, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among ids, rows whose key is not): what must be joined with ids and what need not be shuffled."""
    marked = _bloom_marked(rows, key, ids)
    return marked.filter("hit").select("row.*"), marked.filter("NOT hit").select("row.*")


def with_ids(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows whose id is among ids (one column of distinct values, staged). Only rows that pass the Bloom filter are shuffled."""
    likely, _ = bloom_split(rows, F.col(id_col), ids)
    return likely.join(ids.withColumnRenamed(ids.columns[0], id_col), id_col, "left_semi")


def without_ids(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows whose id is not among ids, null ids included. Only rows that pass the Bloom filter are shuffled."""
    likely, never = bloom_split(rows, F.col(id_col), ids)
    return never.unionByName(likely.join(ids.withColumnRenamed(ids.columns[0], id_col), id_col, "left_anti").select(*rows.columns))


def without_blanks(text: Column) -> Column:
    return F.translate(text, BLANKS, "")


def held_out(id_col: str, folds: int = 5) -> Column:
    """True where crc32 of the id as text leaves no remainder; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))


def few_by_hash(rows: DataFrame, id_col: str, max_rows: int) -> DataFrame:
    """rows whose hashed id is so small that about four times max_rows of them are left, if there are more than that.

    One count, then a filter in each task: what a following sort and limit gathers does not grow with the table.
    """
    total = rows.count()
    if total <= 4 * max_rows:
        return rows
    return rows.filter(F.xxhash64(id_col) < F.lit(-(2**63) + int(2**64 * (4 * max_rows / total))))


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, max_rows: int, training_only: bool) -> DataFrame:
    """(id, label) of at most max_rows labelled ids, one row an id, the same ones on every run.

    max_rows is the documented bound of every fit in this package: more labels never change driver memory.
    Ids whose labels disagree, null ids and null labels are left out. With training_only, held-out ids too.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).dropna()
    if training_only:
        rows = rows.filter(~held_out("id"))
    rows = few_by_hash(rows, "id", max_rows)
    one = rows.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other")
    return one.select("id", "label").orderBy(F.xxhash64("id"), "id").limit(max_rows)

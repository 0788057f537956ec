"""Line deduplication by site-relative frequency; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, bloom_split, refuse, staged, whole

#: Up to so many (host, line) rows are broadcast after they were counted; beyond, those of the largest hosts are.
BROADCAST_ROWS = 200_000
#: At most so many hosts count as the largest.
HOT_HOSTS = 1000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    """128 bits of the trimmed line; null for a blank one, which is never counted."""
    bare = F.trim(line, F.lit(BLANKS))
    return F.when(bare != "", F.unhex(F.md5(bare.cast("binary"))))


def _host(host_col: str) -> Column:
    return F.coalesce(F.col(host_col).cast("string"), F.lit(""))


def _beside(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """keyed (host, ...) with marked, the array of the host's lines in found (host, line, total); null without any.

    A host has at most (lines per page / ratio) boilerplate lines, so an array a host. Up to BROADCAST_ROWS rows of found
    are broadcast. Of more, those of the hosts with most pages are, so that no large host is shuffled; documents of the
    others meet their array by shuffling, if a Bloom filter says that their host may have one.
    """
    arrays = found.groupBy("host").agg(F.collect_list("line").alias("marked"), F.max("total").alias("total"))
    if found.count() <= BROADCAST_ROWS:
        return keyed.join(F.broadcast(arrays.drop("total")), "host", "left")
    hot, rows = [], 0
    for r in arrays.select("host", F.size("marked").alias("n")).orderBy(F.desc(arrays["total"]), "host").limit(HOT_HOSTS).collect():
        if (rows := rows + r["n"]) > BROADCAST_ROWS:
            break
        hot.append(r["host"])
    is_hot, arrays = F.col("host").isin(hot) if hot else F.lit(False), arrays.drop("total")
    large = keyed.filter(is_hot).join(F.broadcast(arrays.filter(is_hot)), "host", "left")
    hosts = staged(arrays.select("host"), "hosts")
    some, never = bloom_split(keyed.filter(~is_hot), F.col("host"), hosts)
    kind = arrays.schema["marked"].dataType
    return large.unionByName(some.join(arrays, "host", "left").select(large.columns)).unionByName(never.withColumn("marked", F.lit(None).cast(kind)).select(large.columns))


def boilerplate(docs: DataFrame, host_col: str, text_col: str, ratio: float, min_pages: int) -> DataFrame:
    """(host, line, total): lines (as keys) on so many pages of different texts that they make min_pages and over ratio of the host's.

    First every page counts a line once; then the few lines with enough pages are counted again over different texts, so
    that copies of one page lift none of its lines. The counts of (host, line) are partial sums, so neither a hot host
    nor a hot line meets in one task. Null hosts are one host.
    """
    pages = docs.select(_host(host_col).alias("host"), F.array_distinct(F.transform(_lines(F.col(text_col)), _key)).alias("lines"), F.xxhash64(text_col).alias("text"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    enough = (F.col("pages") >= min_pages) & (F.col("pages") > ratio * F.col("total"))

    def often(each: DataFrame) -> DataFrame:
        counts = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages)
        return counts.join(totals, "host").filter(enough).select("host", "line", "total")

    likely = staged(often(pages.select("host", F.explode("lines").alias("line")).filter("line IS NOT NULL")), "boilerplate-likely")
    some = _beside(pages, likely).filter("marked IS NOT NULL").select("host", "text", F.explode(F.array_intersect("lines", "marked")).alias("line"))
    return often(some.distinct())


def line_dedup(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", ratio: float = 0.01, min_pages: int = 3) -> DataFrame:
    """docs with two columns more, __n_lines and __n_dropped, and with text_col without its site's boilerplate lines.

    A line (\\n-split, compared without white space at its ends) is boilerplate on a host when pages of different texts,
    min_pages at least and over ratio of all the host's pages, contain it. All its occurrences go; the lines left are
    joined by \\n again. Blank lines stay. A page without boilerplate keeps its text as it is; null text stays null and
    has one blank line. Null hosts are one host; null ids and repeated rows are rows like any other, and an empty table
    gives none. All other columns pass through unchanged, whatever their names; only columns named like the two new
    ones are refused.
    """
    refuse(docs, "__n_lines", "__n_dropped")
    found = staged(boilerplate(docs, host_col, text_col, ratio, min_pages), "boilerplate")
    joined = _beside(docs.select(whole(docs).alias("row"), _host(host_col).alias("host")), found)
    text = F.col("row")[text_col]
    lines = _lines(text)
    left = F.when(F.col("marked").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("marked"), _key(x)), F.lit(False))))
    out = joined.withColumn("left", left).withColumn("n_lines", F.size(lines).cast("long"))
    out = out.withColumn("n_dropped", F.col("n_lines") - F.size("left"))
    new = F.when(F.col("n_dropped") > 0, F.array_join("left", "\n")).otherwise(text)
    return out.select(*(new.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns), F.col("n_lines").alias("__n_lines"), F.col("n_dropped").alias("__n_dropped"))

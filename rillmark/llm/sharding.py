"""Sharding by a minimax contiguous partition of atomic groups of equal texts; DataFrame operations only."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import running_sums
from .common import staged

#: Groups with one LARGE-th of all bytes at least, LARGE of them at most, come first, by size; the others follow by digest.
LARGE = 1 << 16
#: Of the ends of groups, the driver holds the least and the largest of so many blocks, and of so many pieces of each block a search has touched.
BLOCKS, PIECES = 4096, 64


class _Ends:
    """The places where groups end, in bytes from the start, known by blocks: (least end, largest end, number of ends).

    A look for an end that lies within a block gives the block's least or largest end instead and marks the block.
    """

    def __init__(self, ends: DataFrame, total: int):
        self.ends, self.total = ends, total
        self.blocks = self._read(F.floor((F.col("upto") - 1) * F.lit(BLOCKS) / F.lit(total)), None)
        self._index()

    def _read(self, bucket: Column, within: Column | None) -> list[tuple[int, int, int]]:
        rows = self.ends if within is None else self.ends.filter(within)
        own = rows.groupBy(bucket.alias("bucket")).agg(F.min("upto").alias("lo"), F.max("upto").alias("hi"), F.count(F.lit(1)).alias("n"))
        return sorted((r["lo"], r["hi"], r["n"]) for r in own.collect())  # BLOCKS rows, or PIECES for each block marked

    def _index(self) -> None:
        self.los, self.his = [b[0] for b in self.blocks], [b[1] for b in self.blocks]
        self.marked: set[int] = set()

    def floor(self, x: int) -> int:
        """The largest end up to x, 0 if there is none."""
        i = bisect_right(self.los, x) - 1
        if i < 0:
            return 0
        lo, hi, n = self.blocks[i]
        if x >= hi:
            return hi
        if n > 2:
            self.marked.add(i)
        return lo

    def ceil(self, x: int) -> int:
        """The least end from x on; 0 counts as one."""
        if x <= 0:
            return 0
        i = bisect_left(self.his, x)
        lo, hi, n = self.blocks[i]
        if x <= lo:
            return lo
        if n > 2 and x < hi:
            self.marked.add(i)
        return hi

    def refine(self) -> None:
        """Splits the marked blocks, in one job."""
        marked = [self.blocks[i] for i in sorted(self.marked)]
        keep = [b for i, b in enumerate(self.blocks) if i not in self.marked]
        bounds = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi, _ in marked])
        own = F.filter(bounds, lambda b: F.col("upto").between(b["lo"], b["hi"]))[0]
        piece = F.struct(own["lo"], F.floor((F.col("upto") - own["lo"]) * F.lit(PIECES) / (own["hi"] - own["lo"] + 1)))
        inside = F.exists(bounds, lambda b: F.col("upto").between(b["lo"], b["hi"]))
        self.blocks = sorted(keep + self._read(piece, inside & F.col("upto").between(marked[0][0], marked[-1][1])))
        self._index()


def _capacity(ends: _Ends, shards: int, largest: int) -> int:
    """The smallest capacity that so many shards, filled greedily one after another, need: found by binary search."""

    def enough(capacity: int) -> bool:
        at = 0
        for _ in range(shards):
            at = ends.floor(at + capacity)
        return at == ends.total

    lo = max(-(-ends.total // shards), largest)
    hi = lo + largest  # each shard then takes total / shards at least
    while lo < hi:
        mid = (lo + hi) // 2
        if enough(mid):
            hi = mid
        else:
            lo = mid + 1
    return lo


def _cuts(ends: _Ends, shards: int, capacity: int) -> list[int]:
    """The ends of all shards but the last, none over capacity, each as near to an equal share of what is left as that allows."""
    total, first = ends.total, [0] * shards
    at = total
    for k in range(shards - 1, 0, -1):  # the earliest end of shard k from which the rest can hold all that follows
        at = first[k] = ends.ceil(at - capacity)
    out, at = [], 0
    for k in range(1, shards):
        share = at + -(-(total - at) // (shards - k + 1))
        below, above = ends.floor(share), ends.ceil(min(share, total))
        near = below if below > at and share - below <= above - share else above
        at = min(max(near, first[k]), ends.floor(at + capacity))
        out.append(at)
    return out


def plan_cuts(ends: DataFrame, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """(capacity, cuts) over the ends of all groups (upto).

    The ends stay distributed: the search runs on blocks of them, and as long as it looked into a block, that block is
    read in finer pieces and the search runs again. What the driver holds is bounded by BLOCKS, and by PIECES for each
    look of a search, whatever the number of groups; each round makes the blocks looked into PIECES times finer.
    """
    known = _Ends(ends, total)
    while True:
        capacity = _capacity(known, shards, largest)
        cuts = _cuts(known, shards, capacity)
        if not known.marked:
            return capacity, cuts
        known.refine()


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard), one row per input row: shards of like size by bytes.

    A row's size is its text's UTF-8 bytes plus 1, a null text being empty. Rows of equal texts are a group, which one
    shard holds. Groups stand in an order, large ones first (LARGE), and are cut into contiguous shards whose largest is
    as small as any contiguous cut can make it; within that bound, shards are evened out. A group larger than a shard's
    equal share is a shard of its own, or nearly. slot numbers a shard's rows from 0, in the order of groups, then ids,
    null ids first; equal rows take neighbouring slots. law is "bytes", grown_shard null. With fewer groups than shards
    the last shards are empty; an empty table gives no rows; other columns are ignored, whatever their names.

    Texts are read once and never shuffled: a digest stands for a text. Group sizes are partial sums, positions sums of
    sorted ranges (running_sums); a row finds its shard by comparing its digest with those of the cuts, and its group's
    size only where that is large, so no join moves rows by group.
    """
    text = F.coalesce(text_col, F.lit(""))
    rows = staged(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest")), "shard-rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    total, largest = groups.agg(F.sum("bytes"), F.max("bytes")).first()
    law, none = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    if not total:
        return rows.select("id", "size", "text_crc32", law, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), none)
    is_large = F.col("bytes") * LARGE >= total
    ahead = F.when(is_large, -F.col("bytes")).otherwise(0).cast("long")
    ends = staged(running_sums(groups.withColumn("ahead", ahead), [F.col("ahead"), F.col("digest")], {"upto": "bytes"}), "shard-ends")
    _, cuts = plan_cuts(ends, total, largest, shards)
    last = {r["upto"]: (r["ahead"], bytes(r["digest"])) for r in ends.filter(F.col("upto").isin(cuts)).select("upto", "ahead", "digest").collect()}  # shards - 1 rows
    large = groups.filter(is_large).select("digest", ahead.alias("ahead"))  # at most LARGE rows
    placed = rows.join(F.broadcast(large), "digest", "left").withColumn("ahead", F.coalesce("ahead", F.lit(0)))
    behind = [(F.struct("ahead", "digest") > F.struct(F.lit(last[c][0]).cast("long").alias("ahead"), F.lit(last[c][1]).alias("digest"))) if c else F.lit(True) for c in cuts]
    placed = placed.withColumn("shard", sum((b.cast("int") for b in behind), F.lit(0))).withColumns({"one": F.lit(1), "nth": F.monotonically_increasing_id()})
    numbered = running_sums(placed, [F.col("ahead"), F.col("digest"), F.col("id"), F.col("nth")], {"place": "one"})
    sizes = placed.groupBy("shard").count().collect()  # shards rows
    before = F.create_map(*[F.lit(x) for s in range(shards) for x in (s, sum(r["count"] for r in sizes if r["shard"] < s))])
    return numbered.select("id", "size", "text_crc32", law, "shard", (F.col("place") - 1 - before[F.col("shard")]).cast("long").alias("slot"), none)

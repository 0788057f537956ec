"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union-find grouping."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, staged, with_ids
from .components import connected_components
from .text_batches import mix, shingle_set, slices, words

BAND_ROWS = 5
MISS = 1e-6
_RANK_BITS = np.uint64(44)
_SEED = np.uint64(0xD1B54A32D192ED03)


def bands_for(threshold: float, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    """So many bands that a pair at the threshold shares none with a probability of at most miss."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def superminhash(elements: np.ndarray, sizes: np.ndarray, m: int) -> np.ndarray:
    """Signatures (len(sizes), m) of the sets that lie one after the other in elements.

    Each element deals its ranks 0, 1, 2... to the m slots in the order of a random permutation of its own, and a slot
    keeps the smallest rank + fraction it was dealt. The ranks are dealt in rounds, to all sets at once; a set stops
    as soon as no slot is open, since a later round can only deal larger ranks. Sets larger than m mostly stop after
    the first one or two rounds. An empty set's slots stay at the largest value.
    """
    docs = np.repeat(np.arange(len(sizes)), sizes)
    sig = np.full(len(sizes) * m, np.iinfo(np.uint64).max, np.uint64)
    live, own = elements, docs
    perm = None
    for j in range(m):
        if not len(live):
            break
        r = mix(live + np.uint64(int(_SEED) * (j + 1) & (1 << 64) - 1))
        k = (j + (r >> _RANK_BITS) % np.uint64(m - j)).astype(np.intp)
        if perm is None:
            slot = k
        else:
            at = np.arange(len(live))
            slot = perm[at, k].astype(np.intp)
            perm[at, k] = perm[:, j]
            perm[:, j] = slot
        value = (np.uint64(j) << _RANK_BITS) | (r & np.uint64((1 << 44) - 1))
        np.minimum.at(sig, own * m + slot, value)
        is_open = (sig.reshape(-1, m) >= (np.uint64(m) << _RANK_BITS)).any(axis=1)
        keep = is_open[own]
        if perm is None:
            live, own, k = live[keep], own[keep], k[keep]
            perm = np.tile(np.arange(m, dtype=np.uint16), (len(live), 1))
            perm[np.arange(len(live)), k] = 0
            perm[:, 0] = k
        elif keep.mean() < 0.75:  # else carrying on with closed sets, which changes nothing, costs less
            live, own, perm = live[keep], own[keep], perm[keep]
    return sig.reshape(-1, m)


def _sketches(k: int, bands: int, rows: int):
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, 1, 500_000):  # superminhash holds m ranks for each shingle of a small set
            sets = [shingle_set([w.lower() for w in words(t)], k) for t in texts]
            sizes = np.array([len(s) for s in sets])
            sig = superminhash(np.concatenate(sets), sizes, m).reshape(len(sets), bands, rows)
            key = mix(sig[:, :, 0] + np.arange(1, bands + 1, dtype=np.uint64) * _SEED)
            for i in range(1, rows):
                key = mix(key * _SEED + sig[:, :, i])
            full = sizes > 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([list(x) if f else None for x, f in zip(key.view(np.int64), full)], pa.list_(pa.int64())),
                ],
                names=["id", "n_shingles", "set_key", "bands"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, 1):
            sets = [shingle_set([w.lower() for w in words(t)], k).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return run


def _linked(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(a) + len(b) - len(np.union1d(a, b))
                keep.append(den * both >= num * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    kind = pairs.schema["a"].dataType.simpleString()
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return both.mapInArrow(_linked(num, den), f"a {kind}, b {kind}").distinct()


def _spread(kind: str, columns: int):
    """Rows of the first columns and one shingle each, from rows whose next column holds a set's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = np.frombuffer(batch.column(columns)[i].as_py(), np.int64)
                one = batch.slice(i, 1).select(range(columns)).take(pa.array(np.zeros(len(own), np.int32)))
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array(own)], names=[*batch.schema.names[:columns], "shingle"])

    return run


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, node, n, component, d, diff) from (..., shingles, base): the shingles that only one of set and base has."""
    for batch in batches:
        diffs = []
        for own, base in zip(batch.column(4), batch.column(5)):
            mine = np.frombuffer(own.as_py(), np.int64)
            diffs.append(np.setxor1d(mine, base.values.to_numpy()) if base.is_valid else mine)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([len(x) for x in diffs], pa.int64()), pa.array(diffs, pa.list_(pa.int64()))], names=["grp", "node", "n", "component", "d", "diff"])


def _split(member: DataFrame) -> DataFrame:
    """The rows (bucket, node, n, component) of buckets that hold several components."""
    split = member.groupBy("bucket").agg(F.min("component").alias("p"), F.max("component").alias("q")).filter("p <> q").select("bucket")
    return member.join(split, "bucket", "left_semi")


def _loose_pairs(member: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of nodes of member (bucket, node, n, component), among them enough to join all linked components.

    A node that shares too few of its shingles with any other undecided node can have no link and leaves. The rest falls
    into groups, joined by the buckets that still hold several components. The shingles that over half of a group have
    are its base, and each set is held against it: diff, of d shingles, is what only one of the two has. Two sets are
    linked exactly if |diff ^ diff'| * (den + num) <= (den - num) * (n + n'), so with k = (den + num) * d - (den - num) * n
    if they share at least (k + k') / 2 / (den + num) shingles of their diffs. Where k + k' <= 0 nothing need be shared,
    and then both are linked with the node of the smallest k, the group's hub: one pair a node. All other pairs share
    one of the rarest shingles of their diffs, at a place of both that leaves enough behind it (prefix filter); a place is
    joined only if another one of its shingle could be its partner. Copies of one text, each changed in other places,
    differ from their base by little that others share, so few places are left whatever the group's size.
    """
    kind = member.schema["node"].dataType.simpleString()
    undecided = _split(member)
    nodes = staged(undecided.select("node", "n", "component").distinct(), "near-undecided")
    if nodes.isEmpty():
        return nodes.select(F.col("node").alias("a"), F.col("node").alias("b"))
    each = nodes.join(sets, nodes["node"] == sets["id"]).select("node", "n", "shingles").mapInArrow(_spread(kind, 2), f"node {kind}, n bigint, shingle bigint")
    common = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("f")).filter("f > 1").select("shingle")
    able = each.join(common, "shingle").groupBy("node", "n").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") * den >= F.col("n") * num).select("node")
    live = staged(_split(undecided.join(able, "node", "left_semi")), "near-live")
    if live.isEmpty():
        return live.select(F.col("node").alias("a"), F.col("node").alias("b"))

    firsts = live.groupBy("bucket").agg(F.min("node").alias("a"))
    groups = connected_components(live.join(firsts, "bucket").select("a", F.col("node").alias("b")).distinct())
    own = staged(live.select("node", "n", "component").distinct().join(groups.withColumnRenamed("component", "grp"), "node").select("grp", "node", "n", "component"), "near-groups")
    full = own.join(sets, own["node"] == sets["id"]).select("grp", "node", "n", "component", "shingles")
    shingles = full.select("grp", "shingles").mapInArrow(_spread(kind, 1), f"grp {kind}, shingle bigint")
    size = own.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    base = shingles.groupBy("grp", "shingle").agg(F.count(F.lit(1)).alias("f")).join(size, "grp").filter("2 * f > size").groupBy("grp").agg(F.collect_list("shingle").alias("base"))
    diff = staged(full.join(base, "grp", "left").mapInArrow(_differences, f"grp {kind}, node {kind}, n bigint, component {kind}, d bigint, diff array<bigint>"), "near-diffs")

    whole, rest = den + num, den - num
    keyed = diff.withColumn("k", F.col("d") * whole - F.col("n") * rest)
    hubs = keyed.groupBy("grp").agg(F.min(F.struct("k", "node", "component")).alias("hub"))
    near = keyed.join(hubs, "grp").filter(F.col("k") + F.col("hub.k") <= 0).select("grp", "component", "node", F.col("hub.node").alias("h"), F.col("hub.component").alias("hc"))
    near = staged(near, "near-hubs")
    hub_pairs = near.filter("component <> hc").select(F.least("h", "node").alias("a"), F.greatest("h", "node").alias("b"))
    inside = near.select("grp", "component", F.lit(False).alias("out")).distinct()
    placed = keyed.join(inside, ["grp", "component"], "left").withColumn("out", F.coalesce("out", F.lit(True)))
    placed = placed.join(placed.filter("out").select("grp").distinct(), "grp", "left_semi")
    posts = placed.select("grp", "node", "component", "out", "k", "n", "d", F.explode("diff").alias("shingle"))
    often = posts.groupBy("grp", "shingle").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    w = Window.partitionBy("node")
    at = F.col("d") - F.count(F.lit(1)).over(w) + F.row_number().over(w.orderBy("f", "shingle")) - 1
    slack = F.col("d") * whole + F.col("n") * rest - 2 * whole * at  # the largest k of a partner that first meets here
    every = staged(posts.join(often, ["grp", "shingle"]).withColumn("slack", slack).select("grp", "shingle", "node", "component", "out", "k", "slack"), "near-posts")
    of_out = lambda c: F.when(F.col("out"), F.col(c))
    seen = every.groupBy("grp", "shingle").agg(F.min("k").alias("k0"), F.max("slack").alias("s0"), F.min(of_out("k")).alias("k1"), F.max(of_out("slack")).alias("s1"))
    low, high = F.when(F.col("out"), F.col("k0")).otherwise(F.col("k1")), F.when(F.col("out"), F.col("s0")).otherwise(F.col("s1"))
    posts = every.join(seen, ["grp", "shingle"]).filter((F.col("slack") >= low) & (F.col("k") <= high)).select("grp", "shingle", "node", "component", "out", "k", "slack")
    posts = staged(posts, "near-posts")
    few = posts.filter("out").select("grp", "shingle", F.col("node").alias("p"), F.col("component").alias("pc"), F.col("k").alias("pk"), F.col("slack").alias("ps"))
    meet = (F.col("component") != F.col("pc")) & (F.col("slack") >= F.col("pk")) & (F.col("ps") >= F.col("k")) & (~F.col("out") | (F.col("p") < F.col("node")))
    pairs = posts.join(few, ["grp", "shingle"]).filter(meet).select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b"))
    out = staged(hub_pairs.unionByName(pairs).distinct(), "near-loose")
    discard(nodes, live, own, diff, near, every, posts)
    return out


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, num: int = 4, den: int = 5, rows: int = BAND_ROWS, miss: float = MISS
) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per input row.

    A text's set: its distinct shingles of shingle_words words, A-Z in lower case; with fewer words, the whole sequence
    as one. Texts are linked when den * |intersection| >= num * |union|, checked on full sets; component_id is the
    smallest id that links reach. Candidates come from bands of SuperMinHash signatures (bands_for gives their number;
    a link at the threshold shares no band with a probability of at most miss). Equal sets are one node from the start.
    In a bucket every node meets the bucket's smallest. Nodes of buckets that these links leave in several components
    then meet by what they differ in from their group's common shingles (_loose_pairs), which misses no link between two
    components. So a bucket of n copies costs n pairs, not n * n, in groups of looser copies too.

    Null or blank texts have no shingles and are linked with nothing. A null id is never a node: its row gets the
    component of an equal set, if there is one, else null. Rows that repeat an id are one node. Other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    bands = bands_for(num / den, rows, miss)
    sketch = staged(base.mapInArrow(_sketches(shingle_words, bands, rows), f"id {kind}, n_shingles bigint, set_key binary, bands array<bigint>"), "near-sketch")
    nodes = sketch.filter("n_shingles > 0 AND id IS NOT NULL").groupBy("set_key").agg(F.min("id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = staged(nodes, "near-nodes")

    band = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = band.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("bucket", "first")
    member = staged(band.join(shared, "bucket").select("bucket", "node", "n", "first"), "near-buckets")
    fits = lambda p, q: F.lit(den) * F.least(p, q) >= F.lit(num) * F.greatest(p, q)  # noqa: E731  sets of too unlike sizes can't be linked
    star = member.filter(F.col("node") != F.col("first.node")).filter(fits(F.col("n"), F.col("first.n"))).select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct()
    star = staged(star, "near-star")

    involved = staged(member.select("node").distinct(), "near-involved")
    sets = staged(with_ids(base.select("id", "text"), "id", involved).mapInArrow(_sets(shingle_words), f"id {kind}, shingles binary"), "near-sets")
    links = staged(_verified(star, sets, num, den), "near-links")

    joined = connected_components(links)
    now = staged(member.join(joined, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component")), "near-now")
    pairs = _loose_pairs(now, sets, num, den)
    links = links.unionByName(staged(_verified(pairs, sets, num, den), "near-links"))
    components = connected_components(links)
    of_set = staged(nodes.join(components, "node", "left").select("set_key", F.coalesce("component", "node").alias("component")), "near-of-set")
    discard(nodes, member, star, involved, sets, now, pairs)
    again = sketch.select("id", "n_shingles", "set_key").join(of_set, "set_key", "left")
    component = F.coalesce("component", "id")
    return again.select("id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))

"""Filter interaction audit: what each filter removes, in every order of five filters, by min-plus removal ranks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{m} bigint" for m in MEASURES)


def conditions(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides: too few words, few different ones, capitals, symbols."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    sizes = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": sizes["all"] < 200,
        "B": 100 * sizes["distinct"] < 50 * sizes["all"],
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part by the filters they fail (bit i for the i-th filter), and how many are labelled.

    A text's digest stands for it. A document is a repeat (E) if a smaller id has its text; of the documents of a text,
    those with its smallest id and those without an id are not. These are found by counts of a text's documents by part,
    mask and labels, which are summed before they are shuffled, so that copies by the million meet as a few rows. Texts
    are read once and never shuffled; the counts are staged, as the smallest ids are found from them too. Null texts are empty, null parts the empty string; of an id labelled more than
    once, any label counts; repeated rows count each.
    """
    text = F.coalesce(text_col, F.lit(""))
    # one lambda a row, so that the words are split once
    fails = F.transform(F.array(text), lambda t: reduce(Column.__add__, (F.shiftleft(c.cast("int"), FILTERS.index(f)) for f, c in conditions(t).items())))[0]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), fails.alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    own = labels.select(F.col(id_col).alias("id"), F.col("quality"), F.col("toxic")).filter("id IS NOT NULL").groupBy("id")
    marks = own.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marked = rows.join(marks, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    kind = ["digest", "part", "mask", "good", "toxic"]
    each = marked.groupBy(*kind, "id").agg(F.count(F.lit(1)).alias("n"))
    some = staged(each.groupBy(*kind).agg(F.sum("n").alias("n"), F.min("id").alias("id"), F.min_by("n", "id").alias("firsts"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("nameless")), "audit")
    least = some.groupBy("digest").agg(F.min("id").alias("least"))
    told = some.join(least, "digest")
    new = F.col("nameless") + F.when(F.col("id") == F.col("least"), F.col("firsts")).otherwise(0)
    repeat = 1 << FILTERS.index("E")
    split = told.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask"), new.alias("n")), F.struct((F.col("mask") + repeat).alias("mask"), (F.col("n") - new).alias("n")))).alias("x"))
    split = split.select("part", "good", "toxic", "x.mask", "x.n")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("good"), F.col("n"))), F.lit(0)).alias("good"), F.coalesce(F.sum(F.when(F.col("toxic"), F.col("n"))), F.lit(0)).alias("toxic"))


def removal_steps(orders: list[str] = ORDERS, filters: str = FILTERS) -> np.ndarray:
    """(orders, masks): the step at which an order removes a mask's documents, len(filters) where none does.

    The min-plus product of the position matrix (orders, filters), each row an order's inverse permutation, and the mask
    matrix (filters, masks), 0 where a mask fails a filter and infinite where it passes.
    """
    k = len(filters)
    position = np.array([[o.index(f) for f in filters] for o in orders])
    failed = (np.arange(1 << k)[None, :] >> np.arange(k)[:, None]) & 1
    weight = np.where(failed == 1, 0, k)  # k stands for infinity: no position reaches it
    return np.minimum((position[:, :, None] + weight[None, :, :]).min(axis=1), k)


def audit(counts: np.ndarray, steps: np.ndarray, orders: list[str] = ORDERS, filters: str = FILTERS) -> np.ndarray:
    """(orders, filters, measures) of MEASURES from counts (3, masks): documents, good and toxic ones by mask."""
    k, n = len(filters), len(orders)
    lost = np.zeros((3, n, k + 1), np.int64)  # weighted scatter: what falls at a step, the last column what stays
    for w in range(3):
        np.add.at(lost[w], (np.arange(n)[:, None], steps), counts[w][None, :])
    removed = lost[0, :, :k]
    which = np.array([[filters.index(f) for f in o] for o in orders])
    fails = (np.arange(1 << k)[None, :] >> np.arange(k)[:, None]) & 1
    failing = fails @ counts[0]
    alone = counts[0][1 << np.arange(k)]
    shapley = np.bincount(which.ravel(), removed.ravel().astype(np.float64), k).astype(np.int64)
    kept = counts[0].sum() - np.cumsum(removed, axis=1)
    # a filter's failing documents fall at its own step or earlier
    return np.stack((kept, removed, failing[which] - removed, alone[which], lost[1, :, :k], lost[2, :, :k], shapley[which]), axis=2)


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, filter_order and step (1 to 5): what the order's filter of that step does to the part.

    kept are left after the step, removed fall at it, redundant fail its filter but fell earlier, unique_fails fail it
    alone; good_lost and toxic_lost are the removed ones labelled quality 1 and toxic 1; shapley is what the filter
    removes in all orders together. A part is a value of part_col; null is the empty string. No documents, no rows. Only
    counts by part and mask (mask_counts) reach the matrices, at most MASKS rows a part.
    """
    counts = mask_counts(docs, labels, id_col, text_col, part_col)
    kinds = ("n", "good", "toxic")
    wide = counts.groupBy("part").agg(*(F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).alias(f"{c}{m}") for c in kinds for m in range(MASKS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = removal_steps()
        order = pa.array([o for o in ORDERS for _ in FILTERS])
        step = pa.array([*range(1, len(FILTERS) + 1)] * len(ORDERS), pa.int32())
        for batch in batches:
            table = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1) if batch.num_rows else np.empty((0, 3 * MASKS))
            for part, row in zip(batch.column(0).to_pylist(), table):
                found = audit(row.astype(np.int64).reshape(3, MASKS), steps).reshape(-1, len(MEASURES))
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(found), pa.string()), order, step, *(pa.array(m) for m in found.T)], names=["part", "filter_order", "step", *MEASURES])

    return wide.mapInArrow(run, SCHEMA)

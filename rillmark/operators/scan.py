"""Running values in the order of a key's rows, spread over tasks where a key is hot.

A window puts all of a key's rows into one task. Here the rows of hot keys are cut into blocks by the first column of
their order; windows run in each block, and every block adds one carried value of the blocks before (or behind) it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

#: A key is hot with more rows than HOT_ROWS, if it is among the MOST_KEYS largest: any other has under 1 / MOST_KEYS of all rows.
HOT_ROWS, MOST_KEYS = 1_000_000, 4096
#: What Spark expects to be smaller than this, about one task's input, is not looked through for hot keys.
SMALL_BYTES = 64 << 20
#: A hot key's rows are cut into so many blocks at most.
BLOCKS = 64


def is_small(*tables: DataFrame) -> bool:
    """Whether all tables together are under SMALL_BYTES by the optimizer's estimate; no job is run. Only plans depend on it."""
    return sum(int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in tables) < SMALL_BYTES


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(Column.__and__, (a[n].eqNullSafe(b[f"__{n}"]) for n in names))


def _cuts(df: DataFrame, key: list[str], order: str, hot_rows: int) -> DataFrame:
    """(__key..., __cuts) of df's hot keys, MOST_KEYS rows at most.

    Keys are counted by a mergeable sketch of the most frequent hashes, so nothing of a row is shuffled; it tracks three
    times MOST_KEYS, misses by under 1 / MOST_KEYS of all rows, and is exact where there are fewer keys. Without a hot
    key, adaptive execution drops the second scan.
    """
    tracked = df.select(F.xxhash64(*key).alias("__h")).agg(F.expr(f"approx_top_k(__h, {MOST_KEYS}, {3 * MOST_KEYS})").alias("__top"))
    hot = tracked.selectExpr("inline(__top)").filter(F.col("count") > hot_rows).select(F.col("item").alias("__h"))
    own = df.select(*key, order).withColumn("__h", F.xxhash64(*key)).join(F.broadcast(hot), "__h", "left_semi")
    return own.groupBy(*(F.col(k).alias(f"__{k}") for k in key)).agg(F.percentile_approx(order, [i / BLOCKS for i in range(1, BLOCKS)], 1000).alias("__cuts"))


def _blocked(df: DataFrame, key: list[str], order: str, cuts: DataFrame, how: str) -> DataFrame:
    rows = df.join(F.broadcast(cuts), _same(df, cuts, key), how)
    block = F.size(F.filter("__cuts", lambda c: c < F.col(order)))
    return rows.withColumn("__block", F.when(F.col("__cuts").isNotNull(), block + 1).otherwise(0)).select(*df.columns, "__block")


def spread(df: DataFrame, key: list[str], order: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """df with __block: 0 for all rows of a common key, and for a hot key the block of its row by order, in order.

    Rows with equal values of order are in one block, null ones in the first. The hot keys are at most MOST_KEYS rows,
    which are broadcast with their cuts; without any, adaptive execution drops the work for them.
    """
    if hot_rows >= HOT_ROWS and is_small(df):
        return df.withColumn("__block", F.lit(0))
    return _blocked(df, key, order, _cuts(df, key, order, hot_rows), "left")


#: By kind: a block's own value from its windows (upto the row, before it), what a block hands on, how blocks add up.
#: "sum" and "last" (the last value not null) include the row, "count" numbers rows from 1, "max_before" leaves the row
#: out, "next" is the value of the row behind.


def running(df: DataFrame, key: list[str], order: list[str], values: dict[str, tuple[str, str]], hot_rows: int = HOT_ROWS, keep_block: bool = False, small: bool | None = None) -> DataFrame:
    """df with one more column for each of values (name: (kind, column)): running values of a key's rows in ascending order.

    Equal to windows partitioned by key and ordered by order, which must tell a key's rows apart where that matters. Hot
    keys, with a third of all rows say, are worked on in blocks by many tasks. With keep_block, the rows' blocks stay as
    __block, and a second scan of the same rows in the same order uses them again. small says that the rows are few where
    the optimizer can't tell, as behind a join.
    """
    plain = hot_rows >= HOT_ROWS and (is_small(df) if small is None else small)
    if "__block" in df.columns or plain:
        own = df if "__block" in df.columns else df.withColumn("__block", F.lit(0))
        blocks = own.filter("__block > 0")
    else:
        cuts = _cuts(df, key, order[0], hot_rows)
        own, blocks = (_blocked(df, key, order[0], cuts, how) for how in ("left", "inner"))  # no scan of blocks where there are none
    w = Window.partitionBy(*key, "__block").orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)
    local = {
        "sum": lambda c: F.sum(c).over(upto),
        "last": lambda c: F.last(c, ignorenulls=True).over(upto),
        "count": lambda c: F.row_number().over(w).cast("long"),
        "max_before": lambda c: F.max(c).over(before),
        "next": lambda c: F.lead(F.struct(c)).over(w),
    }
    rest = [c for c in df.columns if c != "__block"] + (["__block"] if keep_block else [])
    rows = own.withColumns({n: local[kind](c) for n, (kind, c) in values.items()})
    if plain:
        return rows.select(*rest, *((F.col(f"{n}.{c}") if kind == "next" else F.col(n)).alias(n) for n, (kind, c) in values.items()))
    hands_on = {
        "sum": F.sum,
        "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)),
        "count": lambda c: F.count(F.lit(1)),
        "max_before": F.max,
        "next": lambda c: F.min_by(F.struct(c), at),
    }
    totals = blocks.groupBy(*(F.col(k).alias(f"__{k}") for k in key), F.col("__block").alias("____block")).agg(*(hands_on[kind](c).alias(f"__{n}") for n, (kind, c) in values.items()))
    wt = Window.partitionBy(*(f"__{k}" for k in key)).orderBy("____block")  # BLOCKS rows a key
    earlier = wt.rowsBetween(Window.unboundedPreceding, -1)
    adds_up = {
        "sum": lambda c: F.sum(c).over(earlier),
        "last": lambda c: F.last(c, ignorenulls=True).over(earlier),
        "count": lambda c: F.sum(c).over(earlier),
        "max_before": lambda c: F.max(c).over(earlier),
        "next": lambda c: F.lead(c).over(wt),
    }
    carried = totals.select(*(f"__{k}" for k in key), "____block", *(adds_up[kind](f"__{n}").alias(f"__{n}") for n, (kind, _) in values.items()))

    def joined(name: str, kind: str) -> Column:
        mine, past = F.col(name), F.col(f"__{name}")
        if kind == "count":
            return mine + F.coalesce(past, F.lit(0))
        if kind == "sum":
            return F.coalesce(mine + past, mine, past)
        if kind == "max_before":
            return F.greatest(mine, past)
        both = F.coalesce(mine, past)
        return both if kind == "last" else F.get(F.array(both.getField(values[name][1])), F.lit(0))

    rows = rows.join(F.broadcast(carried), _same(rows, carried, [*key, "__block"]), "left")  # at most MOST_KEYS * BLOCKS rows
    return rows.select(*rest, *(joined(n, kind).alias(n) for n, (kind, _) in values.items()))


def running_all(df: DataFrame, order: list[Column], values: dict[str, tuple[str, str]]) -> DataFrame:
    """df with one more column for each of values (name: ("sum" or "last", column)), running over all rows in order.

    Rows are dealt to tasks by ranges of the order and staged; a range's rows add up in its task, and what the ranges
    before come to, one row a range, is broadcast. "last" is the last value not null.
    """
    named = {f"__o{i}": o for i, o in enumerate(order)}
    own = staged(df.withColumns(named).repartitionByRange(*named).withColumn("__range", F.spark_partition_id()))
    at = F.struct(*named)
    comes_to = {"sum": F.sum, "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at))}
    totals = own.groupBy("__range").agg(*(comes_to[kind](c).alias(f"__{n}") for n, (kind, c) in values.items()))
    earlier = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    over = {"sum": lambda c, w: F.sum(c).over(w), "last": lambda c, w: F.last(c, ignorenulls=True).over(w)}
    past = totals.select("__range", *(over[kind](f"__{n}", earlier).alias(f"__{n}") for n, (kind, _) in values.items()))
    w = Window.partitionBy("__range").orderBy(*named).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = own.withColumns({n: over[kind](c, w) for n, (kind, c) in values.items()}).join(F.broadcast(past), "__range")
    joined = {"sum": lambda n: F.coalesce(F.col(n) + F.col(f"__{n}"), n, f"__{n}"), "last": lambda n: F.coalesce(n, f"__{n}")}
    return rows.select(*df.columns, *(joined[kind](n).alias(n) for n, (kind, _) in values.items()))


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with one more column for each of sums (name: column): its sum over all rows up to this one, in order."""
    return running_all(df, order, {n: ("sum", c) for n, c in sums.items()})

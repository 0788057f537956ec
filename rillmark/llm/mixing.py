"""Mixing sources to target weights: raking by iterative proportional fitting, then sampling; DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import running_sums
from .common import discard, refuse, staged, whole

#: Up to so many cells are raked in one task, and so many at a time are broadcast to the documents.
SMALL_CELLS, BROADCAST_CELLS = 50_000, 200_000
#: Raking goes on while the residual falls by this share at least from one look to the next.
PROGRESS = 0.01
#: The part of a hash that a sampling decision uses: 13 hexadecimal digits, which a double holds exactly.
HEX = 13
OTHER = "other"
#: Topic words have so many letters, and stand in one of RARE documents of their class at least, one of COMMON at most.
LETTERS, RARE, COMMON = (5, 20), 200, 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A dimension's target: weights by class; None, the same weight for every class; or a number, the power to which each
#: class's own share is raised (1 leaves the shares as they are, 0 makes them alike).
Target = dict[str, float] | float | None


def topic_words(docs: DataFrame, by: Column, text_col: str = "text", k: int = 3) -> list[str]:
    """Of each class of by (a language, say), the k words of most documents: in one of RARE at least, one of COMMON at most.

    Words are of LETTERS letters a to z. Document frequencies cover all whole texts, as partial sums; at most RARE words
    for each word of a text pass the lower bound, and only k words a class reach the driver. Classes and their words in
    order; a word that several classes share counts for the first.
    """
    rows = docs.select(F.coalesce(by.cast("string"), F.lit(OTHER)).alias("by"), F.array_distinct(F.filter(_letters(F.col(text_col)), lambda w: F.length(w).between(*LETTERS))).alias("words"))
    sizes = rows.groupBy("by").agg(F.count(F.lit(1)).alias("docs"))
    each = rows.select("by", F.explode("words").alias("word"))
    common = each.groupBy("by", "word").agg(F.count(F.lit(1)).alias("df")).join(sizes, "by").filter((F.col("df") * RARE >= F.col("docs")) & (F.col("df") * COMMON <= F.col("docs")))
    best = common.withColumn("r", F.row_number().over(Window.partitionBy("by").orderBy(F.desc("df"), "word"))).filter(F.col("r") <= k)
    return list(dict.fromkeys(r["word"] for r in best.orderBy("by", "r").collect()))


def _letters(text: Column) -> Column:
    return F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), "[^a-z]+")


def topic(text: Column, words: list[str]) -> Column:
    """The topic word that a text has most often, the first of words among equals; OTHER without any."""
    if not words:
        return F.lit(OTHER)
    hits = F.filter(_letters(text), lambda w: w.isin(words))

    def best(h: Column) -> Column:
        counted = [F.struct(F.size(F.array_remove(h, w)).alias("others"), F.lit(i).alias("at"), F.lit(w).alias("word")) for i, w in enumerate(words)]
        return F.when(F.size(h) == 0, F.lit(OTHER)).otherwise(F.array_min(F.array(*counted))["word"])

    return F.transform(F.array(hits), best)[0]  # within a lambda, the words are looked for once


def tokens(text: Column) -> Column:
    """Words as a stand-in for tokens; at least 1, so that every document has a weight."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("long")


def chance(id_col: str) -> Column:
    """A number in [0, 1) that an id always gets; the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, HEX), 16, 10).cast("double") / float(16**HEX)


def _class_targets(cells: DataFrame, dim: str, target: Target, budget: float) -> DataFrame:
    """(dim, t_dim): the tokens to keep of every class, budget in all: in proportion to its weight, but no more than it has.

    What a class has too little of goes to the others in proportion. In the order of has / weight, the classes that are
    taken whole come first, and the scale of the others is what they leave of the budget over the weights behind them;
    the first class that has enough at its own place's scale gives the scale of all. Sums over sorted classes are sums of
    the blocks before and of the rows in a block (running), so no number of classes meets in one task. A class without a
    weight gets OTHER's, else none.
    """
    own = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("has"))
    if isinstance(target, dict):
        weight = F.coalesce(F.create_map(*[F.lit(x) for kv in target.items() for x in kv])[F.col(dim)], F.lit(float(target.get(OTHER, 0.0)))).cast("double")
    else:
        weight = F.lit(1.0) if target is None else F.pow("has", F.lit(float(target)))
    classes = staged(own.select(dim, "has", weight.alias("weight")), "classes")
    some = classes.filter("weight > 0").withColumn("full_at", F.col("has") / F.col("weight"))
    sums = running_sums(some, [F.col("full_at"), F.col(dim)], {"used": "has", "passed": "weight"})
    whole_weight = some.agg(F.sum("weight")).first()[0] or 0.0
    scale = (F.lit(float(budget)) - (F.col("used") - F.col("has"))) / (F.lit(float(whole_weight)) - (F.col("passed") - F.col("weight")))
    first = sums.withColumn("scale", scale).filter("full_at >= scale").agg(F.min_by("scale", F.struct("full_at", dim))).first()[0]
    return classes.select(dim, F.least(F.col("has"), F.col("weight") * (1e300 if first is None else first)).alias(f"t_{dim}"))


def rake(cells: DataFrame, targets: dict[str, Target], rate: float, tolerance: float = 1e-3, every: int = 5) -> DataFrame:
    """cells (dims..., tokens) with keep, the expected tokens kept of a cell, and residual.

    Iterative proportional fitting within bounds: from rate * tokens, each round scales every dimension's classes in
    turn to their targets (_class_targets), then cuts what exceeds a cell's tokens. Every few rounds it looks how far, in
    proportion, the worst class is from its target (residual, the same in each row), and stops within tolerance, or
    where the distance has not fallen by PROGRESS since the last look: then the bounds and targets contradict each
    other, and a residual over tolerance says so. Up to SMALL_CELLS cells are one partition, whose windows need no
    exchange; of more, a class's sum is a partial aggregate joined back, so that no class meets in one task.
    """
    total, n = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count(F.lit(1))).first()
    now = cells.withColumn("keep", F.col("tokens") * float(rate))
    for dim, target in targets.items():
        now = now.join(_class_targets(cells, dim, target, rate * total), dim)
    now, columns, residual = staged(now, "raked"), now.columns, None
    small = n <= SMALL_CELLS

    def distance(df: DataFrame) -> float:
        """How far the worst class is from its target."""
        off = lambda d: F.when(F.col(f"t_{d}") > 0, F.abs(F.col("own") / F.col(f"t_{d}") - 1)).otherwise(0.0)
        if small:
            for d in targets:
                df = own(df.coalesce(1), d).withColumn(f"off_{d}", off(d)).drop("own")
            worst = [df.select(F.greatest(F.lit(0.0), *(F.col(f"off_{d}") for d in targets)).alias("off"))]
        else:
            worst = [df.groupBy(d).agg(F.sum("keep").alias("own"), F.first(f"t_{d}").alias(f"t_{d}")).select(off(d).alias("off")) for d in targets]
        return reduce(DataFrame.unionByName, worst).agg(F.coalesce(F.max("off"), F.lit(0.0))).first()[0]

    def own(df: DataFrame, dim: str) -> DataFrame:
        if small:
            return df.withColumn("own", F.sum("keep").over(Window.partitionBy(dim)))
        return df.join(df.groupBy(dim).agg(F.sum("keep").alias("own")), dim)

    while True:
        last, residual = residual, distance(now)
        if residual <= tolerance or (last is not None and residual > last * (1 - PROGRESS)):
            return now.select(*cells.columns, "keep").withColumn("residual", F.lit(float(residual)))
        start = now
        for k in range(every):
            now = now.coalesce(1) if small else now
            for dim in targets:
                scaled = F.when(F.col("own") > 0, F.col("keep") * F.col(f"t_{dim}") / F.col("own")).otherwise(0.0)
                now = own(now, dim).withColumn("keep", scaled).select(columns)
            now = now.withColumn("keep", F.least("keep", F.col("tokens").cast("double")))
            if not small or k == every - 1:
                now = staged(now, "raked")
        discard(start)


def mix(docs: DataFrame, targets: dict[str, Target], dims: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", rate: float = 0.5, tolerance: float = 1e-3, every: int = 5, carry: list[str] | None = None) -> DataFrame:
    """docs with __tokens, __p, __residual and __kept: a sample whose token weights follow the targets.

    dims: the classes of a document by dimension; a null class is OTHER. Tokens are summed by cell (a combination of
    classes that documents have), the cells raked to rate of all tokens (rake), and a cell's documents kept with
    probability keep / tokens, at most 1. A document is kept if the hash of its id falls below its probability, so
    repeated rows share their fate and a run can be repeated. A null id hashes as an empty one. Documents are never
    shuffled: cells come to them by broadcast, BROADCAST_CELLS at a time. No document is dropped by anything but its
    probability; null and empty texts weigh 1 token; an empty table gives none. Other columns pass through unchanged,
    whatever their names; only columns named like the new ones are refused. __residual is how far, in proportion, the
    worst class is from its target. carry names the columns of docs that the result needs, all by default; without the
    text among them, what is read of the texts is staged, and the texts are read once.
    """
    refuse(docs, "__tokens", "__p", "__residual", "__kept")
    rows = docs.select((whole(docs.select(*carry)) if carry else whole(docs)).alias("row"), F.struct(*(F.coalesce(c.cast("string"), F.lit(OTHER)).alias(d) for d, c in dims.items())).alias("cell"), tokens(F.col(text_col)).alias("tokens"), chance(id_col).alias("chance"))
    if carry and text_col not in carry:
        rows = staged(rows, "mixing-rows")
    cells = staged(rows.groupBy("cell").agg(F.sum("tokens").alias("tokens")).select("cell.*", "tokens"), "cells")
    found = staged(rake(cells, targets, rate, tolerance, every), "cells-raked")
    found = found.select(F.struct(*dims).alias("cell"), (F.col("keep") / F.col("tokens")).alias("p"), "residual")
    parts = max(1, -(-found.count() * 5 // (BROADCAST_CELLS * 4)))  # parts by hash are not quite equal
    rows = rows.withColumns({"p": F.lit(None).cast("double"), "residual": F.lit(None).cast("double")})
    for k in range(parts):
        some = found.filter(F.pmod(F.xxhash64("cell"), F.lit(parts)) == k).toDF("cell", "_p", "_residual")
        rows = rows.join(F.broadcast(some), "cell", "left").select("row", "cell", "tokens", "chance", F.coalesce("p", "_p").alias("p"), F.coalesce("residual", "_residual").alias("residual"))
    return rows.select("row.*", F.col("tokens").alias("__tokens"), F.col("p").alias("__p"), F.col("residual").alias("__residual"), (F.col("chance") < F.col("p")).alias("__kept"))

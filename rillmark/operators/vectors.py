"""Scoring vectors against templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from .scan import running_sums


#: Templates are scored in blocks of so many.
BLOCK = 256


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def mean_template(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, template): the element-wise mean of each label's vectors."""
    each = df.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("template"))


def correlation(a: Column, b: Column, mask: Column | None = None) -> Column:
    """Normalized correlation of arrays about their means, -1 to 1; 0 where one is constant. mask: an array of 0 and 1.

    Written with sums of products: a mean inside a lambda would be computed again for each element.
    """
    if mask is not None:
        keep = lambda v: F.transform(F.filter(F.arrays_zip(v.alias("v"), mask.alias("m")), lambda s: s["m"] > 0), lambda s: s["v"])
        a, b = keep(a), keep(b)
    n, sum_of = F.size(a), lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    x, y = sum_of(a), sum_of(b)
    norm = F.sqrt((_dot(a, a) - x * x / n) * (_dot(b, b) - y * y / n))
    return F.when(norm > 0, (_dot(a, b) - x * y / n) / norm).otherwise(0.0)


def difference_confidence(a: Column, b: Column, largest: float, mask: Column | None = None) -> Column:
    """1 - the squared difference over its greatest possible value, of all elements even where a mask leaves some out."""
    d = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))
    if mask is not None:
        d = F.zip_with(d, mask, lambda x, m: x * m)
    return 1 - F.least(F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / (F.size(a) * largest**2), F.lit(1.0))


def _unit(v: Column) -> Column:
    """v less its mean, at length 1; zeros where v is constant. Then a correlation is a dot product."""
    n, total = F.size(v), F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    norm = F.sqrt(F.greatest(_dot(v, v) - total * total / n, F.lit(0.0)))
    parts = F.struct((total / n).alias("mean"), norm.alias("norm"))
    return F.transform(F.array(parts), lambda p: F.transform(v, lambda x: F.when(p["norm"] > 0, (x.cast("double") - p["mean"]) / p["norm"]).otherwise(0.0)))[0]


def template_blocks(templates: DataFrame, label: str) -> DataFrame:
    """(block, center, radius, templates) of up to BLOCK templates each, in the order of their labels.

    center is the mean of the block's unit vectors, radius the largest distance of one from it.
    """
    # a row a template; neighbours in order make a block
    one = templates.select(F.col(label).alias("l"), _unit(F.col("template")).alias("u"), F.lit(1).alias("one"))
    nth = running_sums(one, [F.col("l")], {"nth": "one"}).select("l", "u", "nth", F.floor((F.col("nth") - 1) / BLOCK).cast("long").alias("block"))
    mean = nth.select("block", F.posexplode("u").alias("i", "x")).groupBy("block", "i").agg(F.avg("x").alias("x"))
    center = mean.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("center"))
    held = nth.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("nth", "l", "u"))).alias("templates"))  # BLOCK rows
    apart = lambda t: F.sqrt(F.aggregate(F.zip_with(t["u"], F.col("center"), lambda x, y: F.pow(x - y, 2)), F.lit(0.0), lambda s, x: s + x))
    return held.join(center, "block").withColumn("radius", F.array_max(F.transform("templates", apart)))


def classify(df: DataFrame, templates: DataFrame, key: str, vector: str, label: str, threshold: float) -> DataFrame:
    """(key, label, score) of the best template by correlation, the first label on ties; label null under threshold.

    Any number of templates. As unit vectors have length 1, no template of a block scores more than the vector's product
    with the block's center plus the block's radius, and the best of all no less than the best of the blocks' first
    templates. So a vector goes only to the blocks that may hold its best, which it meets in a join that moves templates
    by block, and of what they find only the best moves on, as a partial maximum. One row with two vectors for each BLOCK
    templates is broadcast.
    """
    blocks = staged(template_blocks(templates, label))
    near = blocks.agg(F.collect_list(F.struct("block", "center", "radius", F.col("templates")[0]["u"].alias("first"))).alias("near"))
    rows = df.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), _unit(F.col(vector)).alias("v"))
    told = F.transform("near", lambda b: F.struct(b["block"].alias("block"), (_dot(F.col("v"), b["center"]) + b["radius"] + 1e-9).alias("most"), _dot(F.col("v"), b["first"]).alias("least")))
    bounds = rows.crossJoin(F.broadcast(near)).select("key", "row", "v", told.alias("bounds"))  # one row
    least = F.array_max(F.transform("bounds", lambda b: b["least"]))
    some = bounds.withColumn("least", least).withColumn("block", F.explode(F.transform(F.filter("bounds", lambda b: b["most"] >= F.col("least")), lambda b: b["block"])))
    best = F.aggregate(
        "templates", F.struct(F.lit(-2.0).alias("score"), F.lit(0).cast("long").alias("nth"), F.lit(None).cast(templates.schema[label].dataType).alias("l")),
        lambda s, t: F.transform(F.array(_dot(F.col("v"), t["u"])), lambda d: F.when(d > s["score"], F.struct(d.alias("score"), t["nth"].alias("nth"), t["l"].alias("l"))).otherwise(s))[0],
    )
    each = some.select("key", "row", "v", "block").join(blocks.select("block", "templates"), "block").select("key", "row", best.alias("b"))
    top = each.groupBy("row", "key").agg(F.max(F.struct(F.col("b.score"), (-F.col("b.nth")).alias("order"), F.col("b.l").alias("l"))).alias("b"))
    return top.select(F.col("key").alias(key), F.when(F.col("b.score") >= threshold, F.col("b.l")).alias(label), F.col("b.score").alias("score"))

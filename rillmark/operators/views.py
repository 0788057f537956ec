"""Views, filters and joins over the domain tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.staging import staged
from .dyadic import stab, with_ancestors, with_nodes
from .scan import HOT_ROWS, is_small, running_all, running_sums

#: What a date range means, in days; each entry point says which of them it knows.
RANGE_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
#: With at most so many ranges of a key, comparing each of them takes no more than the dyadic nodes of each would.
DENSE = 16
SEARCH_COLUMNS = ["detection_id", "username", "streamer_id", "streamer_login", "streamer_display_name", "streamer_avatar", "frame_time_seconds", "confidence", "rank", "vod_id", "vod_source_id", "vod_url", "actual_timestamp"]


def detection_search(t, min_confidence: float = 0.7) -> DataFrame:
    """Detections over min_confidence in available recordings, with recording and streamer; null confidence is out."""
    v = t.vods.filter("availability = 'available'").select(F.col("id").alias("vod_id"), F.col("source_id").alias("vod_source_id"), F.col("title").alias("vod_title"), F.col("published_at").alias("vod_published_at"), F.col("duration_seconds").alias("vod_duration_seconds"), F.col("availability").alias("vod_availability"), "streamer_id")
    s = t.streamers.select(F.col("id").alias("streamer_id"), F.col("login").alias("streamer_login"), F.col("display_name").alias("streamer_display_name"), F.col("profile_image_url").alias("streamer_avatar"))
    d = t.detections.filter(F.col("confidence") > min_confidence).withColumnRenamed("id", "detection_id")
    rows = d.join(v, "vod_id").join(s, "streamer_id")
    return rows.withColumn("actual_timestamp", C.plus_seconds(F.col("vod_published_at"), F.col("frame_time_seconds"))).withColumn("vod_url", C.watch_url(F.col("vod_source_id"), F.col("frame_time_seconds")))


def date_range(df: DataFrame, ts: str, kind: str | None, now: datetime, known: tuple[str, ...] = ("day", "week", "month", "year")) -> DataFrame:
    """'all' keeps all rows, a known range those not older, anything else none."""
    if kind == "all":
        return df
    if kind not in known:
        return df.filter(F.lit(False))
    return df.filter(F.col(ts) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {RANGE_DAYS[kind]} DAYS"))


def opt_filter(df: DataFrame, col: str, value) -> DataFrame:
    """No filter for None and the empty string."""
    return df if value is None or value == "" else df.filter(F.col(col) == value)


def audit(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, key) of every row that breaks a rule; a rule that is null counts as kept, as a CHECK does."""
    broken = [F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()]
    return df.select(F.explode(F.array_compact(F.array(*broken))).alias("rule"), F.col(key).cast("string").alias("key"))


def audit_unique(df: DataFrame, cols: list[str], rule: str) -> DataFrame:
    many = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    return many.select(F.lit(rule).alias("rule"), F.concat_ws("|", *[F.col(c).cast("string") for c in cols]).alias("key"))


def audit_foreign(df: DataFrame, col: str, parents: DataFrame, parent_key: str, key: str, rule: str) -> DataFrame:
    lost = df.filter(F.col(col).isNotNull()).join(parents.select(F.col(parent_key).alias(col)), col, "left_anti")
    return lost.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def visible_detections(t) -> DataFrame:
    """What anonymous readers see: detections of available recordings."""
    open_ids = t.vods.filter("availability = 'available'").select(F.col("id").alias("vod_id"))
    return t.detections.join(open_ids, "vod_id", "left_semi")


def enabled(t) -> DataFrame:
    return t.streamers.filter("processing_enabled").select(F.col("id").alias("streamer_id"))


def eligible_vods(t) -> DataFrame:
    """Recordings that are ready, available, of an enabled streamer and have a pending chunk."""
    ready = t.vods.filter("ready_for_processing AND availability = 'available'").join(enabled(t), "streamer_id", "left_semi")
    pending = t.chunks.filter("status = 'pending'").select(F.col("vod_id").alias("id"))
    return ready.join(pending, "id", "left_semi")


def stale_streamers(streamers: DataFrame, now: datetime, interval: Column) -> DataFrame:
    """Enabled streamers last updated at least an interval ago that have, or may have, recordings."""
    may = F.col("has_vods") | (F.col("created_at") == F.col("updated_at")) | F.col("has_vods").isNull()
    return streamers.filter(F.col("processing_enabled") & may & (F.col("updated_at") <= F.lit(now).cast("timestamp_ntz") - interval))


def new_streamers(found: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    return found.join(known.select(key), key, "left_anti")


def lookup_fallback(events: DataFrame, dim: DataFrame, by: str, other: str) -> DataFrame:
    """Each event with the dimension row of its id, or of its login where there is none; null where neither exists."""
    a = dim.select(F.col(by).alias(f"__{by}"), F.struct(*dim.columns).alias("__first"))
    b = dim.select(F.col(other).alias(f"__{other}"), F.struct(*dim.columns).alias("__second"))
    rows = events.join(a, events[by] == a[f"__{by}"], "left").join(b, events[other] == b[f"__{other}"], "left")
    return rows.withColumn("found", F.coalesce("__first", "__second")).drop("__first", "__second", f"__{by}", f"__{other}")


def embed(parent: DataFrame, child: DataFrame, fk: str, key: str, name: str, how: str = "left") -> DataFrame:
    """The parent row with its child as an object; how="inner" drops parents without one."""
    c = child.select(F.col(key).alias("__key"), F.struct(*child.columns).alias(name))
    return parent.join(c, parent[fk] == c["__key"], how).drop("__key")


def presence(requested: DataFrame, returned: DataFrame, key: str) -> DataFrame:
    """Every requested key once, with whether it was returned; nothing returned means none is available."""
    got = returned.select(key).distinct().withColumn("__got", F.lit(True))
    return requested.select(key).distinct().join(got, key, "left").select(key, F.col("__got").isNotNull().alias("available"))


def effective_profile(vods: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each recording with the latest-starting profile whose [from_date, to_date) holds its time; open ends are null.

    Among profiles that start alike, an open start being the earliest, the one that ends later counts, then the larger
    id. A recording without a time has only profiles open on both sides. Any number of profiles: their dates cut time
    into pieces, each of which gets its profile (a profile is stored at the nodes of its run of pieces, a node keeps its
    best, a piece takes the best of its nodes); then pieces and recordings are put in one order of time, and each
    recording takes the last piece begun.
    """
    p = profiles.select(F.col("id").alias("profile_id"), "from_date", "to_date").filter("from_date IS NULL OR to_date IS NULL OR from_date < to_date")
    rank = F.struct(F.col("from_date").isNotNull(), F.coalesce("from_date", F.lit(datetime(1, 1, 1)).cast(p.schema["from_date"].dataType)), F.col("to_date").isNull(), F.col("to_date"), F.col("profile_id"))
    dates = p.select(F.col("from_date").alias("date")).unionByName(p.select(F.col("to_date").alias("date"))).dropna().distinct()
    dates = staged(running_sums(dates.withColumn("one", F.lit(1)), [F.col("date")], {"nth": "one"}).select("date", F.col("nth").cast("long").alias("nth")))
    begin, end = dates.toDF("from_date", "lo"), dates.toDF("to_date", "hi")
    runs = p.withColumn("rank", rank).join(begin, "from_date", "left").join(end, "to_date", "left")
    runs = runs.select("rank", "profile_id", F.coalesce("lo", F.lit(0)).alias("lo"), F.coalesce("hi", F.lit(1 << 40)).alias("hi"))
    some = dates.count()
    best = with_nodes(runs, F.col("lo"), F.least("hi", F.lit(some + 1))).groupBy("level", "place").agg(F.max(F.struct("rank", "profile_id")).alias("best"))
    pieces = dates.unionByName(profiles.sparkSession.range(1).select(F.lit(None).cast(dates.schema["date"].dataType).alias("date"), F.lit(0).cast("long").alias("nth")))
    own = with_ancestors(pieces, F.col("nth"), best).join(best, ["level", "place"]).groupBy("nth").agg(F.max("best").alias("best"))
    found = pieces.join(own, "nth", "left").select("date", F.struct(F.col("best.profile_id").alias("profile_id")).alias("piece"))
    row = F.struct(*(F.col(f"`{c}`") for c in vods.columns))
    timed = vods.filter("published_at IS NOT NULL").select(F.col("published_at").alias("date"), row.alias("row"))
    both = found.select("date", "piece", F.lit(None).cast(timed.schema["row"].dataType).alias("row")).unionByName(timed.select("date", F.lit(None).cast("struct<profile_id:" + p.schema["profile_id"].dataType.simpleString() + ">").alias("piece"), "row"))
    told = running_all(both, [F.col("date"), F.col("row").isNotNull()], {"last": ("last", "piece")}).filter("row IS NOT NULL")
    always = p.filter("from_date IS NULL AND to_date IS NULL").agg(F.max("profile_id").alias("profile_id"))
    rest = vods.filter("published_at IS NULL").crossJoin(F.broadcast(always))  # one row
    return told.select("row.*", F.col("last.profile_id").alias("profile_id")).unionByName(rest)


def profile_for(t, default: int = 1) -> DataFrame:
    s = t.streamers.select(F.col("id").alias("streamer_id"), F.coalesce("profile_id", F.lit(default)).alias("profile_id"))
    p = t.profiles.select(F.col("id").alias("profile_id"), "profile_name", "custom_edge", "opaque_edge")
    return t.vods.select(F.col("id").alias("vod_id"), "streamer_id").join(s, "streamer_id").join(p, "profile_id")


def overlap_join(a: DataFrame, b: DataFrame, key: str, width: int = 3600, wide: bool = False) -> DataFrame:
    """Pairs of ranges (key, start, end) of one key that overlap; touching ones don't.

    Of two overlapping ranges one begins in the other, so each side's beginnings are joined with the other's ranges as
    dyadic nodes over cells of width seconds: a range of length L takes 2 log2(L / width) + 2 rows at most, each pair
    comes once, and long or many ranges of one key spread over its nodes. Only keys with over DENSE ranges in b or
    HOT_ROWS in a are joined so; the others, and small tables (is_small) unless wide is set, are joined by key alone.
    """

    def told(df: DataFrame, p: str) -> DataFrame:
        return df.select(*(F.col(c).alias(c if c == key else f"{p}_{c}") for c in df.columns)).filter(F.col(f"{p}_end") > F.col(f"{p}_start"))

    x, y = told(a, "a"), told(b, "b")
    by_key = lambda r: x.join(r, key).filter("a_start < b_end AND b_start < a_end")
    if not wide and is_small(a, b):
        return by_key(y)
    over = lambda df, n: df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > n).select(key)
    many = over(y, DENSE).unionByName(over(x, HOT_ROWS))
    own_x, own_y = (df.join(many, key, "left_semi") for df in (x, y))
    cell = lambda c: F.floor(c / width).cast("long")

    def begun(points: DataFrame, ranges: DataFrame, p: str, r: str) -> DataFrame:
        return stab(points, cell(F.col(f"{p}_start")), ranges, cell(F.col(f"{r}_start")), cell(F.col(f"{r}_end") - 1) + 1, [key])

    in_b = begun(own_x, own_y, "a", "b").filter("a_start >= b_start AND a_start < b_end")
    in_a = begun(own_y, own_x, "b", "a").filter("b_start > a_start AND b_start < a_end")
    return by_key(y.join(many, key, "left_anti")).unionByName(in_b).unionByName(in_a)


def fuzzy_join(a: DataFrame, b: DataFrame, col: str, threshold: float) -> DataFrame:
    """(a_value, b_value, similarity) of all distinct values whose trigram similarity reaches threshold.

    Values similar enough share one of their rarest trigrams: of n trigrams the first n - ceil(threshold * n) + 1 in a
    common order by rarity. Only those are joined, as (value, size, place): pairs of too unlike sizes, or that meet where
    too few trigrams are left for the overlap they need, go at once. The candidates' full sets are then attached and compared.
    """

    def grams(df: DataFrame, p: str) -> DataFrame:
        return df.select(F.col(col).alias(p)).filter(F.col(p).isNotNull()).distinct().withColumn(f"{p}_set", C.trigrams(F.col(p))).filter(F.size(f"{p}_set") > 0)

    x, y = grams(a, "a_value"), grams(b, "b_value")
    seen = x.select(F.explode("a_value_set").alias("g")).unionByName(y.select(F.explode("b_value_set").alias("g"))).groupBy("g").agg(F.count(F.lit(1)).alias("df"))

    def prefix(df: DataFrame, p: str) -> DataFrame:
        each = df.select(p, F.size(f"{p}_set").alias("n"), F.explode(f"{p}_set").alias("g")).join(seen, "g")
        rank = F.row_number().over(Window.partitionBy(p).orderBy("df", "g"))
        rows = each.withColumn("r", rank).filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
        return rows.select(p, "g", F.col("n").alias(f"{p}_n"), (F.col("n") - F.col("r") + 1).alias(f"{p}_left"))

    m, n = F.col("a_value_n"), F.col("b_value_n")
    both = (m + n) * (threshold / (1 + threshold)) - 1e-9
    fits = (F.least(m, n) >= F.greatest(m, n) * threshold - 1e-9) & (F.least("a_value_left", "b_value_left") >= both)
    pairs = prefix(x, "a_value").join(prefix(y, "b_value"), "g").filter(fits).select("a_value", "b_value").distinct()
    scored = pairs.join(x, "a_value").join(y, "b_value").select("a_value", "b_value", C.set_similarity(F.col("a_value_set"), F.col("b_value_set")).alias("similarity"))
    return scored.filter(C.similar(F.col("similarity"), threshold))

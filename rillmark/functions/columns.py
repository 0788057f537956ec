"""Column functions: all are compositions of Spark's own, so they stay in the JVM."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# The public address of a recording at a second, and the image sizes of quality labels.
WATCH_URL = "https://www.twitch.tv/videos/"
RESOLUTIONS = {"360p": "640x360", "480p": "854x480", "720p": "1280x720", "720p60": "1280x720", "1080p": "1920x1080", "1080p60": "1920x1080"}
DEFAULT_RESOLUTION = "854x480"
NOTIFY_LABELS = {"dm": "direct message", "server": "server channel", "both": "direct message and server channel"}


def trigrams(text: Column) -> Column:
    """The distinct trigrams of each run of letters and digits, lower-cased, padded by two blanks before and one behind."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def set_similarity(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays as a float; 0 where both are empty; null where one is null."""
    union = F.size(F.array_union(a, b))
    return F.when(a.isNull() | b.isNull(), None).when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union).cast("float")


def similarity(a: Column, b: Column) -> Column:
    return set_similarity(trigrams(a), trigrams(b))


def similar(score: Column, threshold: float) -> Column:
    """A float score is widened before it is compared, so 0.7 as a float is below 0.7."""
    return score.cast("double") >= F.lit(threshold)


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def watch_url(source_id: Column, seconds: Column) -> Column:
    return F.concat(F.lit(WATCH_URL), source_id, F.lit("?t="), seconds.cast("string"), F.lit("s"))


def hms(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%dh%dm%ds", F.expr("0") + F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))


def hms_url(source_id: Column, seconds: Column) -> Column:
    return F.concat(F.lit(WATCH_URL), source_id, F.lit("?t="), hms(seconds))


def parse_hms(text: Column) -> Column:
    """Seconds of 1h2m3s with optional parts; a missing part counts 0, null stays null."""
    part = lambda unit: F.coalesce(F.regexp_extract(text, rf"(\d+){unit}", 1).try_cast("long"), F.lit(0))
    return F.when(text.isNotNull(), part("h") * 3600 + part("m") * 60 + part("s"))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def clean_username(text: Column) -> Column:
    """Strips what no name has; null unless 4 to 25 characters are left and the first is a letter or digit.

    Where a 26th character is found that would stay, nothing is stripped: the result is null whatever follows.
    """
    own = r"a-zA-Z0-9_\-."
    long = text.rlike(rf"^(?:[^{own}]*+[{own}]){{26}}")
    bare = F.regexp_replace(F.when((F.length(text) <= 25) | ~long, text), rf"[^{own}]+", "")
    return F.when(F.length(bare).between(4, 25) & bare.rlike("^[a-zA-Z0-9]"), bare)


def ratio(a: Column, n: Column, digits: int = 2) -> Column:
    """a / n rounded half away from zero; 0 where n is not positive."""
    return F.when(n > 0, F.round(a.cast("decimal(38,10)") / F.nullif(n, F.lit(0)).cast("decimal(38,0)"), digits)).otherwise(F.lit(0).cast("decimal(38,10)"))


def as_int(text: Column, default: int | None = None) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(default).cast("int"))


def as_interval(text: Column, default: str = "6 hours") -> Column:
    """A day-time interval from text like "90 minutes"; the default where it is missing or no interval."""
    part = lambda t, unit: F.coalesce(F.regexp_extract(t, rf"(?i)(\d+)\s*{unit}", 1).try_cast("int"), F.lit(0))
    read = lambda t: F.make_dt_interval(part(t, "day"), part(t, "hour"), part(t, "min"), part(t, "sec"))
    valid = text.rlike(r"(?i)^\s*(\d+\s*(day|hour|min(ute)?|sec(ond)?)s?\s*)+$")
    return F.when(F.coalesce(valid, F.lit(False)), read(text)).otherwise(read(F.lit(default)))


def pixel_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Fractions to whole pixels within the frame: x, y down and w, h up, then clamped."""
    px, py = F.least(F.floor(x * width), width - 1).cast("int"), F.least(F.floor(y * height), height - 1).cast("int")
    return F.struct(F.least(F.ceil(w * width), width - px).cast("int").alias("w"), F.least(F.ceil(h * height), height - py).cast("int").alias("h"), px.alias("x"), py.alias("y"))


def plate_box(width: Column, height: Column, emblem_right: Column) -> Column:
    """The name plate right of the emblem, without the upper and lower 24 percent; the full frame if that is too small."""
    margin = F.floor(height * 0.24).cast("int")
    x, y, w, h = emblem_right, margin, width - emblem_right, height - 2 * margin
    small = (h < 20) | (w < 50)
    pick = lambda a, b: F.when(small, a).otherwise(b).cast("int")
    return F.struct(pick(F.lit(0), x).alias("x"), pick(F.lit(0), y).alias("y"), pick(width, w).alias("w"), pick(height, h).alias("h"))


def right_edge(width: Column, custom: Column, opaque: Column, detected: Column) -> Column:
    """(x, no_right_edge, truncated): an opaque custom edge rules, else what was detected, else none, with the custom one if set."""
    at = F.floor(width * custom).cast("int")
    forced = F.coalesce(opaque, F.lit(False)) & custom.isNotNull()
    missing = ~forced & detected.isNull()
    return F.struct(
        F.when(forced, at).when(detected.isNotNull(), detected).otherwise(at).cast("int").alias("x"),
        missing.alias("no_right_edge"),
        (forced | (missing & custom.isNotNull())).alias("truncated"),
    )


def quality_label(quality: Column, fps: Column) -> Column:
    return F.when(fps == 60, F.concat(quality, F.lit("60"))).otherwise(quality)


def resolution(label: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in RESOLUTIONS.items() for x in kv])
    return F.coalesce(known[label], F.lit(DEFAULT_RESOLUTION))


def notify_label(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in NOTIFY_LABELS.items() for x in kv])[kind]


def result_line(name: Column, epoch: Column, url: Column) -> Column:
    return F.format_string("**%s** - <t:%d:f> - [Watch](%s)", name, epoch, url)


def result_count(text: Column) -> Column:
    """How many results a command asks for: "all" is 10, anything that is no number is 1."""
    return F.when(F.lower(text) == "all", F.lit(10)).otherwise(as_int(text, 1))


def signature(secret: str, message: Column) -> Column:
    """sha256= and HMAC-SHA256 in hex; the two padded keys are folded here, the hashing runs in Spark."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))
    return F.concat(F.lit("sha256="), F.sha2(F.concat(outer, first), 256))


def changed(old: Column, new: Column) -> Column:
    """True where two values differ, nulls taken as values."""
    return ~old.eqNullSafe(new)


def is_category(game_id: Column, name: Column, wanted: str, needle: str) -> Column:
    return F.coalesce(game_id == wanted, F.lit(False)) | F.coalesce(F.contains(F.lower(name), F.lit(needle)), F.lit(False))


def storage_path(source_id: Column, seconds: Column, kind: str = "frame", test_quality: str | None = None) -> Column:
    """Where a detection's image lies; null without a source."""
    ts = seconds.cast("string")
    if kind == "frame":
        top = "/detections/" if test_quality is None else f"/detections/test/{test_quality}/"
        return F.concat(F.lit(top), source_id, F.lit("/"), ts, F.lit(".jpg"))
    if test_quality is not None and kind in ("preprocessed", "boxes"):
        return F.concat(F.lit(f"ocr_debug/{kind}_"), source_id, F.lit("_"), ts, F.lit(".jpg"))
    return F.concat(source_id, F.lit(f"/{kind}_"), ts, F.lit(".jpg"))

"""Changes to snapshots: state machines, claims, queues, sweeps, subscriptions; each gives the new rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .aggregates import pending_by_vod, rollup_status
from .intervals import create_missing_chunks
from .scan import running
from .views import enabled, lookup_fallback, presence

ALLOWED = ("pending", "processing", "completed", "failed")


#: Where a chunk's state has no such column yet, it starts from null.
_STAMPS = {"started_at": "timestamp_ntz", "completed_at": "timestamp_ntz", "last_error": "string"}


def _chunk_state(chunks: DataFrame) -> DataFrame:
    """(id, o_status, ...): the state of chunks that commands change."""
    own = {c: F.col(c) if c in chunks.columns else F.lit(None).cast(k) for c, k in _STAMPS.items()}
    return chunks.select("id", F.col("status").alias("o_status"), F.col("attempt_count").cast("int").alias("o_attempts"), *(v.alias(f"o_{c}") for c, v in own.items()))


def summarize_status(commands: DataFrame) -> DataFrame:
    """(id, last, start, error, again): what the commands (seq, id, status, error, at) of each chunk come to.

    Of every field the latest command that sets it, with its place, and how many attempts were added: maxima and a sum,
    so summaries of parts merge (merge_status), and a chunk with any number of commands is one row before the shuffle.
    """
    place, st = F.struct("seq", "status", "error", "at"), F.col("status")
    again = st.isin("pending", "failed")
    return commands.filter(st.isin(*ALLOWED)).groupBy("id").agg(
        F.max(F.struct(place.alias("place"), st.alias("status"), F.when(st.isin("completed", "failed"), F.col("at")).alias("completed_at"))).alias("last"),
        F.max(F.when(st.isin("processing", "pending"), F.struct(place.alias("place"), F.when(st == "processing", F.col("at")).alias("started_at")))).alias("start"),
        F.max(F.when(~again | F.col("error").isNotNull(), F.struct(place.alias("place"), F.when(again, F.col("error")).alias("last_error")))).alias("error"),
        F.count_if(again).alias("again"),
    )


def merge_status(summaries: DataFrame) -> DataFrame:
    """One summary a chunk from those of any parts of the commands, in any order."""
    return summaries.groupBy("id").agg(*(F.max(c).alias(c) for c in ("last", "start", "error")), F.sum("again").alias("again"))


def apply_status_commands(commands: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks with commands (seq, id, status, error, at), after them by the database's rules.

    Commands with an unknown status or chunk change nothing. Processing sets the start and clears the error; completed
    clears it too; pending and failed count an attempt and keep the error given; completed and failed set the end.
    """
    rows = _chunk_state(chunks).join(summarize_status(commands), "id")
    pick = lambda of, name: F.when(F.col(of).isNotNull(), F.col(of)[name]).otherwise(F.col(f"o_{name}")).alias(name)
    return rows.select("id", F.col("last.status").alias("status"), pick("start", "started_at"), F.col("last.completed_at").alias("completed_at"), (F.col("o_attempts") + F.col("again")).cast("int").alias("attempt_count"), pick("error", "last_error"))


def apply_worker_commands(commands: DataFrame, chunks: DataFrame) -> DataFrame:
    """The same commands by the worker's rules: processing resets attempts to 1, pending adds one, given errors overwrite.

    Commands are numbered by the resets up to them (a running sum, which hot chunks spread over tasks), counted by chunk
    and number, and of a chunk's few maxima the last number's count stands.
    """
    place, st = F.struct("seq", "status", "error", "at"), F.col("status")
    rows = commands.select("id", "seq", "status", "error", "at", (st == "processing").cast("int").alias("reset"))
    rows = running(rows, ["id"], ["seq", "status", "error", "at"], {"resets": ("sum", "reset")})
    latest = lambda c, **v: F.max(F.when(c, F.struct(place.alias("place"), *(x.alias(n) for n, x in v.items()))))
    parts = rows.groupBy("id", "resets").agg(
        latest(F.lit(True), status=st).alias("last"), latest(st == "processing", at=F.col("at")).alias("start"), latest(st == "completed", at=F.col("at")).alias("end"),
        latest(F.col("error").isNotNull(), error=F.col("error")).alias("error"), F.count_if(st == "pending").alias("again"),
    )
    own = parts.groupBy("id").agg(*(F.max(c).alias(c) for c in ("last", "start", "end", "error")), F.max(F.struct("resets", "again")).alias("n"))
    r = _chunk_state(chunks).join(own, "id")
    attempts = F.when(F.col("n.resets") > 0, 1).otherwise(F.col("o_attempts")) + F.col("n.again")
    return r.select("id", F.col("last.status").alias("status"), F.coalesce("start.at", "o_started_at").alias("started_at"), F.coalesce("end.at", "o_completed_at").alias("completed_at"), attempts.cast("int").alias("attempt_count"), F.coalesce("error.error", "o_last_error").alias("last_error"))


def command_results(commands: DataFrame, chunks: DataFrame) -> DataFrame:
    """(seq, id, success, error) of status commands."""
    known = chunks.select("id").withColumn("__known", F.lit(True))
    rows = commands.join(known, "id", "left")
    bad = ~F.col("status").isin(*ALLOWED)
    # The two messages.
    error = F.when(bad, F.format_string("Invalid status: %s. Must be one of: pending, processing, completed, failed", "status")).when(F.col("__known").isNull(), F.format_string("Chunk with ID %s not found", F.col("id").cast("string")))
    return rows.select("seq", "id", error.isNull().alias("success"), error.alias("error"))


def claim(claims: DataFrame, chunks: DataFrame, minutes: int = 30) -> DataFrame:
    """(chunk_id, worker, lease_expires_at): the first claim of each pending chunk wins."""
    pending = chunks.filter("status = 'pending'").select(F.col("id").alias("chunk_id"))
    rank = F.row_number().over(Window.partitionBy("chunk_id").orderBy("at", "worker"))
    won = claims.join(pending, "chunk_id", "left_semi").withColumn("__r", rank).filter("__r = 1")
    return won.select("chunk_id", "worker", (F.col("at") + F.expr(f"INTERVAL {minutes} MINUTES")).alias("lease_expires_at"))


def expired(leases: DataFrame, now: datetime) -> DataFrame:
    return leases.filter(F.col("lease_expires_at") < F.lit(now).cast("timestamp_ntz"))


def admitted(t, limit: int | None, default: int | None = None, max_vods: int = 1, by_attempts: bool = False, switched_on: bool = True) -> DataFrame:
    """Whole recordings to take next, none when limit chunks are active; a null limit and default mean no limit.

    A recording is taken with all its chunks, so the limit may be passed by what is taken last. Switched off, none is.

    by_attempts: fewest attempts, then newest first, else oldest first; unknown dates count as the newest.
    """
    most = limit if limit is not None else default
    rows = pending_by_vod(t)
    if not by_attempts:
        waiting = rollup_status(t).filter("status = 'pending'").select("vod_id")
        rows = rows.join(waiting, "vod_id", "left_semi")
    order = [F.asc("min_attempt_count"), F.desc_nulls_first("published_at")] if by_attempts else [F.asc_nulls_last("published_at")]
    picked = rows.orderBy(*order, F.asc("vod_id")).limit(max_vods).select("vod_id", "source_id", "pending_chunks")
    if not switched_on:
        return picked.limit(0)
    if most is None:
        return picked
    active = t.chunks.agg(F.count_if(F.col("status").isin("queued", "processing")).alias("__active"))
    return picked.crossJoin(F.broadcast(active)).filter(F.col("__active") < most).drop("__active")  # one row


def queue(chunks: DataFrame, vods: DataFrame, now: datetime) -> DataFrame:
    """chunks with those pending of the given recordings queued, and queued_at."""
    take = vods.select("vod_id").distinct().withColumn("__take", F.lit(True))
    hit = F.coalesce("__take", F.lit(False)) & (F.col("status") == "pending")
    rows = chunks.join(take, "vod_id", "left").withColumn("queued_at", F.when(hit, F.lit(now).cast("timestamp_ntz")))
    return rows.withColumn("status", F.when(hit, "queued").otherwise(F.col("status"))).drop("__take")


def changed_rollups(before: DataFrame, touched: DataFrame, t) -> DataFrame:
    """(vod_id, status) of touched recordings whose rolled-up status differs from before (vod_id, status).

    Only their chunks are counted; streaming.rollups keeps stored counts up instead.
    """
    ids = touched.select("vod_id").distinct()
    some = With(t, vods=t.vods.join(ids.select(F.col("vod_id").alias("id")), "id", "left_semi"), chunks=t.chunks.join(ids, "vod_id", "left_semi"))
    old = before.select("vod_id", F.col("status").alias("__old"))
    return rollup_status(some).join(old, "vod_id", "left").filter(C.changed(F.col("__old"), F.col("status"))).drop("__old")


def rechunk(t, changes: DataFrame, shortest: int = 600) -> DataFrame:
    """New chunks of recordings that came, became ready or changed length or chapters (op, old, new), of enabled streamers."""
    old, new = F.col("old"), F.col("new")
    due = (F.col("op") == "insert") | (~F.coalesce(old["ready"], F.lit(False)) & new["ready"]) | C.changed(old["duration_seconds"], new["duration_seconds"]) | C.changed(old["chapters"], new["chapters"])
    ids = changes.filter(due & (new["duration_seconds"] >= shortest)).select(new["id"].alias("id"))
    vods = t.vods.join(enabled(t), "streamer_id", "left_semi").join(ids, "id", "left_semi")
    return create_missing_chunks(With(t, vods=vods))


def chunk_enabled(t, switched_on: DataFrame) -> DataFrame:
    """New chunks of all ready recordings of streamers that were switched on."""
    vods = t.vods.filter("ready_for_processing").join(switched_on.select("streamer_id"), "streamer_id", "left_semi")
    return create_missing_chunks(With(t, vods=vods))


class With:
    """Tables with some replaced."""

    def __init__(self, t, **own: DataFrame):
        self._t, self._own = t, own

    def __getattr__(self, name: str) -> DataFrame:
        return self._own[name] if name in self._own else getattr(self._t, name)


def fail_chunks(chunks: DataFrame, failed: DataFrame) -> DataFrame:
    """chunks with all of failed recordings (vod_id) failed."""
    hit = failed.select("vod_id").distinct().withColumn("__f", F.lit(True))
    return chunks.join(hit, "vod_id", "left").withColumn("status", F.when(F.col("__f"), "failed").otherwise(F.col("status"))).drop("__f")


def drop_work(t) -> DataFrame:
    """chunks without the pending and processing ones of recordings that are not ready or whose streamer is disabled."""
    live = t.vods.filter("ready_for_processing").join(enabled(t), "streamer_id", "left_semi").select(F.col("id").alias("vod_id")).withColumn("__live", F.lit(True))
    return t.chunks.join(live, "vod_id", "left").filter("status NOT IN ('pending', 'processing') OR __live").drop("__live")


def sweep(vods: DataFrame, requested: DataFrame, returned: DataFrame, now: datetime) -> DataFrame:
    """(id, availability, unavailable_since, last_check) of requested recordings after a probe."""
    at = F.lit(now).cast("timestamp_ntz")
    seen = presence(requested, returned, "id")
    rows = vods.select("id", "availability").join(seen, "id")
    gone = ~F.col("available")
    return rows.select("id", F.when(gone, "unavailable").otherwise(F.col("availability")).alias("availability"), F.when(gone, at).alias("unavailable_since"), at.alias("last_check"))


def route(messages: DataFrame, secret: str, id_: str = "message_id", ts: str = "sent", body: str = "body", sign: str = "signature", kind: str = "message_type") -> DataFrame:
    """Webhook messages with route and code: headers and signatures are checked before the kind of message."""
    good = C.signature(secret, F.concat(F.col(id_), F.col(ts), F.col(body))) == F.col(sign)
    missing = F.col(id_).isNull() | F.col(ts).isNull() | F.col(sign).isNull()
    event = F.get_json_object(body, "$.subscription.type")
    to = (
        F.when(missing, "missing_header").when(~good, "bad_signature").when(F.col(kind) == "webhook_callback_verification", "challenge")
        .when(F.col(kind) == "revocation", "revoked").when((F.col(kind) == "notification") & (event == "stream.offline"), "process").otherwise("ignored")
    )
    rows = messages.withColumn("route", to)
    return rows.withColumn("code", F.when(F.col("route") == "missing_header", 400).when(F.col("route") == "bad_signature", 403).otherwise(200))


def classify_offline(events: DataFrame, t) -> DataFrame:
    """(event_id, reason) of offline events (event_id, id, login): the streamer is found by id, else by login."""
    found = lookup_fallback(events, t.streamers.select("id", "login", "processing_enabled"), "id", "login")
    has = t.vods.filter("chapters IS NOT NULL").select(F.col("streamer_id").alias("__s")).distinct()
    rows = found.join(has, found["found.id"] == has["__s"], "left")
    reason = F.when(F.col("found").isNull(), "not_found").when(~F.col("found.processing_enabled"), "disabled").when(F.col("__s").isNull(), "no_chapters").otherwise("processed")
    return rows.select("event_id", reason.alias("reason"))


def toggle_subscriptions(commands: DataFrame, subscriptions: DataFrame, channels: DataFrame) -> DataFrame:
    """(user_id, username, enabled, notify_type, guild_id) after toggles (seq, user_id, username, notify_type, guild_id).

    A toggle for a server needs a guild with a channel, or it is void, also when it would switch off. An unknown pair
    is created; a known one flips; switching on overwrites the kind and the guild (null for dm), switching off keeps them.
    """
    kind = F.coalesce("notify_type", F.lit("both"))
    known = channels.select(F.col("guild_id").alias("__g")).distinct()
    valid = commands.withColumn("notify_type", kind).join(known, commands["guild_id"] == known["__g"], "left").filter("notify_type = 'dm' OR __g IS NOT NULL").drop("__g")
    keys = ["user_id", "username"]
    nth = running(valid.select(*keys, "seq", "notify_type", "guild_id"), keys, ["seq", "notify_type", "guild_id"], {"nth": ("count", "seq")})
    on = F.struct("nth", "notify_type", F.when(F.col("notify_type") != "dm", F.col("guild_id")).alias("guild_id"))
    per = nth.groupBy(*keys).agg(F.max("nth").alias("n"), F.max(F.when(F.col("nth") % 2 == 1, on)).alias("odd"), F.max(F.when(F.col("nth") % 2 == 0, on)).alias("even"))
    rows = subscriptions.select(*keys, "enabled", F.col("notify_type").alias("k"), F.col("guild_id").alias("g")).join(per, keys, "full_outer")
    was = F.coalesce("enabled", F.lit(False))
    # the odd toggles switch on what was off, the even ones what was on
    rows = rows.select(*keys, "k", "g", (was.cast("int") + F.coalesce("n", F.lit(0))) % 2 == 1, F.when(was, F.col("even")).otherwise(F.col("odd"))).toDF(*keys, "k", "g", "enabled", "on")
    pick = lambda name, old: F.when(F.col("on").isNotNull(), F.col("on")[name]).otherwise(F.col(old)).alias(name)
    return rows.select(*keys, "enabled", pick("notify_type", "k"), pick("guild_id", "g"))


def set_channels(commands: DataFrame, channels: DataFrame | None = None) -> DataFrame:
    """(guild_id, channel_id) after commands (seq, guild_id, channel_id): the last of each guild counts, a null channel clears.

    channels are those stored before; a guild without a command keeps its own.
    """
    last = commands.groupBy("guild_id").agg(F.max_by(F.struct("channel_id"), "seq").alias("c"))
    if channels is None:
        return last.select("guild_id", "c.channel_id").filter("channel_id IS NOT NULL")
    both = channels.select("guild_id", F.col("channel_id").alias("__was")).join(last, "guild_id", "full_outer")
    return both.select("guild_id", F.when(F.col("c").isNotNull(), F.col("c.channel_id")).otherwise(F.col("__was")).alias("channel_id")).filter("channel_id IS NOT NULL")


def messages_by_name(subscriptions: DataFrame, channels: DataFrame) -> DataFrame:
    """(username, kind, target, users) of every name that enabled subscriptions ask for: what a detection of it sends.

    A message to each user by dm, and one to each guild's channel for all its users. As many rows as subscriptions at most.
    """
    on = subscriptions.filter("enabled AND username IS NOT NULL").select("username", "user_id", "notify_type", "guild_id")
    dm = on.filter("notify_type IN ('dm', 'both')").select("username", F.lit("dm").alias("kind"), F.col("user_id").alias("target"), F.array("user_id").alias("users"))
    guild = on.filter("notify_type IN ('server', 'both')").join(channels, "guild_id").groupBy("username", "channel_id").agg(F.sort_array(F.collect_set("user_id")).alias("users"))
    return dm.unionByName(guild.select("username", F.lit("server").alias("kind"), F.col("channel_id").alias("target"), "users"))


def send(detections: DataFrame, messages: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(detection_id, kind, target, users): the messages (messages_by_name) of detections (id, username), within by.

    Only ids and names are shuffled: what is sent is put together behind the last exchange. Where one id comes with
    several names, and only there, a channel's users are gathered over them. Messages are merged in, not broadcast, so
    that the result comes name by name: its texts repeat from row to row, and a table of it stays small.
    """
    rows = detections.filter("username IS NOT NULL").select(*by, F.col("id").alias("detection_id"), "username")
    messages = messages.hint("merge")
    dm = rows.join(messages.filter("kind = 'dm'"), [*by, "username"]).select("detection_id", "kind", "target", F.col("target").alias("users"))
    guild = messages.filter("kind = 'server'")
    named = rows.groupBy(*by, "detection_id").agg(F.collect_set("username").alias("names"))
    one = named.filter("size(names) = 1").select(*by, "detection_id", F.get("names", F.lit(0)).alias("username")).join(guild, [*by, "username"])
    more = named.filter("size(names) > 1").select(*by, "detection_id", F.explode("names").alias("username")).join(guild, [*by, "username"])
    more = more.groupBy(*by, "detection_id", "target").agg(F.flatten(F.collect_list("users")).alias("users"))
    both = one.select("detection_id", "target", "users").unionByName(more.select("detection_id", "target", F.array_sort(F.array_distinct("users")).alias("users")))
    return dm.unionByName(both.select("detection_id", F.lit("server").alias("kind"), "target", F.array_join("users", " ").alias("users")))


def notifications(detections: DataFrame, subscriptions: DataFrame, channels: DataFrame) -> DataFrame:
    """(detection_id, kind, target, users): a message to each user by dm, and one to each guild's channel for all its users.

    Usernames match exactly, case and all; only enabled subscriptions count.
    """
    return send(detections, messages_by_name(subscriptions, channels))


def notified(detections: DataFrame, subscriptions: DataFrame, channels: DataFrame) -> DataFrame:
    """(detection_id, notified) of every detection: its direct messages, and its users in guilds that have a channel.

    Subscriptions are counted by username before they meet detections, so a hot name is one row.
    """
    known = channels.select("guild_id", F.lit(1).alias("__has")).distinct()
    on = subscriptions.filter("enabled").select("username", F.coalesce("notify_type", F.lit("both")).alias("kind"), "guild_id").join(known, "guild_id", "left")
    each = F.col("kind").isin("dm", "both").cast("int") + (F.col("kind").isin("server", "both") & F.col("__has").isNotNull()).cast("int")
    per = on.groupBy("username").agg(F.sum(each).alias("n"))
    return detections.select(F.col("id").alias("detection_id"), "username").join(per, "username", "left").select("detection_id", F.coalesce("n", F.lit(0)).cast("long").alias("notified"))


def notification_counts(detections: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(username, user_id, n): every matched subscription counts, delivered or not; matches are counted by name first."""
    n = detections.groupBy("username").agg(F.count(F.lit(1)).alias("n"))
    return subscriptions.filter("enabled").select("username", "user_id").join(n, "username")


def count_notifications(subscriptions: DataFrame, detections: DataFrame) -> DataFrame:
    """subscriptions (..., notification_count) with the matches of a batch of detections added; unmatched ones keep theirs."""
    new = notification_counts(detections, subscriptions).select("username", "user_id", F.col("n").alias("__n"))
    return subscriptions.join(new, ["username", "user_id"], "left").withColumn("notification_count", F.col("notification_count") + F.coalesce("__n", F.lit(0))).select(subscriptions.columns)


def reprocess(t, ids: DataFrame) -> DataFrame:
    """(vod_id, success, chunks_deleted, detections_deleted, chunks_created) of forced recordings (vod_id)."""
    v = ids.select("vod_id").distinct().join(t.vods.select(F.col("id").alias("vod_id"), "availability"), "vod_id", "left")
    ok = F.coalesce(F.col("availability") == "available", F.lit(False))
    go = v.filter(ok).select("vod_id")
    c = t.chunks.join(go, "vod_id", "left_semi").groupBy("vod_id").agg(F.count(F.lit(1)).alias("c"))
    d = t.detections.join(go, "vod_id", "left_semi").groupBy("vod_id").agg(F.count(F.lit(1)).alias("d"))
    # all their chunks go, so that none is left to count or to avoid
    rest = With(t, vods=t.vods.join(go.select(F.col("vod_id").alias("id")), "id", "left_semi"), chunks=t.chunks.limit(0))
    n = create_missing_chunks(rest).groupBy("vod_id").agg(F.count(F.lit(1)).alias("n"))
    rows = v.join(c, "vod_id", "left").join(d, "vod_id", "left").join(n, "vod_id", "left")
    zero = lambda x, name: F.coalesce(x, F.lit(0)).alias(name)
    return rows.select("vod_id", ok.alias("success"), zero("c", "chunks_deleted"), zero("d", "detections_deleted"), zero("n", "chunks_created"))


def force_process(t, requests: DataFrame) -> DataFrame:
    """(request_id, vod_id, success, answer) of requests (request_id, vod_id, source_id): the JSON that each caller gets.

    An id rules over a source id. Requests for recordings that are unknown or not available, or that name none, are
    answered by an error; all others by what was deleted and created. Equal requests are each answered alike.
    """
    by_source = t.vods.groupBy("source_id").agg(F.min("id").alias("__found"))
    r = requests.join(by_source, "source_id", "left").withColumn("__id", F.coalesce("vod_id", "__found"))
    r = r.select("request_id", F.col("vod_id").alias("__asked"), "source_id", F.col("__id").alias("vod_id"))
    known = t.vods.select(F.col("id").alias("vod_id"), "availability")
    done = reprocess(t, r.select("vod_id").dropna())
    rows = r.join(known, "vod_id", "left").join(done.drop("success"), "vod_id", "left")
    text = F.col("vod_id").cast("string")
    # The messages.
    error = (
        F.when(F.col("__asked").isNull() & F.col("source_id").isNull(), "Must provide either p_vod_id or p_source_id")
        .when(F.col("vod_id").isNull(), F.concat(F.lit("VOD not found with source_id: "), "source_id"))
        .when(F.col("availability").isNull(), F.concat(F.lit("VOD not found with id: "), text))
        .when(F.col("availability") != "available", F.format_string("VOD %s is not available (status: %s)", text, "availability"))
    )
    counts = [F.col(c) for c in ("chunks_deleted", "detections_deleted", "chunks_created")]
    message = F.format_string("Force-processed VOD %s: deleted %d chunks/%d detections, created %d new chunks", text, *counts)
    good = F.struct(F.lit(True).alias("success"), "vod_id", counts[0].alias("deleted_chunks"), counts[1].alias("deleted_detections"), counts[2].alias("created_chunks"), message.alias("message"))
    bad = F.struct(F.lit(False).alias("success"), F.col("error"), F.col("vod_id"))
    whole = {"ignoreNullFields": "false"}
    return rows.withColumn("error", error).select("request_id", "vod_id", F.col("error").isNull().alias("success"), F.when(F.col("error").isNull(), F.to_json(good, whole)).otherwise(F.to_json(bad, whole)).alias("answer"))


def sweep_counts(requested: DataFrame, returned: DataFrame, key: str = "id") -> DataFrame:
    """(checked, marked_unavailable, still_available) of a probe, one row."""
    seen = presence(requested, returned, key)
    return seen.agg(F.count(F.lit(1)).alias("checked"), F.count_if(~F.col("available")).alias("marked_unavailable"), F.count_if("available").alias("still_available"))


def counted(rows: DataFrame, by: str) -> DataFrame:
    """(by, n): how many rows took each route, or had each reason."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def list_subscriptions(subscriptions: DataFrame, user_id: str) -> DataFrame:
    """(username, created_at) of a user's enabled subscriptions, the oldest first."""
    return subscriptions.filter((F.col("user_id") == user_id) & F.col("enabled")).select("username", "created_at").orderBy("created_at", "username")


def list_message(subscriptions: DataFrame, user_id: str) -> DataFrame:
    """(content): the answer to a user's list command, one row."""
    own = list_subscriptions(subscriptions, user_id).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("created_at", "username"))), lambda x: F.concat(F.lit("- **"), x["username"], F.lit("**"))), "\n").alias("names"))
    # The answers with and without subscriptions.
    return own.select(F.when(F.col("names") == "", "You have no active subscriptions. Use `/notify <username>` to subscribe.").otherwise(F.concat(F.lit("Your active subscriptions:\n"), "names")).alias("content"))

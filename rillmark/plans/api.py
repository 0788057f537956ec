"""What end users call: searches, statistics, work selection, dispatch plans, catalogue refresh."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import aggregates as A
from ..operators import changes as G
from ..operators import intervals as I
from ..operators import views as V
from ..sources import tables as T
from ..sources.staging import staged
from ..streaming.jobs import shared_dir


def _found(t, query: str | None, streamer_id: int | None, kind: str, threshold: float, now: datetime, known: tuple[str, ...], min_confidence: float) -> DataFrame:
    if query:  # each name is scored once, and only detections of those that match meet recordings
        names = t.detections.filter(F.col("confidence") > min_confidence).select("username").distinct()
        names = names.withColumn("similarity_score", C.set_similarity(C.trigrams(F.col("username")), C.trigrams(F.lit(query))))
        named = t.detections.join(staged(names.filter(C.similar(F.col("similarity_score"), threshold))), "username")
        t = G.With(t, detections=named)
    rows = V.date_range(V.opt_filter(V.detection_search(t, min_confidence), "streamer_id", streamer_id), "actual_timestamp", kind, now, known)
    return rows if query else rows.withColumn("similarity_score", F.lit(1.0).cast("float"))


def _order(query: str | None) -> list:
    first = [F.desc("similarity_score")] if query else []
    return [*first, F.desc_nulls_first("actual_timestamp"), F.asc("detection_id")]


def _first(t, query: str | None, limit: int, *how) -> DataFrame:
    """Rows of _found among which the first limit are.

    Without a query all match: their order is found by ids and times alone, and only those first are looked up whole.
    """
    if query:
        return _found(t, query, *how)
    ids = staged(_found(t, query, *how).orderBy(*_order(query)).limit(limit).select("vod_id", F.col("detection_id").alias("id")).distinct())
    own = t.detections.join(F.broadcast(ids), ["vod_id", "id"], "left_semi")  # limit rows
    vods = staged(t.vods.join(F.broadcast(ids.select(F.col("vod_id").alias("id")).distinct()), "id", "left_semi"))
    return _found(G.With(t, detections=own, vods=vods), query, *how)


def fuzzy_search(t, now: datetime, query: str | None = None, streamer_id: int | None = None, kind: str = "all", threshold: float = 0.2, limit: int = 100, offset: int = 0) -> DataFrame:
    """A ranked page of detections whose username resembles query, with the number of all that match.

    No query matches all with a score of 1. Pages past the end are empty, so they carry no total either.
    """
    rows = _found(t, query, streamer_id, kind, threshold, now, ("day", "week", "month", "year"), 0.7)
    if query:  # few match; they are found once, for the page and the total
        path = shared_dir(t.spark)
        rows.write.parquet(path)
        rows = t.spark.read.schema(rows.schema).parquet(path)
    page = rows.orderBy(*_order(query)).offset(offset).limit(limit).select(*V.SEARCH_COLUMNS, "similarity_score", "truncated")
    return A.with_total(page, rows)


def fuzzy_search_debug(t, now: datetime, query: str | None = None, streamer_id: int | None = None, kind: str = "all", threshold: float = 0.2, limit: int = 100) -> DataFrame:
    """Down to any positive confidence, without total and offset; "day" is no range here."""
    rows = _first(t, query, limit, streamer_id, kind, threshold, now, ("week", "month", "year"), 0.0)
    return rows.orderBy(*_order(query)).limit(limit).select(*V.SEARCH_COLUMNS, "similarity_score", "truncated")


def fuzzy_search_first(t, now: datetime, query: str | None = None, streamer_id: int | None = None, kind: str = "all", threshold: float = 0.2, limit: int = 100) -> DataFrame:
    """The first version: no total, no truncated, no offset; "day" is no range here."""
    rows = _first(t, query, limit, streamer_id, kind, threshold, now, ("week", "month", "year"), 0.7)
    return rows.orderBy(*_order(query)).limit(limit).select(*V.SEARCH_COLUMNS, "similarity_score")


def top_streamers(t, top: int = 10, each: int = 3) -> DataFrame:
    """The streamers with most detections, the smallest id first on ties, with their latest detections.

    Detections are counted by recording before they meet one; then only the best streamers' are looked up.
    """
    by = ["streamer_id", "streamer_login", "streamer_display_name", "streamer_avatar"]
    n = t.detections.filter("confidence > 0.7").groupBy("vod_id").agg(F.count(F.lit(1)).alias("n"))
    v = t.vods.filter("availability = 'available'").select(F.col("id").alias("vod_id"), "streamer_id")
    per = n.join(v, "vod_id").groupBy("streamer_id").agg(F.sum("n").alias("total_detections"), F.countDistinct("vod_id").alias("total_vods"))
    known = t.streamers.select(F.col("id").alias("streamer_id"))
    best = staged(per.join(known, "streamer_id", "left_semi").orderBy(F.desc("total_detections"), "streamer_id").limit(top))
    own = staged(t.vods.join(F.broadcast(best.select("streamer_id")), "streamer_id", "left_semi"))  # top rows
    rows = V.detection_search(G.With(t, vods=own)).join(best, "streamer_id")
    last = A.topk_per_group(rows, "streamer_id", [F.desc_nulls_first("actual_timestamp"), F.asc("detection_id")], each, "detection_row_num")
    cols = [*by, "total_detections", "total_vods", "detection_id", "username", "frame_time_seconds", "confidence", "rank", "vod_id", "vod_source_id", "vod_url", "actual_timestamp", "detection_row_num", "truncated"]
    return last.select(*cols).orderBy(F.desc("total_detections"), "streamer_id", "detection_row_num")


def global_stats_json(t) -> DataFrame:
    return A.global_stats(t).select(F.to_json(F.struct("streamers", "vods", "detections")).alias("stats"))


def pending_chunks(t, vod_id: int | None = None, source_id: str | None = None) -> DataFrame:
    """Pending chunks of the recording by either id, by index; one id must be given."""
    if vod_id is None and source_id is None:
        raise ValueError("give vod_id or source_id")
    v = t.vods.filter("availability = 'available' AND ready_for_processing").join(V.enabled(t), "streamer_id", "left_semi")
    hit = F.lit(False)
    if vod_id is not None:
        hit = hit | (F.col("id") == vod_id)
    if source_id is not None:
        hit = hit | (F.col("source_id") == source_id)
    v = v.filter(hit).select(F.col("id").alias("vod_id"), "source_id")
    c = t.chunks.filter("status = 'pending'").withColumnRenamed("id", "chunk_id").join(v, "vod_id")
    return c.select("chunk_id", "vod_id", "source_id", "chunk_index", "start_seconds", "end_seconds", "status", "attempt_count").orderBy("chunk_index")


def vods_to_check(t, now: datetime, hours: int = 24, limit: int = 100) -> DataFrame:
    """Available recordings never checked, or not within hours; never checked ones first, then the oldest check."""
    old = F.col("last_availability_check").isNull() | (F.col("last_availability_check") < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS"))
    rows = t.vods.filter("availability = 'available' AND source = 'feed'").filter(old)
    return rows.orderBy(F.asc_nulls_first("last_availability_check"), "id").limit(limit).select("id", "source_id", "last_availability_check")


def next_chunks(t, limit: int = 100, min_priority: int = 0) -> DataFrame:
    rows = t.chunks.filter((F.col("status") == "pending") & (F.col("priority") >= min_priority))
    return rows.orderBy(F.desc("priority"), F.asc_nulls_last("scheduled_for"), F.asc("id")).limit(limit).select("id", "vod_id", "priority", "scheduled_for")


def _wanted(count: str) -> int:
    return 10 if count.lower() == "all" else int(count) if count.isdigit() else 1


def search_command(t, now: datetime, name: str, exact: bool = False, count: str = "1") -> DataFrame:
    """(detection_id, position, line): what a search command answers, best first; exact asks for equal trigram sets.

    A line has the streamer's name, the time and a link that opens the recording there; an unknown time is that of epoch 0.
    """
    rows = fuzzy_search(t, now, name, threshold=1.0 if exact else 0.2, limit=_wanted(count))
    epoch = F.coalesce(C.epoch_seconds(F.col("actual_timestamp")), F.lit(0))
    line = C.result_line(F.col("streamer_display_name"), epoch, C.hms_url(F.col("vod_source_id"), F.col("frame_time_seconds")))
    position = F.row_number().over(Window.orderBy(*_order(name)))  # ten rows at most, already in order
    return rows.select("detection_id", position.alias("position"), line.alias("line"))


def search_message(t, now: datetime, name: str, exact: bool = False, count: str = "1") -> DataFrame:
    """(content): the whole answer to a search command, one row, also where nothing is found."""
    lines = search_command(t, now, name, exact, count).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    # The two headers and the answer without results.
    header = f'**Latest result for "{name}":**' if _wanted(count) == 1 else f'**Results for "{name}":**'
    return lines.select(F.when(F.col("lines") == "", F.lit(f"No results found for **{name}**")).otherwise(F.concat(F.lit(header + "\n"), "lines")).alias("content"))


def dispatch_plan(t, until: datetime) -> DataFrame:
    """What each eligible recording's run would be given: its pending chunks in order, the era flag, its profile as JSON."""
    v = V.eligible_vods(t).select(F.col("id").alias("vod_id"), "source_id", "published_at")
    c = t.chunks.filter("status = 'pending'").groupBy("vod_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "id"))), lambda s: s["id"].cast("string")).alias("ids"))
    profile = V.profile_for(t).select("vod_id", F.to_json(F.struct("profile_id", "profile_name")).alias("profile"))
    rows = v.join(c, "vod_id").join(profile, "vod_id", "left")
    return rows.select("vod_id", "source_id", F.array_join("ids", ",").alias("chunk_ids"), (F.col("published_at") <= F.lit(until).cast("timestamp_ntz")).alias("old_templates"), "profile")


def queued_chunks(t, vod_id: int) -> DataFrame:
    return t.chunks.filter((F.col("vod_id") == vod_id) & (F.col("status") == "queued")).select("id", "chunk_index", "start_seconds", "end_seconds").orderBy("chunk_index")


def _with_chapters(feed: DataFrame, wanted: str, needle: str) -> DataFrame:
    """feed with chapters, null where a recording is not to be stored; a row's markers are read where they are."""
    mark = lambda m, i: F.struct(m["positionMilliseconds"].alias("ms"), i.alias("i"), C.is_category(m["game"]["id"], m["game"]["displayName"], wanted, needle).alias("hit"))
    rows = feed.withColumn("__marks", F.sort_array(F.transform("moments", mark)))
    own = I.intervals_in("__marks", "length_seconds")
    main = C.is_category(F.lit(None).cast("string"), F.col("game"), wanted, needle)
    return rows.withColumn("chapters", own).withColumn("chapters", F.when(F.size("chapters") > 0, F.col("chapters")).when(main, F.array(F.lit(0), F.col("length_seconds")))).drop("__marks")


def _updates(rows: DataFrame) -> DataFrame:
    return rows.filter("chapters IS NOT NULL").select(F.col("id").alias("source_id"), "title", F.col("length_seconds").alias("duration_seconds"), "chapters")


def catalogue_updates(feed: DataFrame, wanted: str, needle: str) -> DataFrame:
    """(source_id, title, duration_seconds, chapters) of a feed's recordings that are to be stored.

    Chapters are the wanted markers' intervals, each up to the next marker of any kind. A recording without a wanted
    marker is taken whole if its main game is wanted, else it is left out.
    """
    return _updates(_with_chapters(feed, wanted, needle))


def refresh_catalogue(feed: DataFrame, vods: DataFrame, wanted: str, needle: str) -> DataFrame:
    """vods with a feed's recordings merged by source id."""
    return T.merge_snapshot(vods, catalogue_updates(feed, wanted, needle), ["source_id"], ["title", "duration_seconds", "chapters"])


def refresh_streamers(feed: DataFrame, live: DataFrame, vods: DataFrame, wanted: str, needle: str) -> dict[str, DataFrame]:
    """A refresh as a whole, of a feed with streamer_id and published_at: {"vods", "streamers", "counts"}.

    The newest recording of a live streamer is left out of everything. vods are the stored ones with the rest merged in;
    streamers what each one's row then says; counts (streamer_id, fetched, upserted, segments, oldest) what was done.
    """
    rest = I.skip_live(_with_chapters(feed, wanted, needle), live)
    marked = rest.withColumn("matching", F.col("chapters").isNotNull()).withColumn("pairs", F.when(F.col("matching"), (F.size("chapters") / 2).cast("int")))
    counts = marked.groupBy("streamer_id").agg(F.count(F.lit(1)).alias("fetched"), F.count("pairs").alias("upserted"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("segments"), F.min("published_at").alias("oldest"))
    return {"vods": T.merge_snapshot(vods, _updates(rest), ["source_id"], ["title", "duration_seconds", "chapters"]), "streamers": A.refresh_streamers(marked), "counts": counts}


def discover(videos: DataFrame, known: DataFrame) -> DataFrame:
    """New streamers (streamer_id) of recent videos in order of first sight, with processing enabled."""
    first = T.first_seen(videos, "streamer_id", [F.asc("page"), F.asc("video_id")])
    return V.new_streamers(first.select(F.col("streamer_id").alias("id"), "page"), known).withColumn("processing_enabled", F.lit(True))


def frames_to_detections(frames: DataFrame, ranks: DataFrame, texts: DataFrame, threshold: float = 0.5, gap: int = 10, edges: DataFrame | None = None) -> DataFrame:
    """(chunk_id, frame_time_seconds, username, confidence, rank) of frames (frame_id, chunk_id, ts).

    With edges (frame_id, width, custom_edge, opaque_edge, detected_x), also no_right_edge and truncated, as right_edge
    decides them; a frame without a row there has no edge.

    The best rank (frame_id, rank, score, position) decides which frames count; they are thinned, whether or not a name
    is then read; of the texts (frame_id, idx, text, score) the best is cleaned, and frames without a name go.
    """
    best = A.argmax(ranks, "frame_id", "score", "position", threshold).select("frame_id", "rank")
    hit = frames.join(best, "frame_id")
    kept = A.thin(hit, "chunk_id", "ts", gap).withColumnRenamed("ts", "t")
    one = hit.join(kept, (hit["ts"] == kept["t"]) & (hit["chunk_id"] == kept["chunk_id"]), "left_semi")
    one = T.first_seen(one.withColumn("__k", F.struct("chunk_id", "ts")), "__k", [F.asc("frame_id")]).drop("__k")
    read = A.argmax(texts, "frame_id", "score", "idx").select("frame_id", C.clean_username(F.col("text")).alias("username"), F.col("score").alias("confidence"))
    rows, more = one.join(read, "frame_id").filter("username IS NOT NULL"), []
    if edges is not None:
        edge = C.right_edge(F.col("width"), F.col("custom_edge"), F.col("opaque_edge"), F.col("detected_x"))
        rows, more = rows.join(edges, "frame_id", "left").withColumn("__e", edge), ["__e.no_right_edge", "__e.truncated"]
    return rows.select("chunk_id", F.col("ts").alias("frame_time_seconds"), "username", "confidence", "rank", *more)


force_process = G.force_process

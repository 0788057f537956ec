"""Tables in and out: typed scans, the domain tables derived from the star schema, snapshots and their changes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def bindings(array: str = "array({})") -> dict[str, str]:
    """The domain tables as SQL over the star schema; array: how the dialect writes an array."""
    arr = array.format
    d = "CAST(floor(o_totalprice / 25) AS INT)"
    username = "concat(replace(p_name, ' ', ''), CAST(p_size AS STRING))"
    half = lambda n: f"CAST(floor({d} * {n} / 4.0) AS INT)"
    return {
        "streamers": "SELECT c_custkey AS id, lower(c_name) AS login, c_name AS display_name, concat('img/', CAST(c_custkey AS STRING), '.png') AS profile_image_url, c_acctbal > 0 AS processing_enabled, CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE c_nationkey % 3 = 1 END AS has_vods, c_nationkey % 5 + 1 AS profile_id FROM customer",
        "vods": f"SELECT o_orderkey AS id, o_custkey AS streamer_id, 'feed' AS source, CAST(o_orderkey AS STRING) AS source_id, o_orderpriority AS title, {d} AS duration_seconds, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderdate END AS published_at, CASE o_orderstatus WHEN 'P' THEN 'unavailable' ELSE 'available' END AS availability, o_orderpriority <> '5-LOW' AS ready_for_processing, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate END AS last_availability_check, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN {arr(f'0, {half(2)}')} ELSE {arr(f'{half(1)}, {half(2)}, {half(3)}, {d} + 100')} END AS chapters FROM orders",
        "chunks": "SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS vod_id, l_linenumber - 1 AS chunk_index, (l_linenumber - 1) * 1800 AS start_seconds, l_linenumber * 1800 AS end_seconds, CASE concat(min(l_returnflag), min(l_linestatus)) WHEN 'AF' THEN 'completed' WHEN 'AO' THEN 'queued' WHEN 'RF' THEN 'failed' WHEN 'RO' THEN 'processing' ELSE 'pending' END AS status, CASE WHEN min(l_quantity) < 10 THEN NULL WHEN max(l_tax) > 0.05 THEN '480p' ELSE '360p' END AS quality, CAST(count(*) - 1 AS INT) AS attempt_count, CAST(max(l_quantity) AS INT) % 3 AS priority, min(l_shipdate) AS scheduled_for FROM lineitem GROUP BY l_orderkey, l_linenumber",
        "detections": f"SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(l_extendedprice AS STRING)) AS id, l_orderkey * 10 + l_linenumber AS chunk_id, l_orderkey AS vod_id, {username} AS username, 1.0e0 - 4.0e0 * l_discount AS confidence, CASE l_linenumber % 5 WHEN 0 THEN 'bronze' WHEN 1 THEN 'silver' WHEN 2 THEN 'gold' WHEN 3 THEN 'diamond' ELSE 'legend' END AS rank, CAST(floor(l_extendedprice / 10) AS INT) AS frame_time_seconds, l_linestatus = 'O' AS no_right_edge, l_returnflag = 'R' AS truncated FROM lineitem JOIN part ON p_partkey = l_partkey",
        "subscriptions": f"SELECT CAST(c_custkey AS STRING) AS user_id, {username} AS username, c_acctbal > 0 AS enabled, CASE c_nationkey % 3 WHEN 0 THEN 'dm' WHEN 1 THEN 'server' ELSE 'both' END AS notify_type, CAST(c_nationkey AS STRING) AS guild_id FROM customer JOIN part ON p_partkey = c_custkey",
        "channels": "SELECT CAST(n_nationkey AS STRING) AS guild_id, n_name AS channel_id FROM nation WHERE n_regionkey <> 4",
        "profiles": "SELECT r_regionkey + 1 AS id, r_name AS profile_name, CAST(0.1 * (r_regionkey + 1) AS DOUBLE) AS custom_edge, r_regionkey % 2 = 0 AS opaque_edge FROM region",
        "markers": "SELECT event_id AS marker_id, user_id AS vod_id, ts AS position, event_type AS category FROM events",
        "metrics": "SELECT event_id, ts, event_type AS name, user_id % 4 AS attr, value FROM events",
    }


def load(spark: SparkSession, sf_dir: str, name: str, cols: Iterable[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def load_declared(spark: SparkSession, sf_dir: str, name: str, schema: str, cols: Iterable[str] | None = None) -> DataFrame:
    """A table by a declared schema (DDL): files are not asked for theirs, a column they lack is null, and one of another
    type is an error when it is read."""
    df = spark.read.schema(schema).parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Literal rows as a table."""
    return spark.createDataFrame(rows, schema)


class Tables:
    """The star schema and the domain tables of a folder, by name; each is built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._got: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._got:
            if name in NAMES:
                self._got[name] = load(self.spark, self.sf_dir, name)
            else:
                text = bindings()[name]
                used = [n for n in NAMES if f" {n} " in f"{text} "]
                for n in used:
                    text = f"{text} ".replace(f" {n} ", f" {{{n}}} ")
                self._got[name] = self.spark.sql(text, **{n: getattr(self, n) for n in used})
        return self._got[name]


def newest_per_key(df: DataFrame, key: str, order: list[Column], n: int = 100) -> DataFrame:
    """At most min(n, 100) rows of each key, first in order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__r", rank).filter(F.col("__r") <= min(n, 100)).drop("__r")


def fetched_pages(df: DataFrame, key: str, order: list[Column], n: int | None = None, page: int = 100, pages: int = 50) -> DataFrame:
    """df with page (from 1): what a paged fetch gets of each key, first in order.

    With n, one page of min(n, page) rows; without, up to so many full pages.
    """
    most = min(n, page) if n else page * pages
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    rows = df.withColumn("__r", rank).filter(F.col("__r") <= most)
    return rows.withColumn("page", (F.floor((F.col("__r") - 1) / page) + 1).cast("int")).drop("__r")


def first_seen(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return newest_per_key(df, key, order, 1)


def append_detections(df: DataFrame, path: str, batch: str | int) -> None:
    """Appends the rows that have a username as a batch; a batch that is written again replaces itself."""
    df.filter(F.col("username").isNotNull()).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def merge_snapshot(base: DataFrame, updates: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """base with updates merged by keys: listed columns are overwritten, others keep their value, new keys are added."""
    new = updates.select(*keys, *(F.col(c).alias(f"__n_{c}") for c in cols), F.lit(True).alias("__new"))
    both = base.withColumn("__old", F.lit(True)).join(new, keys, "full_outer")
    pick = lambda c: F.when(F.col("__new"), F.col(f"__n_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*(pick(c) if c in cols else F.col(c) for c in base.columns))


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """streamers, vods, chunks and detections without the streamers gone (id) and what belongs to them."""
    steps = [("vods", "streamer_id"), ("chunks", "vod_id"), ("detections", "vod_id")]
    out = {"streamers": tables["streamers"].join(gone.select("id"), "id", "left_anti")}
    lost = gone.select(F.col("id").alias("__gone"))
    for name, fk in steps:
        df = tables[name]
        out[name] = df.join(lost, df[fk] == lost["__gone"], "left_anti")
        if name == "vods":
            lost = df.join(lost, df[fk] == lost["__gone"], "left_semi").select(F.col("id").alias("__gone"))
    return out


def replace_partition(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """base without the keys that new has, then new."""
    return base.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def export_summary(detections: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """A JSON document for each chunk: its id, how many detections, and they themselves in order of time and id.

    With chunks (id, vod_id, chunk_index, start_seconds, end_seconds, quality), their columns stand in the header, and
    chunks without detections have a document too.
    """
    item = F.struct(F.col("frame_time_seconds").alias("timestamp"), "id", "username", "confidence", "rank")
    grouped = detections.groupBy("chunk_id").agg(F.sort_array(F.collect_list(item)).alias("items"), F.count(F.lit(1)).alias("n"))
    plain = lambda c: F.transform(c, lambda x: F.struct(x["timestamp"].alias("timestamp"), x["username"].alias("username"), x["rank"].alias("rank")))
    if chunks is None:
        return grouped.select("chunk_id", F.to_json(F.struct("chunk_id", F.col("n").alias("detections_count"), plain("items").alias("detections"))).alias("document"))
    rows = chunks.withColumnRenamed("id", "chunk_id").join(grouped, "chunk_id", "left")
    full = F.transform("items", lambda x: F.struct(x["timestamp"].alias("timestamp"), x["username"].alias("username"), F.round(x["confidence"], 6).alias("confidence"), x["rank"].alias("rank")))
    body = F.coalesce(full, F.array().cast("array<struct<timestamp:int,username:string,confidence:double,rank:string>>"))
    head = ["vod_id", "chunk_id", "chunk_index", "start_seconds", "end_seconds", "quality"]
    return rows.select("chunk_id", F.to_json(F.struct(*head, F.coalesce("n", F.lit(0)).alias("detections_count"), body.alias("detections")), {"ignoreNullFields": "false"}).alias("document"))


def write_summaries(documents: DataFrame, path: str, parts: int = 16, compression: str = "none") -> None:
    """Documents (chunk_id, document) as text files, in folders by a hash of the chunk: so many, however many chunks there are.

    Each task writes what it has of each folder, all at once: documents are neither shuffled nor sorted again.
    """
    rows = documents.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int"))
    conf, writers = documents.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    was = conf.get(writers)
    conf.set(writers, str(parts))
    try:
        rows.select("part", F.col("document").alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", compression).partitionBy("part").text(path)
    finally:
        conf.set(writers, was)


PAGE = "struct<user:struct<videos:struct<edges:array<struct<node:struct<id:string,title:string,lengthSeconds:int,publishedAt:string,game:struct<id:string,displayName:string>,moments:struct<edges:array<struct<node:struct<positionMilliseconds:bigint,type:string,game:struct<id:string,displayName:string>>>>>>>>>>>"


def flatten_pages(pages: DataFrame, body: str = "body") -> DataFrame:
    """A row for each recording of nested feed pages; missing moments give an empty array, a missing game null."""
    node = F.explode(F.from_json(body, PAGE)["user"]["videos"]["edges"]["node"]).alias("n")
    n = pages.select(node)
    moments = F.coalesce(F.col("n.moments.edges.node"), F.array().cast("array<struct<positionMilliseconds:bigint,type:string,game:struct<id:string,displayName:string>>>"))
    return n.select(F.col("n.id").alias("id"), F.col("n.title").alias("title"), F.col("n.lengthSeconds").alias("length_seconds"), F.col("n.publishedAt").alias("published_at"), F.col("n.game.displayName").alias("game"), moments.alias("moments"))


def parse_event_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """Log lines whose message is a JSON event again; plain messages go."""
    outer = F.from_json(line, "level string, message string, vod_id bigint, chunk_id bigint")
    inner = F.from_json(F.col("o.message"), "event string, username string, rank string, frames int")
    return lines.select(outer.alias("o")).select("o.vod_id", "o.chunk_id", inner.alias("e")).filter("e.event IS NOT NULL").select("vod_id", "chunk_id", "e.*")


def cap_rows(df: DataFrame, n: int = 1000) -> DataFrame:
    """At most n rows of any result, as the API gives them."""
    return df.limit(n)


def stamped(df: DataFrame, updates: DataFrame, keys: list[str], cols: list[str], now) -> DataFrame:
    """merge_snapshot, with updated_at set to now on the rows that updates names."""
    marked = updates.withColumn("updated_at", F.lit(now).cast("timestamp_ntz"))
    return merge_snapshot(df, marked, keys, [*cols, "updated_at"])

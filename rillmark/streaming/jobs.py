"""Structured Streaming jobs: debouncing, notifications, metric windows, routing; each runs what is there and stops."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..operators import changes
from ..sources.staging import shared_dir


def source(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder or pattern as a stream, with their own schema."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def drain(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Runs a stream over all that is there into a table in the shared folder; the checkpoint beside it lets it go on."""
    spark = stream.sparkSession
    folder = folder or shared_dir(spark)
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{folder}/out")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


class InOrder(StatefulProcessor):
    """Handles a key's rows in order of event time, however they arrive.

    Rows wait in a list until the watermark has passed them, as no earlier one can come then. A timer at the first one
    waiting releases, in order, all that the watermark has passed by then: state is touched a few times for a key and
    batch, not for a row. The first of columns is the row's time, in units of so many milliseconds.
    """

    def __init__(self, columns: list[str], types: list[str], millis: float):
        self.columns, self.types, self.millis = columns, types, millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", f"last {self.types[-1]}")
        self.waiting = handle.getListState("waiting", ", ".join(f"{c} {k}" for c, k in zip(self.columns, self.types)))

    def at(self, x: int) -> int:
        return int(x * self.millis)

    def release(self, key: tuple, rows: list[tuple]) -> pd.DataFrame | None:
        """What rows in order give, after those before."""
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(r) for pdf in rows for r in pdf[self.columns].dropna().astype({c: "int64" for c, k in zip(self.columns, self.types) if k == "long"}).itertuples(index=False)]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(self.at(min(r[0] for r in new)))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.waiting.get())
        ripe = [r for r in rows if self.at(r[0]) <= passed]
        rest = rows[len(ripe) :]
        if not rest:
            self.waiting.clear()
        elif ripe:
            self.waiting.put(rest)
            self.handle.registerTimer(self.at(rest[0][0]))
        out = self.release(key, ripe)
        return iter([] if out is None else [out])


class Debouncer(StatefulProcessor):
    """Greedy thinning of the frames of a group of keys.

    State is touched a few times for a group and batch, however many keys and frames it has: frames wait as arrays of keys
    and times, one pair for each batch, until the watermark has passed them, as no earlier one can come then. A timer at
    the first one waiting takes all that the watermark has passed by then. Once the last time taken of a key is gap behind
    the watermark it can hold no frame back any more and goes: idle keys keep no state. Frames that are known to come in
    order from batch to batch may be handled at once, without a watermark and timers.
    """

    def __init__(self, key: str, ts: str, gap: int, unit: int, at_once: bool):
        self.key, self.ts, self.gap, self.millis, self.at_once = key, ts, gap, unit * 1000, at_once

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.done = handle, None
        self.last = handle.getValueState("last", "keys binary, times binary")
        self.waiting = handle.getListState("waiting", "keys binary, times binary")

    @staticmethod
    def packed(keys: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes]:
        return keys.astype("<i8").tobytes(), times.astype("<i8").tobytes()

    @staticmethod
    def unpacked(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate([np.empty(0, "<i8"), *(np.frombuffer(p[i], "<i8") for p in parts)]) for i in (0, 1))

    def taken(self, keys: np.ndarray, times: np.ndarray, passed: int | None) -> tuple[Iterator[pd.DataFrame], int | None]:
        """The frames taken, and the first time until which a key's last one counts; passed is the watermark in ms."""
        stored = self.last.get()
        last = dict(zip(*(x.tolist() for x in self.unpacked([stored] if stored else []))))
        out: list[tuple[int, int]] = []
        order = np.lexsort((times, keys))
        for k, x in zip(keys[order].tolist(), times[order].tolist()):
            if x - last.get(k, 0) >= self.gap:
                last[k] = x
                out.append((k, x))
        if passed is not None:
            last = {k: x for k, x in last.items() if (x + self.gap) * self.millis > passed}
        if last:
            self.last.update(self.packed(np.array(list(last)), np.array(list(last.values()))))
        elif stored:
            self.last.clear()
        return iter([pd.DataFrame(out, columns=[self.key, self.ts])] if out else []), min(last.values()) + self.gap if last else None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([pdf.loc[pdf["frame"], ["key", "time"]] for pdf in rows])
        if not len(new):
            return iter(())
        keys, times = new["key"].to_numpy(), new["time"].to_numpy()
        if self.at_once:
            return self.taken(keys, times, None)[0]
        self.waiting.appendValue(self.packed(keys, times))
        self.handle.registerTimer(int(times.min()) * self.millis)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        if self.done == (key, passed):  # another timer of the group has done it
            return iter(())
        self.done = key, passed
        keys, times = self.unpacked(list(self.waiting.get()))
        ripe = times * self.millis <= passed
        out, until = self.taken(keys[ripe], times[ripe], passed)
        rest = times[~ripe]
        if not len(rest):
            self.waiting.clear()
        elif ripe.any():
            self.waiting.put([self.packed(keys[~ripe], rest)])
        ahead = ([int(rest.min())] if len(rest) else []) + ([] if until is None else [until])
        if ahead:
            self.handle.registerTimer(min(ahead) * self.millis)
        return out


class Deltas(InOrder):
    """What a cumulative counter grew by from each point to the next; where it fell it was reset, and its value is the growth."""

    def __init__(self) -> None:
        super().__init__(["at", "seq", "value"], ["long", "long", "double"], 0.001)

    def release(self, key: tuple, rows: list[tuple]) -> pd.DataFrame | None:
        if not rows:
            return None
        last = self.last.get()
        before = last[0] if last else None
        out = []
        for at, seq, value in rows:
            out.append((*key, at, seq, value if before is None or value < before else value - before))
            before = value
        self.last.update((before,))
        return pd.DataFrame(out, columns=["name", "attr", "at", "seq", "delta"])


def debounce(frames: DataFrame, key: str, ts: str, gap: int = 10, late: int | None = None, unit: int = 1, groups: int = 256) -> DataFrame:
    """Greedy thinning of a stream: (key, ts) of the frames taken.

    ts counts units of so many seconds. With late, frames may come in any order, up to late units behind the latest of
    all keys; what comes later is dropped, and a frame is given once the watermark has passed it. A row without a key
    moves the watermark and is no frame; one far ahead closes a stream. Without late, a key's frames must come in order
    from batch to batch; they are given at once, and each key keeps its last time. Keys are dealt to so many groups by
    hash, and each group has one state; a group's waiting frames fit in a task's memory. The number of groups must stay
    the same for a checkpoint to go on.
    """
    with_state_store(frames.sparkSession)
    rows = frames.select(F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("key"), F.coalesce(F.col(ts).cast("long"), F.lit(0)).alias("time"), (F.col(key).isNotNull() & F.col(ts).isNotNull()).alias("frame"), F.timestamp_seconds(F.col(ts) * unit).alias("at"))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int"))  # workers rename columns that begin with "_"
    if late is None:
        return rows.filter("frame").groupBy("group").transformWithStateInPandas(Debouncer(key, ts, gap, unit, True), f"{key} long, {ts} long", "Append", "None")
    # a filter here would be pushed below the watermark, which rows without a key are to move
    return rows.withWatermark("at", f"{late * unit} seconds").groupBy("group").transformWithStateInPandas(Debouncer(key, ts, gap, unit, False), f"{key} long, {ts} long", "Append", "EventTime")


def delta_sums(points: DataFrame, late: str = "1 minute") -> DataFrame:
    """(name, attr, ts, seq, delta) of cumulative points (name, attr, ts, seq, value), in any order within late.

    Points of one time follow their seq; a point without a value only moves the watermark, and one far ahead closes the
    stream. Each counter, a name and attr, begins at nothing.
    """
    with_state_store(points.sparkSession)
    rows = points.select("name", "attr", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("seq").cast("long").alias("seq"), F.col("value").cast("double").alias("value"), F.col("ts").cast("timestamp").alias("__at"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = rows.withWatermark("__at", late).groupBy("name", "attr").transformWithStateInPandas(Deltas(), f"name {kinds['name']}, attr {kinds['attr']}, at long, seq long, delta double", "Append", "EventTime")
    return out.select("name", "attr", F.timestamp_micros("at").alias("ts"), "seq", "delta")


def histogram_windows(metrics: DataFrame, bounds: list[float], width: str = "10 seconds", late: str = "1 minute", by: tuple[str, ...] = ("name", "attr")) -> DataFrame:
    """Counts, sums and bucket counts of each window, name and attribute; a bucket holds values up to its bound, the last all beyond."""
    edges = F.array(*[F.lit(float(b)) for b in bounds])
    bucket = F.size(F.filter(edges, lambda b: F.col("value") > b))
    w = metrics.filter("value IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("__b", bucket).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), *by)
    counts = [F.count_if(F.col("__b") == i).alias(f"__{i}") for i in range(len(bounds) + 1)]
    out = w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), *counts)
    return out.select(F.col("w.start").alias("window_start"), *by, "n", "total", F.array(*(f"__{i}" for i in range(len(bounds) + 1))).alias("buckets"))


def with_state_store(spark: SparkSession) -> None:
    """transformWithState needs the store that can hold several states of a key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def metric_windows(metrics: DataFrame, width: str = "10 seconds", late: str = "1 minute", by: tuple[str, ...] = ("name", "attr")) -> DataFrame:
    """Counts and sums of each window, name and attribute; rows later than the watermark are dropped."""
    w = metrics.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), *by)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")


def notify(detections: DataFrame, subscriptions: DataFrame, channels: DataFrame, folder: str | None = None) -> DataFrame:
    """The messages of every batch of new detections, by the subscriptions and channels as they stand when it comes.

    A batch stores its detections and, once, what each name sends, under its number; a batch that comes again replaces
    itself. They are put together where they are read, so what is stored grows with the tables, not with their matches.
    """
    spark = detections.sparkSession
    folder = folder or shared_dir(spark)
    part = lambda what, n: f"{folder}/{what}/batch={n}"

    def batch(df: DataFrame, n: int) -> None:
        changes.messages_by_name(subscriptions, channels).write.mode("overwrite").parquet(part("messages", n))
        df.select("id", "username").write.mode("overwrite").parquet(part("detections", n))

    q = detections.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    stored = lambda what: spark.read.parquet(f"{folder}/{what}")
    return changes.send(stored("detections"), stored("messages"), ("batch",))


def routed(messages: DataFrame, secret: str, late: str = "10 minutes") -> DataFrame:
    """Webhook messages with their route, each id once within the watermark; those without an id are told apart by all they hold."""
    key = F.coalesce(F.col("message_id"), F.xxhash64(*messages.columns).cast("string"))
    once = messages.withColumn("__key", key).withWatermark("received", late).dropDuplicatesWithinWatermark(["__key"])
    return changes.route(once, secret).drop("__key")

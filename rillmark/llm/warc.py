"""Web archives: WARC files written and read by Spark, and a capture index merged from sorted runs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bloom_split, staged

# The parts of a WARC/1.1 record.
VERSION, CRLF = "WARC/1.1", "\r\n"
END = CRLF + CRLF
#: A record's end and the next one's start; Spark's text reader splits archives here.
BETWEEN = END + VERSION + CRLF
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """The host's labels from the last to the first, then path and query: com,example,www)/a?b. Null stays null."""
    rest = F.regexp_replace(F.lower(url), r"^[a-z][a-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, "#.*$", "")
    host = F.regexp_extract(rest, r"^([^/?:]*)", 1)
    tail = F.regexp_replace(rest, r"^[^/?]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(tail == "", F.lit("/")).otherwise(tail))


def plan_records(pages: DataFrame, date: Column, id_col: str, url_col: str, html_col: str, min_bytes: int = 100) -> DataFrame:
    """(id, url, html, date, payload_bytes, digest, refers_to): which captures are revisits, and of which one.

    Of equal payloads of min_bytes at least, the smallest id is stored, the others refer to it. Digests and ids are
    grouped as partial minima. Only payloads whose digest passes a Bloom filter of those that repeat are shuffled to
    meet them; all others go from their scan to the archives.
    """
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), F.coalesce(date, F.timestamp_seconds(F.lit(0))).alias("date"))
    base = base.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    first = base.filter(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    first = staged(first, "warc-repeated")
    again, once = bloom_split(base, F.col("digest"), first.select("digest"))
    known = again.join(first, "digest", "left").withColumn("refers_to", F.when(F.col("first") != F.col("id"), F.col("first"))).drop("first")
    return once.withColumn("refers_to", F.lit(None).cast(base.schema["id"].dataType)).unionByName(known)


def _record() -> Column:
    """A record without its end, which the writer supplies as its line separator.

    Record ids carry the page's id. A payload that itself holds the separator is stored in base64 and says so, so that
    archives split at separators alone.
    """
    revisit = F.col("refers_to").isNotNull()
    coded = F.when(F.instr("html", BETWEEN) > 0, F.lit(True)).otherwise(F.lit(False))
    body = F.when(revisit, F.lit("")).when(coded, F.base64(F.col("html").cast("binary"))).otherwise(F.col("html"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF),
        F.when(coded & ~revisit, F.lit("Content-Transfer-Encoding: base64" + CRLF)).otherwise(F.lit("")),
        F.lit("Content-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(END),
    )
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", "")
    return F.concat(
        F.lit(VERSION + CRLF),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn("id")),
        line("WARC-Date", F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", urn("refers_to")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
        F.lit(CRLF),
        http,
        body,
    )


def write_archives(records: DataFrame, path: str) -> None:
    """Writes records (of plan_records) as gzipped WARC files, one a task, each a run sorted by URL key and date.

    The files go through Spark's own writer, so they land in any store that Spark reaches, and lost tasks are redone.
    """
    text = records.withColumn("key", url_key(F.col("url"))).sortWithinPartitions("key", "date", "id").select(_record().alias("value"))
    text.write.option("lineSep", END).option("compression", "gzip").text(path)


def _after_blank_line(name: str) -> Column:
    return F.col(name).substr(F.instr(name, END) + len(END), F.length(name))


def read_archives(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(file, type, id, url, date, digest, refers_to, payload), a row for each record; payload is null in revisits."""
    raw = spark.read.option("lineSep", BETWEEN).text(path).select("value", F.col("_metadata.file_name").alias("file")).filter(F.length("value") > 0)
    parts = raw.select("file", F.substring_index("value", END, 1).alias("head"), _after_blank_line("value").alias("block"))

    def header(name: str) -> Column:
        return F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)", 1)

    page = lambda name: F.regexp_extract(header(name), "<urn:page:(.*)>", 1)
    known = lambda c: F.when(c != "", c).cast(id_type)
    block = F.col("block")  # a file's last record still has its end
    rest = F.octet_length(block) - header("Content-Length").cast("int")
    parts = parts.withColumn("block", F.when(rest == len(END), F.expr(f"left(block, length(block) - {len(END)})")).otherwise(block))
    body = _after_blank_line("block")
    coded = F.substring_index("block", END, 1).contains("Content-Transfer-Encoding: base64")
    payload = F.when(coded, F.unbase64(body).cast("string")).otherwise(body)
    return parts.select(
        "file",
        header("WARC-Type").alias("type"),
        known(page("WARC-Record-ID")).alias("id"),
        header("WARC-Target-URI").alias("url"),
        F.to_timestamp(header("WARC-Date"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.regexp_extract(header("WARC-Payload-Digest"), "sha256:(.*)", 1).alias("digest"),
        known(page("WARC-Refers-To")).alias("refers_to"),
        F.when(header("WARC-Type") == "response", payload).alias("payload"),
    )


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so the next row costs one path to the root."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.tree = [-1] * max(self.k, 1)
        for i in range(self.k):
            self._replay(i)

    def _beats(self, a: int, b: int) -> bool:
        """An unset slot beats all while the tree is built; a run at its end loses to all; ties go to the lower run."""
        if a == -1 or b == -1:
            return a == -1
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _replay(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node > 0:
            if self._beats(self.tree[node], winner):
                winner, self.tree[node] = self.tree[node], winner
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (row := self.heads[w := self.tree[0]]) is not None:
            yield row
            self.heads[w] = next(self.runs[w], None)
            self._replay(w)


def _sort_key(key: str, date: int | None, row_id: object) -> tuple:
    return key, date or 0, row_id is not None, row_id or 0


def capture_index(records: DataFrame, rows_per_range: int = 50_000, partitions: int | None = None) -> DataFrame:
    """(url_key, date, id, file, type, digest, refers_to, place), in global order of URL key, date and id.

    Every archive is a sorted run. The runs are cut at common ranges of (key, date, id, file) with about rows_per_range
    index rows each, so that neither a large table nor a key with many captures makes a task large. A task gets its
    range's piece of every run in the run's order (a piece that was read in parts is put in order first) and merges the
    pieces with a loser tree. place is a row's number in the whole index, 0 the first: a range's rows follow those of
    the ranges before it, so a key's captures in order of place are its history. Only index rows move, without
    payloads. A null URL has the key of an empty one.
    """
    rows = records.select(F.coalesce(url_key(F.col("url")), F.lit("")).alias("url_key"), F.col("date").cast("long").alias("date"), "id", "file", "type", "digest", "refers_to")
    n = partitions or max(1, -(-records.count() // rows_per_range))
    id_type = records.schema["id"].dataType.simpleString()
    schema = f"url_key string, date bigint, id {id_type}, file string, type string, digest string, refers_to {id_type}, range int, nth bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(batches)  # index rows of one range, about rows_per_range
        table = pa.Table.from_batches(own) if own else None
        if table is None or not table.num_rows:
            return
        pieces: dict[str, list[tuple]] = {}
        for i, (key, date, row_id, file) in enumerate(zip(*(table.column(c).to_pylist() for c in ("url_key", "date", "id", "file")))):
            pieces.setdefault(file, []).append((*_sort_key(key, date, row_id), i))
        merged = LoserTree([iter(sorted(pieces[f])) for f in sorted(pieces)])  # sorting what is in order is one pass
        out = table.take(pa.array([row[-1] for row in merged]))
        out = out.append_column("range", pa.array([TaskContext.get().partitionId()] * len(out), pa.int32()))
        yield from out.append_column("nth", pa.array(range(len(out)), pa.int64())).to_batches(max_chunksize=10_000)

    index = staged(rows.repartitionByRange(n, "url_key", "date", "id", "file").mapInArrow(run, schema), "warc-index")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = index.groupBy("range").agg(F.count(F.lit(1)).alias("c")).select("range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    return index.join(starts, "range").withColumn("place", F.col("start") + F.col("nth")).drop("range", "start", "nth")


def archive_round_trip(pages: DataFrame, path: str, date: Column, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 100) -> DataFrame:
    """Writes pages as archives under path, reads them back, and gives a row for each capture of the merged index.

    (id, url_key, place, record_type, refers_to, payload_bytes, payload_digest): bytes and digest are those of the
    payload as read back, for a revisit of the record it refers to; null if that does not have the digest its header
    says. Null html is an empty payload, a null URL is written empty, a null date is 1970; payloads of fewer than
    min_bytes are all responses. Rows that repeat an id are written each; null ids stay null. Other columns are
    ignored, whatever their names. An empty table gives no records.
    """
    id_type = pages.schema[id_col].dataType.simpleString()
    write_archives(plan_records(pages, date, id_col, url_col, html_col, min_bytes), path)
    back = read_archives(pages.sparkSession, path, id_type)
    content = F.col("payload").cast("binary")
    read = staged(back.withColumns({"payload_bytes": F.octet_length(content).cast("long"), "payload_digest": F.sha2(content, 256)}).drop("payload"), "warc-read")
    index = capture_index(read).withColumn("of", F.coalesce("refers_to", "id"))
    stored = read.filter("type = 'response'").select(F.col("id").alias("stored_id"), "payload_bytes", "payload_digest").distinct()
    joined = index.join(stored, index["of"].eqNullSafe(stored["stored_id"]) & (index["digest"] == stored["payload_digest"]), "left")
    return joined.select("id", "url_key", "place", F.col("type").alias("record_type"), "refers_to", "payload_bytes", "payload_digest")

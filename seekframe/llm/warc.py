"""WARC archives: writing, reading, and a globally ordered capture index.

Pages are sorted by URL key and time within a partition and written by Spark as text archives, one WARC record a
row; an archive is thus a sorted capture run, of about ``ARCHIVE_BYTES`` before compression. Of equal payloads the largest ``page_id`` is stored as response,
the others as revisit records that refer to it. Reading parses archives record by record, by ``Content-Length``, and checks
the digests. The index merges the sorted runs: captures are dealt out by ranges of (URL key, time, page), and
each range merges the slices of its runs with a loser tree. What arrives is cut where its order breaks; ``HELD`` captures are merged in
memory into a longer run, which is spilled to a file of the task, and the spilled runs are merged ``FAN_IN`` at a time, a batch of each in memory.

A null payload is empty, and empty payloads are equal payloads like others. A null URL stands as
``urn:page:<id>``. Control characters in a URL are percent-encoded in the archive. Equal keys keep the order of
``page_id``. Rows that repeat a page_id, or have none, are pages of their own, one record each; null stands before all
ids, and where several rows of a payload have its largest id, each is a response. An empty table gives an empty index. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, shared_dir, staged

EPOCH = 1704067200
NO_ID = -(1 << 63)  # stands in archives for a null page_id
MOST_RECORDS, ARCHIVE_BYTES = 4000, 32 << 20
HELD, FAN_IN, SPILLED = 50_000, 64, 2000
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "url_key string, ts string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, run string, offset long, intact boolean"


BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def payload_digest(sha1):
    """A SHA-1 of 20 bytes in base 32: five hexadecimal digits are four letters."""
    fives = [F.conv(F.substring(F.hex(sha1), 5 * g + 1, 5), 16, 10).cast("int") for g in range(8)]
    return F.concat(*(F.substring(F.lit(BASE32), F.shiftright(five, shift).bitwiseAND(F.lit(31)) + F.lit(1), F.lit(1)) for five in fives for shift in (15, 10, 5, 0)))


def url_key(url):
    """Sort-friendly key: the host's labels reversed, then the rest."""
    labels = F.reverse(F.split(F.regexp_replace(F.lower(F.regexp_extract(url, r"(?s)^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", ""), r"\."))
    rest = F.regexp_extract(url, r"(?s)^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(.*)$", 1)
    return F.when(url.contains("://"), F.concat(F.array_join(labels, ","), F.lit(")"), rest)).otherwise(url)


def records(pages: DataFrame) -> DataFrame:
    """(url_key, ts, page_id, record): the text of one WARC record a page, without its last line end."""
    url = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), F.concat(F.lit("urn:page:"), F.col("page_id").cast("string")))
    pages = pages.select(F.coalesce("page_id", F.lit(NO_ID)).alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.select("page_id", url.alias("url"), "html", F.unhex(F.sha1("html")).alias("hash"), F.octet_length("html").cast("long").alias("n"))
    # no join is on page_id, which may be repeated: a row has its digest with it, and meets its payload's group only
    groups = staged(pages.groupBy("hash").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "warc-groups")
    rows = (
        pages.join(groups, "hash", "left").withColumn("refers_to", F.when(F.col("page_id") < F.col("first"), F.col("first")))
        .withColumn("digest", payload_digest(F.col("hash")))
        .withColumn("ts", F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.col("page_id") % 31536000), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    revisit = F.col("refers_to").isNotNull()
    identity = F.regexp_replace(F.md5(F.col("page_id").cast("string").cast("binary")), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), identity, F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.col("ts")), F.concat(F.lit("WARC-Target-URI: "), F.col("url")), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nX-Refers-To-Page: "), F.col("refers_to").cast("string"))),
        F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string")), F.concat(F.lit("X-Payload-Length: "), F.col("n").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), (F.lit(len(HTTP)) + F.when(revisit, 0).otherwise(F.col("n"))).cast("string")),
    )
    body = F.concat(head, F.lit("\r\n\r\n" + HTTP), F.when(revisit, "").otherwise(F.col("html")), F.lit("\r\n"))
    return rows.select(url_key(F.col("url")).alias("url_key"), "ts", "page_id", body.alias("record"))


def records_each(pages: DataFrame) -> int:
    """How many records an archive takes, by the mean payload."""
    mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0
    return max(1, min(MOST_RECORDS, int(ARCHIVE_BYTES / (mean + 600))))


def write(pages: DataFrame, path: str) -> None:
    """Archives ``path/*.txt.gz``; each is a capture run in (URL key, time, page) order."""
    runs = records(pages).sortWithinPartitions("url_key", "ts", "page_id").select(F.col("record").alias("value"))
    runs.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_each(pages)).text(path)


def parse(archive: io.BufferedIOBase) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header, block) of every record of an archive, one at a time."""
    at = 0
    while first := archive.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        header, size = {}, len(first)
        while (line := archive.readline()) != b"\r\n":
            if not line:
                raise ValueError(f"record at byte {at} ends in its header")
            name, _, value = line.decode("utf-8", "surrogateescape").removesuffix("\r\n").partition(": ")
            header[name], size = value, size + len(line)
        block = archive.read(int(header["Content-Length"]))
        archive.read(4)
        yield at, header, block
        at += size + 2 + len(block) + 4


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["uri", *[f.split()[0] for f in CAPTURE.split(", ")][1:]]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            raw = io.BytesIO(content.as_py())
            archive = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16) if path.endswith(".gz") else raw
            rows = []
            for offset, h, block in parse(archive):
                digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                revisit = h["WARC-Type"] == "revisit"
                payload = block.partition(b"\r\n\r\n")[2]
                intact = revisit or (base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest and len(payload) == int(h["X-Payload-Length"]))
                n = int(h["X-Payload-Length"]) if revisit else len(payload)
                rows.append((h["WARC-Target-URI"], h["WARC-Date"], int(h["X-Page-Id"]), n, digest, h["WARC-Type"], int(h["X-Refers-To-Page"]) if revisit else None, path.rpartition("/")[2], offset, intact))
                if len(rows) >= SPILLED:
                    yield batch_of(rows)
                    rows = []
            yield batch_of(rows)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: its index fields; ``intact`` is false where digest or length does not fit."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    rows = files.mapInArrow(_captures, CAPTURE.replace("url_key", "uri"))
    rows = rows.withColumn("uri", url_key(F.col("uri"))).withColumnRenamed("uri", "url_key")
    for c in ("page_id", "refers_to"):
        rows = rows.withColumn(c, F.nullif(F.col(c), F.lit(NO_ID)))
    return rows


def order_of(row: tuple) -> tuple:
    """What captures are ordered by: URL key, time, page; null before all."""
    return tuple((x is not None, x) for x in row[:3])


class LoserTree:
    """k-way merge of sorted runs of rows; each inner node holds the run that lost there, and of every run only the next row is looked at."""

    def __init__(self, runs: Iterable[Iterable[tuple]]):
        self.runs = [iter(r) for r in runs] or [iter(())]
        self.k = len(self.runs)
        self.next: list[tuple | None] = [self._take(i) for i in range(self.k)]
        self.node = [0] * self.k
        winners = [0] * self.k + list(range(self.k))
        for i in range(self.k - 1, 0, -1):
            a, b = winners[2 * i], winners[2 * i + 1]
            winners[i], self.node[i] = (b, a) if self._less(b, a) else (a, b)
        self.top = winners[1] if self.k > 1 else 0

    def _take(self, run: int) -> tuple | None:
        row = next(self.runs[run], None)
        return None if row is None else (order_of(row), row)

    def _less(self, a: int, b: int) -> bool:
        a, b = self.next[a], self.next[b]
        return a is not None and (b is None or a[0] < b[0])

    def __iter__(self) -> Iterator[tuple]:
        while (found := self.next[self.top]) is not None:
            w = self.top
            yield found[1]
            self.next[w] = self._take(w)
            i = (w + self.k) // 2
            while i >= 1 and self.k > 1:
                if self._less(self.node[i], w):
                    w, self.node[i] = self.node[i], w
                i //= 2
            self.top = w


def natural_runs(rows: Iterable[tuple]) -> list[list[tuple]]:
    """Rows cut where their order breaks."""
    runs, last = [], None
    for row in rows:
        key = order_of(row)
        if last is None or key < last:
            runs.append([])
        runs[-1].append(row)
        last = key
    return runs


def merged(rows: Iterator[tuple], schema: pa.Schema, held: int = HELD, fan_in: int = FAN_IN) -> Iterator[tuple]:
    """All rows in order; those beyond ``held`` wait in sorted runs on the task's disk."""
    with tempfile.TemporaryDirectory(prefix="warc-runs-") as folder:
        spilled: list[str] = []

        def spill(run: Iterable[tuple]) -> None:
            spilled.append(f"{folder}/{uuid.uuid4().hex}")
            with pa.OSFile(spilled[-1], "wb") as sink, pa.ipc.new_stream(sink, schema) as out:
                for batch in batched(run, schema):
                    out.write_batch(batch)

        def spilled_run(path: str) -> Iterator[tuple]:
            with pa.OSFile(path, "rb") as source, pa.ipc.open_stream(source) as found:
                for batch in found:
                    yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        waiting: list[tuple] = []
        for row in rows:
            waiting.append(row)
            if len(waiting) >= held:
                spill(LoserTree(natural_runs(waiting)))
                waiting = []
        while len(spilled) > fan_in:
            some, spilled = spilled[:fan_in], spilled[fan_in:]
            spill(LoserTree([spilled_run(p) for p in some]))
        yield from LoserTree([*(spilled_run(p) for p in spilled), *natural_runs(waiting)])


def batched(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    some = []
    for row in rows:
        some.append(row)
        if len(some) >= SPILLED:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges what one range holds of every run."""
    first = next(batches, None)
    if first is None:
        return

    def rows() -> Iterator[tuple]:
        for batch in chain((first,), batches):
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    yield from batched(merged(rows(), first.schema), first.schema)


def index(captures: DataFrame) -> DataFrame:
    """All captures in the order of (URL key, time, page): partition after partition, and within each."""
    runs = staged(captures, "warc-runs")
    return runs.repartitionByRange(partitions(runs.sparkSession), "url_key", "ts", "page_id", "run", "offset").mapInArrow(_merge, runs.schema)


def op6(spark, sf_dir):
    from .common import table

    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), path)
    merged = index(read(spark, path))
    sound = F.when(F.col("intact"), F.col("payload_digest"))
    return merged.select("page_id", "payload_bytes", sound.alias("payload_digest"), "record_type", "refers_to")

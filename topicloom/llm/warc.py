"""WARC archives: written with an index, read back by coalesced byte ranges.

Writing: each task writes one archive, a gzip member per record, and hands up an index row per record:
file, offset, length, URL, digest. Only what the committed index names is ever read, so a task that ran
twice leaves a file that nobody looks at. Records with equal payloads become one response and revisits.

Reading: index first. The selected index rows are dealt out by stretches of the archives, sorted, and
neighbours are fetched in one byte-range read; each record is then unpacked, parsed and its payload held
against its digest. Archives that came from elsewhere are indexed by one sequential pass each.

Archives lie where driver and executors can both reach them by pyarrow's file systems (file, s3, gs, hdfs).
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, settle

#: Payloads under this size are always written in full.
REVISIT_FROM = 100
#: Up to so many digests of repeated payloads are broadcast to the writers; more are joined by shuffle.
BROADCAST_DIGESTS = 100_000
#: Bytes of an archive that one reading group spans, and gaps and totals that one read may have.
STRETCH, GAP, READ = 8 << 20, 64 << 10, 4 << 20
#: Archives are closed at this size.
ARCHIVE = 1 << 30
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'page:{page_id}'.encode()).digest())}>"


def escaped(url: str) -> str:
    """Fit for a header line: anything but printable ASCII percent-encoded."""
    return quote(url, safe="".join(map(chr, range(33, 127))))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    """A record; ``first`` is the page that a revisit refers to, or None for a response."""
    revisit = first is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {escaped(url)}")
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(block)}"]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first)}", f"Refers-To-Page-ID: {first}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; continuation lines are joined."""
    text = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace"))
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in text.split("\r\n")[1:])}


def parse(raw: bytes) -> dict:
    """A record: its fields, type, payload (None for revisits), payload size and digest, both checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    own = fields(head)
    block = rest[: int(own["content-length"])]
    kind = own["warc-type"]
    out = {"type": kind, "fields": own, "payload": None, "size": None, "digest": None}
    if kind in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        out["digest"] = own.get("warc-payload-digest", "").partition(":")[2] or None
        if kind == "response":
            got = hashlib.sha256(payload).hexdigest()
            if own.get("warc-payload-digest", "").startswith("sha256:") and got != out["digest"]:
                raise ValueError(f"payload of {own.get('warc-record-id')} doesn't have its digest")
            out |= {"payload": payload, "size": len(payload), "digest": got}
        else:
            out["size"] = int(fields(http).get("content-length", 0))
    return out


def written(directory: str, date: str, level: int, most: int):
    """Rows (page_id, url, payload, digest, first) -> index rows, beside an archive for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(directory)
        stem, turn, out, at, name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, None, 0, ""
        for b in batches:
            rows = []
            for page, url, payload, digest, first in zip(*(b.column(i) for i in range(5)), strict=True):
                page, url, first, body = page.as_py(), url.as_py(), first.as_py(), payload.as_py().encode()
                url = None if url is None else escaped(url)
                raw = gzip.compress(record(page, url, body, digest.as_py(), first, date), level, mtime=0)
                if out is None or at + len(raw) > most and at:
                    if out is not None:
                        out.close()
                    name, turn, at = f"{stem}-{turn}.warc.gz", turn + 1, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                out.write(raw)
                rows.append((f"{directory}/{name}", at, len(raw), url, digest.as_py(), page, "response" if first is None else "revisit"))
                at += len(raw)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)
        if out is not None:
            out.close()

    return run


TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
NAMES = ["file", "offset", "length", "url", "digest", "page_id", "record_type"]


def write_archives(pages: DataFrame, directory: str, date: str = "1970-01-01T00:00:00Z", level: int = 5, most: int = ARCHIVE) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) below ``directory``; return the index.

    Of equal payloads of at least 100 bytes, the row with the smallest page_id is the response and the
    others revisit it; null html is an empty payload. Rows that repeat the smallest id are all responses; a
    null id is never referred to while there is another. A null URL is left out of the record. An empty
    table writes nothing. Other columns are ignored.
    """
    spark = pages.sparkSession
    store, base = fs.FileSystem.from_uri(directory)
    store.create_dir(base, recursive=True)
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha2(F.encode(payload, "UTF-8"), 256).alias("digest"))
    large = F.octet_length("payload") >= REVISIT_FROM
    again = rows.filter(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = settle(again.select("digest", "first"), "warc-repeats")
    if again.count() <= BROADCAST_DIGESTS:
        again = F.broadcast(again)
    first: Column = F.when(large & (F.col("page_id").isNull() | (F.col("first") != F.col("page_id"))), F.col("first"))
    marked = rows.join(again, "digest", "left").select("page_id", "url", "payload", "digest", first.alias("first"))
    return settle(marked.mapInArrow(written(directory, date, level, most), INDEX), "warc-index")


def stretches(rows: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """Sorted (offset, length) -> reads: start, end and which rows lie in them."""
    start = end = 0
    held: list[int] = []
    for i, (offset, length) in enumerate(rows):
        if held and (offset - end > GAP or max(end, offset + length) - start > READ):
            yield start, end, held
            held = []
        if not held:
            start = end = offset
        held.append(i)
        end = max(end, offset + length)
    if held:
        yield start, end, held


READ_SCHEMA = "file string, offset long, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def fetched(payloads: bool):
    """Index rows (file, stretch, offset, length), sorted -> parsed records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
        handles: dict[str, object] = {}
        number = lambda x: None if x is None else int(x)
        for b in batches:
            files, offsets, lengths = b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()
            i = 0
            while i < len(files):
                j = i
                while j < len(files) and files[j] == files[i]:
                    j += 1
                if files[i] not in handles:
                    for h in handles.values():
                        h.close()
                    store, path = fs.FileSystem.from_uri(files[i])
                    handles = {files[i]: store.open_input_file(path)}
                source, spans = handles[files[i]], list(zip(offsets[i:j], lengths[i:j], strict=True))
                for start, end, inside in stretches(spans):
                    data, rows = source.read_at(end - start, start), []
                    for k in inside:
                        o, n = spans[k]
                        got = parse(zlib.decompress(data[o - start : o - start + n], wbits=31))
                        own = got["fields"]
                        rows.append(
                            (files[i], o, got["type"], number(own.get("page-id")), own.get("warc-target-uri"), got["size"], got["digest"])
                            + (number(own.get("refers-to-page-id")), got["payload"] if payloads else None)
                        )
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                i = j
        for h in handles.values():
            h.close()

    return run


def read_records(index: DataFrame, payloads: bool = False) -> DataFrame:
    """The records that index rows (file, offset, length) name; payloads only if asked for.

    Rows are dealt by stretches of archive to as many tasks as their bytes ask for, however small the index.
    Records named twice are read twice; rows that lack one of the three name nothing; no rows, no records.
    """
    wanted = index.filter("file IS NOT NULL AND offset IS NOT NULL AND length IS NOT NULL")
    wanted = wanted.select("file", F.floor(F.col("offset") / STRETCH).alias("stretch"), "offset", "length")
    tasks = 1 + 2 * int((wanted.agg(F.sum("length")).first()[0] or 0) // STRETCH)
    return wanted.repartition(tasks, "file", "stretch").sortWithinPartitions("file", "offset").mapInArrow(fetched(payloads), READ_SCHEMA)


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archive names -> index rows, by one pass over each archive's gzip members."""
    for b in batches:
        for name in b.column(0).to_pylist():
            store, path = fs.FileSystem.from_uri(name)
            rows, at, seen, unzip, raw = [], 0, 0, zlib.decompressobj(31), b""
            with store.open_input_stream(path, compression=None) as source:
                data = source.read(READ)
                while data:
                    raw += unzip.decompress(data)
                    seen += len(data) - len(unzip.unused_data)
                    data = unzip.unused_data
                    if unzip.eof:
                        got = parse(raw)
                        page = got["fields"].get("page-id")
                        rows.append((name, at, seen - at, got["fields"].get("warc-target-uri"), got["digest"], page and int(page), got["type"]))
                        at, unzip, raw = seen, zlib.decompressobj(31), b""
                    data = data or source.read(READ)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)


def index_archives(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Index of WARC archives (record-wise gzip) that a table names in its column ``file``, once each; nulls name none."""
    named = files.select("file").filter("file IS NOT NULL").distinct()
    return named.repartition(max(1, named.count()), "file").mapInArrow(scanned, INDEX)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), fresh(spark, "warc"))
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = {
    "op6_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        f AS (SELECT *, CAST(strlen(h) AS BIGINT) AS n, min(page_id) OVER (PARTITION BY h) AS first FROM p)
        SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest,
               CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
        FROM f""",
}
QUERIES = {"op6_warc": op6_warc}

"""WARC archives: a writer that turns repeated payloads into revisits, and a salvage reader.

The writer gives each record a gzip member of its own and rolls files at a bounded size. The reader
checks every member and record (gzip checksum, version line, header block, content length, block
digest). After a failed check it searches for the next member that decompresses to a valid record, or
the next version line at the start of a line that heads one, goes on from there, and logs the bytes in
between as a quarantined gap.

Defined cases: null html is an empty payload; null url has no target header; null page_id is kept and
is never what a revisit refers to, while another id is there; rows that repeat the smallest page_id of
a payload are all responses; an empty table gives an archive without records.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path, small, table

MIN_REVISIT_BYTES = 100
ROLL_BYTES = 16 << 20
GZIP_LEVEL = 5
BLOCK_BYTES = 64 << 10
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "path string, kind string, offset long, length long, reason string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"

_VERSION = re.compile(rb"WARC/\d\.\d\r\n")
_MEMBER = b"\x1f\x8b\x08"


# --- writing ---------------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``(page_id, url, html, digest, refers_to)``: refers_to is the smallest page_id with the same payload, where that is another page."""
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    full = full.withColumn("digest", F.sha2("html", 256))
    many = full.filter(F.octet_length("html") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    many = materialize(many.filter("n > 1 and first is not null").select("digest", "first"), "warc-repeats")
    joined = full.join(small(many), "digest", "left")
    return joined.select("page_id", "url", "html", "digest", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP header alone."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(records: DataFrame, path: str, roll_bytes: int = ROLL_BYTES, compress: bool = True) -> DataFrame:
    """Write ``with_revisits()`` rows to ``path``; returns the manifest (path, records, bytes).

    A task writes its files under names of its own attempt and renames them at the end, so a task
    that is run again replaces what a lost one left; files outside the manifest are not read.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        made: list[tuple[str, str, int, int]] = []
        out, size, n = None, 0, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                made[-1] = (*made[-1][:2], n, size)
                out = None

        for batch in batches:
            for row in batch.itertuples(index=False):
                if out is None:
                    name = f"part-{task.partitionId():06d}-{len(made):04d}.warc" + ".gz" * compress
                    made.append((f"{root}/_{task.attemptNumber()}-{task.taskAttemptId()}-{name}", f"{root}/{name}", 0, 0))
                    out, size, n = store.open_output_stream(made[-1][0], compression=None), 0, 0
                known = lambda x: None if pd.isna(x) else int(x)
                data = record_bytes(known(row.page_id), row.url, row.html.encode(), row.digest, known(row.refers_to))
                data = gzip.compress(data, GZIP_LEVEL, mtime=0) if compress else data
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= roll_bytes:
                    close()
        close()
        for temporary, final, _, _ in made:
            store.move(temporary, final)
        yield pd.DataFrame([(p.rpartition("/")[2], r, b) for _, p, r, b in made], columns=["file", "records", "bytes"])

    folder = records.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(records.sparkSession.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    nullable = records.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest", F.col("refers_to").cast("string").alias("refers_to"))
    return materialize(nullable.mapInPandas(write, "file string, records long, bytes long"), "warc-manifest")


# --- reading ---------------------------------------------------------------------------------------


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    block: bytes
    error: str | None = None
    extra: list = field(default_factory=list)


def parse_record(data: bytes, at: int = 0) -> tuple[Record | None, int, str]:
    """The record that starts at ``at`` and where it ends; else None, ``at`` and the check that failed."""
    if not (m := _VERSION.match(data, at)):
        return None, at, "no version line"
    end = data.find(b"\r\n\r\n", m.end() - 2)
    if end < 0:
        return None, at, "header block not ended"
    headers = {}
    for line in data[m.end() : end].split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if not colon:
            return None, at, "bad header line"
        headers[key.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not (size := headers.get("content-length", "")).isascii() or not size.isdigit():
        return None, at, "no content length"
    start, stop = end + 4, end + 4 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        return None, at, "record cut short or wrong content length"
    block = data[start:stop]
    kind, _, digest = headers.get("warc-block-digest", "").partition(":")
    if kind == "sha256" and hashlib.sha256(block).hexdigest() != digest:
        return None, at, "block digest differs"
    return Record(at, stop + 4 - at, headers, block), stop + 4, ""


def _member(data: bytes, at: int) -> tuple[bytes | None, int]:
    """What the gzip member at ``at`` holds and where it ends; None if it is not whole. Fed by blocks, so no more than one is copied."""
    pull, view, out, pos = zlib.decompressobj(31), memoryview(data), [], at
    try:
        while not pull.eof and pos < len(data):
            block = view[pos : pos + BLOCK_BYTES]
            out.append(pull.decompress(block))
            pos += len(block)
    except zlib.error:
        return None, at
    return (b"".join(out), pos - len(pull.unused_data)) if pull.eof else (None, at)


def _valid_at(data: bytes, at: int) -> tuple[list[Record], int, str]:
    """The valid records of the member or plain record at ``at``, and where it ends; none if a check fails."""
    if data[at : at + 3] == _MEMBER:
        inside, end = _member(data, at)
        if inside is None:
            return [], at, "gzip member damaged or cut short"
        records, pos = [], 0
        while pos < len(inside):
            record, pos, why = parse_record(inside, pos)
            if record is None:
                return [], at, why
            record.offset, record.length = at, end - at
            records.append(record)
        return (records, end, "") if records else ([], at, "empty member")
    record, end, why = parse_record(data, at)
    return ([record], end, "") if record else ([], at, why)


def salvage(data: bytes) -> Iterator[Record | tuple[int, int, str]]:
    """The valid records of an archive file in order, and (start, end, reason) for each quarantined gap."""
    at, bad, reason = 0, -1, ""
    while at < len(data):
        records, end, why = _valid_at(data, at)
        if records:
            if bad >= 0:
                yield bad, at, reason
                bad = -1
            yield from records
            at = end
            continue
        if bad < 0:
            bad, reason = at, why
        member = data.find(_MEMBER, at + 1)
        line = data.find(b"\nWARC/", at)
        at = min([x for x in (member, line + 1 if line >= 0 else -1) if x > at], default=len(data))
    if bad >= 0:
        yield bad, len(data), reason


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records (kind ``record``) and quarantined gaps (kind ``gap``) of the archive files under ``path``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for x in salvage(bytes(data)):
                    if not isinstance(x, Record):
                        rows.append((name, "gap", x[0], x[1] - x[0], x[2], None, None, None, None, None, None, None))
                        continue
                    h = x.headers
                    http, _, payload = x.block.partition(b"\r\n\r\n")
                    if h.get("warc-type") == "revisit":
                        size = re.search(rb"(?mi)^content-length: *(\d+)", http)
                        n, digest = int(size[1]) if size else None, h.get("warc-payload-digest", "").removeprefix("sha256:")
                    else:
                        n, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    rows.append((name, "record", x.offset, x.length, None, h.get("warc-type"), _page(h.get("warc-record-id")), h.get("warc-target-uri"), n, digest, _page(h.get("warc-refers-to")), payload if with_payload else None))
                frame = pd.DataFrame(rows, columns=names)
                yield frame.astype({c: "Int64" for c in ("offset", "length", "page_id", "payload_bytes", "refers_to")})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select("path", "content")
    return files.mapInPandas(read, RECORD)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    manifest = write_warc(with_revisits(table(spark, sf_dir, "pages")), path)
    files = small(manifest.select("file"))
    back = read_warc(spark, path).filter("kind = 'record'").withColumn("file", F.element_at(F.split("path", "/"), -1))
    return back.join(files, "file", "left_semi").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""

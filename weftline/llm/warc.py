"""Splittable reader of gzip-compressed WARC files, and a writer.

Each record of a .warc.gz file is a gzip member of its own, so a file can be read from any member on.  A
task takes a byte range, looks for the gzip magic in it, and takes a place for a member's start only if
what follows decodes to a WARC header; it owns the records that start inside its range, and reads on past the
range's end to finish the last one.  Every record is thus read by exactly one task.

A member that is stored without compression and itself holds a .warc.gz file could be mistaken for
several, if a range starts inside it; nothing short of an index of the file tells these apart.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import field, shared_dir, ship

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a file that one task owns.
SPLIT_BYTES = 64 << 20
#: Bytes read at a time.
BLOCK = 1 << 20
#: Bytes given to the decompressor at a time: what lies behind a member's end is copied once.
STEP = 1 << 14
RECORD = "path string, offset long, type string, record_id string, target_uri string, date string, content_type string, http_status int, payload binary"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), unquote(urlparse(path).path)
    return pafs.FileSystem.from_uri(path)


class _Window:
    """Some bytes of a file from a place on, read block by block as they are asked for."""

    def __init__(self, file: pa.NativeFile, at: int):
        self.file = file
        self.seek(at)

    def seek(self, at: int) -> None:
        self.base, self.data, self.eof = at, b"", False
        self.file.seek(at)

    def more(self) -> bool:
        block = b"" if self.eof else self.file.read(BLOCK)
        self.eof = self.eof or not block
        self.data += block
        return bool(block)

    def drop(self, to: int) -> None:
        """Forgets what lies before ``to``, once that is much."""
        if to - self.base >= BLOCK or to - self.base >= len(self.data):
            self.data, self.base = self.data[to - self.base :], to


def _member(w: _Window, at: int) -> tuple[bytes, int] | None:
    """The member that starts at ``at`` and where it ends, or None if no WARC record starts there. What was decompressed is forgotten block by block."""
    z = zlib.decompressobj(31)
    out: list[bytes] = []
    head = b""
    pos = at
    try:
        while True:
            w.drop(pos)
            if pos - w.base >= len(w.data) and not w.more():
                return None  # cut off
            piece = w.data[pos - w.base : pos - w.base + STEP]
            got = z.decompress(piece)
            pos += len(piece) - len(z.unused_data)
            out.append(got)
            if len(head) < 5:
                head = (head + got)[:5]
                if not b"WARC/".startswith(head[:5]):
                    return None
            if z.eof:
                return (b"".join(out), pos) if len(head) == 5 else None
    except zlib.error:
        return None


def members(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and content of every record that starts in [start, end)."""
    w = _Window(file, start)
    at = start
    while at < end:
        i = w.data.find(MAGIC, at - w.base)
        if i < 0:
            keep = max(at, w.base + len(w.data) - len(MAGIC) + 1)
            if keep >= end:
                return
            w.drop(keep)
            at = keep
            if not w.more():
                return
            continue
        at = w.base + i
        if at >= end:
            return
        w.drop(at)
        got = _member(w, at)
        if got is None:
            at += 1
            if at < w.base:  # read on before the damage was seen
                w.seek(at)
        else:
            yield at, got[0]
            at = got[1]


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields: dict[str, str] = {}
    last = ""
    for line in head.split(b"\r\n")[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            fields[last] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            last = name.strip().lower()
            fields[last] = value.strip()
    size = fields.get("content-length", "")
    return fields, rest[: int(size)] if size.isdigit() else rest


def http(block: bytes) -> tuple[int | None, bytes]:
    """Status and body of a stored HTTP response."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"HTTP/"):
        return None, block
    status = head.split(None, 2)[1:2]
    return (int(status[0]) if status and status[0].isdigit() else None), body


def splits(spark: SparkSession, paths: list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """path, start, end: byte ranges of the files, spread over the cluster.  Spark lists them: files, folders or globs of any file system it knows."""
    if not paths:
        return spark.createDataFrame([], "path string, start long, end long")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(sorted(set(paths))).where("length > 0").select("path", "length")  # without their content
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long")))
    ranges = files.select("path", "length", start.alias("start")).select("path", "start", F.least(F.col("start") + split_bytes, F.col("length")).alias("end"))
    return ranges.repartition(max(1, ranges.count()), "path", "start")


def read(spark: SparkSession, paths: list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of .warc.gz files: path, offset, type, record_id, target_uri, date, content_type, http_status, payload.

    For a response over HTTP the payload is the body, else the record's block.  Absent header fields are null.
    Bytes between members, cut-off last members and members that aren't WARC records are skipped; empty files and no
    paths give no rows.  A path that is listed twice is read once.  A very long record is a row like any other.
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "offset", "type", "record_id", "target_uri", "date", "content_type", "http_status", "payload"]
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int32(), pa.binary()]

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for path, start, end in zip(*(batch.column(i).to_pylist() for i in range(3))):
                fs, p = _open(path)
                rows, size = [], 0
                with fs.open_input_file(p) as file:
                    for at, raw in members(file, start, end):
                        f, block = parse(raw)
                        kind = f.get("content-type")
                        status, body = http(block) if (kind or "").startswith("application/http") else (None, block)
                        rows.append((path, at, f.get("warc-type"), f.get("warc-record-id"), f.get("warc-target-uri"), f.get("warc-date"), kind, status, body))
                        size += len(body)
                        if size >= 4 * BLOCK:
                            yield emit(rows)
                            rows, size = [], 0
                if rows:
                    yield emit(rows)

    return splits(spark, paths, split_bytes).mapInArrow(run, RECORD)


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> list[str]:
    """A .warc.gz file per task in ``folder``, a response record per row; the paths of the tasks that succeeded.

    A file of a task that was lost or ran twice isn't listed.  A row without html becomes a metadata record
    without a block; without a URL, a record without a target; without an id, one with an id of its own.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        fs, p = _open(name)
        out = None
        for batch in batches:
            for i, url, html in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if out is None:
                    fs.create_dir(p.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(p, compression=None)
                body = b"" if html is None else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + html.encode()
                head = ["WARC/1.0", f"WARC-Type: {'metadata' if html is None else 'response'}", f"WARC-Record-ID: <urn:page:{'' if i is None else i}>", "WARC-Date: 2024-01-01T00:00:00Z"]
                if url is not None:
                    head.append(f"WARC-Target-URI: {url}")
                if html is not None:
                    head.append("Content-Type: application/http; msgtype=response")
                head.append(f"Content-Length: {len(body)}")
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                out.write(z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["path"])

    slim = pages.select(id_col, F.regexp_replace(F.trim(F.col(url_col)), r"[\r\n]+", " "), html_col)
    return sorted(r[0] for r in slim.mapInArrow(run, "path string").collect())  # a path per task


def round_trip(pages: DataFrame, id_col: str = "page_id", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """id, url and html of every page, written to WARC files in the shared folder and read again by byte ranges."""
    spark = pages.sparkSession
    paths = write(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}", id_col)
    records = read(spark, paths, split_bytes)
    number = F.nullif(F.regexp_extract("record_id", "<urn:page:(.*)>", 1), F.lit(""))
    html = F.when(F.col("type") == "response", F.decode("payload", "UTF-8"))
    return records.select(number.cast(field(pages, id_col).dataType).alias(id_col), F.col("target_uri").alias("url"), html.alias("html"))

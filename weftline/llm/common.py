"""What the training-data operators share: batching, words, hashes, storage, size checks.

A *word* is a maximal run of ASCII letters, ASCII digits and characters beyond ASCII, after Unicode
lower-casing; everything else separates words.  All kernels work on the UTF-8 bytes of a batch at
once, so that no operator runs a Python statement per character or per word.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy pass takes at a time: bounds a worker's memory, not the result.
CHUNK_BYTES = 1 << 18
#: Bytes of a long text, or of its words, that intermediate arrays cover at a time: likewise.
PIECE = 1 << 18
#: Rows of text that one numpy pass takes at a time.
CHUNK_ROWS = 1024

_rng = np.random.default_rng(20240611)
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
MULT = np.uint64(0x9E3779B97F4A7C15)
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = True
WORD_BYTE[128:] = True


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where it isn't installed (on a cluster: --py-files), and has rows come to them in small batches.

    The batch settings are the session's, so one that set them itself keeps them.
    """
    for name, ours in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1024"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))):
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, ours)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; unset, one of our own in local mode and an error on a cluster."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(where)
        return where
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept in the shared folder: survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: computed once, and columns that aren't asked for aren't read again."""
    at = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def small(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most ``most`` rows; counts no further than that."""
    return df.limit(most + 1).count() <= most


def maybe_broadcast(df: DataFrame, most: int = 400_000, most_bytes: int = 128 << 20) -> DataFrame:
    """``df`` with a broadcast hint if its rows are few and, counted as JSON where they vary, small; else as it is (shuffle join). Counts no further than that."""
    fixed = all(isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)) for f in df.schema)
    size = F.lit(0) if fixed else F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))
    got = df.limit(most + 1).select(size.cast("long").alias("b")).agg(F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if got["n"] <= most and got["b"] <= most_bytes else df


def texts_of(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns that a kernel needs, text as string, ``more`` unchanged."""
    return df.select(id_col, F.col(text_col).cast("string").alias(text_col), *more)


def field(df: DataFrame, name: str, to: str | None = None) -> T.StructField:
    return T.StructField(to or name, df.schema[name].dataType, True)


def chunks(texts: pa.Array, most: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is a range of its own."""
    n = len(texts)
    if not n:
        return
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    i = 0
    while i < n:
        j = int(np.searchsorted(total, total[i] + most, side="right")) - 1
        j = min(max(j, i + 1), i + rows, n)
        yield i, j
        i = j


def raw_bytes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins (one more at the end). Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


class Words:
    """The words of a batch: ``hash``, ``start``/``end`` in ``buf``, ``doc`` (row), ``first`` (one more at the end)."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        self.buf, self.off = raw_bytes(texts, lower)
        n = len(self.buf)
        rows = len(self.off) - 1
        if not n:
            self.start = self.end = self.doc = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            self.first = np.zeros(rows + 1, np.int64)
            return
        is_word = np.zeros(n + 1, bool)
        is_word[:n] = WORD_BYTE[self.buf]
        begins = np.zeros(n + 1, bool)
        begins[self.off] = True
        edges = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, n, PIECE):
            j = min(i + PIECE, n)
            here, cut = is_word[i:j], begins[i:j]
            before = is_word[i - 1 : j - 1] if i else np.concatenate([[False], is_word[: j - 1]])
            edges[0].append(np.flatnonzero(here & (~before | cut)) + i)
            edges[1].append(np.flatnonzero(here & (~is_word[i + 1 : j + 1] | begins[i + 1 : j + 1])) + (i + 1))
        self.start, self.end = (np.concatenate(x) for x in edges)
        del is_word, begins, edges
        self.first = np.searchsorted(self.start, self.off)
        self.doc = np.repeat(np.arange(rows), np.diff(self.first))
        self.hash = span_hash(self.buf, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def count(self) -> np.ndarray:
        return np.diff(self.first)


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """MULT to the power of 0 .. n - 1, modulo 2^64."""
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 256)
        steps = np.full(size, MULT, np.uint64)
        steps[0] = 1
        _POWERS = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[:n]


def released() -> None:
    """Gives what a task's arrays took back to the system: idle workers keep little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        return


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit given."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _long_hash(span: np.ndarray) -> np.uint64:
    """The sum that ``span_hash`` mixes, of one span, piece by piece."""
    total, scale = 0, 1
    for i in range(0, len(span), PIECE):
        part = span[i : i + PIECE]
        total += scale * int((BYTE_CODE[part] * powers(len(part))).sum(dtype=np.uint64))
        scale = scale * pow(int(MULT), len(part), 1 << 64) % (1 << 64)
    return np.uint64(total % (1 << 64))


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each non-empty, ascending, disjoint span of ``buf``; what it needs besides the result is bounded."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    total = np.cumsum(length)
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        before = total[i] - length[i]
        j = max(int(np.searchsorted(total, before + PIECE, side="right")), i + 1)
        if length[i] > PIECE:
            out[i] = _long_hash(buf[start[i] : end[i]])
        else:
            size = length[i:j].astype(np.int32)
            first = (total[i:j] - length[i:j] - before).astype(np.int32)
            at = np.arange(total[j - 1] - before, dtype=np.int32)
            at -= np.repeat(first, size)
            code = BYTE_CODE[buf[np.repeat(start[i:j], size) + at]]
            code *= powers(int(size.max()))[at]
            out[i:j] = np.add.reduceat(code, first)
        i = j
    out += length.astype(np.uint64)
    return mix(out)


def kgrams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``k`` words inside one row, and the index of its first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(words.doc[:n] == words.doc[k - 1 :])
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h = (h + words.hash[at + j]) * MULT
    return mix(h), at


def hash_words(text: str) -> np.ndarray:
    """Hashes of the words of one text, in order."""
    return Words(pa.array([text or ""])).hash


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` within each of the ranges that begin at ``first`` (one more at the end); 0 if empty."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def over_texts(
    work: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: int = 1, most: int = CHUNK_BYTES, rows: int = CHUNK_ROWS
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that hands ``work`` slices of bounded size; column ``text`` holds the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in chunks(batch.column(text), most, rows):
                out = work(batch.slice(i, j - i))
                if out is not None and out.num_rows:
                    yield out
                del out
            del batch
        released()

    return run

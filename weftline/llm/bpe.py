"""Byte-level BPE: encoding with tiktoken and a local rank file, decoding from raw bytes.

Long texts are cut before encoding, at boundaries where the pre-splitting pattern breaks in any
context: a non-space followed by a space, or a letter next to a digit.  The pieces' ids, one after
another, are then the ids of the whole text.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from weftline.llm.common import field, over_texts, raw_bytes, ship, texts_of

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of more characters than this are cut at safe boundaries.
LONG = 1 << 16
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


@lru_cache(maxsize=4)
def coder(path: str) -> tuple[tiktoken.Encoding, np.ndarray, np.ndarray]:
    """The encoding, all tokens' bytes one after another, and where each token's bytes begin."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    size = max(ranks.values()) + 1
    by_id = [b""] * size
    for token, i in ranks.items():
        by_id[i] = token
    begins = np.concatenate([[0], np.cumsum([len(x) for x in by_id])]).astype(np.int64)
    name = "weftline_" + str(abs(hash(path)))
    enc = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return enc, np.frombuffer(b"".join(by_id), np.uint8), begins


def handed_out(spark: SparkSession, ranks: str) -> str:
    """Hands the rank file to every executor; the name it has there, for ``local``."""
    name = os.path.basename(ranks)
    if not any(f.rpartition("/")[2] == name for f in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(ranks)
    return name


def local(name: str) -> str:
    return SparkFiles.get(name)


def pieces(text: str, long: int = LONG) -> list[str]:
    """``text`` cut at the first safe boundary after every ``long`` characters."""
    if len(text) <= long:
        return [text]
    out, at = [], 0
    while len(text) - at > long:
        m = _SAFE.search(text, at + long)
        if m is None:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def encode_one(text: str, path: str = RANKS, long: int = LONG) -> np.ndarray:
    """Token ids of a whole text; the strings of special tokens are ordinary text."""
    enc = coder(path)[0]
    parts = [enc.encode_to_numpy(p, disallowed_special=()) for p in pieces(text, long)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def decode_raw(ids: np.ndarray, path: str = RANKS) -> bytes:
    """The bytes that token ids stand for, by table lookup alone; valid UTF-8 or not."""
    _, vocabulary, begins = coder(path)
    ids = np.asarray(ids, np.int64)
    length = begins[ids + 1] - begins[ids]
    total = np.cumsum(length)
    at = np.arange(total[-1] if len(total) else 0) + np.repeat(begins[ids] - (total - length), length)
    return vocabulary[at].tobytes()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, ``keep`` columns, n_bytes, n_tokens, token_ids, exact.

    ``exact`` says that the ids decode to the text's own bytes.  Null text: token_ids, n_bytes,
    n_tokens and exact are null.  Empty text: no ids, exact.  Repeated rows: a row each.  An empty table gives none.  Other columns
    are ignored, and so are ``keep`` columns that aren't there.  Very long texts are cut at safe boundaries, the ids are the whole text's.
    No shuffle: a scan and one pass of tiktoken.
    """
    ship(docs.sparkSession)
    keep = tuple(c for c in keep if c in docs.columns)
    name = handed_out(docs.sparkSession, ranks)
    src = texts_of(docs, id_col, text_col, *keep)
    kept = [field(docs, c) for c in keep]
    schema = T.StructType(
        [field(docs, id_col), *kept, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("exact", T.BooleanType())]
    )

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, ranks = batch.column(1), local(name)
        ids = [None if t is None else encode_one(t, ranks) for t in texts.to_pylist()]
        null = np.array([x is None for x in ids], bool)
        arrays = [np.zeros(0, np.uint32) if x is None else x for x in ids]
        lens = np.array([len(x) for x in arrays], np.int64)
        flat = np.concatenate(arrays).astype(np.int32)
        buf, off = raw_bytes(texts, lower=False)
        _, _, begins = coder(ranks)
        decoded = np.frombuffer(decode_raw(flat, ranks), np.uint8)
        widths = np.concatenate([[0], np.cumsum(begins[flat.astype(np.int64) + 1] - begins[flat])])
        ends = widths[np.concatenate([[0], np.cumsum(lens)])]
        exact = [bool(np.array_equal(decoded[ends[i] : ends[i + 1]], buf[off[i] : off[i + 1]])) for i in range(len(ids))]
        offsets = pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32), mask=np.concatenate([null, [False]]) if null.any() else None)
        item = pa.field("element", pa.int32(), False)
        lists = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()), type=pa.list_(item))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *batch.columns[2:], pa.array(np.diff(off), pa.int64(), mask=null), pa.array(lens, pa.int64(), mask=null), lists, pa.array(exact, pa.bool_(), mask=null)], names=schema.names
        )

    return src.mapInArrow(over_texts(work), schema)


def decode(encoded: DataFrame, ids_col: str = "token_ids", ranks: str = RANKS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``raw`` (binary: the ids' bytes) and ``text`` (null where these aren't UTF-8).

    Null ids give null, no ids an empty text.  Repeated rows: a row each.  Other columns are ignored.
    """
    ship(encoded.sparkSession)
    name = handed_out(encoded.sparkSession, ranks)
    src = encoded.select(ids_col, *keep)
    schema = T.StructType([*(field(encoded, c) for c in keep), T.StructField("raw", T.BinaryType()), T.StructField("text", T.StringType())])

    def run(batches):
        ranks = local(name)
        for batch in batches:
            raw = [None if x is None else decode_raw(np.array(x, np.int64), ranks) for x in batch.column(0).to_pylist()]
            text = []
            for x in raw:
                try:
                    text.append(None if x is None else x.decode())
                except UnicodeDecodeError:
                    text.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(raw, pa.binary()), pa.array(text, pa.string())], names=schema.names)

    return src.mapInArrow(run, schema)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the corpus pipeline: every document as token ids, with what there is of lang, source and n_chars."""
    return encode(docs, keep=("lang", "source", "n_chars"))

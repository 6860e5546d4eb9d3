"""Benchmark decontamination with a positional inverted index of the training documents.

The index is sharded by document, as in distributed search engines: each task turns the documents it
reads into segments, and a segment holds its terms in order, for each term the documents that have it
and the positions in them, delta-coded and compressed.  Nothing is shuffled.  Test items are looked
up in every segment from their rarest terms on: the postings of a term, less the term's offset in the
item, are the diagonals on which the item could lie; only documents that collect enough of the rarest
terms are looked at in full.

An item of n words matches a document *exactly* if its words follow one another there; *in proximity*
if, within some window of neighbouring diagonals, at least ``share`` of its words occur.  A window is ``slop`` + 1
diagonals wide, and of an item of fewer words than that, n + 1: an item may be spread by as many words as it has.
Matches are taken from left to right and don't overlap: of the windows that begin within n words after the first that
reaches the share, the first exact one or else the first with the most words; the search goes on n words after its beginning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import CHUNK_BYTES, Words, chunks, field, hash_words, maybe_broadcast, released, ship, stored, texts_of

#: Share of an item's words that a proximity match needs, in a window of SLOP + 1 diagonals.
SHARE = 0.8
SLOP = 8
#: Bytes of text of a segment; a longer text is a segment of its own.
SEGMENT_BYTES = 4 << 20
#: Items, and bytes of their texts, that one pass over the index looks up; more are looked up in several passes.
ITEMS_A_PASS = 50_000
BYTES_A_PASS = 32 << 20


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpack(b: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


@dataclass
class Segment:
    """Postings of some documents: of ``terms[i]``, ``doc``/``pos`` from ``begin[i]`` to ``begin[i + 1]``, ascending."""

    terms: np.ndarray
    begin: np.ndarray
    doc: np.ndarray
    pos: np.ndarray

    @staticmethod
    def of(hashes: np.ndarray, count: np.ndarray) -> Segment:
        """From the word hashes of some documents, one after another, and the number of words of each."""
        order = np.argsort(hashes, kind="stable")  # stable: documents and positions stay ascending
        h = hashes[order]
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        terms, begin = h[new], np.append(new, len(h)).astype(np.uint32)
        del h
        doc = np.repeat(np.arange(len(count), dtype=np.uint32), count)[order]
        first = np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else np.zeros(0, np.int64)
        order -= first[doc]
        return Segment(terms, begin, doc, order.astype(np.uint32))

    def packed(self) -> tuple[bytes, bytes, bytes, bytes]:
        n = np.diff(self.begin.astype(np.int64))
        step = np.diff(self.doc, prepend=np.uint32(0))  # wraps around at each term's first, and back when summed
        return _pack(self.terms), _pack(n.astype(np.uint32)), _pack(step), _pack(self.pos)

    @staticmethod
    def unpacked(terms: bytes, counts: bytes, docs: bytes, positions: bytes) -> Segment:
        n = _unpack(counts, np.uint32)
        return Segment(_unpack(terms, np.uint64), np.concatenate([[0], np.cumsum(n, dtype=np.int64)]), np.cumsum(_unpack(docs, np.uint32), dtype=np.uint32), _unpack(positions, np.uint32))

    def slots(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each term's postings; equal where it has none."""
        if not len(self.terms):
            z = np.zeros(len(terms), np.int64)
            return z, z
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        has = self.terms[at] == terms
        return np.where(has, self.begin[at], 0).astype(np.int64), np.where(has, self.begin[at + 1], 0).astype(np.int64)


@dataclass
class Items:
    """Test items: ids, each one's word hashes from ``first[i]`` to ``first[i + 1]``."""

    ids: pa.Array
    words: np.ndarray
    first: np.ndarray


def needed(n: int, share: float) -> int:
    """Words of an item of ``n`` that have to match."""
    return max(1, int(np.ceil(share * n - 1e-9)))


def windows(slot: np.ndarray, diagonal: np.ndarray, n: int, need: int, slop: int) -> Iterator[tuple[bool, int, int]]:
    """(exact, matched words, least diagonal) of the matches among postings of an item of ``n`` words, from left to right."""
    order = np.lexsort((slot, diagonal))
    slot, diagonal = slot[order].tolist(), diagonal[order].tolist()
    at, size = 0, len(slot)
    while at < size:
        seen: dict[int, int] = {}
        lo, hi = at, at
        best, where, line, limit = 0, 0, None, None
        while lo < size and (limit is None or diagonal[lo] < limit):
            d = diagonal[lo]
            while hi < size and diagonal[hi] <= d + slop:
                seen[slot[hi]] = seen.get(slot[hi], 0) + 1
                hi += 1
            if len(seen) >= need and limit is None:
                limit = d + n
            if len(seen) > best:
                best, where = len(seen), d
            same = lo
            while same < size and diagonal[same] == d:
                t = slot[same]
                seen[t] -= 1
                if not seen[t]:
                    del seen[t]
                same += 1
            if same - lo == n and limit is not None:
                line = d
                break
            lo = same
        if limit is None:
            return
        yield (True, n, line) if line is not None else (False, best, where)
        done = (line if line is not None else where) + n
        while at < size and diagonal[at] < done:
            at += 1


def lookup(seg: Segment, items: Items, share: float = SHARE, slop: int = SLOP) -> Iterator[tuple[int, int, bool, int, int, int]]:
    """(item row, document row, exact, matched words, words, position) of each match in a segment.

    The position is that of the item's first word, as the diagonal says (it may lie before the text).
    """
    begin, end = seg.slots(items.words)
    count = end - begin
    present = np.concatenate([[0], np.cumsum(count > 0)])
    n_all = np.diff(items.first)
    need_all = np.maximum(1, np.ceil(share * n_all - 1e-9).astype(np.int64))
    for i in np.flatnonzero((present[items.first[1:]] - present[items.first[:-1]] >= need_all) & (n_all > 0)):
        lo, n, need = int(items.first[i]), int(n_all[i]), int(need_all[i])
        width = min(slop, n)
        b, e, c = begin[lo : lo + n], end[lo : lo + n], count[lo : lo + n]
        rare = np.argsort(c, kind="stable")
        spare = n - need  # words that may be missing
        k = min(n, 2 * spare + 2)
        lists = [seg.doc[b[s] : e[s]] for s in rare[:k]]
        # of the k rarest words, at least k - spare are in any document that matches
        if k - spare > 1:
            once = [x[np.concatenate([[True], x[1:] != x[:-1]])] for x in lists if len(x)]
            docs, votes = np.unique(np.concatenate(once), return_counts=True) if once else (np.zeros(0, np.uint32), np.zeros(0, int))
            cand = docs[votes >= k - spare]
        else:
            cand = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.uint32)
        for d in cand:
            slot, diag = [], []
            left = n
            for s in rare:  # from the rarest on, until too few are left
                x = seg.doc[b[s] : e[s]]
                u, v = np.searchsorted(x, [d, d + 1])
                if u == v:
                    left -= 1
                    if left < need:
                        break
                    continue
                slot.append(np.full(v - u, s))
                diag.append(seg.pos[b[s] + u : b[s] + v].astype(np.int64) - s)
            if left < need:
                continue
            slot_, diag_ = np.concatenate(slot), np.concatenate(diag)
            # a window that matches holds one of the spare + 1 rarest words: keep what is near such a diagonal
            anchors = np.unique(diag_[np.isin(slot_, rare[: spare + 1])])
            at = np.searchsorted(anchors, diag_)
            near = np.zeros(len(diag_), bool)
            for shift in (-1, 0):
                j = at + shift
                ok = (j >= 0) & (j < len(anchors))
                near[ok] |= np.abs(anchors[j[ok]] - diag_[ok]) <= width
            for exact, got, where in windows(slot_[near], diag_[near], n, need, width):
                yield int(i), int(d), exact, got, n, where


_SEGMENT = ("terms", "counts", "docs", "positions")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The index of all documents: a row per segment (row_ids, keys: hash of each text; terms, counts, docs, positions)."""
    ship(docs.sparkSession)
    src = texts_of(docs, id_col, text_col).withColumn("__wl_key", F.xxhash64(text_col))
    id_field = field(docs, id_col)
    schema = T.StructType([T.StructField("row_ids", T.ArrayType(id_field.dataType)), T.StructField("keys", T.ArrayType(T.LongType())), *(T.StructField(c, T.BinaryType()) for c in _SEGMENT)])

    def segment(ids: list[pa.Array], keys: list[pa.Array], hashes: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        packed = Segment.of(np.concatenate(hashes), np.concatenate(counts)).packed()
        one = lambda parts: pa.ListArray.from_arrays(pa.array([0, sum(map(len, parts))], pa.int32()), pa.concat_arrays(parts))
        return pa.RecordBatch.from_arrays([one(ids), one(keys), *(pa.array([x], pa.binary()) for x in packed)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [])  # of the texts only hashes are held
        size = 0
        for batch in batches:
            for i, j in chunks(batch.column(1), min(segment_bytes, CHUNK_BYTES)):
                part = batch.slice(i, j - i)
                more = pc.sum(pc.binary_length(part.column(1))).as_py() or 0
                if size and size + more > segment_bytes:
                    yield segment(*held)
                    held, size = ([], [], [], []), 0
                words = Words(part.column(1))
                every = pa.array(np.arange(j - i))
                for into, x in zip(held, (part.column(0).take(every), part.column(2).take(every), words.hash, words.count())):
                    into.append(x)  # copies: the batch itself isn't kept
                size += more
                del part, words
            del batch
        if held[0]:
            yield segment(*held)
        released()

    return src.mapInArrow(run, schema)


def _items(table: pa.Table) -> Items:
    hashes = [hash_words(x) for x in table.column(1).to_pylist()]
    first = np.concatenate([[0], np.cumsum([len(h) for h in hashes])]).astype(np.int64)
    return Items(table.column(0).combine_chunks(), np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), first)


def search(index: DataFrame, benchmark: DataFrame, doc_type: T.DataType, item_col: str = "item_id", text_col: str = "text", share: float = SHARE, slop: int = SLOP, a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """Matches of all items in all segments: doc_id, item_id, exact, matched, words, position, __wl_key (of the document)."""
    spark = index.sparkSession
    ship(spark)
    items = texts_of(benchmark, item_col, text_col).where(F.col(text_col).isNotNull())
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("b")).first()
    passes = max(1, -(-size["n"] // a_pass), -(-size["b"] // BYTES_A_PASS))
    schema = T.StructType(
        [T.StructField("doc_id", doc_type), field(benchmark, item_col, "item_id"), T.StructField("exact", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("matched", "words", "position", "__wl_key"))]
    )

    def pass_over(part: DataFrame) -> DataFrame:
        spread = spark.sparkContext.broadcast(_items(part.toArrow()))  # a_pass items and BYTES_A_PASS of text, about

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    seg = Segment.unpacked(*(batch.column(2 + c)[r].as_py() for c in range(4)))
                    found = list(lookup(seg, spread.value, share, slop))
                    if not found:
                        continue
                    ids, keys = batch.column(0)[r].values, batch.column(1)[r].values
                    at = pa.array([f[1] for f in found], pa.int64())
                    item = spread.value.ids.take(pa.array([f[0] for f in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(at), item, pa.array([f[2] for f in found], pa.bool_()), *(pa.array([f[c] for f in found], pa.int64()) for c in (3, 4, 5)), keys.take(at)], names=schema.names
                    )
            released()

        return index.mapInArrow(run, schema)

    out = None
    for p in range(passes):
        got = pass_over(items if passes == 1 else items.where(F.pmod(F.xxhash64(item_col, text_col), F.lit(passes)) == p))
        out = got if out is None else out.unionByName(got)
    return out


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", **options) -> DataFrame:
    """doc_id, item_id, exact, matched, words, position: every match of each item in each row of ``docs``, without overlaps of one item.

    Ties between windows go to the earliest.  Null and empty texts and items match nothing, and so do empty tables.
    Repeated rows, of either table, give repeated matches.  Extra columns are ignored, whatever their names.  A very
    long text is indexed whole, as a segment of its own: a task takes about twelve times its bytes.  Ids may be of any type.
    """
    index = stored(build_index(docs, id_col, text_col))
    return search(index, benchmark, docs.schema[id_col].dataType, item_col, item_text, **options).drop("__wl_key")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that an item matches, exactly or in proximity; all their columns.

    Rows with null or empty texts stay, and all rows if there are no items.  Repeated rows go or stay together.  Very long texts as in ``matches``.
    """
    index = stored(build_index(docs, id_col, text_col))
    found = search(index, benchmark, docs.schema[id_col].dataType, item_col, item_text, **options)
    gone = stored(found.select(F.col("doc_id").alias("__wl_gi"), F.col("__wl_key").alias("__wl_gk")).distinct())
    keyed = docs.withColumn("__wl_k", F.xxhash64(F.col(text_col).cast("string")))
    kept = keyed.join(maybe_broadcast(gone), (F.col("__wl_k") == F.col("__wl_gk")) & F.col(id_col).eqNullSafe(F.col("__wl_gi")), "left_anti")
    return kept.select(*docs.columns)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Third stage of the corpus pipeline: documents without benchmark passages."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

"""Nearest neighbours by additive quantisation.

A vector is encoded as the sum of one codeword from each of ``BOOKS`` codebooks, all of full dimension:
each codebook is trained on what the ones before leave over, and encoding keeps the ``BEAM`` best partial sums.
A query scores a vector by one lookup per codebook, inner products of the query with the codewords, less half the
stored squared norm of the sum; this ranks as the distance does.  The best ``RERANK`` of every block of vectors are
ranked again by the vectors themselves.

The index holds every vector, in lists by its first codeword, and is written once.  Tasks go through it block by block,
with the queries at hand, a bounded number in each pass, so vectors aren't shuffled for queries.  Each query comes with a
bound, the distance of its k-th neighbour in the training sample; a list is left out for a query only if the triangle
inequality puts all its vectors beyond that bound.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftline.llm.common import released, ship, stored, written

BOOKS, WORDS, BEAM = 16, 128, 4
#: Vectors that the codebooks are trained on, about: a bound of the training sample. The index holds all.
SAMPLE_ROWS = 8192
#: Neighbours reported, and candidates of a block that are ranked by exact distance.
K, RERANK = 10, 512
#: Vectors in a block, and bytes of them at most; queries of a pass, and bytes of them at most.
DATA_BLOCK, BLOCK_BYTES = 16384, 16 << 20
QUERIES_A_PASS, PASS_BYTES = 32768, 32 << 20
#: Queries scored together.
TOGETHER = 256


def nearest_words(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words * words).sum(axis=1)[None] - 2 * (x @ words.T)).argmin(axis=1)


def one_hot(at: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((len(at), k), np.float32)
    out[np.arange(len(at)), at] = 1
    return out


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    words = x[rng.choice(len(x), k, replace=len(x) < k)].astype(np.float32)
    for _ in range(rounds):
        at = nearest_words(x, words)
        n = np.bincount(at, minlength=k)
        total = one_hot(at, k).T @ x
        words = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], words).astype(np.float32)
    return words


@dataclass
class Codebooks:
    """``words``: books x words x dimension."""

    words: np.ndarray

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes (a column per book) by beam search: of all one-word extensions, the best partial sums go on."""
        m, k, d = self.words.shape
        n = len(x)
        left = x[:, None, :].astype(np.float32)  # residuals of the partial sums
        codes = np.zeros((n, 1, 0), np.uint8)
        for b in range(m):
            w = self.words[b]
            err = (left * left).sum(axis=2)[:, :, None] - 2 * (left @ w.T) + (w * w).sum(axis=1)
            flat = err.reshape(n, -1)
            keep = min(beam if b < m - 1 else 1, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(flat.shape[1]), (n, 1))
            from_, word = best // k, best % k
            row = np.arange(n)[:, None]
            codes = np.concatenate([codes[row, from_], word[:, :, None].astype(np.uint8)], axis=2)
            left = left[row, from_] - w[word]
        return codes[:, 0]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[b][codes[:, b]] for b in range(self.words.shape[0]))

    def norms(self, codes: np.ndarray) -> np.ndarray:
        x = self.decode(codes)
        return (x * x).sum(axis=1)

    def scores(self, queries: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """vectors x queries: sums of looked-up inner products, less half the norm; larger is nearer."""
        out = np.repeat(-0.5 * norms[:, None].astype(np.float32), len(queries), axis=1)
        for b in range(self.words.shape[0]):
            out += (self.words[b] @ queries.T)[codes[:, b]]  # the table's rows are contiguous: words x queries
        return out


def seed_books(x: np.ndarray, books: int = BOOKS, words: int = WORDS) -> Codebooks:
    """Codebooks trained one after another on residuals."""
    out = []
    left = x.astype(np.float32)
    for b in range(books):
        w = kmeans(left, words, seed=b)
        out.append(w)
        left = left - w[nearest_words(left, w)]
    return Codebooks(np.stack(out))


def as_matrix(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1).astype(np.float32) if len(col) else np.zeros((0, 1), np.float32)


def clean(table: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """id, x of rows that can be compared: an id, no null, NaN or infinite number, and the most common dimension (the larger of equals)."""
    ok = table.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0))
    ok = ok.where(~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    dims = ok.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = dims["d"] if dims else 0
    return ok.where(F.size("x") == d), d


def sample(vectors: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list, np.ndarray]:
    """Ids and vectors of about ``rows`` rows of a table (id, x), drawn by hash of the id; all, if there are no more than that."""
    n = vectors.count()
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    got = sorted(vectors.where(draw < float(min(1.0, rows / max(n, 1)) * (1 << 30))).select("id", "x").collect(), key=lambda r: r["id"])
    return [r["id"] for r in got], np.array([r["x"] for r in got], np.float32)


def bounds(x: np.ndarray, ids: np.ndarray, books: Codebooks, sample_ids: np.ndarray, sample_x: np.ndarray, k: int) -> np.ndarray:
    """A squared distance within which each of ``x`` has at least ``k`` others; infinite where the sample has too few."""
    if len(sample_ids) <= k:
        return np.full(len(x), np.inf)
    d = (sample_x * sample_x).sum(axis=1)[None] - 2 * (x @ sample_x.T)
    near = np.argpartition(d, k, axis=1)[:, : k + 1]
    exact = ((sample_x[near] - x[:, None]).astype(np.float64) ** 2).sum(axis=2)
    exact[sample_ids[near] == ids[:, None]] = np.inf
    return np.sort(exact, axis=1)[:, k - 1] * (1 + 1e-5) + 1e-9


@dataclass
class Queries:
    """Queries of a pass, those of one first codeword side by side; ``words``: distances to all first codewords."""

    ids: pa.Array
    keys: np.ndarray
    x: np.ndarray
    bound: np.ndarray
    words: np.ndarray

    @staticmethod
    def of(table: pa.Table, books: Codebooks) -> Queries:
        x = as_matrix(table.column("x"))
        first = books.words[0]
        d = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (first * first).sum(axis=1)[None] - 2 * (x @ first.T), 0)).astype(np.float32)
        order = np.lexsort((table.column("bound").to_numpy(), d.argmin(axis=1)))
        ids = table.column("id").combine_chunks().take(pa.array(order))
        return Queries(ids, ids.to_numpy(zero_copy_only=False), x[order], table.column("bound").to_numpy()[order], d[order])


def alive(queries: Queries, lists: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """queries x lists: whether a vector of the list, all within ``radius`` of its codeword, may be within the query's bound."""
    gap = queries.words[:, lists] - radius[None]
    return np.maximum(gap - 1e-4 * (1 + np.abs(gap)), 0) ** 2 <= queries.bound[:, None]


def block_neighbours(queries: Queries, ids: pa.Array, x: np.ndarray, codes: np.ndarray, norms: np.ndarray, books: Codebooks, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, squared distance): up to ``k`` candidates of each query among the vectors of a block."""
    did = ids.to_numpy(zero_copy_only=False)
    order = np.argsort(codes[:, 0], kind="stable")
    lists, begin = np.unique(codes[order, 0], return_index=True)
    from_word = np.sqrt(((x - books.words[0][codes[:, 0]]) ** 2).sum(axis=1))
    may = alive(queries, lists, np.maximum.reduceat(from_word[order], begin))
    end = np.append(begin[1:], len(order))
    who, which, dist = [], [], []
    for i in range(0, len(queries.x), TOGETHER):
        asked = may[i : i + TOGETHER].any(axis=0)
        if not asked.any():
            continue
        rows = order if asked.all() else np.concatenate([order[b:e] for b, e in zip(begin[asked], end[asked])])
        s = books.scores(queries.x[i : i + TOGETHER], codes[rows], norms[rows]).T
        take = min(rerank + 1, len(rows))
        best = rows[np.argpartition(-s, take - 1, axis=1)[:, :take] if take < len(rows) else np.tile(np.arange(len(rows)), (len(s), 1))]
        del s
        for j in range(0, len(best), 32):
            here = slice(i + j, i + min(j + 32, len(best)))
            cand = best[j : j + 32]
            d = ((x[cand] - queries.x[here][:, None]).astype(np.float64) ** 2).sum(axis=2)
            d[(did[cand] == queries.keys[here][:, None]) | (d > queries.bound[here][:, None])] = np.inf
            at = np.lexsort((did[cand], d), axis=1)[:, : min(k, take)]
            row = np.arange(len(cand))[:, None]
            fine = np.isfinite(d[row, at])
            who.append(np.broadcast_to(i + j + row, at.shape)[fine]), which.append(cand[row, at][fine]), dist.append(d[row, at][fine])
    cat = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
    return cat(who, np.int64), cat(which, np.int64), cat(dist, np.float64)


def index(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """Every vector (id, x) with its code and norm, written once, in lists by first codeword; a list of very many is cut by id."""
    spread = vectors.sparkSession.sparkContext.broadcast(books)  # books x words x dimension numbers, whatever the number of vectors
    schema = T.StructType([*vectors.schema.fields, T.StructField("code", T.BinaryType()), T.StructField("norm", T.FloatType()), T.StructField("first", T.IntegerType())])

    def encode(batches):
        for batch in batches:
            x = as_matrix(batch.column(1))
            codes = spread.value.encode(x)
            code = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, code, pa.array(spread.value.norms(codes), pa.float32()), pa.array(codes[:, 0].astype(np.int32))], names=schema.names)
        released()

    return written(vectors.mapInArrow(encode, schema).repartitionByRange("first", "id").sortWithinPartitions("first"))


def search(coded: DataFrame, queries: DataFrame, books: Codebooks, k: int = K, rerank: int = RERANK, data_block: int = DATA_BLOCK, a_pass: int = QUERIES_A_PASS) -> DataFrame:
    """id, neighbour_id, distance: candidates of every query (id, x, bound) in every block of an ``index``; at most ``k`` each."""
    spark = coded.sparkSession
    id_type = coded.schema["id"].dataType
    size = 4 * books.words.shape[2]
    a_pass, data_block = max(1, min(a_pass, PASS_BYTES // size)), max(1, min(data_block, BLOCK_BYTES // size))
    passes = max(1, -(-queries.count() // a_pass))
    schema = T.StructType([T.StructField("id", id_type), T.StructField("neighbour_id", id_type), T.StructField("distance", T.DoubleType())])
    known = spark.sparkContext.broadcast(books)

    def pass_over(part: DataFrame) -> DataFrame:
        asked = spark.sparkContext.broadcast(Queries.of(part.toArrow(), books))  # a_pass queries, about

        def block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
            data = pa.Table.from_batches(batches).combine_chunks()
            ids = data.column("id").combine_chunks()
            codes = np.frombuffer(b"".join(data.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            who, which, dist = block_neighbours(asked.value, ids, as_matrix(data.column("x")), codes, data.column("norm").to_numpy(), known.value, k, rerank)
            return pa.RecordBatch.from_arrays([asked.value.ids.take(pa.array(who)), ids.take(pa.array(which)), pa.array(dist)], names=schema.names)

        def run(batches):
            held, n = [], 0
            for batch in batches:
                held.append(batch)
                n += batch.num_rows
                if n >= data_block:
                    yield block(held)
                    held, n = [], 0
            if n:
                yield block(held)
            released()

        return coded.select("id", "x", "code", "norm").mapInArrow(run, schema)

    out = None
    for p in range(passes):
        got = pass_over(queries if passes == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == p))
        out = got if out is None else out.unionByName(got)
    return out


def neighbours(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", queries: Column | None = None, k: int = K, rerank: int = RERANK, sample_rows: int = SAMPLE_ROWS, books: int = BOOKS, words: int = WORDS, **blocks) -> DataFrame:
    """id, neighbour_id, distance (squared Euclidean), rank: the ``k`` nearest other rows of each query, of all rows.

    ``queries``: a condition on id that names the queries; every row is one by default.  Approximate in the candidates
    (``rerank`` of every block of vectors), exact in distance and order.  Ties go to the smaller id.  Rows without an id, or
    whose vector is null, empty, of another dimension than most, or not finite, are neither queries nor neighbours.
    Repeated rows (of one id) count once, by their smallest vector.  A table of one row has no neighbours, nor has an empty one.
    """
    spark = table.sparkSession
    ship(spark)
    ok, _ = clean(table, id_col, vec_col)
    vectors = stored(ok.groupBy("id").agg(F.min("x").alias("x")))
    drawn, x = sample(vectors, sample_rows)
    if not drawn:
        drawn, x = sample(vectors.limit(sample_rows), sample_rows)  # so few rows that none was drawn
    id_type = table.schema[id_col].dataType
    if not drawn:
        out = [T.StructField(id_col, id_type), T.StructField("neighbour_id", id_type), T.StructField("distance", T.DoubleType()), T.StructField("rank", T.IntegerType())]
        return spark.createDataFrame([], T.StructType(out))
    made = seed_books(x, books, words)
    known = spark.sparkContext.broadcast((made, np.array(drawn), x))  # the codebooks and the sample: bounded

    def bound(batches):
        for batch in batches:
            b = bounds(as_matrix(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False), *known.value, k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(b)], names=["id", "x", "bound"])

    asked = vectors if queries is None else vectors.withColumnRenamed("id", id_col).where(queries).withColumnRenamed(id_col, "id")
    asked = stored(asked.mapInArrow(bound, T.StructType([*vectors.schema.fields, T.StructField("bound", T.DoubleType())])))
    found = search(index(vectors, made), asked, made, k, rerank, **blocks)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("id").alias(id_col), "neighbour_id", "distance", "rank")

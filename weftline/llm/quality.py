"""Document quality by hierarchical empirical Bayes.

A logistic model gives each document's evidence: the log of how much likelier its text is among
acceptable than among unacceptable labelled documents (acceptable: quality 1 and not toxic).  Sites
add a prior: the expected share of acceptable documents of each path section is shrunk toward that of
its host, and the host's toward the global one, by as much as grouped moments of all documents say.
The posterior of a document is its evidence plus the log-odds of its path's shrunk share.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import MULT, PIECE, Words, chunks, kgrams, maybe_broadcast, mix, over_texts, raw_bytes, released, segment_sum, ship, span_hash, stored, written

#: Labelled rows that the document model is fitted on, about: a bound of the training sample. Their texts are taken whole.
TRAIN_ROWS = 6000
#: Log-odds of a lexicon's terms, at least, and standard errors by which they must exceed zero.
WEIGHT, Z = 3.0, 4.0
#: Words whose terms are scored at a time: bounds a worker's memory, not the result.
SCORE_WORDS = 1 << 15
#: Documents whose posterior of being acceptable is under this are rejected.
THRESHOLD = 0.5
#: Groups of a site level that are sent to every executor, at most; beyond that the join shuffles.
BROADCAST_SITES = 300_000

_PUNCT = np.zeros(256, bool)
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True
_ODD = _PUNCT.copy()
_ODD[list(b".,;:'\"-()?")] = False
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True


def shapes(texts: pa.Array, words: Words) -> np.ndarray:
    """What a text looks like, a row each; zeros for a text without words."""
    buf, off = raw_bytes(texts, lower=False)
    rows = len(off) - 1
    size = np.maximum(np.diff(off), 1)
    n = np.maximum(words.count(), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        out = np.zeros(rows, np.int64)
        for i in range(0, len(buf), PIECE):
            total = np.concatenate([[0], np.cumsum(mask[buf[i : i + PIECE]])])
            out += np.diff(total[np.clip(off - i, 0, len(total) - 1)])
        return out / size

    upper, lower = share(_UPPER), share(_LOWER)
    again = np.zeros(len(words) + 1)
    if len(words) > 1:
        again[1:-1] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    repeats = segment_sum(again[:-1], words.first) / n
    newline = np.flatnonzero(buf == 10)
    start = np.unique(np.concatenate([off[:-1], newline + 1]))
    start = start[start < len(buf)]
    end = np.append(start[1:], len(buf)).astype(np.int64)
    doc = np.searchsorted(off, start, side="right") - 1
    h = span_hash(buf, start, end) if len(start) else np.zeros(0, np.uint64)
    lines = np.bincount(doc, minlength=rows)
    distinct = np.bincount(doc[np.unique(in_row(h, doc), return_index=True)[1]], minlength=rows)
    odd = share(_ODD)
    cols = [
        np.log1p(100 * odd), np.minimum(odd / 0.02, 1), np.log1p(100 * share(_PUNCT)), upper / np.maximum(upper + lower, 1e-9),
        np.minimum(repeats / 0.1, 1), np.log1p(100 * repeats), 1 - distinct / np.maximum(lines, 1), np.log(n), np.log1p(segment_sum((words.end - words.start).astype(float), words.first) / n),
    ]
    return np.stack(cols, axis=1) * (words.count() > 0)[:, None]


#: Bytes of the beginnings of words that are terms too: they carry over to forms of a stem that no labelled text has.
STEMS = (4, 5)


class Bag:
    """Hashes of some rows' terms: those of row r from first[r] to first[r + 1]."""

    def __init__(self, hashes: np.ndarray, count: np.ndarray):
        self.hash, self.first = hashes, np.concatenate([[0], np.cumsum(count)])
        self.doc = np.repeat(np.arange(len(count)), count)

    def __len__(self) -> int:
        return len(self.hash)


def terms(words: Words, at: int = 0, upto: int | None = None) -> Bag:
    """Each word and its beginnings, in order, of the words from ``at`` to ``upto``; 0 in place of a beginning that is the whole word."""
    upto = len(words) if upto is None else upto
    own, start = words.hash[at:upto], words.start[at:upto]
    cols = [own]
    size = words.end[at:upto] - start
    for k in STEMS:
        long = np.flatnonzero(size > k)
        h = np.zeros(len(own), np.uint64)
        h[long] = mix(span_hash(words.buf, start[long], start[long] + k) ^ np.uint64(k))
        cols.append(h)
    return Bag(np.stack(cols, axis=1).ravel(), np.diff(np.clip(words.first, at, upto)) * len(cols))


def copies(words: Words) -> np.ndarray:
    """Three numbers a row that near copies mostly share: the least hashes of its runs of three words."""
    h, at = kgrams(words, 3)
    row = words.doc[at]
    first = np.searchsorted(row, np.arange(len(words.first)))
    full = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((len(words.first) - 1, 3), np.uint64)
    for j in range(3):
        if len(full):
            out[full, j] = np.minimum.reduceat(mix(h ^ np.uint64(j * 0x9E37)), first[full])
    return out


def without_copies(sketch: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows of the sample of which no earlier row of the same class is a near copy (one of the three numbers is shared)."""
    keep = np.ones(len(sketch), bool)
    for j in range(sketch.shape[1]):
        key = mix(sketch[:, j] + y.astype(np.uint64) * MULT)
        again = np.ones(len(key), bool)
        again[np.unique(key, return_index=True)[1]] = False
        keep &= ~again | (sketch[:, j] == 0)
    return keep


@dataclass
class Lexicon:
    """Words that tell a class: sorted hashes and weights (log-odds of a document's having the word)."""

    hashes: np.ndarray
    weights: np.ndarray

    def add(self, bag: Bag, to: np.ndarray) -> None:
        """Adds the weights of the terms that speak for the class to each row's sum."""
        if not len(self.hashes) or not len(bag):
            return
        sieve = np.zeros(1 << 16, bool)
        sieve[self.hashes & np.uint64(0xFFFF)] = True
        may = np.flatnonzero(sieve[bag.hash & np.uint64(0xFFFF)])
        at = np.minimum(np.searchsorted(self.hashes, bag.hash[may]), len(self.hashes) - 1)
        hit = self.hashes[at] == bag.hash[may]
        to += np.bincount(bag.doc[may[hit]], weights=self.weights[at[hit]], minlength=len(to))


def in_row(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that differ between rows too."""
    return mix(h + doc.astype(np.uint64) * MULT)


def tally(texts: pa.Array, classes: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """All terms of the texts and, for each of ``classes`` (y, rows that count), the rows of class 1 and of class 0 that have them; chunk by chunk."""
    hashes = np.zeros(0, np.uint64)
    counts = np.zeros((0, 2 * len(classes)))
    for i, j in chunks(texts):
        bag = terms(Words(texts.slice(i, j - i)))
        once = np.unique(in_row(bag.hash, bag.doc), return_index=True)[1]
        once = once[bag.hash[once] != 0]
        row = bag.doc[once] + i
        each = np.stack([part for y, own in classes for part in (y[row] * own[row], (1 - y[row]) * own[row])], axis=1)
        hashes, at = np.unique(np.concatenate([hashes, bag.hash[once]]), return_inverse=True)
        both = np.concatenate([counts, each])
        counts = np.stack([np.bincount(at, weights=both[:, c], minlength=len(hashes)) for c in range(both.shape[1])], axis=1)
    return hashes, [(counts[:, 2 * k], counts[:, 2 * k + 1]) for k in range(len(classes))]


def lexicon(hashes: np.ndarray, one: np.ndarray, zero: np.ndarray, n1: int, n0: int, z: float = Z, weight: float = WEIGHT) -> Lexicon:
    """Terms whose smoothed log-odds for class 1 are at least ``weight`` and ``z`` standard errors above zero; one, zero: rows of either class that have them."""
    a, b = one + 1, zero + 1
    w = np.log(a / (max(n1, 1) + 2)) - np.log(b / (max(n0, 1) + 2))
    ok = (w >= weight) & (w / np.sqrt(1 / a + 1 / b) > z)
    return Lexicon(hashes[ok], w[ok])


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights, bias last, of an L2-regularised logistic regression by Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], l2)
    reg[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(reg), x.T @ (p - y) + reg * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def looks(texts: pa.Array, lexicons: list[Lexicon]) -> np.ndarray:
    """The features of each row; zeros for a text without words."""
    words = Words(texts)
    sums = np.zeros((len(lexicons), len(texts)))
    for i in range(0, len(words), SCORE_WORDS):
        bag = terms(words, i, min(i + SCORE_WORDS, len(words)))
        for lex, to in zip(lexicons, sums):
            lex.add(bag, to)
    return np.concatenate([shapes(texts, words), np.log1p(sums).T], axis=1)


@dataclass
class Model:
    lexicons: list[Lexicon]
    weights: np.ndarray | None  # None: no labelled rows of both classes, no evidence
    prior: float  # share of acceptable documents in the sample

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """Log-likelihood ratio of acceptable to unacceptable; 0 for a text without words."""
        if self.weights is None:
            return np.zeros(len(texts))
        x = looks(texts, self.lexicons)
        return (x @ self.weights[:-1] + self.weights[-1] - np.log(self.prior / (1 - self.prior))) * x.any(axis=1)


def _sketches(texts: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros((0, 3), np.uint64), *(copies(Words(texts.slice(i, j - i))) for i, j in chunks(texts))])


def _features(texts: pa.Array, lexicons: list[Lexicon]) -> np.ndarray:
    return np.concatenate([looks(texts.slice(i, j - i), lexicons) for i, j in chunks(texts)])


def _counting(q: np.ndarray, t: np.ndarray, sketch: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of either lexicon, toxic and poor: the class of each row, and whether the row counts. A labelled text with many copies would make its own words tell the class: copies count once."""
    return [(y, without_copies(sketch, y).astype(int)) for y in (t, 1 - q)]


def fit_rows(texts: list[str], quality: list[int], toxic: list[int]) -> Model:
    """The model of some rows, on the driver."""
    q, t = np.array(quality, int), np.array(toxic, int)
    good = (q == 1) & (t == 0)
    if good.all() or not good.any():
        return Model([], None, 0.5)
    arr = pa.array(texts, pa.string())
    classes = _counting(q, t, _sketches(arr))
    hashes, seen = tally(arr, classes)
    lexicons = [lexicon(hashes, one, zero, int((y * own).sum()), int(((1 - y) * own).sum())) for (y, own), (one, zero) in zip(classes, seen)]
    return Model(lexicons, logistic(_features(arr, lexicons), good.astype(float)), float(good.mean()))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """id, text, q, t of about ``rows`` labelled rows, drawn by hash of the id; of rows of one id, the least text. Contradictory labels: the worse one holds."""
    lab = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min("quality").cast("int").alias("q"), F.coalesce(F.max("toxic"), F.lit(0)).cast("int").alias("t"))
    n = lab.count()
    drawn = lab.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < float(min(1.0, rows / max(n, 1)) * (1 << 30)))
    text = docs.where(F.octet_length(text_col) > 0).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return text.join(maybe_broadcast(drawn), "id").groupBy("id", "q", "t").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """The document model from about ``rows`` labelled rows (``training_sample``); their texts stay on the executors, which send counts and features."""
    spark = docs.sparkSession
    ship(spark)
    sample = written(training_sample(docs, labels, id_col, text_col, rows).select("id", "text", "q", "t"))
    own = sample.schema["id"]

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = _sketches(batch.column(1)).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *(pa.array(s[:, j]) for j in range(3))], names=["id", "q", "t", "a", "b", "c"])

    flat = T.StructType([own, *(T.StructField(c, T.IntegerType()) for c in "qt"), *(T.StructField(c, T.LongType()) for c in "abc")])
    drawn = sorted(sample.mapInArrow(over_texts(sketch), flat).collect(), key=lambda r: str(r["id"]))  # a few numbers for each of about `rows` rows
    q, t = (np.array([r[c] for r in drawn], int) for c in "qt")
    good = (q == 1) & (t == 0)
    if good.all() or not good.any():
        return Model([], None, 0.5)
    classes = _counting(q, t, np.array([[r[c] for c in "abc"] for r in drawn], np.int64).view(np.uint64))
    row_of = spark.sparkContext.broadcast({r["id"]: k for k, r in enumerate(drawn)})
    counted = spark.sparkContext.broadcast(classes)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        row = np.array([row_of.value[i] for i in batch.column(0).to_pylist()], int)
        hashes, seen = tally(batch.column(1), [(y[row], use[row]) for y, use in counted.value])
        return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), *(pa.array(x.astype(np.int64)) for both in seen for x in both)], names=["term", "t1", "t0", "q1", "q0"])

    sums = sample.mapInArrow(over_texts(count), "term long, t1 long, t0 long, q1 long, q0 long").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("t1", "t0", "q1", "q0")))
    sums = written(sums)
    lexicons = []
    for (y, use), k in zip(classes, "tq"):
        n1, n0 = int((y * use).sum()), int(((1 - y) * use).sum())
        # ``lexicon``'s test with a margin for rounding: only what passes comes to the driver
        one, zero = F.col(f"{k}1") + 1.0, F.col(f"{k}0") + 1.0
        w = F.log(one / (max(n1, 1) + 2)) - F.log(zero / (max(n0, 1) + 2)) + 1e-6
        got = sums.where((w >= WEIGHT) & (w > Z * F.sqrt(1 / one + 1 / zero))).select("term", f"{k}1", f"{k}0").collect()
        got.sort(key=lambda r: r[0] % (1 << 64))
        lexicons.append(lexicon(np.array([r[0] for r in got], np.int64).view(np.uint64), np.array([r[1] for r in got], float), np.array([r[2] for r in got], float), n1, n0))
    known = spark.sparkContext.broadcast(lexicons)

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _features(batch.column(1), known.value)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "x"])

    rows_ = sample.mapInArrow(over_texts(look), T.StructType([own, T.StructField("x", T.ArrayType(T.DoubleType()))])).collect()
    x = np.array([r["x"] for r in sorted(rows_, key=lambda r: row_of.value[r["id"]])])
    return Model(lexicons, logistic(x, good.astype(float)), float(good.mean()))


def evidence_udf(spark, model: Model):
    """A column of the documents' evidence; only the text goes to Python and only a number comes back."""
    ship(spark)
    spread = spark.sparkContext.broadcast(model)  # bounded by the sample, not by the rows scored

    @F.arrow_udf("double")
    def llr(texts: pa.Array) -> pa.Array:
        if len(texts) == 0:
            return pa.array([], pa.float64())
        out = np.concatenate([spread.value.evidence(texts.slice(i, j - i)) for i, j in chunks(texts)])
        released()
        return pa.array(out)

    return llr


def site(source: Column) -> tuple[Column, Column]:
    """Host and path section (the first segment) of a source that is a URL or a plain name. Null is ''."""
    bare = F.regexp_replace(F.lower(F.coalesce(source.cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(bare, r"^([^/?#]*)", 1)
    return host, F.regexp_extract(bare, r"^[^/?#]*/([^/?#]*)", 1)


def shrunk(groups: DataFrame) -> DataFrame:
    """host, path, host_rate, path_rate from per-path sums (host, path, n, s: sum of expected acceptability).

    The strength k of each level's prior is by moments: m(1 - m) / between-group variance - 1, kept in
    1 .. 10000; a rate is (s + k * parent's rate) / (n + k).
    """
    hosts = groups.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))

    def strength(rates: DataFrame, n: str, s: str, parent: Column) -> float:
        r = rates.select(F.col(n).alias("n"), F.col(s).alias("s"), parent.alias("m")).agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("m"), 2)).alias("ss"), F.sum(F.col("m") * (1 - F.col("m"))).alias("within"), F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("v")
        ).first()
        if not r["n"]:
            return 1.0
        between = max((r["ss"] - r["within"]) / r["n"], 1e-9)
        return float(min(max(r["v"] / r["n"] / between - 1, 1.0), 1e4))

    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    m0 = (total["s"] + 0.5) / (total["n"] + 1) if total["n"] else 0.5
    k = strength(hosts, "hn", "hs", F.lit(m0))
    hosts = hosts.select("host", ((F.col("hs") + k * m0) / (F.col("hn") + k)).alias("host_rate"))
    both = groups.join(hosts, "host")
    kp = strength(both, "n", "s", F.col("host_rate"))
    return both.select("host", "path", "host_rate", ((F.col("s") + kp * F.col("host_rate")) / (F.col("n") + kp)).alias("path_rate"))


def _keyed(docs: DataFrame, model: Model, text_col: str, source_col: str, path_col: str | None) -> DataFrame:
    """``docs`` with __wl_host, __wl_path and __wl_evidence."""
    host, section = site(F.col(source_col))
    path = F.when(section == "", F.coalesce(F.col(path_col).cast("string"), F.lit(""))).otherwise(section) if path_col else section
    llr = evidence_udf(docs.sparkSession, model)
    return docs.withColumns({"__wl_host": host, "__wl_path": path, "__wl_evidence": llr(F.col(text_col).cast("string"))})


def _judged(keyed: DataFrame, model: Model, threshold: float) -> DataFrame:
    """Stored rows of ``_keyed`` with the rates, the posterior and the decision."""
    prior = float(np.log(model.prior / (1 - model.prior)))
    p = 1 / (1 + F.exp(-(F.col("__wl_evidence") + prior)))
    groups = stored(keyed.groupBy(F.col("__wl_host").alias("host"), F.col("__wl_path").alias("path")).agg(F.count("*").alias("n"), F.sum(p).alias("s")))
    rates = shrunk(groups).select(F.col("host").alias("__wl_host"), F.col("path").alias("__wl_path"), F.col("host_rate").alias("__wl_host_rate"), F.col("path_rate").alias("__wl_path_rate"))
    rate = F.least(F.greatest(F.col("__wl_path_rate"), F.lit(1e-6)), F.lit(1 - 1e-6))
    posterior = 1 / (1 + F.exp(-(F.col("__wl_evidence") + F.log(rate / (1 - rate)))))
    out = keyed.join(maybe_broadcast(rates, BROADCAST_SITES), ["__wl_host", "__wl_path"]).withColumn("__wl_posterior", posterior)
    return out.withColumn("__wl_keep", F.col("__wl_posterior") >= threshold)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", path_col: str | None = None, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with __wl_evidence, __wl_host_rate, __wl_path_rate, __wl_posterior and __wl_keep.

    The path section is the source URL's first segment; where a source has none, ``path_col`` if given.  Null
    source and path are the site ''.  Null and empty texts have evidence 0: their site decides.  A
    posterior equal to the threshold is kept.  Repeated rows count and are judged one by one.  Without
    labels of both classes all evidence is 0 and the posterior is the site's rate, 0.5: all are kept.  An empty
    table gives none.  Very long texts are scored whole, piece by piece.  Columns of any other name pass through.
    The rows are written to the shared folder once with their evidence, so no text is scored twice.
    """
    model = fit(docs, labels, id_col, text_col, train_rows)
    return _judged(written(_keyed(docs, model, text_col, source_col, path_col)), model, threshold)


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", path_col: str | None = None, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of ``docs``: id, host, path, evidence, host_rate, path_rate, posterior, keep; as ``classify``, without the documents."""
    model = fit(docs, labels, id_col, text_col, train_rows)
    keyed = written(_keyed(docs, model, text_col, source_col, path_col).select(id_col, "__wl_host", "__wl_path", "__wl_evidence"))
    c = _judged(keyed, model, threshold)
    return c.select(id_col, *(F.col(f"__wl_{x}").alias(x) for x in ("host", "path", "evidence", "host_rate", "path_rate", "posterior", "keep")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """First stage of the corpus pipeline: the documents that the classifier keeps, with their columns. Awkward rows as in ``classify``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels).where("__wl_keep").select(*docs.columns)

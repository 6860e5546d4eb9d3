"""Language identification in two steps: family first, then one-versus-one linear SVMs within it.

Features are hashed byte trigrams of the whole lower-cased text, as shares of the text's trigrams.
The models are fitted on a bounded sample of labelled rows (``per_language``), whose texts stay on the executors: the driver
gets their features.  Prediction covers all rows in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftline.llm.common import PIECE, field, over_texts, raw_bytes, ship, small, texts_of

#: Language families; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("de", "en", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("es", "fr", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "mr", "ur", "pa", "gu"),
}
BUCKETS = 1 << 13
#: Labelled rows per language that the models are fitted on, at most: a bound of the training sample. Their texts are taken whole.
PER_LANGUAGE = 300
UNKNOWN = "und"


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def features(texts: pa.Array) -> np.ndarray:
    """Rows of shares of hashed trigrams, spaces around each text; a text without letters is a zero row."""
    buf, off = raw_bytes(texts)
    rows = len(off) - 1
    if not len(buf):
        return np.zeros((rows, BUCKETS), np.float32)
    count = np.zeros(rows * BUCKETS, np.int64)
    first = off[:-1][np.diff(off) > 0]
    for i in range(0, len(buf), PIECE):  # bounds memory, not the result: the two bytes before a piece come with it
        at = max(i - 2, 0)
        part = buf[at : i + PIECE]
        x = part.astype(np.uint32)
        x[part < 97] = 32  # digits, punctuation and spaces say nothing of the language
        x[(part > 122) & (part < 128)] = 32
        code = x.copy()
        code[1:] |= x[:-1] << np.uint32(8)
        code[2:] |= x[:-2] << np.uint32(16)
        ok = code & np.uint32(0xFFFFFF) != 0x202020
        ok[: i - at] = False
        begins = first[(first >= at - 1) & (first < at + len(part))] - at
        ok[begins[begins >= 0]] = False
        begins = begins[begins + 1 < len(ok)] + 1
        ok[begins[begins >= 0]] = False
        bucket = ((code * np.uint32(2654435761)) >> np.uint32(32 - 13)).astype(np.int64)
        doc = np.repeat(np.arange(rows), np.diff(np.clip(off, at, at + len(part))))
        count += np.bincount((bucket + doc * BUCKETS)[ok], minlength=rows * BUCKETS)
    count = count.reshape(rows, BUCKETS).astype(np.float32)
    norm = np.sqrt((count * count).sum(axis=1, keepdims=True))
    return count / np.maximum(norm, 1e-9)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Weights, bias last, of an L2-regularised hinge-loss SVM by dual coordinate descent; y is +1 or -1."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    q = np.maximum((x * x).sum(axis=1), 1e-9)
    w, a = np.zeros(x.shape[1], np.float32), np.zeros(len(x))
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            new = min(max(a[i] + (1 - y[i] * float(w @ x[i])) / q[i], 0), c)
            if new != a[i]:
                w += np.float32((new - a[i]) * y[i]) * x[i]
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-3:
            break
    return w


@dataclass
class Model:
    families: list[str]
    members: dict[str, list[str]]
    family_w: np.ndarray  # one-versus-rest, a column each
    pair_w: dict[tuple[str, str], np.ndarray]  # positive: the first

    def predict(self, x: np.ndarray) -> tuple[list[str], list[str], np.ndarray]:
        """Family, language and margin of each row; a zero row is of no language."""
        known = x.any(axis=1)
        scores = x @ self.family_w[:-1] + self.family_w[-1]
        pick = scores.argmax(axis=1)
        top = np.sort(scores, axis=1)
        margin = (top[:, -1] - top[:, -2]) if len(self.families) > 1 else top[:, -1]
        family = np.array(self.families, object)[pick]
        lang = np.full(len(x), UNKNOWN, object)
        for f, langs in self.members.items():
            rows = np.flatnonzero((family == f) & known)
            votes, strength = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs)))
            for (a, b), w in self.pair_w.items():
                if a in langs and b in langs:
                    s = x[rows] @ w[:-1] + w[-1]
                    i, j = langs.index(a), langs.index(b)
                    votes[:, i] += s >= 0
                    votes[:, j] += s < 0
                    strength[:, i] += s
                    strength[:, j] -= s
            best = (votes + 1e-6 * np.tanh(strength)).argmax(axis=1)
            lang[rows] = np.array(langs, object)[best]
        family[~known] = UNKNOWN
        margin = np.where(known, margin, 0.0)
        return list(family), list(lang), margin


def fit_features(x: np.ndarray, langs: list[str]) -> Model:
    """A model from the features of labelled texts. One language or family alone is always predicted."""
    y = np.array(langs, object)
    fam = np.array([family_of(v) for v in langs], object)
    families = sorted(set(fam))
    ws = [linear_svm(x, np.where(fam == f, 1, -1)) if len(families) > 1 else np.zeros(BUCKETS + 1, np.float32) for f in families]
    members = {f: sorted(set(y[fam == f])) for f in families}
    pairs = {}
    for langs_ in members.values():
        for a, b in combinations(langs_, 2):
            rows = (y == a) | (y == b)
            pairs[a, b] = linear_svm(x[rows], np.where(y[rows] == a, 1, -1))
    return Model(families, members, np.stack(ws, axis=1) if ws else np.zeros((BUCKETS + 1, 0), np.float32), pairs)


def fit_rows(texts: list[str], langs: list[str]) -> Model:
    return fit_features(features(pa.array(texts, pa.string())), langs)


def training_sample(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """lang, draw, text of at most ``per_language`` different labelled texts of each language, drawn by hash of the text; bounded whatever the size.

    Texts of a language that has very many copies of one may be drawn fewer: copies count when the rate is set, and are one when drawn.
    """
    drawn = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.octet_length(text_col) > 0)).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("draw"), F.col(text_col).cast("string").alias("text"))
    rate = drawn.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).select("lang", F.least(F.lit(1.0), 1.5 * per_language / F.col("n")).alias("share"))
    picked = drawn.join(F.broadcast(rate) if small(rate, 100_000) else rate, "lang").where(F.pmod("draw", F.lit(1 << 30)) < F.col("share") * float(1 << 30))
    once = picked.groupBy("lang", "draw").agg(F.min("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("draw", F.lit(1 << 30)), "draw"))
    return once.withColumn("nth", nth).where(F.col("nth") <= per_language).drop("nth")


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    ship(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(batch.column(2))
        at = [np.flatnonzero(r).astype(np.int32) for r in x]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int32())), pa.array([r[i] for r, i in zip(x, at)], pa.list_(pa.float32()))], names=["lang", "draw", "at", "x"])

    rows = training_sample(docs, text_col, lang_col, per_language).mapInArrow(over_texts(work, text=2, rows=256), "lang string, draw long, at array<int>, x array<float>").collect()
    rows.sort(key=lambda r: (r["lang"], r["draw"]))
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for k, r in enumerate(rows):
        x[k, r["at"]] = r["x"]
    return fit_features(x, [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, family, language, margin (of the family decision).

    Null and empty texts, and those without letters: family and language 'und', margin 0.  Ties between
    pairwise votes go to the larger sum of margins, then to the first language by name.  Repeated rows:
    a row each.  Without a single labelled row every text is 'und'.  Very long texts are taken whole; an empty table gives none.
    Other columns are ignored.
    """
    ship(docs.sparkSession)
    schema = T.StructType([field(docs, id_col), T.StructField("family", T.StringType()), T.StructField("language", T.StringType()), T.StructField("margin", T.DoubleType())])
    spread = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of languages, not by rows

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = spread.value
        if not m.families:
            n = batch.num_rows
            family, lang, margin = [UNKNOWN] * n, [UNKNOWN] * n, np.zeros(n)
        else:
            family, lang, margin = m.predict(features(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(family, pa.string()), pa.array(lang, pa.string()), pa.array(margin.astype(np.float64))], names=schema.names)

    return texts_of(docs, id_col, text_col).mapInArrow(over_texts(work, rows=256), schema)

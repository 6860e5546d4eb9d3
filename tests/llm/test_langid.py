"""op1: rows held out, and the one-versus-one vote by hand."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tests.llm import fixtures as fx
from weftline.llm import langid, queries

SAMPLES = {
    "en": "the house that stands by the water was built when the town had only two streets and nobody had thought of trains",
    "de": "das haus, das am wasser steht, wurde gebaut, als die stadt nur zwei strassen hatte und niemand an eisenbahnen dachte",
    "es": "la casa que está junto al agua fue construida cuando la ciudad tenía solo dos calles y nadie pensaba en trenes",
    "fr": "la maison qui se trouve au bord de l'eau a été construite quand la ville n'avait que deux rues et personne ne pensait aux trains",
}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    got = langid.identify(docs.where("doc_id % 2 = 1"), model).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("n_chars >= 40").collect()
    right = sum(r["language"] == r["lang"] for r in got) / len(got)
    assert right > 0.93, right
    assert all(r["family"] == langid.family_of(r["language"]) for r in got)


def plain_features(text: str) -> np.ndarray:
    """Trigram by trigram."""
    raw = [b if b >= 128 or 97 <= b <= 122 else 32 for b in text.lower().encode()]
    out = np.zeros(langid.BUCKETS)
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        code = a << 16 | b << 8 | c
        if code != 0x202020:
            out[code * 2654435761 % 2**32 >> 19] += 1
    return out / max(np.sqrt((out * out).sum()), 1e-9)


def test_registered_query_equals_brute_force(spark, sf):
    """Every document's features trigram by trigram, every machine by itself, every vote counted."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in queries.op1_language_id(spark, sf).collect()}
    for r in docs.collect():
        x = langid.features(pa.array([r["text"]]))[0] if len(r["text"] or "") > 3000 else plain_features(r["text"] or "")
        if not x.any():
            assert got[r["doc_id"]]["language"] == "und"
            continue
        scores = [float(x @ w[:-1] + w[-1]) for w in model.family_w.T]
        best = sorted(scores)[::-1]
        family = model.families[scores.index(best[0])]
        votes = {la: [0, 0.0] for la in model.members[family]}
        for (a, b), w in model.pair_w.items():
            if a in votes and b in votes:
                s = float(x @ w[:-1] + w[-1])
                for la, gain in ((a, s), (b, -s)):
                    votes[la][0] += gain > 0 or (gain == 0 and la == a)
                    votes[la][1] += gain
        language = max(sorted(votes), key=lambda la: tuple(votes[la]))
        assert (got[r["doc_id"]]["family"], got[r["doc_id"]]["language"]) == (family, language)
        assert abs(got[r["doc_id"]]["margin"] - (best[0] - best[1])) < 1e-3


def test_features_of_a_long_text_do_not_depend_on_the_pieces(monkeypatch):
    texts = pa.array(["été " * 300, "", "ab", "x" * 1000 + " the end", None, "a", "the quick brown fox"])
    whole = langid.features(texts)
    for piece in (7, 64, 1001):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert np.array_equal(langid.features(texts), whole)


def test_the_sample_is_bounded_and_copies_count_once(spark):
    df = fx.docs(spark, *["same text"] * 400, *[f"text number {i}" for i in range(100)])
    sample = langid.training_sample(df, per_language=20).collect()
    assert len(sample) <= 20 and len({r["text"] for r in sample}) == len(sample) > 5
    assert [r["text"] for r in langid.training_sample(fx.docs(spark, *["same text"] * 400)).collect()] == ["same text"]


def test_ties_of_votes_go_to_the_larger_margins_then_the_first_name():
    w = lambda v: np.append(np.eye(1, langid.BUCKETS, dtype=np.float32)[0] * v, 0).astype(np.float32)
    x = np.eye(1, langid.BUCKETS, dtype=np.float32)
    circle = langid.Model(["f"], {"f": ["a", "b", "c"]}, np.zeros((langid.BUCKETS + 1, 1), np.float32), {("a", "b"): w(1), ("a", "c"): w(-2), ("b", "c"): w(3)})
    assert circle.predict(x)[1] == ["b"]  # a over b by 1, c over a by 2, b over c by 3: a vote each
    flat = langid.Model(["f"], {"f": ["a", "b", "c"]}, np.zeros((langid.BUCKETS + 1, 1), np.float32), {("a", "b"): w(1), ("a", "c"): w(-1), ("b", "c"): w(1)})
    assert flat.predict(x)[1] == ["a"]


def test_family_first_then_pairs():
    texts = [" ".join(SAMPLES[k].split()[i : i + 12]) for k in SAMPLES for i in range(8)]
    model = langid.fit_rows(texts, [k for k in SAMPLES for _ in range(8)])
    assert model.families == ["germanic", "romance"] and set(model.pair_w) == {("de", "en"), ("es", "fr")}
    x = langid.features(pa.array(list(SAMPLES.values())))
    family, lang, _ = model.predict(x)
    assert lang == list(SAMPLES)
    for row, f, la in zip(x, family, lang):
        assert f == model.families[int((row @ model.family_w[:-1] + model.family_w[-1]).argmax())]
        (pair,) = [p for p in model.pair_w if la in p]
        w = model.pair_w[pair]
        assert la == pair[0 if row @ w[:-1] + w[-1] >= 0 else 1]


def test_svm_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5)).astype(np.float32)
    y = np.where(x @ np.array([1, -2, 0.5, 0, 1], np.float32) > 0, 1, -1)
    w = langid.linear_svm(x, y)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.97


def test_awkward_rows(spark):
    df = fx.awkward(spark)
    got = langid.identify(df, langid.fit(df)).collect()
    assert len(got) == df.count()
    assert {r["language"] for r in got if r["doc_id"] in (2, 3, 6)} == {"und"}
    assert langid.identify(fx.empty(spark), langid.fit(df)).count() == 0
    assert {r["language"] for r in langid.identify(df, langid.fit(fx.empty(spark))).collect()} == {"und"}
    one = langid.identify(df, langid.fit(fx.docs(spark, fx.PROSE))).where("doc_id = 5").first()
    assert one["language"] == "en"

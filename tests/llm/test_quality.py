"""op5: shrinkage against its formulas in plain Python, the classifier on rows held out."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import fixtures as fx
from weftline.llm import quality, queries
from weftline.llm.common import Words

LABELS = "doc_id long, quality int, toxic int"


def plain_shrink(groups: list[tuple[str, str, int, float]]) -> dict:
    hosts: dict[str, list[float]] = {}
    for h, _, n, s in groups:
        a = hosts.setdefault(h, [0, 0.0])
        a[0] += n
        a[1] += s
    n_all, s_all = sum(a[0] for a in hosts.values()), sum(a[1] for a in hosts.values())
    m0 = (s_all + 0.5) / (n_all + 1)

    def strength(rows):
        n = sum(r[0] for r in rows)
        ss = sum(r[0] * (r[1] / r[0] - r[2]) ** 2 for r in rows)
        within = sum(r[2] * (1 - r[2]) for r in rows)
        v = sum(r[0] * r[2] * (1 - r[2]) for r in rows)
        return min(max(v / n / max((ss - within) / n, 1e-9) - 1, 1.0), 1e4)

    k = strength([(n, s, m0) for n, s in hosts.values()])
    rate = {h: (s + k * m0) / (n + k) for h, (n, s) in hosts.items()}
    kp = strength([(n, s, rate[h]) for h, _, n, s in groups])
    return {(h, p): (rate[h], (s + kp * rate[h]) / (n + kp)) for h, p, n, s in groups}


def test_shrinkage_equals_plain_python(spark):
    rng = random.Random(4)
    groups = [(f"h{i % 7}", f"p{i}", n := rng.randint(1, 400), n * rng.random()) for i in range(40)]
    got = {(r["host"], r["path"]): (r["host_rate"], r["path_rate"]) for r in quality.shrunk(spark.createDataFrame(groups, "host string, path string, n long, s double")).collect()}
    want = plain_shrink(groups)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-9)


def test_sparse_sites_move_to_the_prior(spark):
    groups = [("big", "a", 5000, 4500.0), ("small", "a", 1, 0.0), ("other", "a", 5000, 500.0)]
    got = {r["host"]: r["path_rate"] for r in quality.shrunk(spark.createDataFrame(groups, "host string, path string, n long, s double")).collect()}
    assert got["big"] == pytest.approx(0.9, abs=0.01) and got["other"] == pytest.approx(0.1, abs=0.01)
    assert 0.2 < got["small"] < 0.5


def test_tally_equals_plain_counts():
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["alpha", "alphabet", "be", "gamma", "gammas", "δelta", "x"]) for _ in range(rng.randint(0, 12))) for _ in range(200)]
    y, own = np.array([rng.randint(0, 1) for _ in texts]), np.array([rng.randint(0, 1) for _ in texts])
    hashes, [(one, zero)] = quality.tally(pa.array(texts), [(y, own)])
    want: dict[str, list[int]] = {}
    for t, c, o in zip(texts, y, own):
        forms = {w.encode() for w in t.split()}
        for f in {(0, w) for w in forms} | {(k, w[:k]) for w in forms for k in quality.STEMS if len(w) > k}:
            want.setdefault(f, [0, 0])[1 - c] += int(o)
    assert sorted(zip(one, zero)) == sorted(map(tuple, want.values())) and len(hashes) == len(want)


def test_copies_count_once():
    base = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(5)]
    near = [b.replace("x30", "x99") for b in base]
    sketch = quality.copies(Words(pa.array([*base, *near, "one", ""])))
    keep = quality.without_copies(sketch, np.ones(12, int))
    assert keep[:5].all() and keep[10:].all() and keep[5:10].sum() <= 1
    y = np.array([1] * 5 + [0] * 7)
    assert quality.without_copies(sketch, y).all()  # copies of the other class stay


def test_forms_of_a_stem_that_no_labelled_text_has():
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    some = lambda: [rng.choice(words) for _ in range(80)]
    texts, toxic = [], []
    for i in range(600):
        bad = i % 6 == 0
        texts.append(" ".join(some() + ([f"grimble{rng.choice('abcdefgh')}{rng.randrange(50)}" for _ in range(3)] if bad else [])))
        toxic.append(int(bad))
    model = quality.fit_rows(texts, [1] * 600, toxic)
    fresh = pa.array([" ".join([*some(), "grimblezz999"]), " ".join(some())])
    bad, good = model.evidence(fresh)
    assert bad < -1 < 0 < good


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = quality.report(docs, train).join(test, "doc_id").collect()
    right = sum(r["keep"] == (r["quality"] == 1 and r["toxic"] == 0) for r in got)
    assert right / len(got) > 0.9, right / len(got)


def test_fit_equals_the_fit_of_the_same_rows_on_the_driver(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    lab: dict[int, list[int]] = {}
    for r in labels.collect():
        q, t = lab.get(r["doc_id"], (1, 0))
        lab[r["doc_id"]] = [min(q, r["quality"]), max(t, r["toxic"])]
    ids = sorted((i for i in lab if text.get(i)), key=str)
    want = quality.fit_rows([text[i] for i in ids], [lab[i][0] for i in ids], [lab[i][1] for i in ids])
    got = quality.fit(docs, labels)
    assert got.prior == want.prior and np.allclose(got.weights, want.weights, atol=1e-6)
    for a, b in zip(got.lexicons, want.lexicons, strict=True):
        assert (a.hashes == b.hashes).all() and np.allclose(a.weights, b.weights)
    assert any(len(a.hashes) for a in got.lexicons)
    # and the registered query gives each document this model's evidence
    rows = {r["doc_id"]: r["evidence"] for r in queries.op5_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    for i, x in text.items():
        assert rows[i] == pytest.approx(float(want.evidence(pa.array([x]))[0]), abs=1e-4)


def test_a_long_text_is_scored_whole():
    lex = quality.Lexicon(np.sort(Words(pa.array(["rare"])).hash), np.array([2.0]))
    text = "a common word " * 300_000
    x = quality.looks(pa.array([text + "rare rare", "rare", None, ""]), [lex])
    assert x[0, -1] == pytest.approx(np.log1p(4)) and x[1, -1] == pytest.approx(np.log1p(2)) and not x[2:].any()
    assert x[0, 7] == pytest.approx(np.log(900_002))


def test_a_labelled_text_with_very_many_copies_is_drawn_once(spark):
    docs = fx.docs(spark, *["same text here"] * 50).withColumn("doc_id", F.lit(1).cast("long"))
    sample = quality.training_sample(docs, spark.createDataFrame([(1, 1, 0)], LABELS)).collect()
    assert [(r["id"], r["text"]) for r in sample] == [(1, "same text here")]


def test_posterior_is_evidence_plus_site(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.report(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        p = min(max(r["path_rate"], 1e-6), 1 - 1e-6)
        assert r["posterior"] == pytest.approx(1 / (1 + math.exp(-(r["evidence"] + math.log(p / (1 - p))))), abs=1e-9)
        assert r["keep"] == (r["posterior"] >= quality.THRESHOLD)


def test_awkward_rows(spark):
    df = fx.awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (4, 0, 1), (5, None, None), (None, 1, 0), (99, 1, 0)], LABELS)
    got = quality.report(df, labels)
    assert got.count() == df.count()
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[2]["evidence"] == 0 and by[3]["evidence"] == 0 and by[3]["host"] == "" and by[5]["host"] == "h.example" and by[5]["path"] == "p"
    none = quality.report(df, spark.createDataFrame([], LABELS)).collect()
    assert all(r["evidence"] == 0 and r["keep"] for r in none)
    assert quality.report(fx.empty(spark), labels).count() == 0
    assert quality.classify(df, labels).where("__wl_keep").select(*df.columns).columns == df.columns

"""The corpus pipeline against each stage's decisions made one by one on the driver."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

import __spark_entry__
import corpus_pipeline
from tests.llm import fixtures as fx
from tests.llm.test_decontam import brute as brute_matches
from tests.llm.test_simhash import brute as brute_near
from weftline.llm import bpe, decontam, quality, secretscan
from weftline.llm.common import Words


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower()) if text.isascii() else [bytes(w.buf[a:b]).decode() for w in [Words(pa.array([text]))] for a, b in zip(w.start, w.end)]


def test_run_equals_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    good = {r["doc_id"] for r in quality.report(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("posterior >= 0.5").collect()}
    kept = sorted(((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good))
    text = {i: " ".join(words(t)) for i, t in kept}
    ids = [i for i, _ in kept if text[i]]
    _, root = brute_near([text[i] for i in ids])
    alone = [i for k, i in enumerate(ids) if root[k] == k] + [i for i, _ in kept if not text[i]]
    items = [words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = []
    for i in alone:
        doc = text[i].split()
        have = set(doc)
        worth = [x for x in items if len(have & set(x)) >= 0.5 * decontam.needed(len(set(x)), decontam.SHARE)]
        if not any(brute_matches(doc, x, decontam.SHARE, decontam.SLOP) for x in worth):
            clean.append(i)
    assert sorted(got) == sorted(clean)
    raw = dict(kept)
    grammar = secretscan.fit(pairs=secretscan.document_pairs(docs.where(docs["doc_id"].isin(clean))))
    for i in clean:
        row, start, end, fmt, _ = secretscan.findings(grammar, pa.array([raw[i]]))
        b = raw[i].encode()
        for s, e, f in sorted(zip(start, end, fmt), reverse=True):
            b = b[:s] + f"[SECRET:{grammar.automata[f].name}]".encode() + b[e:]
        assert bpe.decode_raw(np.array(got[i]["token_ids"])) == b and got[i]["n_chars"] == len(b.decode())


def test_stages_take_awkward_tables(spark, sf):
    for df in (fx.awkward(spark), fx.empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, sf)
            assert out.columns == df.columns
            out.count()
        corpus_pipeline.STAGES[-1][1](spark, df, sf).count()


def test_run_takes_an_awkward_table(spark, sf, tmp_path):
    """Nulls, empty and very long texts, repeated rows: what run() keeps of them, and how often."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").where("false").write.parquet(str(tmp_path / "a" / f"{name}.parquet"))
    fx.awkward(spark).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path / "a")).collect()
    # without labels all are kept; of the four rows of the same prose, one; the longer one differs by more words than near copies do or is one of them
    ids = sorted((r["doc_id"] for r in rows), key=str)
    assert [ids.count(i) for i in (1, 2, 3, 4, 5, 6)] == [1, 1, 1, 0, 1, 1] and len(rows) in (6, 7)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[3]["token_ids"] is None and by[2]["token_ids"] == [] and by[5]["n_tokens"] > 100_000 and all(r["exact"] for r in rows if r["token_ids"] is not None)
    fx.empty(spark).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(str(tmp_path / "b" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0


def test_registered():
    names = list(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "secret scans", "byte-level BPE"]

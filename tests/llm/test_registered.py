"""The registered queries over the test tables, each row against brute force."""

from __future__ import annotations

import tiktoken

from tests.llm.test_decontam import brute as brute_matches
from tests.llm.test_pipeline import words
from tests.llm.test_simhash import brute as brute_near
from weftline.llm import bpe, decontam, htmltext, licenses, queries


def test_op2_every_match(spark, sf):
    docs = {r["doc_id"]: words(r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(r["item_id"], words(r["text"] or "")) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = []
    for d, doc in docs.items():
        have = set(doc)
        for i, item in items:
            if len(have & set(item)) >= 0.5 * decontam.needed(len(set(item)), decontam.SHARE):
                want += [(d, i, *m) for m in brute_matches(doc, item, decontam.SHARE, decontam.SLOP)]
    got = [tuple(r) for r in queries.op2_decontamination(spark, sf).collect()]
    assert sorted(got) == sorted(want) and got


def test_op6_every_token(spark, sf):
    enc = bpe.coder(bpe.RANKS)[0]
    assert isinstance(enc, tiktoken.Encoding)
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op6_byte_bpe(spark, sf).collect():
        t = text.pop(r["doc_id"])
        assert r["token_ids"] == (None if t is None else enc.encode_ordinary(t))
        assert t is None or (r["n_bytes"], r["n_tokens"], r["exact"]) == (len(t.encode()), len(r["token_ids"]), True)
    assert not text


def test_op7_every_whole_notice(spark, sf):
    """Every notice that a text holds word for word is found, or a longer one over it; and whatever is found has the coverage it says."""
    text = {r["doc_id"]: words(r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    notices = [words(t) for _, t in licenses.TEMPLATES]
    spans: dict[int, list] = {}
    for r in queries.op7_license_scan(spark, sf).collect():
        spans.setdefault(r["doc_id"], []).append(r)
        doc, notice = text[r["doc_id"]][r["start"] : r["end"]], notices[r["template"]]
        row = [0] * (len(notice) + 1)
        for w in doc:
            new = [0]
            for j, v in enumerate(notice):
                new.append(row[j] + 1 if w == v else max(row[j + 1], new[j]))
            row = new
        assert abs(row[-1] / len(notice) - r["coverage"]) < 1e-5 and r["coverage"] >= licenses.COVERAGE and len(doc) <= licenses.SLACK * len(notice) + 1
    for d, doc in text.items():
        for notice in notices:
            for i in range(len(doc) - len(notice) + 1):
                if len(notice) >= licenses.K and doc[i : i + len(notice)] == notice:
                    assert any(s["start"] < i + len(notice) and s["end"] > i for s in spans.get(d, [])), (d, i)


def test_op9_every_group(spark, sf):
    rows = [(r["doc_id"], " ".join(words(r["text"] or ""))) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    ids = sorted(i for i, t in rows if t)
    text = dict(rows)
    near, root = brute_near([text[i] for i in ids])
    groups: dict[int, list[int]] = {}
    for k, r in enumerate(root):
        groups.setdefault(ids[r], []).append(ids[k])
    got: dict[int, list[int]] = {}
    for r in queries.op9_simhash_groups(spark, sf).collect():
        got.setdefault(r["group_id"], []).append(r["doc_id"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in groups.items() if len(v) > 1} and near


def test_op10_every_page(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op10_html_extraction(spark, sf).collect():
        p = htmltext.extract_one(pages.pop(r["page_id"]))
        assert (r["title"], r["text"], r["tag"], r["n_chars"]) == (p.title, p.text, p.tag, len(p.text))
    assert not pages

"""op7: votes and spans counted in plain Python, and templates planted whole and changed."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from tests.llm import fixtures as fx
from weftline.llm import licenses as li


def text(words: list[str]) -> str:
    return " ".join(words)


def test_spans_equal_plain_python(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(6)]
    templates = [(f"t{i}", text([rng.choice(vocab) for _ in range(rng.randint(6, 15))])) for i in range(4)]
    docs = [[rng.choice(vocab) for _ in range(rng.randint(0, 80))] for _ in range(40)]
    df = fx.docs(spark, *map(text, docs), first=0)
    runs = li.template_runs(spark, templates)
    got = {(r["doc_id"], r["template"], r["votes"], r["lo"], r["hi"]) for r in li.spans(li.document_runs(df, "doc_id", "text").join(runs, "run"), "doc_id").collect()}
    want = set()
    for d, doc in enumerate(docs):
        for t, (_, tt) in enumerate(templates):
            words = tt.split()
            diagonal: dict[int, set[int]] = {}
            for p in range(len(doc) - li.K + 1):
                for a in range(len(words) - li.K + 1):
                    if doc[p : p + li.K] == words[a : a + li.K]:
                        diagonal.setdefault(p - a, set()).add(p)
            span: list[list[int]] = []
            for g in sorted(diagonal):
                if span and g - span[-1][-1] <= li.GAP:
                    span[-1].append(g)
                else:
                    span.append([g])
            for s in span:
                every = [p for g in s for p in diagonal[g]]
                want.add((d, t, sum(len(diagonal[g]) for g in s), min(every), max(every)))
    assert got == want and len(want) > 20


def plain_lcs(a: list[int], b: list[int]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_alignment_equals_plain_python():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(0, 25)), rng.integers(0, 6, rng.integers(1, 12))
        got, first, last = li.aligned(a, b)
        assert got == plain_lcs(list(a), list(b)) == plain_lcs(list(a[first:last]), list(b))


def test_planted_templates(spark):
    rng = random.Random(9)
    prose = fx.PROSE.split()
    docs, want = [], []
    for i, (name, t) in enumerate(li.TEMPLATES):
        words = t.split()
        changed = list(words)
        if len(words) >= 12:
            changed[len(words) // 2] = "else"
            del changed[3]
        at = rng.randint(0, 20)
        docs.append(text(prose[:at] + changed + prose[at:]))
        want.append(name)
    docs += [fx.PROSE, "license version conditions under the of any kind software"]
    got = Counter((r["doc_id"], r["license"]) for r in li.scan(fx.docs(spark, *docs, first=0)).collect())
    assert all(got[(i, n)] >= 1 for i, n in enumerate(want)), [n for i, n in enumerate(want) if not got[(i, n)]]
    assert not any(d >= len(want) for d, _ in got)


def test_stretches_equal_plain_python():
    rng = np.random.default_rng(6)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(0, 25)), rng.integers(0, 6, rng.integers(1, 9))
        need, most = max(1, len(b) // 2), int(1.3 * len(b) + 1)
        best = {(i, j): plain_lcs(list(a[i:j]), list(b)) for i in range(len(a)) for j in range(i, min(len(a), i + most) + 1)}
        want = {(g, i, j) for (i, j), g in best.items() if j > i and a[i] in b and g >= need and g > best[i, j - 1]}
        got = li.stretches(a, b, need, most)
        assert len(got) == len(set(got)) and set(got) == want


def test_cut_notice_before_words_of_the_same_template(spark):
    words = max((t for n, t in li.TEMPLATES if n == "MIT"), key=lambda t: len(t.split())).split()
    n = len(li.hash_words(text(words)))
    cut = words[:-5]
    docs = [text(cut + ["filler"] * 3 + words[-5:] + ["filler"] * 12 + words[-5:]), text(cut + words), text(fx.PROSE.split() + cut + words[-9:] * 5)]
    got = {(r["doc_id"], r["start"], r["end"]) for r in li.scan(fx.docs(spark, *docs, first=0), templates=[("MIT", text(words))]).collect()}
    assert {d for d, _, _ in got} == {0, 1, 2}
    assert {(1, 0, n - 5), (1, n - 5, 2 * n - 5)} <= got
    # the missing words come again too far on for one stretch: what is there stays a match
    far = cut + ["filler"] * n + words[-5:]
    assert [(r["start"], r["end"]) for r in li.scan(fx.docs(spark, text(far)), templates=[("MIT", text(words))]).collect()] == [(0, n - 5)]


def test_awkward_rows(spark):
    mit = "Released under the MIT License"
    df = fx.awkward(spark).unionByName(fx.docs(spark, f"{mit}. {fx.PROSE} {mit}", first=70)).unionByName(fx.docs(spark, *[mit] * 1, first=71)).unionByName(fx.docs(spark, mit, first=71))
    got = li.scan(df)
    assert sorted((r["doc_id"], r["license"], r["start"], r["end"]) for r in got.collect()) == [(70, "MIT", 0, 5), (70, "MIT", 29, 34), (71, "MIT", 0, 5), (71, "MIT", 0, 5)]
    assert li.scan(fx.empty(spark)).count() == 0
    assert li.scan(df, templates=[("short", "two words")]).count() == 0


def test_whole_license_texts_are_named_over_the_notices_in_them(spark):
    names = [n for n, _ in li.TEXTS]
    df = fx.docs(spark, *[f"Copyright (c) 2020 Some One\n\n{t}\n\nint main() {{}}" for _, t in li.TEXTS], first=0)
    rows = li.scan(df).collect()
    best = {}
    for r in rows:
        best.setdefault(r["doc_id"], []).append((r["end"] - r["start"], r["license"], r["coverage"]))
    assert [max(best[i])[1:] for i in range(len(names))] == [(n, 1.0) for n in names]


def test_of_equal_templates_the_first_is_named(spark):
    twice = [("one", "some words that are the license of this work"), ("two", "some words that are the license of this work")]
    rows = li.scan(fx.docs(spark, "here are some words that are the license of this work indeed"), twice).collect()
    assert [(r["license"], r["template"]) for r in rows] == [("one", 0)]

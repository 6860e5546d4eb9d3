"""op2: against every window of every document looked at."""

from __future__ import annotations

import datetime
import random
from collections import Counter
from decimal import Decimal

import numpy as np
import pyarrow as pa

from tests.llm import fixtures as fx
from weftline.llm import decontam
from weftline.llm.common import Words, hash_words


def brute(doc: list[str], item: list[str], share: float, slop: int) -> list[tuple]:
    """(exact, matched, words, position) of all matches, by looking at every diagonal."""
    n = len(item)
    if not n or not doc:
        return []
    need, width = decontam.needed(n, share), min(slop, n)
    on = {d: here for d in range(-n, len(doc)) if (here := {s for s in range(n) if 0 <= d + s < len(doc) and doc[d + s] == item[s]})}
    got = {d: len(set().union(*(on.get(x, set()) for x in range(d, d + width + 1)))) for d in on}
    out, start = [], -n
    while True:
        first = next((d for d in sorted(on) if d >= start and got[d] >= need), None)
        if first is None:
            return out
        near = [d for d in sorted(on) if first <= d < first + n]
        line = next((d for d in near if len(on[d]) == n), None)
        at = line if line is not None else max(near, key=lambda d: (got[d], -d))
        out.append((line is not None, n if line is not None else got[at], n, at))
        start = at + n


def case(seed: int) -> tuple[list[list[str]], list[list[str]]]:
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    items = [[rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 7, 10, 20, 40]))] for _ in range(25)]
    out = []
    for _ in range(60):
        d = [rng.choice(vocab) for _ in range(rng.randint(0, 90))]
        twice = rng.choice(items)
        for _ in range(rng.choice([0, 1, 2, 4])):
            x = list(rng.choice([twice, rng.choice(items)]))
            for _ in range(rng.choice([0, 0, 1, 3, 6])):
                k = rng.randrange(len(x))
                kind = rng.random()
                x[k : k + (kind < 0.6)] = [] if kind < 0.3 else [rng.choice(vocab)]
                x = x or ["w1"]
            at = rng.randint(0, len(d))
            d[at:at] = x
        out.append(d)
    return out, items


def test_matches_equal_brute_force(spark):
    for seed in (1, 2):
        texts, items = case(seed)
        df = fx.docs(spark, *map(" ".join, texts), first=0)
        bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
        got = sorted((r["doc_id"], r["item_id"], r["exact"], r["matched"], r["words"], r["position"]) for r in decontam.matches(df, bench).collect())
        want = sorted((d, i, *m) for d, doc in enumerate(texts) for i, item in enumerate(items) for m in brute(doc, item, decontam.SHARE, decontam.SLOP))
        assert got == want
        assert any(m[2] for m in want) and any(not m[2] and m[4] < 8 for m in want)  # short items in proximity too
        assert max(Counter(m[:2] for m in want).values()) > 1
        kept = {r["doc_id"] for r in decontam.decontaminate(df, bench).collect()}
        assert kept == set(range(len(texts))) - {m[0] for m in want}


def test_item_ids_of_any_type(spark):
    df = fx.docs(spark, fx.PROSE)
    for kind, value in (("int", 7), ("smallint", 7), ("string", "x"), ("date", datetime.date(2024, 1, 1)), ("decimal(9,2)", Decimal("1.50"))):
        bench = spark.createDataFrame([(value, "lazy dog while seven patient herons")], f"item_id {kind}, text string")
        assert [(r["item_id"], r["exact"]) for r in decontam.matches(df, bench).collect()] == [(value, True)]


def test_a_very_long_text(spark):
    """64 MB, indexed whole: an item at its end, one across what the kernels take at a time."""
    unit = " ".join(f"w{i}" for i in range(9000)) + " "
    text = unit * ((64 << 20) // len(unit)) + "here is the planted item at last"
    words = Words(pa.array([text]))
    assert words.hash[-7:].tolist() == hash_words("here is the planted item at last").tolist()
    seg = decontam.Segment.of(words.hash, words.count())
    first = np.concatenate([[0], np.cumsum([7, 5])])
    items = decontam.Items(pa.array([1, 2]), np.concatenate([hash_words("here is the planted item at last"), hash_words("w8998 w8999 w0 w1 w2")]), first)
    got = list(decontam.lookup(seg, items))
    assert [x for x in got if x[0] == 0] == [(0, 0, True, 7, 7, len(words) - 7)]
    assert [x[5] for x in got if x[0] == 1] == list(range(8998, len(words) - 9000, 9000))


def test_segments_and_passes_do_not_change_the_result(spark):
    texts, items = case(3)
    df = fx.docs(spark, *map(" ".join, texts), first=0)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    once = sorted(map(tuple, decontam.matches(df, bench).collect()))
    index = decontam.build_index(df, segment_bytes=500)
    assert index.count() > 5
    many = decontam.search(index, bench, df.schema["doc_id"].dataType, a_pass=4).drop("__wl_key")
    assert sorted(map(tuple, many.collect())) == once


def test_awkward_rows(spark):
    df = fx.awkward(spark)
    bench = spark.createDataFrame([(1, fx.PROSE), (1, fx.PROSE), (2, ""), (3, None), (None, "word17 stays17")], "item_id long, text string")
    got = decontam.matches(df, bench)
    assert got.columns == ["doc_id", "item_id", "exact", "matched", "words", "position"]
    found = sorted(((r["doc_id"], r["item_id"]) for r in got.collect()), key=str)
    assert found.count((4, 1)) == 4 and found.count((1, 1)) == 2 and found.count((5, None)) == 1 and found.count((None, 1)) == 2
    kept = decontam.decontaminate(df, bench)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([2, 3, 6, None], key=str)
    assert decontam.matches(fx.empty(spark), bench).count() == 0
    assert decontam.decontaminate(df, bench.where("item_id = 9")).count() == df.count()

"""op9: against all pairs compared one by one."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import fixtures as fx
from weftline.llm import simhash
from weftline.llm.common import Words


def corpus(n: int = 150, seed: int = 5) -> list[str]:
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 200))]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            out.append(" ".join(copy))
    return out


def plain_fingerprint(text: str) -> int:
    """Bit by bit, the way SimHash is defined: different words, each weighing the root of its count."""
    count = Counter(Words(pa.array([text])).hash.tolist())
    pairs = [(int(simhash.mix(np.array([w], np.uint64))[0]), round(2 * math.sqrt(c))) for w, c in count.items()]
    total = sum(c for _, c in pairs)
    halves = []
    for k in range(2):
        vals = pairs if k == 0 else [(int(simhash.mix(np.array([p], np.uint64) ^ np.uint64(0xD6E8FEB86659FD93))[0]), c) for p, c in pairs]
        halves.append(sum((2 * sum(c for v, c in vals if v >> b & 1) > total) << b for b in range(64)))
    return halves[0] << 64 | halves[1]


def brute(texts: list[str]) -> tuple[set, list[int]]:
    fps = [plain_fingerprint(t) for t in texts]
    near = {(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= simhash.RADIUS}
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in near:
        a, b = find(i), find(j)
        up[max(a, b)] = min(a, b)
    return near, [find(i) for i in range(len(fps))]


WAYS = [{}, {"shard": 8}, {"blocks_from": 0}, {"blocks_from": 0, "shard": 3}]  # one shard, many; pigeonhole, with values that are cut


def test_fingerprints_are_majorities():
    texts = corpus(10)
    got = simhash.fingerprints(Words(pa.array(texts)))
    assert [int(a) << 64 | int(b) for a, b in got] == [plain_fingerprint(t) for t in texts]


def members(df, **ways) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for r in simhash.groups(df, **ways).collect():
        out.setdefault(r["group_id"], []).append(r["doc_id"])
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("ways", WAYS, ids=str)
def test_pairs_and_groups_match_brute_force(spark, ways):
    texts = corpus()
    near, root = brute(texts)
    df = fx.docs(spark, *texts, first=0)
    table = simhash.fingerprint_table(df)
    where = {}
    for r in table.collect():
        where.setdefault((r["hi"], r["lo"]), []).append(r["doc_id"])
    rows = simhash.pairs(table, **ways).collect()
    found = [tuple((r[f"hi_{s}"], r[f"lo_{s}"]) for s in "ab") for r in rows]
    assert len(found) == len({frozenset(p) for p in found})
    got = {(max(i, j), min(i, j)) for a, b in found for i in where[a] for j in where[b]} | {(max(i, j), min(i, j)) for ids in where.values() for i in ids for j in ids if i != j}
    assert got == near
    full = lambda x: (x[0] & (2**64 - 1)) << 64 | (x[1] & (2**64 - 1))
    assert all(r["distance"] == (full(a) ^ full(b)).bit_count() for r, (a, b) in zip(rows, found))
    expected = {}
    for i, r in enumerate(root):
        expected.setdefault(r, []).append(i)
    assert members(df, **ways) == {k: v for k, v in expected.items() if len(v) > 1}
    fp = {i: k for k, ids in where.items() for i in ids}
    links = {i: len({fp[b if i == a else a] for a, b in near if i in (a, b)} - {fp[i]}) for i in fp}
    for r in simhash.groups(df, **ways).collect():
        assert (r["n_links"], r["n_copies"]) == (links[r["doc_id"]], len(where[fp[r["doc_id"]]]))
    kept = sorted(r["doc_id"] for r in simhash.deduplicate(df, **ways).collect())
    assert kept == sorted(expected)


@pytest.mark.parametrize("ways", WAYS[:3], ids=str)
def test_lengths_do_not_separate_near_fingerprints(spark, ways):
    texts = corpus(40, seed=8)
    for t in texts[:12]:
        words = t.split()
        texts += [" ".join(words[: int(len(words) * 0.8)]), " ".join([*words, *words])]  # cut by a fifth; the text twice
    _, root = brute(texts)
    want = {r: [i for i, x in enumerate(root) if x == r] for r in root if root.count(r) > 1}
    assert all(root[j] == root[i] for i in range(12) for j in [len(texts) - 23 + 2 * i])  # the doubled ones
    df = fx.docs(spark, *texts, first=0)
    assert members(df, **ways) == want
    assert {r["doc_id"] for r in simhash.deduplicate(df, **ways).collect()} == set(root)


def test_trees_and_shards_leave_out_what_is_out_of_reach(spark, monkeypatch):
    """Of clustered fingerprints most pairs are never compared, and nothing is lost; shards stay small."""
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, (6, 2), dtype=np.uint64) * np.uint64(2)
    fps = np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, (1500, 2), dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, (1500, 2), dtype=np.uint64)) for c in centres])
    fps = np.unique(fps, axis=0)
    compared = 0
    count = np.bitwise_count

    def counting(x, **out):
        nonlocal compared
        compared += x.size if x.ndim == 2 and min(x.shape) > 1 else 0  # blocks of pairs, not distances to a vantage point
        return count(x, **out)

    monkeypatch.setattr(np, "bitwise_count", counting)
    pairs = sum(len(a) for a, _, _ in simhash.shard_pairs(fps, fps, True, 3))
    monkeypatch.undo()
    want = sum(int((simhash.hamming(fps[i : i + 256], fps) <= 3).sum()) for i in range(0, len(fps), 256))
    assert pairs == (want - len(fps)) // 2
    assert 0 < compared < 0.5 * len(fps) ** 2 / 2  # under half of all pairs
    table = spark.createDataFrame([tuple(map(int, r)) for r in fps.view(np.int64)], "hi long, lo long")
    met = simhash._in_shards(table, len(fps), 3, 500)
    sizes = [r["n"] for r in met.where("at = s").groupBy("s", "t").agg(F.count("*").alias("n")).collect()]
    shards = -(-len(fps) // 500)
    assert max(sizes) < 1000 and len(sizes) < 0.85 * shards * (shards + 1) / 2
    # and evenly spread ones, by pigeonhole: a random pair hardly ever meets
    spread = rng.integers(0, 1 << 63, (400, 2), dtype=np.uint64)
    table = spark.createDataFrame([tuple(map(int, r)) for r in spread.view(np.int64)], "hi long, lo long")
    cells = simhash._in_blocks(table, 400, 10**6).groupBy("k", "v").count().where("count > 1").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0] or 0
    assert cells < 0.05 * 400 * 399 / 2


def spread_and_near(n: int, seed: int) -> np.ndarray:
    """Evenly spread fingerprints, and for every twentieth others that differ from it in 1 to 25 bits."""
    rng = np.random.default_rng(seed)
    fps = rng.integers(0, 1 << 64, (n, 2), dtype=np.uint64)
    near = fps[::20].copy()
    for i, row in enumerate(near):
        for b in rng.choice(128, 1 + i % 25, replace=False):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    return rng.permutation(np.unique(np.concatenate([fps, near]), axis=0))


def all_pairs(query: np.ndarray, data: np.ndarray, radius: int) -> set[tuple[int, int, int]]:
    found = []
    for i in range(0, len(query), 256):
        d = simhash.hamming(query[i : i + 256], data)
        a, b = np.nonzero(d <= radius)
        found += zip((a + i).tolist(), b.tolist(), d[a, b].tolist())
    return set(found)


def test_evenly_spread_fingerprints_are_looked_up(monkeypatch):
    """Most pairs of a large shard are never compared, though no vantage point separates them; every near pair is found, once."""
    fps = spread_and_near(6000, 3)
    compared = 0
    count = np.bitwise_count

    def counting(x, **out):
        nonlocal compared
        compared += x.size
        return count(x, **out)

    none = np.zeros(len(fps), np.int64)
    monkeypatch.setattr(np, "bitwise_count", counting)
    got = [(max(x), min(x), int(z)) for a, b, d in simhash._near(fps, none, none, none, none, simhash.RADIUS) for *x, z in zip(a.tolist(), b.tolist(), d)]
    monkeypatch.undo()
    assert len(got) == len(set(got)) and set(got) == {(a, b, d) for a, b, d in all_pairs(fps, fps, simhash.RADIUS) if a > b}
    assert len(got) > 200 and compared < 0.1 * len(fps) ** 2 / 2


@pytest.mark.parametrize("radius", [0, 3, 18, 21])
@pytest.mark.parametrize("n", [6, 9, 12])
def test_every_index_finds_all_pairs_once(monkeypatch, n, radius):
    monkeypatch.setattr(simhash, "MET_AT_ONCE", 50)  # values that more share are compared in pieces
    fps = spread_and_near(500, 4)
    fps = np.concatenate([fps, fps[:1] ^ np.arange(1, 200, dtype=np.uint64)[:, None] * np.array([[0, 1 << 30]], np.uint64)])  # many share all blocks but two
    other = np.concatenate([fps[::3], spread_and_near(100, 5)])
    for query, own in ((fps, True), (other, False)):
        got = [(*x, z) for a, b, d in simhash.indexed_pairs(query, fps, own, radius, n) for *x, z in zip(a.tolist(), b.tolist(), d.tolist())]
        want = all_pairs(query, fps, radius)
        if own:
            got, want = [(max(a, b), min(a, b), d) for a, b, d in got], {(a, b, d) for a, b, d in want if a > b}
        assert len(got) == len(set(got)) and set(got) == want


def test_an_index_is_left_where_it_compares_more():
    rng = np.random.default_rng(6)
    alike = np.unique(np.uint64(1) << rng.integers(0, 64, (4000, 2), dtype=np.uint64), axis=0)
    assert simhash.cheapest_index(alike, alike, True, simhash.RADIUS) == 0
    assert simhash.cheapest_index(fps := spread_and_near(6000, 3), fps, True, simhash.RADIUS) in simhash._CUTS
    assert simhash.cheapest_index(fps, fps, True, 60) == 0


def test_a_task_has_one_pair_of_shards_and_looks_it_up(spark):
    fps = spread_and_near(10_000, 7)
    table = spark.createDataFrame([tuple(map(int, r)) for r in fps.view(np.int64)], "hi long, lo long")
    met = simhash._in_shards(table, len(fps), simhash.RADIUS, 5500)
    tasks = met.groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("s", "t").alias("n"), F.count("*").alias("rows")).collect()
    assert [r["n"] for r in tasks] == [1, 1, 1] and min(r["rows"] for r in tasks) ** 2 >= simhash.INDEX_FROM
    rows = simhash.pairs(table, shard=5500).collect()
    at = {tuple(map(int, r)): i for i, r in enumerate(fps.view(np.int64))}
    got = [(at[r["hi_a"], r["lo_a"]], at[r["hi_b"], r["lo_b"]], r["distance"]) for r in rows]
    got = [(max(a, b), min(a, b), d) for a, b, d in got]
    assert len(got) == len(set(got)) and set(got) == {(a, b, d) for a, b, d in all_pairs(fps, fps, simhash.RADIUS) if a > b}


def test_large_group_of_copies_and_chain(spark):
    base = corpus(1)[0]
    df = fx.docs(spark, *[base] * 3000, "something else entirely that has words of its own")
    assert {(r["group_id"], r["n_copies"], r["n_links"]) for r in simhash.groups(df).collect()} == {(1, 3000, 0)} and simhash.groups(df).count() == 3000
    assert sorted(r["doc_id"] for r in simhash.deduplicate(df).collect()) == [1, 3001]


def test_awkward_rows(spark):
    df = fx.awkward(spark)
    got = simhash.deduplicate(df)
    assert got.columns == df.columns
    ids = sorted((r["doc_id"] for r in got.collect()), key=str)
    assert ids.count(4) == 0 and ids.count(1) == 1  # copies of 1
    assert {2, 3, 5, 6} <= set(ids)  # no words: no fingerprint, so they stay
    assert simhash.groups(fx.empty(spark)).count() == 0 and simhash.deduplicate(fx.empty(spark)).count() == 0


def test_copies_without_words_are_a_group(spark):
    df = fx.docs(spark, "*** --- ***", "some words", "*** --- ***", "*** --- **", "", "", None, None)
    assert sorted((r["doc_id"], r["group_id"], r["n_copies"]) for r in simhash.groups(df).collect()) == [(1, 1, 2), (3, 1, 2)]
    assert sorted(r["doc_id"] for r in simhash.deduplicate(df).collect()) == [1, 2, 4, 5, 6, 7, 8]

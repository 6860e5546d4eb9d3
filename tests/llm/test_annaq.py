"""op4: against exact search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import annaq, queries

SCHEMA = "vec_id long, embedding array<float>, label int, id string, x int, code string, norm double, q int, d int"


def exact(ids: list[int], x: np.ndarray, k: int) -> dict[int, list[int]]:
    out = {}
    for i in range(len(x)):
        d = ((x.astype(np.float32) - x[i].astype(np.float32)).astype(np.float64) ** 2).sum(axis=1)
        d[i] = np.inf
        out[ids[i]] = [ids[j] for j in sorted(range(len(x)), key=lambda j: (d[j], ids[j]))[:k] if j != i]
    return out


def test_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = table.collect()
    want = exact([r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows]), 10)
    got: dict[int, list] = {}
    for r in annaq.neighbours(table, rerank=64, data_block=250, a_pass=200).collect():
        got.setdefault(r["vec_id"], []).append(r["neighbour_id"])
    hits = sum(len(set(got[i]) & set(w)) for i, w in want.items())
    assert got.keys() == want.keys() and hits / sum(map(len, want.values())) >= 0.9
    for r in annaq.neighbours(table, words=16, books=4, rerank=10**6).where("vec_id < 20").groupBy("vec_id").agg({"neighbour_id": "collect_list"}).collect():
        assert set(r[1]) == set(want[r[0]])  # with all candidates ranked again it is exact search


def test_registered_query_against_exact_search(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], np.float32)
    got: dict[int, list] = {}
    for r in sorted(queries.op4_nearest_neighbours(spark, "/root/testdata/sf0.1").collect(), key=lambda r: (r["vec_id"], r["rank"])):
        got.setdefault(r["vec_id"], []).append((r["neighbour_id"], r["distance"]))
    assert got.keys() == {i for i in ids if i % 50 == 0}
    hits = 0
    for i, found in got.items():
        d = ((x - x[ids.index(i)]).astype(np.float64) ** 2).sum(axis=1)
        best = [ids[j] for j in np.argsort(d, kind="stable") if ids[j] != i][:10]
        hits += len({f for f, _ in found} & set(best))
        assert len(found) == 10 and all(np.isclose(dist, d[ids.index(f)]) for f, dist in found)
    assert hits / (10 * len(got)) >= 0.9, hits / (10 * len(got))


def test_lists_out_of_reach_are_left_out_and_nothing_is_lost(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 20
    x = np.round(centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)), 4).astype(np.float32)
    books = annaq.seed_books(x, 2, 32)
    codes = books.encode(x)
    radius = np.array([np.sqrt(((x[codes[:, 0] == w] - books.words[0][w]) ** 2).sum(axis=1)).max() if (codes[:, 0] == w).any() else 0 for w in range(32)])
    ids = np.arange(3000)
    table = pa.table({"id": ids, "x": list(x), "bound": annaq.bounds(x, ids, books, ids[:1000], x[:1000], 10)})
    asked = annaq.Queries.of(table, books)
    may = annaq.alive(asked, np.arange(32), radius)
    assert may.mean() < 0.25
    for q in range(0, 3000, 60):
        d = ((x - asked.x[q]) ** 2).sum(axis=1)
        d[asked.keys[q]] = np.inf
        assert may[q, codes[np.argsort(d)[:10], 0]].all()
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    want = exact(list(range(3000)), x, 10)
    got: dict[int, set] = {}
    for r in annaq.neighbours(df, books=2, words=32, rerank=3000, sample_rows=1000).collect():
        got.setdefault(r["vec_id"], set()).add(r["neighbour_id"])
    assert got == {i: set(w) for i, w in want.items()}


def test_codes_and_scores():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 12)).astype(np.float32)
    books = annaq.seed_books(x, books=4, words=16)
    err = lambda beam: float(((x - books.decode(books.encode(x, beam))) ** 2).sum())
    assert err(8) <= err(1) < float((x**2).sum())
    codes = books.encode(x)
    y, q = books.decode(codes), x[:5]
    s = books.scores(q, codes, books.norms(codes))
    plain = -0.5 * ((y[:, None] - q[None]) ** 2).sum(axis=2) + 0.5 * (q**2).sum(axis=1)
    assert np.allclose(s, plain, atol=1e-3)


def test_awkward_rows(spark):
    row = lambda i, v: (i, v, 0, "i", 1, "c", 0.0, 1, 1)
    nan, inf = float("nan"), float("inf")
    table = spark.createDataFrame([row(1, [0.0, 0.0]), row(2, [1.0, 0.0]), row(3, [0.0, 1.0]), row(3, [0.0, 1.0]), row(4, [5.0, 5.0]), row(5, None), row(6, []), row(7, [1.0]), row(8, [nan, 0.0]), row(9, [inf, 0.0]), row(None, [0.0, 0.0]), row(10, [None, 1.0]), (None,) * 9], SCHEMA)
    got = {}
    for r in annaq.neighbours(table, k=2).orderBy("vec_id", "rank").collect():
        got.setdefault(r["vec_id"], []).append((r["neighbour_id"], r["distance"], r["rank"]))
    assert got == {1: [(2, 1.0, 1), (3, 1.0, 2)], 2: [(1, 1.0, 1), (3, 2.0, 2)], 3: [(1, 1.0, 1), (2, 2.0, 2)], 4: [(2, 41.0, 1), (3, 41.0, 2)]}
    assert annaq.neighbours(table.where("vec_id = 1")).count() == 0
    none = annaq.neighbours(table.where("false"))
    assert none.count() == 0 and none.columns == ["vec_id", "neighbour_id", "distance", "rank"]


@pytest.mark.parametrize("n", [1, 3])
def test_fewer_rows_than_codewords(n):
    books = annaq.seed_books(np.eye(3, dtype=np.float32)[:n])
    assert np.allclose(books.decode(books.encode(np.eye(3, dtype=np.float32)[:n])), np.eye(3)[:n], atol=1e-4)

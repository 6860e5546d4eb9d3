"""op8: exact round trips at every split size, and files that aren't as they should be."""

from __future__ import annotations

import gzip
import os
import time

import duckdb
import pyarrow as pa
import pytest

from weftline.llm import queries, warc

PAGES = "page_id long, url string, html string, path string, type string, offset long, payload binary"


def page(i, url, html):
    return i, url, html, "p", "t", 1, b"x"


@pytest.mark.parametrize("split", [1, 50, 257, 10_000, 64 << 20])
def test_every_record_once(spark, tmp_path, split):
    if split == 1:
        some = [page(1, "http://a/1", "<p>one</p>"), page(2, "http://a/2", "two")]
    else:
        inner = gzip.compress(b"WARC/1.0\r\nfake").decode("latin-1")
        some = [page(i, f"http://a/{i}", f"<p>{i} {inner if i % 5 == 0 else 'x' * (i * 37 % 900)}</p>") for i in range(60)]
    paths = warc.write(spark.createDataFrame(some, PAGES).coalesce(2), str(tmp_path / "w"))
    got = warc.read(spark, paths, split).collect()
    assert sorted((r["target_uri"], r["payload"].decode()) for r in got) == sorted((p[1], p[2]) for p in some)
    assert all(r["http_status"] == 200 and r["type"] == "response" for r in got)


def test_registered_query_equals_its_sql(spark, sf):
    pages = f"{sf}/pages.parquet"
    want = duckdb.sql(queries.oracle_sql()["op8_warc_reader"].replace("pages", f"'{pages}'")).fetchall()
    got = queries.queries()["op8_warc_reader"](spark, sf).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_awkward_rows(spark, tmp_path):
    some = [page(1, None, "<p>é</p>"), page(2, "http://a/b\n c", None), page(None, " http://x ", ""), page(3, "u", "y" * 3_000_000), page(3, "u", "y" * 3_000_000), (None,) * 7]
    df = spark.createDataFrame(some, PAGES)
    got = warc.round_trip(df, split_bytes=1000)
    assert got.columns == ["page_id", "url", "html"]
    short = lambda rows: sorted(((r[0], r[1], r[2] and (r[2][:9], len(r[2]))) for r in rows), key=str)
    assert short(got.collect()) == short([(1, None, "<p>é</p>"), (2, "http://a/b  c", None), (None, "http://x", ""), (3, "u", "y" * 3_000_000), (3, "u", "y" * 3_000_000), (None, None, None)])
    assert warc.round_trip(df.where("page_id = 99")).count() == 0
    assert warc.read(spark, []).count() == 0


def test_damage_is_skipped(spark, tmp_path):
    record = lambda u: gzip.compress(f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: {u}\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n".encode())
    f = tmp_path / "x.warc.gz"
    f.write_bytes(record("a") + b"\x1f\x8b\x08junk" + gzip.compress(b"not a record") + record("b") + record("c")[:-9])
    got = warc.read(spark, [str(f)], 40).collect()
    assert sorted(r["target_uri"] for r in got) == ["a", "b"] and {bytes(r["payload"]) for r in got} == {b"abc"}
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    assert warc.read(spark, [str(tmp_path / "empty.warc.gz")]).count() == 0


def test_large_members_take_linear_time_and_damage_is_read_again():
    """A record of many blocks is decompressed as it is read; where one is damaged far behind its header, the next is still found."""
    big = os.urandom(24 << 20)
    whole = gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\n\r\n" + big, 1)
    small = gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\n\r\nabc", 1)
    start = time.perf_counter()
    got = list(warc.members(pa.BufferReader(whole + small), 0, 1 << 40))
    assert [len(x) for _, x in got] == [len(big) + 33, 36] and time.perf_counter() - start < 4
    damaged = bytearray(whole)
    damaged[-12] ^= 255
    damaged[5_000_000:5_000_000] = small  # inside the damaged one
    offsets = [at for at, _ in warc.members(pa.BufferReader(bytes(damaged) + small), 0, 1 << 40)]
    assert offsets == [5_000_000, len(damaged)]


def test_folders_and_globs(spark, tmp_path):
    for name in ("a/x.warc.gz", "a/b/y.warc.gz", "c d.warc.gz"):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(gzip.compress(f"WARC/1.0\r\nWARC-Target-URI: {name}\r\n\r\nabc".encode()))
    uris = lambda *paths: sorted(r["target_uri"] for r in warc.read(spark, [str(tmp_path / p) for p in paths]).collect())
    assert uris("a") == ["a/b/y.warc.gz", "a/x.warc.gz"] and uris("*.warc.gz", "*.warc.gz") == ["c d.warc.gz"]

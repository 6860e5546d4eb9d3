"""Every registered query against its SQL in DuckDB, as the driver compares them."""

from __future__ import annotations

import datetime
import math
import os

import duckdb
import pytest

from weftline.plans import queries as plans

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return int(v) if isinstance(v, bool) else v


def table(rows, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in plans.SQL:
        assert got
        return
    rel = duck.sql(plans.SQL[name])
    want = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    a, b = table(got, df.columns), table(want, rel.columns)
    assert len(a) == len(b)
    assert a == b, next((x, y) for x, y in zip(a, b) if x != y)
    assert a or name in ("table_lookups",), "nothing to compare"

"""Every registered query against its DuckDB oracle on the smallest tables (the driver's check)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as ENTRY
from conftest import SF_SMALL
from quillspark.plans.registry import load_all

TABLES = ["documents", "labels", "conversations", "pages", "benchmark"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    return con


QUERIES, ORACLE = load_all()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(ENTRY.queries()) >= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLE[name])
    exp = _rows([d[0] for d in cur.description], cur.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in cur.description)
    assert got == exp


def test_entry_smoke(spark):
    df = ENTRY.entry(spark)
    rows = df.collect()
    assert df.columns == ["prompt_id", "n", "qwk"]
    assert {r["prompt_id"] for r in rows} == {"average", *map(str, range(1, 9))}
    assert all(r["n"] > 0 for r in rows)

"""Every query with SQL gives DuckDB's rows on the smallest tables, and some rows."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from loomgraph import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=repr), [columns[i] for i in order]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(catalogue.ORACLES[name])
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert got[1] == want[1]
    assert got[0] == want[0]
    assert got[0] or name in {"missed_companions", "contract_forbidden", "contract_required", "secrets_scan"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())

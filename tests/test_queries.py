"""Every registered engine query against the same question in another engine."""

import math

import duckdb
import pytest

from sparkveil.plans import catalog
from sparkveil.plans.tables import TABLES

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, other, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    if name not in ORACLE:
        assert cols and got is not None
        return
    rel = other.sql(ORACLE[name])
    names = list(rel.columns)
    assert sorted(names) == cols
    assert got == sorted(tuple(shown(r[names.index(c)]) for c in cols) for r in rel.fetchall())

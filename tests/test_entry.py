"""Driver contract: the flagship query, and every registered query against its
SQL (DuckDB) at sf0.001."""

import collections

import duckdb
import pytest

import __spark_entry__ as entry
from tablekeep.plans.catalogue import TABLES

from conftest import SF0001


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 14 and set(df.columns) == {"table_name", "section", "chunk_id", "value"}


def _norm(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return str([_norm(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(entry.REGISTRY))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF0001)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)

    def bag(cs, rs):
        order = sorted(range(len(cs)), key=lambda i: cs[i])
        return collections.Counter(tuple(_norm(r[i]) for i in order) for r in rs)
    assert bag(df.columns, rows) == bag(cols, res.fetchall())

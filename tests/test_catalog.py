"""Every registered query that has SQL for it gives the same rows on both engines."""

from __future__ import annotations

import pytest

from quern.plans import catalog
from tests.conftest import rows

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, small, duck):
    df = QUERIES[name](spark, small)
    got = rows(df.columns, df.collect())
    if name not in ORACLE:
        assert df.columns
        return
    found = duck.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, found.fetchall())


def test_min_max_by_of_equal_balances(spark, small, tmp_path):
    """Of tied rows the smallest key, as DuckDB's first row of a table in the order of keys, however the rows lie; nulls as there."""
    import duckdb

    con = duckdb.connect(config={"threads": 1})  # several threads merge their tied rows in any order
    con.execute(f"CREATE TABLE customer AS SELECT * REPLACE (c_custkey + i * 150 AS c_custkey) FROM '{small}/customer.parquet', range(5) r(i) ORDER BY c_custkey + i * 150")
    odd = "(1000, 90, 5.0), (1001, 90, 'nan'::DOUBLE), (1002, 90, 'nan'), (1003, 91, 0.0), (1004, 91, -0e0), (1005, 92, NULL), (NULL, 93, 2.0), (1006, 93, 1.0), (1007, 93, NULL), (1008, NULL, 3.0), (1009, NULL, 3.0)"
    con.execute(f"INSERT INTO customer BY NAME SELECT k AS c_custkey, n AS c_nationkey, CAST(b AS DOUBLE) AS c_acctbal FROM (VALUES {odd}) t(k, n, b)")
    for name, order in (("ordered", "rowid"), ("reversed", "rowid DESC"), ("mixed", "hash(rowid)")):
        (tmp_path / name).mkdir()
        con.execute(f"COPY (SELECT * FROM customer ORDER BY {order}) TO '{tmp_path / name}/customer.parquet'")
        con.execute(f"COPY (SELECT * FROM '{small}/nation.parquet') TO '{tmp_path / name}/nation.parquet'")
    found = con.execute(ORACLE["agg_min_max_by"])
    want = rows([d[0] for d in found.description], found.fetchall())
    for name in ("ordered", "reversed", "mixed"):
        df = QUERIES["agg_min_max_by"](spark, str(tmp_path / name))
        assert rows(df.columns, df.collect()) == want


def test_names():
    assert set(ORACLE) <= set(QUERIES)
    assert catalog.FLAGSHIP in QUERIES


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(catalog.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())

"""Every catalog query against its SQL twin."""

from __future__ import annotations

import duckdb
import pytest

from blockloom import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def order(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_twin(name, spark, sf_dir, con):
    found = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    want = con.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    rows = [tuple(r) for r in found.select(*columns).collect()]
    twin = want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    assert sorted(rows, key=order) == sorted(twin, key=order)


def test_every_query_has_a_twin():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["shown", "content_type", "missing", "n_objects", "n_bytes", "pending_objects", "pending_bytes"]
    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())

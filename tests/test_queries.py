"""Every query with SQL gives the rows that DuckDB gives; the others give rows."""

import math

import duckdb
import pytest

from tremolo.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or isinstance(value, (str, bool)):
        return value
    if isinstance(value, (int, float)) or hasattr(value, "as_tuple"):
        return None if math.isnan(value) else float(value) + 0.0
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_against_sql(spark, duck, name):
    found = registry.QUERIES[name](spark, DATA)
    wanted = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in wanted.description]
    assert _rows(found.columns, found.collect()) == _rows(names, wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    found = registry.QUERIES[name](spark, DATA)
    assert found.columns
    found.collect()

"""Every registered query that SQL can express gives what DuckDB gives, at the smallest scale."""

import os

import duckdb
import pytest

from pairscope.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def normal(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{round(float(value), 6) + 0.0:.6f}"
    return str(value)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cursor = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted(tuple(str(normal(dict(zip(columns, r))[c])) for c in order) for r in cursor.fetchall())
    got = sorted(tuple(str(normal(r[c])) for c in order) for r in df.collect())
    assert got == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_give_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0

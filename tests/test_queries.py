"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from parchment.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for name in TABLES:
        path = f"{DATA}/{name}.parquet"
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return f"{value:.8g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    got = registry.queries()[name](spark, DATA)
    want = db.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted([plain(r[c]) for c in columns] for r in got.collect())
    assert rows == sorted([plain(v) for v in r] for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    got = registry.queries()[name](spark, DATA)
    assert len(set(got.columns)) == len(got.columns) and got.count() > 0


def test_flagship_is_registered():
    assert registry.FLAGSHIP in registry.queries()

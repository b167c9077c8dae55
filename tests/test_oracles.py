"""Every registered query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(names, data):
    at = sorted(range(len(names)), key=names.__getitem__)
    plain = [tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at) for r in data]
    return sorted(plain, key=lambda r: [(x is not None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_same_rows(spark, db, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    found = db.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(names, found.fetchall())


def test_the_rest_runs(spark):
    rest = sorted(n for n in set(__spark_entry__.queries()) - set(__spark_entry__.oracle_sql()) if not n.startswith(("op", "pipeline")))
    for name in rest:
        assert __spark_entry__.queries()[name](spark, DATA).count() > 0, name


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0

"""Every registered query against its SQL in DuckDB."""

import math

import duckdb
import pytest

from pathloom.plans import registry

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return round(float(x), 6) if isinstance(x, float) else x

    df = df[sorted(df.columns)]
    return sorted(repr(tuple(plain(x) for x in r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    mine = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(mine)
        return
    theirs = duck.execute(SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert len(SQL) >= 100

"""Every registered query of the library runs on the smallest tables; where it has SQL, DuckDB gives the same rows."""

import glob
import os

import pytest

import __spark_entry__
from chronoloom import plans

duckdb = pytest.importorskip("duckdb")


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda x: None if x is None or x != x else round(float(x), 6) if isinstance(x, float) else x
    return sorted(repr([plain(x) for x in r]) for r in df.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    for file in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, small, sql, name):
    got = plans.QUERIES[name](spark, small).toPandas()
    assert len(got.columns)
    if name in plans.ORACLE_SQL:
        want = sql.execute(plans.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

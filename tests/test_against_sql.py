"""Queries on rows that the smallest tables lack, against their SQL."""

import pytest

from chronoloom import plans

duckdb = pytest.importorskip("duckdb")


def same_as_sql(spark, folder, name, rows, schema, table="conversations"):
    """Runs a query on a table of these rows; returns its rows, which are those of its SQL."""
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
    got = plans.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({plans.ORACLE_SQL[name]})").fetchall()
    found = [tuple(r) for r in got.collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, want))
    return found


def test_negations_beside_letters_with_accents(spark, tmp_path):
    texts = ["el noñllo", "el no", "no noitada", "schöne", "ne", "nicht, kein: not_no never9 non", "ñno noñ", "no", "", None, "no"]
    found = same_as_sql(spark, tmp_path, "value_conflicts", [("a", t, "user", x) for t, x in enumerate(texts)], "conv_id string, turn long, role string, text string")
    assert [r[3] for r in sorted(found)] == [False] * 4 + [True] * 4

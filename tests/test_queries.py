"""Every query with SQL agrees with DuckDB on the smallest test tables."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def shown(x):
    return f"{x:.10g}" if isinstance(x, float) else str(x) if not isinstance(x, decimal.Decimal) else f"{x:f}"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = entry.queries()[name](spark, DIR)
    con.execute(entry.oracle_sql()[name])
    kinds = {d[0]: str(d[1]) for d in con.description}
    assert {c: TYPES.get(k, k.upper()) for c, k in df.dtypes} == kinds
    names = [d[0] for d in con.description]
    expected = sorted(tuple(map(shown, r)) for r in con.fetchall())
    assert sorted(tuple(shown(r[c]) for c in names) for r in df.collect()) == expected


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")
def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")
def test_titles_of_all_regions(spark):
    got = {r.title for r in entry.queries()["category_titles_by_word"](spark, DIR).collect()}
    assert got == {"Africa", "America", "Asia", "Europe", "Middle East"}

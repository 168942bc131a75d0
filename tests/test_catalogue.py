"""Every query with SQL against an independent engine on the smallest tables."""

import os

import duckdb
import pytest

from seekframe.plans import catalogue


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    return float(round(v, 5)) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows(spark, db, small, name):
    mine = catalogue.QUERIES[name](spark, small)
    other = db.sql(catalogue.ORACLES[name])
    columns = sorted(other.columns)
    assert sorted(mine.columns) == columns
    a = sorted(repr([plain(r[c]) for c in columns]) for r in mine.collect())
    b = sorted(repr([plain(r[other.columns.index(c)]) for c in columns]) for r in other.fetchall())
    assert a == b


def test_flagship(spark, small):
    rows = catalogue.flagship(spark, small).collect()
    assert 0 < len(rows) <= 10 and rows[0].path.startswith("/")


def test_prefix_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("content", "abc", 1)], "field string, term string, doc_id long").write.parquet(str(tmp_path / "p"))
    plan = catalogue.index.starts_with(spark.read.parquet(str(tmp_path / "p")), "content", "ab")._jdf.queryExecution().toString()
    assert "StringStartsWith(term,ab)" in plan


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES) and len(catalogue.QUERIES) > 160

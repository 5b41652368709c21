"""Every query beside its SQL on the smallest tables."""

import duckdb
import pytest

from goldweave.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name, tmp_path):
    out = f"{tmp_path}/{name}"
    QUERIES[name](spark, SF).write.parquet(out)
    if name not in SQL:
        assert spark.read.parquet(out).count() > 0
        return
    want = con.sql(SQL[name])
    cols = sorted(want.columns)
    got = con.sql(f"SELECT * FROM '{out}/*.parquet'")
    assert sorted(got.columns) == cols
    pick = ", ".join(f'"{c}"' for c in cols)
    rows = lambda r: sorted(map(repr, con.sql(f"SELECT {pick} FROM ({r})").fetchall()))
    assert rows(SQL[name]) == rows(f"SELECT * FROM '{out}/*.parquet'")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

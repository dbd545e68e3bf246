"""Every registered query against its SQL on the given tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from panelkit import jobs

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    columns = sorted(df.columns)
    plain = df[columns].apply(lambda s: s.astype(str) if s.dtype == object or "date" in str(s.dtype) else s)
    return plain.sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(jobs.QUERIES))
def test_query_equals_sql(spark, duck, name):
    found = jobs.QUERIES[name](spark, SF).toPandas()
    assert len(found)
    if name in jobs.SQL:
        pd.testing.assert_frame_equal(ordered(found), ordered(duck.sql(jobs.SQL[name]).df()), check_dtype=False, rtol=0, atol=2e-6)


def test_entry(spark):
    out = entry.entry(spark)
    assert {r.portfolio for r in out.collect()} == {"strategy", "benchmark"} and {"annual_return", "sharpe", "avg_names"} <= set(out.columns)
    assert set(entry.oracle_sql()) <= set(entry.queries())

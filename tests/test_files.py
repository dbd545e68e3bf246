"""Lines in their order however files are split, rejected lines, versions in two formats, macro tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from panelkit.sources import files


def test_lines_keep_the_order_of_the_file(spark, tmp_path):
    text = ["Index: X", "", "Date,Index Level"] + [f"{d} March {2000 + y},{y}.{d:02d}" for y in range(300) for d in (1, 2)] + [f"1 March {2000 + y},9" for y in range(300)]
    (tmp_path / "a.csv").write_text("\n".join(text))
    (tmp_path / "b.csv").write_text("1 March 1990,5\n1 March 1990,6\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        own = files.lines(spark, str(tmp_path)).where(F.col("file").endswith("a.csv")).orderBy("block", "at").collect()
        assert [r.line for r in own] == text
        rows, lost = files.index_lines(spark, str(tmp_path), "1995-01-01")
        found = {(r.date, r.level) for r in rows.collect()}
        assert found == {(datetime.date(2000 + y, 3, d), float(f"{y}.{d:02d}")) for y in range(300) for d in (1, 2)}
        assert {r.reason: r.n for r in lost.groupBy("reason").agg(F.count("*").alias("n")).collect()} == {"date": 3, "repeated": 301, "early": 1}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_versions_are_whole_in_both_formats(spark, tmp_path):
    path = str(tmp_path / "t")
    one = files.commit_both(spark.createDataFrame([("x", 1.5, None)], "k string, v double, n int"), path)
    files.commit_both(spark.createDataFrame([("x", 2.5, 3), ("y", 0.1, 4)], "k string, v double, n int"), path, "k")
    for kind in ("parquet", "csv"):
        assert sorted((r.k, r.v, r.n) for r in files.read_committed(spark, path, kind).collect()) == [("x", 2.5, 3), ("y", 0.1, 4)]
        assert [(r.k, r.v, r.n) for r in files.read_committed(spark, path, kind, one).collect()] == [("x", 1.5, None)]
    with pytest.raises(ValueError):
        files.read_committed(spark, path, "csv", "other")


def test_macro_months(spark):
    raw = spark.createDataFrame([("1995.1", "5", "x"), ("1995.01", "n/a", "x"), ("1995.13", "6", "x"), (None, "7", "x"), ("text", "8", "x")], "d string, p string, y string")
    assert sorted((str(r.period), r.price) for r in files.monthly_macro(raw, {"p": "price"}, "d").collect()) == [("1995-01-01", None), ("1995-10-01", 5.0)]

"""Files written from the given tables and read back, each beside the SQL over those tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.operators.staging import shared_dir
from panelkit.plans.registry import query, read
from panelkit.plans.tables import SQL_daily, SQL_monthly, daily, monthly
from panelkit.sources import files

_D, _M = SQL_daily(), SQL_monthly("l_returnflag")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"SELECT asset, date, close FROM ({_D}) WHERE date IN (SELECT date FROM ({_D}) GROUP BY 1 HAVING count(*) = 3)", "close")
def s1_close_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV folder for each asset; only dates on which all have a price."""
    path = _folder(spark, "closes")
    daily(spark, sf_dir).select("asset", F.col("date").alias("Date"), F.col("close").alias("Close")).write.partitionBy("asset").option("header", True).csv(path)
    return files.read_close_panel(spark, f"{path}/*/*.csv", r"asset=([^/]+)/")


def _index_files(spark: SparkSession, sf_dir: str) -> str:
    """A text file for each asset: a title, a blank line, a heading, and a line for each month - twice, the second time with
    another value - with a note where the month is a January."""
    path = _folder(spark, "index")
    m = monthly(spark, sf_dir, "l_returnflag").select("asset", "date", F.round("close", 2).alias("close"))
    day, level = F.date_format("date", "d MMMM yyyy"), F.col("close").cast("string")
    body = m.select("asset", "date", F.posexplode(F.array(F.concat(F.lit('"'), day, F.lit('",'), level), F.concat(day, F.lit(",-1")), F.when(F.month("date") == 1, F.concat(day, F.lit(",revised"))))).alias("k", "line")).where("line is not null")
    head = m.select("asset").distinct().select("asset", F.lit(None).cast("date").alias("date"), F.posexplode(F.array(F.concat(F.lit("Index: "), "asset"), F.lit(""), F.lit("Date,Index Level"))).alias("k", "line"))
    every = head.union(body).repartition("asset").sortWithinPartitions("asset", F.col("date").asc_nulls_first(), "k")
    every.select("asset", "line").write.partitionBy("asset").text(path)
    return path


@query(f"SELECT asset, date, round(close, 2) AS level FROM ({_M}) WHERE date >= DATE '1996-01-01'", "level")
def s2_index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = files.index_lines(spark, f"{_index_files(spark, sf_dir)}/*/*", "1996-01-01")
    return rows.select(F.regexp_extract("file", r"asset=([^/]+)/", 1).alias("asset"), "date", "level")


@query(
    f"""WITH m AS (SELECT asset, date FROM ({_M})) SELECT asset, 'date' AS reason, 3::BIGINT AS n FROM (SELECT DISTINCT asset FROM m) UNION ALL SELECT asset, 'repeated', count(*) FROM m GROUP BY 1
    UNION ALL SELECT asset, 'level', count(*) FROM m WHERE month(date) = 1 GROUP BY 1 UNION ALL SELECT asset, 'early', count(*) FROM m WHERE date < DATE '1996-01-01' GROUP BY 1"""
)
def s2_rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, lost = files.index_lines(spark, f"{_index_files(spark, sf_dir)}/*/*", "1996-01-01")
    return lost.groupBy(F.regexp_extract("file", r"asset=([^/]+)/", 1).alias("asset"), "reason").agg(F.count("*").alias("n"))


@query("SELECT 'nation' AS name, 'csv' AS kind, n_nationkey::VARCHAR AS key, n_name AS label FROM nation UNION ALL SELECT 'region', 'parquet', r_regionkey::VARCHAR, r_name FROM region")
def s3_parquet_or_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two tables one is there as Parquet and as an older CSV, the other as CSV only."""
    path = _folder(spark, "tables")
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    nation.write.option("header", True).csv(f"{path}/nation.csv")
    region.limit(1).write.option("header", True).csv(f"{path}/region.csv")
    region.write.parquet(f"{path}/region.parquet")
    pick = lambda name, key, label: files.read_table(spark, path, name).select(F.lit(name).alias("name"), F.lit("csv" if name == "nation" else "parquet").alias("kind"), F.col(key).cast("string").alias("key"), F.col(label).alias("label"))
    return pick("nation", "n_nationkey", "n_name").union(pick("region", "r_regionkey", "r_name"))


@query(
    f"""SELECT asset, CAST(date_trunc('month', date) AS DATE) AS period, close AS price, CASE WHEN month(date) % 4 > 0 THEN dividends END AS dividend FROM ({_M})""",
    "price dividend",
)
def s4_macro_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A monthly table as published: decimal dates (1995.1 is October), text among the numbers, a yearly total as month 13."""
    path = _folder(spark, "macro")
    m = monthly(spark, sf_dir, "l_returnflag")
    code = (F.year("date") + F.month("date") / 100).cast("decimal(8, 2)").cast("double").cast("string")
    rows = m.select("asset", code.alias("Date"), F.col("close").cast("string").alias("P"), F.when(F.month("date") % 4 > 0, F.col("dividends").cast("string")).otherwise("n/a").alias("D"))
    total = m.groupBy("asset", (F.year("date") + 0.13).cast("decimal(8, 2)").cast("string").alias("Date")).agg(F.sum("close").cast("string").alias("P"), F.lit("").alias("D"))
    rows.unionByName(total).select("asset", "Date", "P", "D", F.lit("x").alias("Unnamed: 3")).write.option("header", True).csv(path)
    raw = spark.read.option("header", True).csv(path)
    return files.monthly_macro(raw, {"P": "price", "D": "dividend"}, "Date", ["asset"])


@query("SELECT (label + 1.0) / sum(label + 1.0) OVER () AS q, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, vec_id FROM embeddings", "q a b")
def s5_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scenario sheet with an index column without a name, assets by their aliases and unnormalised probabilities."""
    path = _folder(spark, "scenarios")
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("Unnamed: 0"), F.element_at("embedding", 1).cast("double").alias("Equity Europe"), F.element_at("embedding", 2).cast("double").alias("BOND-US"), (F.col("label") + 1).alias("Prob_ability"), F.col("vec_id").cast("double").alias("Row No."))
    e.write.option("header", True).csv(path)
    raw = spark.read.option("header", True).csv(path)
    out = files.read_scenarios(raw, {"europe": ["equity europe"], "us_bond": ["bond us"], "row": ["row no"]})
    return out.select("q", F.col("r")[0].alias("a"), F.col("r")[1].alias("b"), F.col("r")[2].cast("long").alias("vec_id"))


@query(
    "SELECT kind, o_orderstatus AS status, count(*)::BIGINT AS n, sum(o_totalprice) AS total, min(o_orderkey) AS first_key FROM orders, (SELECT unnest(['parquet', 'csv']) AS kind) GROUP BY ALL",
    relative="total",
)
def s6_both_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, committed twice as Parquet and CSV by status: both formats give the last version, the first one is only rows of
    one status."""
    path = _folder(spark, "orders")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    first = files.commit_both(orders.where("o_orderstatus = 'F'"), path, "o_orderstatus")
    files.commit_both(orders, path, "o_orderstatus")
    if files.read_committed(spark, path, "csv", first).where("o_orderstatus <> 'F'").take(1):
        raise ValueError("a version has changed")
    kinds = [files.read_committed(spark, path, kind).select(F.lit(kind).alias("kind"), "o_orderstatus", "o_totalprice", "o_orderkey") for kind in ("parquet", "csv")]
    return kinds[0].union(kinds[1]).groupBy("kind", F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), F.min("o_orderkey").alias("first_key"))

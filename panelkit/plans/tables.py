"""Price panels and cross-sections from the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.operators.series import bars, by, change
from panelkit.plans.registry import read


def daily(spark: SparkSession, sf_dir: str, key: str = "l_returnflag") -> DataFrame:
    """asset, date, close, dividends: a dense panel by l_returnflag, one of many assets by l_suppkey."""
    line = read(spark, sf_dir, "lineitem")
    return line.groupBy(F.col(key).cast("string").alias("asset"), F.to_date("l_shipdate").alias("date")).agg(
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), (F.sum(F.col("l_extendedprice") * F.col("l_discount")) / F.sum("l_quantity")).alias("dividends")
    )


def monthly(spark: SparkSession, sf_dir: str, key: str = "l_suppkey") -> DataFrame:
    """asset, date (first of the month), close, dividends."""
    return bars(daily(spark, sf_dir, key), "month", ("close",), ("dividends",)).withColumnRenamed("period", "date").drop("last_date")


def weekly(spark: SparkSession, sf_dir: str, key: str = "l_returnflag") -> DataFrame:
    """asset, date (the week's Friday), close."""
    return bars(daily(spark, sf_dir, key), "friday_week").withColumnRenamed("period", "date").drop("last_date")


def returns(spark: SparkSession, sf_dir: str, key: str = "l_returnflag", unit: str = "day") -> DataFrame:
    """asset, date, r of consecutive rows."""
    px = daily(spark, sf_dir, key) if unit == "day" else weekly(spark, sf_dir, key) if unit == "week" else monthly(spark, sf_dir, key)
    return px.withColumn("r", change("close", by("asset"))).where("r is not null").select("asset", "date", "r")


def scenarios(spark: SparkSession, sf_dir: str, n: int = 4) -> DataFrame:
    """scen_id, q, r: the first n dimensions as returns, probabilities by label."""
    emb = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("scen_id"), (F.col("label") + 1).cast("double").alias("m"), F.transform(F.slice("embedding", 1, n), lambda x: x.cast("double") / 10).alias("r"))
    total = emb.agg(F.sum("m").alias("total"))
    return emb.join(F.broadcast(total)).select("scen_id", (F.col("m") / F.col("total")).alias("q"), "r")  # one row


def lattice(spark: SparkSession, steps: int = 10) -> DataFrame:
    """cand_id, w: all weights of four assets in steps of one tenth that sum to one (286 for ten steps)."""
    k = spark.range((steps + 1) ** 3)
    a, b, c = F.floor(F.col("id") / (steps + 1) ** 2), F.floor(F.col("id") / (steps + 1)) % (steps + 1), F.col("id") % (steps + 1)
    d = F.lit(steps) - a - b - c
    return k.where(d >= 0).select(F.col("id").alias("cand_id"), F.array(*((x / steps).cast("double") for x in (a, b, c, d))).alias("w"))


def SQL_daily(key: str = "l_returnflag") -> str:  # noqa: N802
    return f"SELECT CAST({key} AS VARCHAR) AS asset, CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_extendedprice * l_discount) / sum(l_quantity) AS dividends FROM lineitem GROUP BY 1, 2"


def SQL_monthly(key: str = "l_suppkey") -> str:  # noqa: N802
    return f"SELECT asset, CAST(date_trunc('month', date) AS DATE) AS date, arg_max(close, date) AS close, sum(dividends) AS dividends FROM ({SQL_daily(key)}) GROUP BY 1, 2"


def SQL_returns(key: str = "l_returnflag", unit: str = "day") -> str:  # noqa: N802
    px = SQL_daily(key) if unit == "day" else SQL_monthly(key)
    return f"SELECT * FROM (SELECT asset, date, close / lag(close) OVER (PARTITION BY asset ORDER BY date) - 1 AS r FROM ({px})) WHERE r IS NOT NULL"


SQL_weekly_returns = f"SELECT * FROM (SELECT asset, date, close / lag(close) OVER (PARTITION BY asset ORDER BY date) - 1 AS r FROM (SELECT asset, date + CAST((5 - isodow(date) + 7) % 7 AS INTEGER) AS date, arg_max(close, date) AS close FROM ({SQL_daily()}) GROUP BY 1, 2)) WHERE r IS NOT NULL"
SQL_scenarios = "SELECT vec_id AS scen_id, (label + 1.0)::DOUBLE / sum(label + 1.0) OVER () AS q, list_transform(embedding[1:4], lambda x: x::DOUBLE / 10) AS r FROM embeddings"
SQL_lattice = "SELECT a * 121 + b * 11 + c AS cand_id, [a / 10, b / 10, c / 10, (10 - a - b - c) / 10]::DOUBLE[] AS w FROM range(11) t1(a), range(11) t2(b), range(11) t3(c) WHERE a + b + c <= 10"


def dirichlet_candidates(spark: SparkSession, n_assets: int, draws: int, cap: float = 1.0, seed: int = 42) -> DataFrame:
    """cand_id, w: equal weights, corners and 60/40 pairs, and uniform draws from the simplex, none over the cap.

    A draw is exponentials of a hash of (seed, draw, asset), normalised, so any executor makes the same one again. Rows that
    agree to twelve digits are one (U6).
    """
    k = F.sequence(F.lit(0), F.lit(n_assets - 1))
    unit = lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    raw = F.transform(k, lambda i: -F.log(unit(i)))
    total = F.aggregate(F.col("raw"), F.lit(0.0), lambda s, x: s + x)
    drawn = spark.range(draws).withColumn("raw", raw).select("id", F.transform("raw", lambda x: x / total).alias("w"))
    fixed = [[1 / n_assets] * n_assets]
    for i in range(n_assets):
        fixed.append([1.0 if j == i else 0.0 for j in range(n_assets)])
        fixed += [[0.6 if j == i else 0.4 if j == o else 0.0 for j in range(n_assets)] for o in range(n_assets) if o != i]
    rows = spark.range(len(fixed)).select((F.col("id") - len(fixed)).alias("id"), F.element_at(F.lit(fixed), (F.col("id") + 1).cast("int")).alias("w"))
    every = rows.unionByName(drawn).where(F.array_max("w") <= cap + 1e-12).withColumn("w", F.transform("w", lambda x: F.round(x, 12)))
    return every.groupBy("w").agg(F.min("id").alias("cand_id")).select("cand_id", "w")

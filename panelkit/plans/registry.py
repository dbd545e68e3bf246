"""Registered queries: a Spark job over the given tables and, beside it, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIGITS, NUDGE = 6, 1.7e-10


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, relative: Sequence[str] = ()) -> DataFrame:
    """Doubles to six digits, moved off decimal ties first, so that the order of additions doesn't show; no negative zeros.
    Those of relative have eight digits after the first one instead, whatever their size."""
    plain = lambda c: F.round(F.col(c) + NUDGE, DIGITS) + 0.0
    digits = lambda c: F.format_string("%.8e", F.col(c)).try_cast("double")
    return df.select([(digits(c) if c in relative else plain(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None, doubles: str = "", relative: str = ""):
    """Registers a job under its function's name. doubles, relative: the columns to be rounded on SQL's side."""

    def register(job: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[job.__name__] = lambda spark, sf_dir: rounded(job(spark, sf_dir), relative.split())
        if sql:
            replaced = ", ".join([*(f"round({c} + {NUDGE}, {DIGITS}) + 0.0 AS {c}" for c in doubles.split()), *(f"printf('%.8e', {c})::DOUBLE AS {c}" for c in relative.split())])
            SQL[job.__name__] = f"SELECT *{f' REPLACE ({replaced})' if replaced else ''} FROM ({sql})"
        return job

    return register

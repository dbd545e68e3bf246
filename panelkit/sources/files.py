"""Reading and writing files. Everything goes through Spark's readers and writers, so paths may be in any store.

Where the order of lines counts, each line has its file, the block of the file that a task reads and its place among the lines
of that task: together they order lines as the file does, however it is split.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from panelkit.functions.columns import date_token, decimal_month, number_token, to_number
from panelkit.operators.series import complete_dates


def read_close_panel(spark: SparkSession, glob: str, pattern: str = r"([^/]+)\.csv$") -> DataFrame:
    """One CSV (Date, Close) for each ticker, named by the file; only dates on which all have a price."""
    raw = spark.read.schema("Date string, Close string").option("header", True).csv(glob)
    panel = raw.select(F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).alias("asset"), date_token("Date").alias("date"), to_number("Close").alias("close"))
    return complete_dates(panel.where("date is not null and close is not null"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, at, line of text files; block and at order the lines of a file."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return raw.select("file", "block", F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def index_lines(spark: SparkSession, path: str, start: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Index files with lines of any kind before and between their data. Of each file the rows (file, date, level) whose
    first cells are a date and a number, the first one of each date; and all other lines (file, block, at, line, reason):
    `date`, `level`, `repeated`, or `early`, before the start."""
    cells = F.from_csv("line", "a string, b string", {"mode": "PERMISSIVE"})
    rows = lines(spark, path).withColumn("cells", cells).withColumns({"date": date_token("cells.a"), "level": number_token("cells.b")})
    dated = F.col("date").isNotNull() & F.col("level").isNotNull()
    place = F.row_number().over(Window.partitionBy("file", "date", dated).orderBy("block", "at"))  # lines of one date
    reason = F.when(F.col("date").isNull(), "date").when(F.col("level").isNull(), "level").when(place > 1, "repeated")
    if start:
        reason = F.coalesce(reason, F.when(F.col("date") < F.lit(start).cast("date"), "early"))
    judged = rows.withColumn("reason", reason)
    return judged.where("reason is null").select("file", "date", "level"), judged.where("reason is not null").select("file", "block", "at", "line", "reason")


def read_index_csv(spark: SparkSession, path: str, start: str | None = None) -> DataFrame:
    """Date, level of one index file."""
    return index_lines(spark, path, start)[0].select("date", "level")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """S3: Parquet if it is there, else CSV with a header."""
    if _exists(spark, f"{folder}/{name}.parquet"):
        return spark.read.parquet(f"{folder}/{name}.parquet")
    return spark.read.option("header", True).csv(f"{folder}/{name}.csv")


def monthly_macro(raw: DataFrame, columns: Mapping[str, str], code: str, keys: Sequence[str] = ()) -> DataFrame:
    """Columns renamed and coerced, the decimal month decoded, rows outside months 1 to 12 dropped; keys are kept as they are."""
    out = raw.select(*keys, decimal_month(to_number(code)).alias("period"), *(to_number(c).alias(new) for c, new in columns.items()))
    return out.where("period is not null")


def read_scenarios(raw: DataFrame, assets: Mapping[str, list[str]], probability: str | None = "probability") -> DataFrame:
    """scen_id, q, r: columns found by their plain labels, `Unnamed` ones ignored; without probabilities equal ones."""
    plain = {_label(c): c for c in raw.columns if not c.startswith("Unnamed")}
    found = [next((plain[_label(x)] for x in [a, *aliases] if _label(x) in plain), None) for a, aliases in assets.items()]
    if missing := [a for a, c in zip(assets, found) if c is None]:
        raise ValueError(f"no column for {missing}")
    q: Column = to_number(f"`{plain[_label(probability)]}`") if probability and _label(probability) in plain else F.lit(1.0)
    out = raw.select(F.monotonically_increasing_id().alias("scen_id"), q.alias("m"), F.array(*(to_number(f"`{c}`") for c in found)).alias("r"))
    total = out.agg(F.sum("m").alias("total"))
    return out.join(F.broadcast(total)).select("scen_id", (F.col("m") / F.col("total")).alias("q"), "r")  # one row


def _label(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum() and c.isascii())


def write_both(df: DataFrame, path: str, partition: str | None = None) -> None:
    """The table as Parquet and as CSV."""
    for kind in ("parquet", "csv"):
        writer = df.write.mode("overwrite").option("header", True)
        (writer.partitionBy(partition) if partition else writer).format(kind).save(f"{path}.{kind}")


def commit_both(df: DataFrame, path: str, partition: str | None = None) -> str:
    """A new version of the table under path, as Parquet and as CSV of the same rows; gives the version's name.

    Both are written beside the versions before, the CSV from the written Parquet. Only then one commit file names the version,
    so a reader of either format sees all of it or what was there before.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    for kind in ("parquet", "csv"):
        writer = df.write.option("header", True)
        (writer.partitionBy(partition) if partition else writer).format(kind).save(f"{path}/{version}.{kind}")
        df = spark.read.schema(df.schema).parquet(f"{path}/{version}.parquet")
    n = (spark.read.schema(_COMMIT).json(f"{path}/_commits").agg(F.max("n")).first()[0] or 0) + 1 if _exists(spark, f"{path}/_commits") else 1
    commit = spark.createDataFrame([(n, version, df.count(), df.schema.json())], _COMMIT)
    commit.coalesce(1).write.mode("append").json(f"{path}/_commits")
    return version


_COMMIT = "n long, version string, rows long, schema string"


def read_committed(spark: SparkSession, path: str, kind: str = "parquet", version: str | None = None) -> DataFrame:
    """The last committed version, or a given one, in either format. Two commits at a time can have one number; of these the
    one with the larger name is the last for every reader."""
    found = spark.read.schema(_COMMIT).json(f"{path}/_commits")
    row = (found.where(F.col("version") == version) if version else found).orderBy(F.desc("n"), F.desc("version")).first()
    if row is None:
        raise ValueError(f"no such version under {path}")
    return spark.read.schema(T.StructType.fromJson(json.loads(row["schema"]))).option("header", True).format(kind).load(f"{path}/{row['version']}.{kind}")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object a row; NaN and infinities are null."""
    clean = [to_number(f.name).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("value"))


def manifest(results: DataFrame, group: str, status: str, feasible: str = "optimal", volatility: DataFrame | None = None) -> DataFrame:
    """Rows, feasible rows and counts by status for each group, as one JSON object; with a table (asset, vol) its volatilities."""
    by_status = results.groupBy(group, status).count()
    rows = by_status.groupBy(group).agg(
        F.sum("count").alias("rows"), F.sum(F.when(F.col(status) == feasible, F.col("count")).otherwise(0)).alias("feasible"),
        F.array_sort(F.collect_list(F.struct(F.col(status).alias("status"), F.col("count").alias("n")))).alias("by_status"),
    )
    rows = rows.crossJoin(F.broadcast(rows.agg(F.sum("rows").alias("total"))))  # one row
    fields = ["total", group, "rows", "feasible", "by_status"]
    if volatility is not None:
        rows = rows.crossJoin(F.broadcast(volatility.agg(F.array_sort(F.collect_list(F.struct("asset", "vol"))).alias("volatility"))))  # one row
        fields.append("volatility")
    return rows.select(F.to_json(F.struct(*fields)).alias("manifest"), group)

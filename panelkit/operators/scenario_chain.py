"""From driver paths to terminal returns of assets, with its checks, as one job.

Checks are metrics that Spark gathers while the rows pass (`DataFrame.observe`): no table is read again to be checked. The result is
written to the shared folder, which runs the job once; the counts are known then, and bad ones are an error that names them.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from panelkit.operators.staging import staged


def terminal_returns(paths: DataFrame, p: DataFrame, fx: str, exposed: Collection[str], horizons: Sequence[int] = (12, 36, 60)) -> tuple[DataFrame, dict[str, int]]:
    """scen_id, asset, p, ret_H and yearly_H for each horizon in months, and how many rows break each rule.

    paths: scen_id, asset, month, log_ret, the exchange rate among the assets as fx; exposed assets are converted by it, and it
    is dropped. p: scen_id, p. Rules: log returns and probabilities are finite, months are 1 to the longest horizon and every
    path has each of them once, every month has an exchange rate, every scenario has a probability, none is negative, they sum
    to one. A rule's count is 0 if it holds.
    """
    last = max(horizons)
    seen, met, ended, chances = (Observation(f"terminal {x}") for x in ("paths", "rates", "ends", "chances"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = paths.select("scen_id", "asset", F.col("month").cast("long").alias("month"), F.col("log_ret").cast("double").alias("log_ret"))
    rows = rows.observe(seen, F.count_if(~finite("log_ret")).alias("not_finite"), F.count_if(~F.col("month").between(1, last) | F.col("month").isNull()).alias("months_outside"))
    rate = F.max(F.when(F.col("asset") == fx, F.col("log_ret"))).over(Window.partitionBy("scen_id", "month"))
    rows = rows.withColumn("rate", rate).where(F.col("asset") != fx)
    rows = rows.observe(met, F.count_if(F.col("rate").isNull()).alias("without_rate"))
    rows = rows.withColumn("log_ret", F.when(F.col("asset").isin(list(exposed)), F.col("log_ret") - F.col("rate")).otherwise(F.col("log_ret")))
    sums = [F.expm1(F.sum(F.when(F.col("month") <= h, F.col("log_ret")))).alias(f"ret_{h}") for h in horizons]
    # the months that a path has, a bit each, 62 to a number: distinct counts would keep all rows of a task in memory
    starts = range(1, last + 1, 62)
    bit = lambda k: F.when(F.col("month").between(k, k + 61), F.expr(f"shiftleft(1L, cast(month - {k} AS int))"))
    months = [F.bit_or(bit(k)).alias(f"_m{k}") for k in starts]
    out = rows.groupBy("scen_id", "asset").agg(F.count("*").alias("n"), F.min("month").alias("first"), F.max("month").alias("last"), *months, *sums)
    chance = p.select("scen_id", F.col("p").cast("double").alias("p")).observe(chances, F.count_if(~finite("p")).alias("p_not_finite"), F.count_if(F.col("p") < 0).alias("negative_p"), F.sum("p").alias("sum_p"))
    out = out.join(chance, "scen_id", "left")
    seen_months = sum((F.coalesce(F.bit_count(f"_m{k}"), F.lit(0)) for k in starts), F.lit(0))
    whole = (F.col("n") == last) & (seen_months == last) & (F.col("first") == 1) & (F.col("last") == last)
    out = out.observe(ended, F.count_if(~whole).alias("broken_paths"), F.count_if(F.col("p").isNull()).alias("without_p"))
    yearly = [(F.pow(1 + F.col(f"ret_{h}"), 12.0 / h) - 1).alias(f"yearly_{h}") for h in horizons]
    found = staged(out.select("scen_id", "asset", "p", *(f"ret_{h}" for h in horizons), *yearly))
    counts = {k: v for o in (seen, met, ended, chances) for k, v in o.get.items()}
    counts["sum_not_one"] = int(abs((counts.pop("sum_p") or 0.0) - 1) > 1e-8)
    return found, {k: int(v) for k, v in counts.items()}


def require(counts: dict[str, int]) -> None:
    if bad := {k: v for k, v in counts.items() if v}:
        raise ValueError(f"broken rules: {bad}")

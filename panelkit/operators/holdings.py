"""Weights that are moved to targets now and then, under a turnover cap, and drift with returns in between.

State along a strategy is split in two levels. Between rebalances an asset's weight is its traded weight times a running product
of its own returns, a window over a few rows of one asset. Only the rebalances depend on each other: their vectors, rebalances
times assets numbers of a strategy, go through one fold inside the JVM. So rows of dates never meet in one group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.operators.series import positions_text
from panelkit.operators.staging import staged

LEAST = 1e-8  # weights below count as no position


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _normal(values: Column) -> Column:
    return _let(_total(values), lambda s: F.transform(values, lambda x: F.when(s > 0, x / s).otherwise(0.0)))


def _moved(one: Column, two: Column) -> Column:
    return _total(F.zip_with(one, two, lambda a, b: F.abs(a - b))) / 2


def _traded(now: Column, target: Column, cap: float) -> Column:
    """The target; if that is more than cap away, as far towards it as the cap allows; unchanged if there is no target."""
    scaled = lambda turn: _normal(F.zip_with(now, target, lambda w, t: F.greatest(F.lit(0.0), w + (t - w) * cap / turn)))
    return F.when(_total(target) > 0, _let(_moved(now, target), lambda turn: F.when(turn <= cap, target).otherwise(scaled(turn)))).otherwise(now)


def _placed(rows: DataFrame, key: str, every: int) -> DataFrame:
    """rows with k, the rebalance that they follow, and step, the dates since then; dates are numbered in each strategy."""
    dates = rows.select(key, "date").distinct()
    pos = F.row_number().over(Window.partitionBy(key).orderBy("date")) - 1  # a row for each date
    dates = dates.withColumn("pos", pos).select(key, "date", F.expr(f"pos div {every}").alias("k"), (F.col("pos") % every).alias("step"))
    return rows.join(dates, [key, "date"])


def trades(placed: DataFrame, key: str, cap: float, every: int) -> DataFrame:
    """key, k, turnover, asset, w: what each rebalance trades into, of `_placed` rows with key, date, asset, target, next."""
    grown = placed.groupBy(key, "k", "asset").agg(F.product(1 + F.col("next")).alias("growth"), F.count("*").alias("n")).where(F.col("n") == every)
    grown = grown.select(key, (F.col("k") + 1).alias("k"), "asset", "growth")  # assets that went out of the table in between are sold
    present = placed.where("step = 0").select(key, "k", "asset", "target").join(grown, [key, "k", "asset"], "left")
    names = placed.select(key, "asset").distinct()
    grid = placed.where("step = 0").select(key, "k").distinct().join(names, key).join(present, [key, "k", "asset"], "left")
    grid = grid.fillna(0.0, ["target", "growth"])
    vectors = grid.groupBy(key, "k").agg(F.array_sort(F.collect_list(F.struct("asset", "target", "growth"))).alias("v"))
    field = lambda c: F.transform("v", lambda x: x[c])
    vectors = vectors.select(key, F.struct("k", field("target").alias("target"), field("growth").alias("growth")).alias("x"), field("asset").alias("assets"))
    folded = vectors.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("xs"), F.first("assets").alias("assets"))
    out_type = "array<struct<k:bigint,turnover:double,w:array<double>>>"
    start = F.struct(F.transform("assets", lambda _: F.lit(0.0)).alias("w"), F.array().cast(out_type).alias("out"))

    def step(state: Column, x: Column) -> Column:
        def done(now: Column, new: Column) -> Column:
            row = F.struct(x["k"].alias("k"), _moved(now, new).alias("turnover"), new.alias("w"))
            return F.struct(new.alias("w"), F.concat(state["out"], F.array(row)).cast(out_type).alias("out"))

        drifted = F.zip_with(state["w"], x["growth"], lambda w, g: w * g)
        return _let(_normal(drifted), lambda now: _let(_traded(now, x["target"], cap), lambda new: done(now, new)))

    out = folded.select(key, "assets", F.explode(F.aggregate("xs", start, step)["out"]).alias("t"))
    return out.select(key, "t.k", "t.turnover", F.explode(F.arrays_zip("assets", F.col("t.w").alias("w"))).alias("a")).select(key, "k", "turnover", F.col("a.assets").alias("asset"), F.col("a.w").alias("w"))


def simulate(targets: DataFrame, key: str, cap: float = 0.35, cost: float = 0.001, every: int = 3) -> tuple[DataFrame, DataFrame]:
    """A strategy's rows by date and by rebalance, of rows (key, date, asset, target, next).

    By date: gross and net return, turnover and cost (0 between rebalances), whether it is a rebalance, number of positions, the
    largest weight, names by weight and the wealth so far. By rebalance: turnover, cost, number of positions, the five largest.
    An asset without a row at a date, or without a next return, isn't held then: the others share its weight.
    """
    placed = staged(_placed(staged(targets.where("next is not null").select(key, "date", "asset", F.coalesce("target", F.lit(0.0)).alias("target"), "next")), key, every))
    earlier = Window.partitionBy(key, "asset", "k").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)  # under `every` rows
    growth = F.when(F.count("*").over(earlier) == F.col("step"), F.coalesce(F.product(1 + F.col("next")).over(earlier), F.lit(1.0))).otherwise(0.0)
    rows = placed.withColumn("growth", growth).join(staged(trades(placed, key, cap, every)), [key, "k", "asset"])
    rows = rows.withColumn("v", F.col("w") * F.col("growth"))
    total = F.sum("v").over(Window.partitionBy(key, "date"))
    rows = staged(rows.withColumn("w", F.when(total > 0, F.col("v") / total).otherwise(0.0)))
    held = F.col("w") > LEAST
    names = F.array_sort(F.collect_list(F.when(held, F.struct((-F.round("w", 12)).alias("w"), "asset"))))
    first = F.col("step") == 0
    dates = rows.groupBy(key, "date", "step").agg(
        F.sum(F.col("w") * F.col("next")).alias("gross"), F.first("turnover").alias("turnover"), F.count_if(held).alias("n_positions"), F.max("w").alias("largest_weight"),
        F.array_join(F.transform(names, lambda x: x["asset"]), " | ").alias("names"))
    turned = F.when(first, F.col("turnover")).otherwise(0.0)
    dates = dates.select(key, "date", first.alias("rebalance"), "gross", turned.alias("turnover"), (cost * turned).alias("cost"), (F.col("gross") - cost * turned).alias("net"), "n_positions", "largest_weight", "names")
    rows, dates = staged(rows.where(first & held).select(key, "date", "asset", F.round("w", 12).alias("w"))), staged(dates)
    so_far = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # a row for each date
    dates = dates.withColumn("equity", F.product(1 + F.col("net")).over(so_far))
    top = positions_text(rows, [key, "date"]).withColumnRenamed("positions", "top_positions")
    rebalances = dates.where("rebalance").select(key, "date", "turnover", "cost", "n_positions").join(top, [key, "date"], "left")
    return dates, rebalances

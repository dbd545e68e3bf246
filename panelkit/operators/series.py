"""Series in long form (asset, date, value): bars, returns, trailing and expanding features, regimes, curves.

One window specification for each asset serves all features of a table, so a table is shuffled once.
"""

from __future__ import annotations

import functools
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def by(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def back(w: WindowSpec, rows: int) -> WindowSpec:
    return w.rowsBetween(1 - rows, 0)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def period_label(date: str, unit: str) -> Column:
    """Start of the day's month, quarter or (Monday) week; `friday_week` is labelled by its Friday."""
    return F.next_day(F.date_sub(F.col(date), 1), "FRI") if unit == "friday_week" else F.trunc(date, unit)


def bars(prices: DataFrame, unit: str = "month", last: tuple[str, ...] = ("close",), sums: tuple[str, ...] = (), key: str = "asset") -> DataFrame:
    """(key, period, last_date, last values, sums). Both labels are kept: the period and its last traded day."""
    aggregates = [F.max("date").alias("last_date"), *(F.max_by(c, "date").alias(c) for c in last), *(F.sum(c).alias(c) for c in sums)]
    return prices.groupBy(key, period_label("date", unit).alias("period")).agg(*aggregates)


def change(c: str, w: WindowSpec, rows: int = 1) -> Column:
    """Growth over a number of rows."""
    return F.col(c) / F.lag(c, rows).over(w) - 1


def log_change(c: str, w: WindowSpec) -> Column:
    """T4."""
    return F.log(F.col(c) / F.lag(c).over(w))


def forward(c: str, w: WindowSpec, rows: int, years: float | None = None) -> Column:
    """The return over the next rows, by row and not by calendar; yearly if years is given."""
    growth = F.lead(c, rows).over(w) / F.col(c)
    return (growth if years is None else F.pow(growth, 1 / years)) - 1


def trailing(aggregate: Column, c: str, w: WindowSpec, rows: int) -> Column:
    """An aggregate over the last rows; null until there are as many values."""
    return F.when(F.count(c).over(back(w, rows)) == rows, aggregate.over(back(w, rows)))


def fill_forward(panel: DataFrame, value: str = "close", key: str = "asset") -> DataFrame:
    """T5: gaps on the grid of dates and assets take the last value; assets that still have gaps are dropped."""
    dates, keys = panel.select("date").distinct(), panel.groupBy(key).agg(F.min("date").alias("first"))
    start = panel.agg(F.min("date").alias("start"))
    whole = keys.crossJoin(F.broadcast(start)).where("first = start").select(key)  # one row against the assets
    cells = dates.join(whole)  # the grid itself
    filled = cells.join(panel.select(key, "date", value), [key, "date"], "left")
    return filled.withColumn(value, F.last(value, ignorenulls=True).over(so_far(by(key))))


def complete_dates(panel: DataFrame, key: str = "asset") -> DataFrame:
    """Rows of the dates on which every asset has a value."""
    n = panel.agg(F.countDistinct(key)).first()[0]
    full = panel.where("close is not null").groupBy("date").agg(F.countDistinct(key).alias("n")).where(F.col("n") == n)
    return panel.join(full.select("date"), "date", "left_semi")


def convert(returns: DataFrame, fx: DataFrame, keys: list[str], method: str = "log_additive") -> DataFrame:
    """(keys, r) less (keys, fx). `exact` divides the simple return by one plus that of the currency."""
    joined = returns.join(fx, keys)
    exact = F.log1p(F.expm1("r") / (1 + F.expm1("fx")))
    return joined.withColumn("r_converted", F.col("r") - F.col("fx") if method == "log_additive" else exact)


def hedged(r: str, home_rate: str, foreign_rate: str) -> Column:
    """The return and a month's share of the difference of the yearly rates, in percent."""
    return F.col(r) + (F.col(home_rate) - F.col(foreign_rate)) / 12 / 100


def cash_return(rate: str) -> Column:
    """T12."""
    return F.log1p(F.col(rate) / 1200)


def to_panel(long: DataFrame, keys: list[str], value: str = "r", key: str = "asset") -> DataFrame:
    """One column for each of the fixed keys, outer-aligned on date."""
    return long.groupBy("date").pivot(key, keys).agg(F.first(value))


def null_counts(panel: DataFrame, columns: list[str]) -> DataFrame:
    """One row, how many values each column lacks."""
    return panel.select(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))


def require_full(panel: DataFrame, columns: list[str], fail: bool = True) -> DataFrame:
    """The panel; columns that lack values are an error, or a warning and dates that are left out."""
    lacking = {c: n for c, n in null_counts(panel, columns).first().asDict().items() if n}
    if lacking and fail:
        raise ValueError(f"columns lack values: {lacking}")
    if lacking:
        warnings.warn(f"columns lack values: {lacking}", stacklevel=2)
    return panel.dropna(subset=columns)


def common_dates(*series: DataFrame) -> DataFrame:
    """The dates that all series have."""
    return functools.reduce(DataFrame.intersect, (s.select("date") for s in series))


def expanding_regime(value: str, w: WindowSpec, least: int = 36) -> Column:
    """K1: high / middle / low against the quartiles of earlier rows; null before enough of them. High is tested first."""
    past = before(w)
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).over(past)
    label = F.when(F.col(value) >= q[1], "high").when(F.col(value) <= q[0], "low").otherwise("middle")
    return F.when((F.count(value).over(past) >= least) & F.col(value).isNotNull(), label)


def z_score(value: str, group: WindowSpec) -> Column:
    """K5: population z-score in the group; 0 for every row of a constant group."""
    sd = F.stddev_pop(value).over(group)
    return F.when(sd == 0, 0.0).otherwise((F.col(value) - F.avg(value).over(group)) / sd)


def scored(df: DataFrame, formulas: dict[str, tuple[tuple[str, float], ...]], *keys: str) -> DataFrame:
    """K6: for each formula of (column, coefficient) raw_NAME, the first column's z-score with its sign alone, and adj_NAME,
    the sum of all. Every z-score is taken over the same groups, so one shuffle serves all."""
    w = Window.partitionBy(*keys)
    z = {c: z_score(c, w) for f in formulas.values() for c, _ in f}
    df = df.withColumns({f"z_{c}": x for c, x in z.items()})
    total = lambda f: sum((k * F.col(f"z_{c}") for c, k in f[1:]), f[0][1] * F.col(f"z_{f[0][0]}"))
    sign = lambda k: 1.0 if k > 0 else -1.0
    return df.withColumns({n: x for k, f in formulas.items() for n, x in ((f"raw_{k}", sign(f[0][1]) * F.col(f"z_{f[0][0]}")), (f"adj_{k}", total(f)))}).drop(*(f"z_{c}" for c in z))


def percentile_rank(value: str, *keys: str) -> Column:
    """K7: share of the rows at or below, ties at their mean rank."""
    ties = F.count(value).over(Window.partitionBy(*keys, value))
    return (F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (ties - 1) / 2) / F.count(value).over(Window.partitionBy(*keys))


def buckets(df: DataFrame, signal: str, keys: list[str], order: list[str], k: int = 4) -> DataFrame:
    """K3: low / middle / high by equal-count buckets (larger ones first), with the cut-offs."""
    n = F.ntile(k).over(Window.partitionBy(*keys).orderBy(signal, *order))
    df = df.withColumn("bucket", n)
    w = Window.partitionBy(*keys)
    label = F.when(F.col("bucket") == 1, "low").when(F.col("bucket") == k, "high").otherwise("middle")
    return df.select("*", label.alias("label"), F.max(F.when(F.col("bucket") == 1, F.col(signal))).over(w).alias("low_cut"), F.min(F.when(F.col("bucket") == k, F.col(signal))).over(w).alias("high_cut"))


def sigma_split(signal: str, *keys: str) -> Column:
    """K4: outside one population standard deviation of the mean."""
    w = Window.partitionBy(*keys)
    mean, sd = F.avg(signal).over(w), F.stddev_pop(signal).over(w)
    return F.when(F.col(signal) >= mean + sd, "high").when(F.col(signal) <= mean - sd, "low").otherwise("middle")


def wealth(r: str, w: WindowSpec) -> Column:
    """K8: product of one plus the returns so far."""
    return F.exp(F.sum(F.log1p(r)).over(so_far(w)))


def with_curve(df: DataFrame, r: str, keys: list[str], order: str = "date") -> DataFrame:
    """K8: wealth and drawdown; each key is one series of one row a period."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn("wealth", wealth(r, w))
    return df.withColumn("drawdown", F.col("wealth") / F.max("wealth").over(so_far(w)) - 1)


def calendar_window(days: int, *keys: str) -> WindowSpec:
    """So many days, the row's own the last of them."""
    return Window.partitionBy(*keys).orderBy(F.unix_date("date")).rangeBetween(1 - days, 0)


def rolling_correlations(df: DataFrame, x: str, y: str, days: int, keys: list[str], least: int = 2, name: str = "corr") -> DataFrame:
    """K9: df with the correlation over the calendar window of so many days that ends with the row's; null under `least` pairs
    or where one side is constant.

    A frame isn't summed up again for each row: sums from the start on are running values, and those at the frame's left end are
    the last ones before it, found by sorting all left ends among the rows. Both passes only move forward, so the work is linear
    in rows, whatever the window's length. Values are centred by series first, so that differences of sums keep their digits.
    """
    means = df.groupBy(*keys).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    a, b = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    both = a.isNotNull() & b.isNotNull()
    parts = {"n": F.lit(1.0), "x": a, "y": b, "xx": a * a, "yy": b * b, "xy": a * b}
    day = F.unix_date("date")
    upto = Window.partitionBy(*keys).orderBy(day).rangeBetween(Window.unboundedPreceding, 0)
    sums = F.struct(*(F.coalesce(F.sum(F.when(both, v)).over(upto), F.lit(0.0)).alias(k) for k, v in parts.items()))
    rows = df.join(means, keys).withColumn("_sums", sums)
    ends = rows.select(*keys, (day - days).alias("_day"), F.lit(1).alias("_kind"), F.lit(None).cast(rows.schema["_sums"].dataType).alias("_left"), F.struct(*(F.col(c) for c in df.columns), "_sums").alias("_row"))
    sources = rows.select(*keys, day.alias("_day"), F.lit(0).alias("_kind"), F.col("_sums").alias("_left"), F.lit(None).cast(ends.schema["_row"].dataType).alias("_row"))
    before = Window.partitionBy(*keys).orderBy("_day", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    every = sources.union(ends).withColumn("_left", F.last("_left", ignorenulls=True).over(before)).where("_kind = 1")
    part = lambda k: F.col(f"_row._sums.{k}") - F.coalesce(F.col(f"_left.{k}"), F.lit(0.0))
    n, scale = part("n"), lambda k: F.col(f"_row._sums.{k}")
    vx, vy = part("xx") - part("x") ** 2 / n, part("yy") - part("y") ** 2 / n
    moves = (n >= least) & (vx > 1e-13 * scale("xx")) & (vy > 1e-13 * scale("yy"))
    corr = F.when(moves, (part("xy") - part("x") * part("y") / n) / F.sqrt(F.when(moves, vx * vy)))
    return every.select(*(F.col(f"_row.{c}").alias(c) for c in df.columns), corr.alias(name))


def stacked(parts: dict[str, DataFrame], name: str) -> DataFrame:
    """The tables one below the other, with the name of each."""
    return functools.reduce(DataFrame.unionByName, (df.withColumn(name, F.lit(k)) for k, df in parts.items()))


def expanding_fit(df: DataFrame, x: str, y: str, keys: list[str], order: str, least: int = 20) -> DataFrame:
    """K2: alpha, beta and forecast of the rows so far, the current one included, from the least-th row on."""
    w = so_far(Window.partitionBy(*keys).orderBy(order))
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    out = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"rn": rn, "beta": F.regr_slope(y, x).over(w), "alpha": F.regr_intercept(y, x).over(w)})
    return out.where(F.col("rn") >= least).withColumn("forecast", F.col("alpha") + F.col("beta") * F.col(x))


def fit_summary(fits: DataFrame, y: str, keys: list[str], order: str) -> DataFrame:
    """K2: of forecasts and outcomes their correlation, the mean and mean absolute error, and the last alpha, beta and forecast."""
    error = F.col(y) - F.col("forecast")
    last = [F.max_by(c, order).alias(f"last_{c}") for c in ("alpha", "beta", "forecast")]
    return fits.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("forecast", y).alias("corr"), F.avg(error).alias("mean_error"), F.avg(F.abs(error)).alias("mad"), *last)


def turnover(weights: DataFrame, keys: list[str], cost: float = 0.001) -> DataFrame:
    """Half the absolute change of weights between dates; null on the first, where the cost is 0."""
    last = F.lag("w").over(Window.partitionBy(*keys, "asset").orderBy("date"))
    out = weights.withColumn("moved", F.abs(F.col("w") - last)).groupBy(*keys, "date").agg((F.sum("moved") / 2).alias("turnover"))
    return out.withColumn("cost", cost * F.coalesce("turnover", F.lit(0.0)))


def instability(points: DataFrame, columns: list[str], keys: list[str], order: Column) -> DataFrame:
    """Change of each column from the point before; L1, L2 and largest jump. A null breaks the chain."""
    w = Window.partitionBy(*keys).orderBy(order)
    jumps = {f"d_{c}": F.col(c) - F.lag(c).over(w) for c in columns}
    out = points.withColumns(jumps)
    parts = [F.abs(f"d_{c}") for c in columns]
    l1 = sum(parts[1:], parts[0])
    l2 = F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))
    return out.withColumns({"l1": l1, "l2": l2, "max_jump": F.when(l1.isNotNull(), F.greatest(*parts)) if len(parts) > 1 else parts[0]}).withColumn("score", F.col("l1") + F.col("l2") + F.col("max_jump"))


def share(value: str, *keys: str) -> Column:
    """K14."""
    return F.col(value) / F.sum(value).over(Window.partitionBy(*keys))


def top_share(score: str, keys: list[str], tie: str, part: float = 0.25, least: int = 1) -> Column:
    """Is the row among the best part of its group, at least `least` of them?"""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie))
    n = F.count(score).over(Window.partitionBy(*keys))
    return rank <= F.least(n, F.greatest(F.lit(least), F.ceil(n * part)))


def ends(df: DataFrame, score: str, keys: list[str], tie: str, n: int = 3) -> DataFrame:
    """L3: the best and the worst n of each group, each row once."""
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie))
    worst = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score), F.desc(tie)))
    return df.withColumns({"best": best, "worst": worst}).where((F.col("best") <= n) | (F.col("worst") <= n))


def latest(df: DataFrame, keys: list[str], order: str = "date") -> DataFrame:
    """The last row of each key, by a partial aggregate."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("x")).select(*keys, "x.*")


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """L9."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def positions_text(weights: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """`T:12.34% | ...`, heaviest first."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("neg"), "asset")))
    text = F.transform(F.slice(ordered, 1, n), lambda x: F.format_string("%s:%.2f%%", x["asset"], -x["neg"] * 100))
    return weights.groupBy(*keys).agg(F.concat_ws(" | ", text).alias("positions"))

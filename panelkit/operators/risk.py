"""Summaries of return series and scenario risk, one row for each group; every aggregate combines before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelkit.functions.columns import sample_kurtosis, sample_skew
from panelkit.operators.series import with_curve
from panelkit.operators.staging import staged


def compound(r: str) -> Column:
    """A5."""
    return F.expm1(F.sum(F.log1p(r)))


def performance(df: DataFrame, r: str, keys: list[str], periods: int = 12, ddof: int = 1, order: str = "date", names: str | None = None) -> DataFrame:
    """A6 (ddof 1), A7 (ddof 0): yearly return and volatility, Sharpe, downside deviation, drawdown, Calmar, hit rate; with
    the column of the number of names held, its average."""
    sd = F.stddev_samp if ddof else F.stddev_pop
    low = F.when(F.col(r) < 0, F.col(r))
    sums = with_curve(df.where(F.col(r).isNotNull()), r, keys, order).groupBy(*keys).agg(
        F.count(r).alias("n"), F.exp(F.sum(F.log1p(r))).alias("growth"), sd(r).alias("sd"), F.coalesce(F.when(F.count(low) > 1, sd(low)), F.lit(0.0)).alias("sd_low"),
        F.min("drawdown").alias("max_drawdown"), F.avg((F.col(r) > 0).cast("double")).alias("hit_rate"),
        *([F.avg(names).alias("avg_names")] if names else []),
    )
    yearly, vol = F.pow("growth", periods / F.col("n")) - 1, F.col("sd") * periods**0.5
    return sums.select(
        *keys, "n", yearly.alias("annual_return"), vol.alias("annual_vol"), F.when(vol > 0, yearly / vol).alias("sharpe"), (F.col("sd_low") * periods**0.5).alias("downside"),
        "max_drawdown", F.when(F.col("max_drawdown") < 0, yearly / -F.col("max_drawdown")).alias("calmar"), "hit_rate", *(["avg_names"] if names else []),
    )


def tail_summary(df: DataFrame, r: str, keys: list[str], alpha: float = 0.05, risk_free: float = 0.0, periods: int = 52, order: str = "date") -> DataFrame:
    """Total and yearly return, Sharpe over a risk-free rate, drawdown, quantile VaR, mean at or below it,
    bias-corrected skew and kurtosis. Returns are written once: sums of doubles made a second time can differ in their last
    digit, and the row at the quantile would fall on either side of it."""
    df = staged(df)
    var = df.groupBy(*keys).agg(F.percentile(r, alpha).alias("var"))
    joined = with_curve(df.where(F.col(r).isNotNull()), r, keys, order).join(var, keys)
    out = joined.groupBy(*keys).agg(
        F.count(r).alias("n"), compound(r).alias("total_return"), F.stddev_samp(r).alias("sd"), F.min("drawdown").alias("max_drawdown"), F.first("var").alias("var"),
        F.avg(F.when(F.col(r) <= F.col("var"), F.col(r))).alias("cvar"), sample_skew(r).alias("skew"), sample_kurtosis(r).alias("kurtosis"),
    )
    yearly, vol = F.pow(1 + F.col("total_return"), periods / F.col("n")) - 1, F.col("sd") * periods**0.5
    return out.withColumns({"annual_return": yearly, "sharpe": F.when(vol > 0, (yearly - risk_free) / vol)}).drop("sd")


def weighted_var_cvar(losses: DataFrame, keys: list[str], alpha: float, loss: str = "loss", q: str = "q", tie: str = "scen_id") -> DataFrame:
    """VaR is the first loss at which the cumulated probability reaches alpha; CVaR adds the mean excess over it."""
    cum = F.sum(q).over(Window.partitionBy(*keys).orderBy(loss, tie).rowsBetween(Window.unboundedPreceding, 0))
    var = losses.withColumn("cum", cum).groupBy(*keys).agg(F.min(F.when(F.col("cum") >= alpha - 1e-12, F.col(loss))).alias("var"))
    excess = F.greatest(F.col(loss) - F.col("var"), F.lit(0.0)) * F.col(q)
    return losses.join(var, keys).groupBy(*keys).agg(F.first("var").alias("var"), (F.first("var") + F.sum(excess) / (1 - alpha)).alias("cvar"))


def tail_count_cvar(df: DataFrame, r: str, keys: list[str], alpha: float, tie: str) -> DataFrame:
    """Mean of the worst ceil((1 - alpha) n) losses."""
    n = F.count(r).over(Window.partitionBy(*keys))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(r, tie))
    return df.withColumns({"n": n, "rank": rank}).where(F.col("rank") <= F.ceil(F.round((1 - alpha) * F.col("n"), 9))).groupBy(*keys).agg((-F.avg(r)).alias("cvar"), F.count("*").alias("n_tail"))


def characteristics(df: DataFrame, r: str, keys: list[str], alpha: float = 0.95, tau: float = 0.0, benchmark: str | None = None) -> DataFrame:
    """Mean, deviation, mean absolute deviation, VaR and CVaR (strictly beyond it), lower partial moment, semivariance
    and semideviation; with the column of a benchmark's returns the tracking error, the root mean square of the difference. Returns are
    written once, as in `tail_summary`."""
    df = staged(df)
    first = df.groupBy(*keys).agg(F.avg(r).alias("mean"), F.percentile(r, round(1 - alpha, 12)).alias("quantile"))
    x, below = F.col(r) - F.col("mean"), F.greatest(F.lit(tau) - F.col(r), F.lit(0.0))
    sums = df.join(first, keys).groupBy(*keys).agg(
        F.first("mean").alias("mean"), F.stddev_pop(r).alias("sd"), F.avg(F.abs(x)).alias("mad"), (-F.first("quantile")).alias("var"),
        (-F.avg(F.when(F.col(r) < F.col("quantile"), F.col(r)))).alias("cvar"), F.avg(below).alias("lpm"), (F.sum(F.pow(F.least(x, F.lit(0.0)), F.lit(2.0))) / F.nullif(F.count(r) - 1, F.lit(0))).alias("semivariance"),
        *([F.sqrt(F.avg(F.pow(F.col(r) - F.col(benchmark), F.lit(2.0)))).alias("tracking_error")] if benchmark else []),
    )
    return sums.withColumn("semideviation", F.sqrt("semivariance"))


def dot(r: str | Column, w: str | Column) -> Column:
    """Sum of products of two arrays of one length."""
    return F.aggregate(F.zip_with(r, w, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def asset_moments(s: DataFrame, n: int, keys: tuple[str, ...] = (), q: str | None = None) -> DataFrame:
    """keys, mu, cov of scenarios r, one row a group: means and sample covariances, or, with probabilities q, expected values and
    covariances under them. A candidate's mean and variance are products with these, so candidates never meet scenarios."""
    x = [F.get("r", F.lit(k)) for k in range(n)]
    if q is None:
        return s.groupBy(*keys).agg(F.array(*map(F.avg, x)).alias("mu"), F.array(*(F.array(*(F.covar_samp(a, b) for b in x)) for a in x)).alias("cov"), F.count("*").alias("n"))
    mean = [F.sum(F.col(q) * a) for a in x]
    cov = F.array(*(F.array(*(F.sum(F.col(q) * a * b) - mean[i] * mean[j] for j, b in enumerate(x))) for i, a in enumerate(x)))
    return s.groupBy(*keys).agg(F.array(*mean).alias("mu"), cov.alias("cov"), F.count("*").alias("n"))


def variance(w: str = "w", cov: str = "cov") -> Column:
    """w' S w of an array of weights and one of rows."""
    return dot(F.transform(cov, lambda row: dot(row, w)), w)


def portfolio_losses(scenarios: DataFrame, candidates: DataFrame) -> DataFrame:
    """(cand_id, scen_id, q, loss) of every candidate in every scenario: candidates are a table of parameters."""
    return scenarios.join(candidates).select("cand_id", "scen_id", "q", (-dot("r", "w")).alias("loss"))


def portfolio_metrics(scenarios: DataFrame, candidates: DataFrame, benchmark: tuple[float, ...], alpha: float) -> DataFrame:
    """cand_id, expected, CVaR of full and of demeaned returns, the same of what is active against the benchmark,
    distances to it, concentration, turnover from it.

    CVaR moves with a constant added to all losses: demeaned figures are the full ones plus the expected return.
    """
    bench = F.array(*map(F.lit, benchmark))
    x = scenarios.join(candidates).select("cand_id", "scen_id", "q", (-dot("r", "w")).alias("full"), (dot("r", bench) - dot("r", "w")).alias("active"))  # J10
    sums = x.groupBy("cand_id").agg((-F.sum(F.col("q") * F.col("full"))).alias("expected"), (-F.sum(F.col("q") * F.col("active"))).alias("ahead"))
    losses = x.select("cand_id", "scen_id", "q", F.explode(F.create_map(F.lit("full"), "full", F.lit("active"), "active")).alias("kind", "loss"))
    cvar = weighted_var_cvar(losses, ["cand_id", "kind"], alpha).groupBy("cand_id").pivot("kind", ["full", "active"]).agg(F.first("cvar"))
    gap, add = F.zip_with("w", bench, lambda a, b: a - b), lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, v: s + v)
    l1, hhi = add(F.transform(gap, F.abs)), dot("w", "w")
    own = candidates.select("cand_id", l1.alias("l1"), F.sqrt(add(F.transform(gap, lambda v: v * v))).alias("l2"), hhi.alias("hhi"), F.array_max("w").alias("max_weight"), (1 / hhi).alias("effective_n"), l1.alias("turnover"))
    out = cvar.join(sums, "cand_id").join(own, "cand_id")
    return out.select(
        "cand_id", "expected", F.col("full").alias("cvar_full"), (F.col("full") + F.col("expected")).alias("cvar_demeaned"), F.col("active").alias("te_full"),
        (F.col("active") + F.col("ahead")).alias("te_demeaned"), "l1", "l2", "hhi", "max_weight", "effective_n", "turnover",
    )


def sweep_limits(points: DataFrame, at: str, risk: str, requested: float, buffer: float, factor: float) -> DataFrame:
    """Lowest, highest and mean risk of a sweep and where they are; the effective absolute limit, which is never under
    the highest and a buffer; and the limits that a factor of each risk gives."""
    top = F.max(risk) + buffer
    return points.agg(
        F.min(risk).alias("lowest"), F.min_by(at, risk).alias("at_lowest"), F.max(risk).alias("highest"), F.max_by(at, risk).alias("at_highest"), F.avg(risk).alias("mean"),
        F.greatest(top, F.lit(requested)).alias("effective_limit"), (F.lit(requested) < top).alias("adjusted"), (F.min(risk) * factor).alias("factor_lowest"), (F.max(risk) * factor).alias("factor_highest"),
    )


def mixed_risk(measures: DataFrame, first: str, others: list[str], steps: int) -> DataFrame:
    """For each other measure and each mix of it with the first, both scaled to 0 .. 1, the candidate of least risk."""
    ends = measures.agg(*(f(c).alias(f"{n}_{c}") for c in (first, *others) for n, f in (("lo", F.min), ("hi", F.max))))
    part = lambda c: (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))
    scaled = measures.crossJoin(F.broadcast(ends)).select("cand_id", part(first).alias("a"), F.explode(F.create_map(*(x for c in others for x in (F.lit(c), part(c))))).alias("measure", "b"))  # one row
    mixes = scaled.withColumn("mix", F.explode(F.array(*(F.lit(i / (steps - 1)) for i in range(steps)))))
    risk = F.col("mix") * F.col("a") + (1 - F.col("mix")) * F.col("b")
    return mixes.withColumn("risk", risk).groupBy("measure", "mix").agg(F.min_by("cand_id", F.struct(F.round("risk", 9), "cand_id")).alias("cand_id"), F.min("risk").alias("risk"), F.count("*").alias("n"))


def diversification(weights: DataFrame, keys: list[str], least: float = 0.01) -> DataFrame:
    """Entropy and concentration of weights in long form."""
    w = F.col("w")
    out = weights.groupBy(*keys).agg(
        F.sum(F.when(w > 0, -w * F.log(w)).otherwise(0.0)).alias("entropy"), F.sum(w * w).alias("hhi"), F.max(w).alias("max_weight"),
        F.aggregate(F.slice(F.sort_array(F.collect_list(w), asc=False), 1, 3), F.lit(0.0), lambda s, x: s + x).alias("top3"), F.count_if(w > least).alias("n_names"),
    )
    return out.withColumns({"effective_n": F.exp("entropy"), "effective_n_hhi": 1 / F.col("hhi")})


def bin_edges(df: DataFrame, r: str) -> tuple[float, float]:
    low, high = df.agg(F.min(r), F.max(r)).first()
    return low, high


def histogram_entropy(df: DataFrame, r: str, keys: list[str], edges: tuple[float, float], bins: int = 20) -> DataFrame:
    """-sum p ln p over bins common to all groups; values outside are clipped to the end bins."""
    low, high = edges
    width = (high - low) / bins
    bin_ = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(r) - low) / width))) if width else F.lit(0)
    return _entropy(df.groupBy(*keys, bin_.alias("bin")).count(), keys, bins)


def downside_entropy(df: DataFrame, r: str, keys: list[str], edges: tuple[float, float], bins: int = 20) -> DataFrame:
    """Negative returns keep their bins (bins - 1 up to zero), all positive ones share one."""
    low = min(edges[0], -1e-12)
    width = -low / (bins - 1)
    bin_ = F.when(F.col(r) > 0, F.lit(-1)).otherwise(F.greatest(F.lit(0), F.least(F.lit(bins - 2), F.floor((F.col(r) - low) / width))))
    return _entropy(df.groupBy(*keys, bin_.alias("bin")).count(), keys, bins)


def _entropy(counts: DataFrame, keys: list[str], bins: int) -> DataFrame:
    p = F.col("count") / F.sum("count").over(Window.partitionBy(*keys))
    return counts.withColumn("p", p).groupBy(*keys).agg(F.sum(-F.col("p") * F.log("p")).alias("entropy")).withColumn("normalised", F.col("entropy") / F.log(F.lit(float(bins))))


def terminal_returns(paths: DataFrame, keys: list[str], horizons: tuple[int, ...], month: str = "month", r: str = "log_ret") -> DataFrame:
    """The simple return of the first h months for each h, in one shuffle, and its yearly rate."""
    out = paths.groupBy(*keys).agg(*(F.expm1(F.sum(F.when(F.col(month) <= h, F.col(r)))).alias(f"ret_{h}") for h in horizons))
    return out.withColumns({f"yearly_{h}": F.pow(1 + F.col(f"ret_{h}"), 12.0 / h) - 1 for h in horizons})


def check_scenarios(paths: DataFrame, p: DataFrame, horizons: tuple[int, ...] | None = None, month: str = "month") -> DataFrame:
    """How many rows break each rule: probabilities, their sum, finite returns, one length for all paths; of the given
    horizons those that some path doesn't have, and of those that paths have the ones that aren't given."""
    shape = paths.groupBy("scen_id", "asset").count().agg(F.countDistinct("count").alias("n_lengths"))
    bad = paths.agg(F.count_if(F.col("log_ret").isNull() | F.isnan("log_ret")).alias("not_finite"))
    prob = p.agg(F.count_if(F.col("p") < 0).alias("negative_p"), (F.abs(F.sum("p") - 1) > 1e-8).cast("long").alias("bad_sum"))
    out = shape.crossJoin(bad).crossJoin(prob)  # three tables of one row
    if horizons is None:
        return out
    n_paths = paths.select("scen_id", "asset").distinct().count()
    have = paths.groupBy(F.col(month).cast("long").alias("h")).agg(F.countDistinct("scen_id", "asset").alias("n"))
    given = F.col("h").isin(*horizons)
    keys = have.agg((F.lit(len(horizons)) - F.count_if(given & (F.col("n") == n_paths))).cast("long").alias("horizons_missing"), F.count_if(~given).alias("horizons_unknown"))
    return out.crossJoin(keys)  # one row


def feasible_summary(df: DataFrame, keys: list[str], feasible: Column, means: list[str], top: str) -> DataFrame:
    """A1: of each group the rows, the feasible and the infeasible ones, and of the feasible ones the means and the largest
    value. One aggregate keeps groups without feasible rows, which a filter and a join would have to bring back."""
    of = lambda c: F.when(feasible, F.col(c))
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count(of(top)).alias("feasible"), *(F.avg(of(c)).alias(f"avg_{c}") for c in means), F.max(of(top)).alias(f"max_{top}"))
    return out.withColumn("infeasible", F.col("n") - F.col("feasible"))


def ols(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Correlation and simple regression, null with fewer than two rows or a constant side."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    sums = both.groupBy(*keys).agg(F.count("*").alias("n"), F.corr(x, y).alias("corr"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    varies_x, varies = (F.col("n") > 1) & (F.col("x0") < F.col("x1")), (F.col("n") > 1) & (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))
    return sums.select(*keys, "n", F.when(varies, F.col("corr")).alias("corr"), F.when(varies_x, F.col("slope")).alias("slope"), F.when(varies_x, F.col("intercept")).alias("intercept"))


def weighted_mean(value: str, weight: str) -> Column:
    """A3: a null weight counts as one; the plain mean if weights sum to zero."""
    w = F.when(F.col(value).isNotNull(), F.coalesce(F.col(weight).cast("double"), F.lit(1.0)))
    return F.when(F.sum(w) == 0, F.avg(value)).otherwise(F.sum(F.col(value) * w) / F.sum(w))


def quartile_labels(df: DataFrame, value: str, keys: list[str], names: tuple[str, str, str] = ("low", "middle", "high")) -> DataFrame:
    """Quartile cut-offs of each group and a three-way label, the high one tested first."""
    cuts = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    out = df.join(cuts, keys) if keys else df.crossJoin(F.broadcast(cuts))  # without keys: one row of cut-offs
    label = F.when(F.col(value) >= F.col("q")[1], names[2]).when(F.col(value) <= F.col("q")[0], names[0]).otherwise(names[1])
    return out.withColumns({"q25": F.col("q")[0], "q75": F.col("q")[1], "label": label}).drop("q")

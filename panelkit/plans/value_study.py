"""Relative value, allocation, signal and rebalancing studies, and forecasts merged over horizons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelkit.functions import columns as C
from panelkit.operators import covariance as V
from panelkit.operators import joins as J
from panelkit.operators import merging as G
from panelkit.operators import regression as Q
from panelkit.operators import risk as R
from panelkit.operators import series as S
from panelkit.plans.registry import SQL, query, read
from panelkit.plans.strategies import score_panel, score_returns
from panelkit.plans.tables import SQL_daily, SQL_monthly, daily, monthly, weekly, returns

QW = "PARTITION BY asset ORDER BY date"

# ---- K6, A18, B13: scores, regressions and their mix ----
# Weights of the z-scores of each score.
FORMULAS = {
    "pe": (("pe", -1.0), ("growth", 0.8), ("payout", 0.4), ("beta", -0.6)),
    "pbv": (("pbv", -1.0), ("roe", 1.0), ("roic", 0.4), ("coe", -0.4)),
    "ps": (("ps", -1.0), ("margin", 1.0), ("fgrowth", 0.7), ("beta", -0.5)),
    "ev": (("ev", -1.0), ("roic", 0.8), ("opm", 0.5), ("capex", -0.6), ("coc", -0.4)),
}
SPECS = (Q.Spec("pe", "pe", ("growth", "payout", "beta")), Q.Spec("pbv", "pbv", ("roe",)), Q.Spec("ps", "ps", ("margin", "fgrowth")), Q.Spec("ev", "ev", ("roic", "opm"), lower_is_cheaper=False))
_LINE = {
    "pe": "avg(l_extendedprice / l_quantity)", "growth": "avg(l_discount)", "payout": "avg(l_tax)", "beta": "stddev_pop(l_quantity) / avg(l_quantity)", "pbv": "avg(l_extendedprice) / 1000", "roe": "avg(l_discount * l_quantity)",
    "roic": "avg(l_tax * l_quantity)", "coe": "stddev_pop(l_discount)", "margin": "avg(l_extendedprice * (1 - l_discount)) / avg(l_extendedprice)", "fgrowth": "avg(CASE WHEN l_returnflag = 'R' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)",
    "ev": "max(l_extendedprice) / avg(l_quantity) / 100", "opm": "avg(CASE WHEN l_linestatus = 'O' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)", "capex": "avg(l_linenumber)", "coc": "avg(l_tax * l_discount)",
}
SQL_frame = f"""WITH l AS (SELECT p_brand || ' ' || p_type AS name, {', '.join(f'{x} AS {c}' for c, x in _LINE.items())} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
p AS (SELECT p_brand || ' ' || p_type AS name, avg(p_retailprice) / avg(p_size) AS ps, avg(p_size) AS capex FROM part GROUP BY 1) SELECT name, substr(name, 1, 7) AS region, {', '.join('coalesce(l.capex, p.capex) AS capex' if c == 'capex' else c for c in _LINE)}, ps FROM p FULL JOIN l USING (name)"""


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, region and the measures of two sources, each measure from the first source that has it."""
    part = read(spark, sf_dir, "part").withColumn("name", F.concat_ws(" ", "p_brand", "p_type"))
    line = read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("name").agg(*(F.expr(x).alias(c) for c, x in _LINE.items()))
    own = part.groupBy("name").agg((F.avg("p_retailprice") / F.avg("p_size")).alias("ps"), F.avg("p_size").alias("capex"))
    fields = {c: [(0, c)] for c in _LINE} | {"ps": [(1, "ps")], "capex": [(0, "capex"), (1, "capex")]}
    return J.by_priority([line, own], "name", fields).withColumn("region", F.substring("name", 1, 7))


def _z(c: str) -> str:
    return f"(CASE WHEN stddev_pop({c}) OVER p = 0 THEN 0 ELSE ({c} - avg({c}) OVER p) / stddev_pop({c}) OVER p END)"


_MEAN = lambda cs: f"list_avg(list_filter([{', '.join(cs)}], lambda x: x IS NOT NULL))"
SQL_scores = f"""SELECT name, region, {', '.join(f"{_z(f[0][0])} * -1 AS raw_{k}, {' + '.join(f'{w} * {_z(c)}' for c, w in f)} AS adj_{k}" for k, f in FORMULAS.items())} FROM ({SQL_frame}) WINDOW p AS (PARTITION BY region)"""
SQL_composites = f"""SELECT name, region, {_MEAN([f'raw_{k}' for k in FORMULAS])} AS raw, {_MEAN([f'adj_{k}' for k in FORMULAS])} AS adjusted FROM ({SQL_scores})"""


def scores(f: DataFrame) -> DataFrame:
    """K6: raw and adjusted scores of each measure, their means, and what the adjustments add."""
    out = S.scored(f, {k: v for k, v in FORMULAS.items()}, "region")
    raw, adjusted = C.row_mean(*(f"raw_{k}" for k in FORMULAS)), C.row_mean(*(f"adj_{k}" for k in FORMULAS))
    return out.withColumns({"raw": raw, "adjusted": adjusted}).withColumn("overlay", F.col("adjusted") - F.col("raw"))


@query(f"SELECT *, adjusted - raw AS overlay FROM ({SQL_composites})", "raw adjusted overlay")
def k6_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(frame(spark, sf_dir)).select("name", "region", "raw", "adjusted", "overlay")


SQL_specs = {s.name: Q.fitted_sql(f"({SQL_frame})", "name", "region", s.target, s.predictors) for s in SPECS}
_SIGN = {s.name: "-" if s.lower_is_cheaper else "" for s in SPECS}
SQL_fits = " UNION ALL ".join(f"SELECT '{k}' AS spec, name, region, fitted, residual, {_SIGN[k]}residual AS mispricing, CASE WHEN stddev_pop(residual) OVER p = 0 THEN 0 ELSE {_SIGN[k]}residual / stddev_pop(residual) OVER p END AS z, 1 - sum(residual ** 2) OVER p / sum((y - avg_y) ** 2) OVER p AS r2 FROM ({q}) WINDOW p AS (PARTITION BY region)" for k, q in SQL_specs.items())


@query(f"SELECT f.name, f.region, s.spec, fitted, residual, mispricing, z FROM ({SQL_frame}) f CROSS JOIN (SELECT unnest(['pe', 'pbv', 'ps', 'ev']) AS spec) s LEFT JOIN ({SQL_fits}) x ON x.name = f.name AND x.spec = s.spec", "fitted residual mispricing z")
def a18_spec_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted values, residuals and mispricing of every spec; rows with a null come back as null."""
    fits, _ = Q.regress_suite(frame(spark, sf_dir), SPECS, "region")
    of = [F.struct(F.lit(s.name).alias("spec"), *(F.col(f"{s.name}_{c}").alias(c) for c in ("fitted", "residual", "mispricing", "z"))) for s in SPECS]
    return fits.select("name", "region", F.explode(F.array(*of)).alias("x")).select("name", "region", "x.*")


@query(f"SELECT region, spec, count(*)::BIGINT AS n, any_value(r2) AS r_squared FROM ({SQL_fits}) GROUP BY ALL", "r_squared")
def a18_spec_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, summary = Q.regress_suite(frame(spark, sf_dir), SPECS, "region")
    return summary.select("region", "spec", "n", "r_squared")


SQL_coefficients = " UNION ALL ".join(f"SELECT region, '{s.name}' AS spec, predictor, coefficient FROM ({Q.coefficients_sql(f'({SQL_frame})', 'region', s.target, s.predictors)})" for s in SPECS)


@query(SQL_coefficients, relative="coefficient")
def a18_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intercept and coefficients of every region and spec, by predictor."""
    _, summary = Q.regress_suite(frame(spark, sf_dir), SPECS, "region")
    return summary.select("region", "spec", F.explode("coefficients").alias("predictor", "coefficient"))


SQL_final = f"""SELECT name, region, raw, adjusted, reg, final, CASE WHEN final >= hi THEN 'cheap' WHEN final <= lo THEN 'expensive' ELSE 'neutral' END AS regime FROM (SELECT *, quantile_cont(final, 0.25) OVER p AS lo, quantile_cont(final, 0.75) OVER p AS hi FROM
(SELECT c.*, reg, 0.6 * adjusted + 0.4 * reg AS final FROM ({SQL_composites}) c LEFT JOIN (SELECT name, avg(z) AS reg FROM ({SQL_fits}) GROUP BY 1) USING (name)) WINDOW p AS (PARTITION BY region)) WHERE final IS NOT NULL"""
_ACTION = "CASE regime WHEN 'cheap' THEN 'overweight' WHEN 'expensive' THEN 'underweight' ELSE 'market_weight' END"


def value_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and regressions, the final score (0.6 and 0.4), regime by the region's quartiles, action."""
    fits, _ = Q.regress_suite(scores(frame(spark, sf_dir)), SPECS, "region")
    out = fits.withColumn("reg", C.row_mean(*(f"{s.name}_z" for s in SPECS))).withColumn("final", 0.6 * F.col("adjusted") + 0.4 * F.col("reg")).where("final is not null")
    out = R.quartile_labels(out, "final", ["region"], ("expensive", "neutral", "cheap")).withColumnRenamed("label", "regime")
    return out.withColumn("action", C.label_value("regime", {"cheap": "overweight", "expensive": "underweight"}, "market_weight"))


@query(f"SELECT *, {_ACTION} AS action FROM ({SQL_final})", "raw adjusted reg final")
def b13_value_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_model(spark, sf_dir).select("name", "region", "raw", "adjusted", "reg", "final", "regime", "action")


@query(f"""WITH f AS (SELECT *, {_ACTION} AS action, row_number() OVER (PARTITION BY region ORDER BY final DESC, name)::INT AS best, row_number() OVER (PARTITION BY region ORDER BY final, name DESC)::INT AS worst FROM ({SQL_final})) SELECT region, name, final, regime, action, best, worst FROM f WHERE best <= 5 OR worst <= 5""", "final")
def b13_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best and the five worst of each region."""
    return S.ends(value_model(spark, sf_dir), "final", ["region"], "name", 5).select("region", "name", "final", "regime", "action", "best", "worst")


@query(f"SELECT region, count(*)::BIGINT AS n, avg(final) AS final, avg(adjusted - raw) AS overlay, count(*) FILTER (regime = 'cheap')::BIGINT AS overweight, count(*) FILTER (regime = 'expensive')::BIGINT AS underweight FROM ({SQL_final}) GROUP BY 1", "final overlay")
def b13_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_model(spark, sf_dir).groupBy("region").agg(F.count("*").alias("n"), F.avg("final").alias("final"), F.avg("overlay").alias("overlay"), F.count_if(F.col("action") == "overweight").alias("overweight"), F.count_if(F.col("action") == "underweight").alias("underweight"))


# ---- B14: regions, cash, sectors, recommendations ----
_LABEL = lambda v, o, names: f"CASE WHEN {v} >= quantile_cont({v}, 0.75) OVER {o} THEN '{names[2]}' WHEN {v} <= quantile_cont({v}, 0.25) OVER {o} THEN '{names[0]}' ELSE '{names[1]}' END"
_CASE = lambda c, values, other: f"CASE {c} {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in values.items())} ELSE {other!r} END"
SQL_sectors = """SELECT substr(p_brand, 1, 7) AS region, CASE WHEN lower(p_name) ~ 'widget|bolt' THEN 'Industrials' WHEN lower(p_name) ~ 'ring|gem' THEN 'Materials' ELSE p_type END AS sector, count(*)::BIGINT AS n, sum(p_retailprice * p_size) / sum(p_size) AS score FROM part GROUP BY ALL"""
SQL_regions = f"""SELECT *, bench * m / greatest(1, sum(bench * m) OVER ()) AS target FROM (SELECT *, {_CASE('action', C.REGION_MULTIPLIERS, 1.0)}::DOUBLE AS m FROM (SELECT region, bench, {_LABEL('score', '()', ('underweight', 'neutral', 'overweight'))} AS action FROM (SELECT region, sum(n) / sum(sum(n)) OVER () AS bench, sum(score * n) / sum(n) AS score FROM ({SQL_sectors}) GROUP BY 1)))"""
_PAIRS = {f"{r}|{s}": both for r, s, both in C.COMBINED_ACTIONS}
SQL_weights = f"""WITH s AS (SELECT *, {_LABEL('score', '(PARTITION BY region)', ('underweight', 'market_weight', 'overweight'))} AS sector_action FROM ({SQL_sectors})), j AS (SELECT s.*, bench, target, {_CASE("action || '|' || sector_action", _PAIRS, 'market_weight')} AS portfolio_action, n / sum(n) OVER (PARTITION BY region) AS share FROM s JOIN ({SQL_regions}) USING (region)),
k AS (SELECT *, {_CASE('portfolio_action', C.ACTION_MULTIPLIERS, 1.0)}::DOUBLE * share AS raw FROM j), w AS (SELECT *, raw / sum(raw) OVER (PARTITION BY region) * target AS weight FROM k) SELECT region, sector, n, score, portfolio_action, {_CASE('portfolio_action', C.SIGNAL_SCORES, 0.0)}::DOUBLE AS signal, weight, weight - share * bench AS active FROM w"""


def region_targets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sectors (region, sector, n, score) and regions (region, bench, action, target); a row for each region."""
    name = C.sector_of("p_name", (("Industrials", "widget|bolt"), ("Materials", "ring|gem")), "")
    p = read(spark, sf_dir, "part").select(F.substring("p_brand", 1, 7).alias("region"), F.when(name == "", F.col("p_type")).otherwise(name).alias("sector"), "p_retailprice", "p_size")
    s = p.groupBy("region", "sector").agg(F.count("*").alias("n"), R.weighted_mean("p_retailprice", "p_size").alias("score"))
    r = s.groupBy("region").agg(F.sum("n").alias("n"), (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("score"))
    total = r.agg(F.sum("n").alias("total"))
    r = R.quartile_labels(r.crossJoin(F.broadcast(total)), "score", [], ("underweight", "neutral", "overweight")).withColumnRenamed("label", "action")  # one row
    r = r.select("region", (F.col("n") / F.col("total")).alias("bench"), "action").withColumn("wanted", F.col("bench") * C.label_value("action", C.REGION_MULTIPLIERS, 1.0))
    whole = r.agg(F.greatest(F.lit(1.0), F.sum("wanted")).alias("whole"))
    return s, r.crossJoin(F.broadcast(whole)).select("region", "bench", "action", (F.col("wanted") / F.col("whole")).alias("target"))  # one row


@query(f"SELECT region, bench, action, target FROM ({SQL_regions}) UNION ALL SELECT 'cash', 0, 'cash', 1 - sum(target) FROM ({SQL_regions})", "bench target")
def b14_region_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's share times its action's multiplier; what that leaves is cash."""
    _, r = region_targets(spark, sf_dir)
    cash = r.agg((1 - F.sum("target")).alias("target")).select(F.lit("cash").alias("region"), F.lit(0.0).alias("bench"), F.lit("cash").alias("action"), "target")
    return r.unionByName(cash)


def sector_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, r = region_targets(spark, sf_dir)
    s = R.quartile_labels(s, "score", ["region"], ("underweight", "market_weight", "overweight")).join(r, "region")
    s = s.withColumns({"portfolio_action": C.combine_actions("action", "label"), "share": S.share("n", "region")})
    s = s.withColumn("raw", C.label_value("portfolio_action", C.ACTION_MULTIPLIERS, 1.0) * F.col("share")).withColumn("weight", S.share("raw", "region") * F.col("target"))
    return s.select("region", "sector", "n", "score", "portfolio_action", C.label_value("portfolio_action", C.SIGNAL_SCORES, 0.0).alias("signal"), "weight", (F.col("weight") - F.col("share") * F.col("bench")).alias("active"))


@query(SQL_weights, "score signal weight active")
def b14_sector_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sector_weights(spark, sf_dir)


@query(f"""WITH w AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY weight DESC, sector)::INT AS best, row_number() OVER (PARTITION BY region ORDER BY weight, sector DESC)::INT AS worst FROM ({SQL_weights})) SELECT region, sector, portfolio_action, weight, active, best FROM w WHERE best <= 3 OR worst <= 3""", "weight active")
def b14_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest and the three smallest positions of each region, each once."""
    return S.ends(sector_weights(spark, sf_dir), "weight", ["region"], "sector", 3).select("region", "sector", "portfolio_action", "weight", "active", "best")


# ---- B12: proxies and the market overview ----
SQL_countries = """WITH a AS (SELECT c_nationkey AS k, count(*) AS n, sum(abs(c_acctbal)) / 1e6 AS cap, avg(c_acctbal) AS pe, max(c_acctbal) / 1e6 AS erp FROM customer GROUP BY 1), e AS (SELECT k, n, cap, 100 / pe - erp AS spread FROM a WHERE n >= 20 AND cap >= 0.02 AND pe > 0)
SELECT k, n, cap, spread, CASE WHEN spread >= quantile_cont(spread, 0.75) OVER () THEN 'overweight' WHEN spread <= quantile_cont(spread, 0.25) OVER () THEN 'underweight' ELSE 'neutral' END AS signal FROM e"""
SQL_regimes = f"SELECT asset, arg_max(regime, date) AS regime, arg_max(dy, date) AS dy FROM (SELECT asset, date, dividends / close AS dy, CASE WHEN close >= 1600 THEN 'high' WHEN close <= 1400 THEN 'low' ELSE 'middle' END AS regime FROM ({SQL_monthly()})) GROUP BY 1"


@query(
    f"""WITH m AS (SELECT n_nationkey, 'market ' || n_nationkey AS key, n_nationkey::VARCHAR AS proxy FROM nation), c AS (SELECT x.*, n_name FROM ({SQL_countries}) x JOIN nation ON n_nationkey = k)
    SELECT key, proxy, coalesce(n_name, key) AS name, signal, regime, dy, CASE WHEN s IS NULL THEN NULL WHEN s >= 0.5 THEN 'overweight' WHEN s <= -0.5 THEN 'underweight' ELSE 'neutral' END AS combined FROM (SELECT key, proxy, n_name, signal, regime, dy,
    list_avg(list_filter([{_CASE('signal', {'overweight': 1.0, 'neutral': 0.0, 'underweight': -1.0}, None).replace('None', 'NULL')}::DOUBLE, {_CASE('regime', {'high': 1.0, 'middle': 0.0, 'low': -1.0}, None).replace('None', 'NULL')}::DOUBLE], lambda v: v IS NOT NULL)) AS s FROM m LEFT JOIN c ON c.k = m.n_nationkey LEFT JOIN ({SQL_regimes}) r ON r.asset = m.proxy)""",
    "dy",
)
def b12_market_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets with their proxies, the countries' signals by normalised name (the key stands for a missing name), the proxy's
    latest regime, and the mean of both scores as the combined signal."""
    a = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), (F.sum(F.abs("c_acctbal")) / 1e6).alias("cap"), F.avg("c_acctbal").alias("pe"), (F.max("c_acctbal") / 1e6).alias("erp"))
    e = a.where("n >= 20 and cap >= 0.02 and pe > 0").select("c_nationkey", (C.ratio(F.lit(100.0), "pe") - F.col("erp")).alias("spread"))
    e = R.quartile_labels(e, "spread", [], ("underweight", "neutral", "overweight"))
    country = e.join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("Market-"), F.col("c_nationkey").cast("string")).alias("spelled"), F.col("n_name").alias("name"), F.col("label").alias("signal"))
    markets = read(spark, sf_dir, "nation").select(F.concat(F.lit("market "), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_nationkey").cast("string").alias("proxy"))
    m = monthly(spark, sf_dir).select("asset", "date", (F.col("dividends") / F.col("close")).alias("dy"), F.when(F.col("close") >= 1600, "high").when(F.col("close") <= 1400, "low").otherwise("middle").alias("regime"))
    both = J.on_name(markets, country, "key", "spelled").join(S.latest(m, ["asset"]).withColumnRenamed("asset", "proxy"), "proxy", "left")
    of = lambda c, values: F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), F.col(c))
    score = C.row_mean(of("signal", {"overweight": 1.0, "neutral": 0.0, "underweight": -1.0}), of("regime", {"high": 1.0, "middle": 0.0, "low": -1.0}))
    return both.select("key", "proxy", F.coalesce("name", "key").alias("name"), "signal", "regime", "dy", F.when(score >= 0.5, "overweight").when(score <= -0.5, "underweight").when(score.isNotNull(), "neutral").alias("combined"))


# ---- B11: three splits x three signals x three samples ----
SQL_splits = f"""WITH f AS (SELECT asset, date, close / 1000 AS x1, dividends / 100 AS x2, close / lag(close, 12) OVER w - 1 AS x3, lead(close, 6) OVER w / close - 1 AS y FROM ({SQL_monthly()}) WINDOW w AS ({QW})), u AS (SELECT asset, date, y, unnest(['close', 'div', 'momentum']) AS signal, unnest([x1, x2, x3]) AS x FROM f),
v AS (SELECT * FROM u WHERE x IS NOT NULL AND y IS NOT NULL), b AS (SELECT *, ntile(4) OVER o AS q, ntile(3) OVER o AS t, avg(x) OVER p AS m, stddev_pop(x) OVER p AS s FROM v WINDOW o AS (PARTITION BY signal, asset ORDER BY x, date), p AS (PARTITION BY signal, asset)),
k AS (SELECT asset, date, y, signal, x, unnest(['quartile', 'tercile', 'sigma']) AS method, unnest([CASE q WHEN 1 THEN 'low' WHEN 4 THEN 'high' ELSE 'middle' END, CASE t WHEN 1 THEN 'low' WHEN 3 THEN 'high' ELSE 'middle' END, CASE WHEN x >= m + s THEN 'high' WHEN x <= m - s THEN 'low' ELSE 'middle' END]) AS label FROM b),
e AS (SELECT *, unnest(['all', CASE WHEN label = 'middle' THEN 'middle' ELSE 'high_low' END]) AS sample FROM k)"""


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset, date, y, signal, x, method, label: all signals by all split methods; signals are unpivoted, methods exploded."""
    w = S.by("asset")
    f = monthly(spark, sf_dir).select("asset", "date", (F.col("close") / 1000).alias("x1"), (F.col("dividends") / 100).alias("x2"), S.change("close", w, 12).alias("x3"), S.forward("close", w, 6).alias("y"))
    u = f.select("asset", "date", "y", F.explode(F.create_map(F.lit("close"), "x1", F.lit("div"), "x2", F.lit("momentum"), "x3")).alias("signal", "x")).where("x is not null and y is not null")
    keys = ["signal", "asset"]
    u = S.buckets(u, "x", keys, ["date"]).withColumnRenamed("label", "quartile").drop("bucket", "low_cut", "high_cut")
    u = S.buckets(u, "x", keys, ["date"], 3).withColumnRenamed("label", "tercile").drop("bucket", "low_cut", "high_cut").withColumn("sigma", S.sigma_split("x", *keys))
    return u.select("asset", "date", "y", "signal", "x", F.explode(F.create_map(*(v for m in ("quartile", "tercile", "sigma") for v in (F.lit(m), F.col(m))))).alias("method", "label"))


def samples(labelled: DataFrame) -> DataFrame:
    return labelled.withColumn("sample", F.explode(F.array(F.lit("all"), F.when(F.col("label") == "middle", "middle").otherwise("high_low"))))


@query(f"{SQL_splits} SELECT method, signal, sample, asset, count(*)::BIGINT AS n, corr(x, y) AS corr, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM e GROUP BY ALL HAVING count(*) > 1", "corr slope intercept")
def b11_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ols(samples(splits(spark, sf_dir)), "x", "y", ["method", "signal", "sample", "asset"]).where("n > 1")


@query(
    f"""{SQL_splits}, g AS (SELECT *, row_number() OVER o AS rn, regr_slope(y, x) OVER o AS beta, regr_intercept(y, x) OVER o AS alpha FROM e WINDOW o AS (PARTITION BY method, signal, sample, asset ORDER BY date ROWS UNBOUNDED PRECEDING)), h AS (SELECT *, alpha + beta * x AS forecast FROM g WHERE rn >= 20)
    SELECT method, signal, sample, asset, count(*)::BIGINT AS n, avg(y - forecast) AS mean_error, avg(abs(y - forecast)) AS mad, arg_max(alpha, date) AS last_alpha, arg_max(beta, date) AS last_beta FROM h GROUP BY ALL""",
    "mean_error mad last_alpha last_beta",
)
def b11_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["method", "signal", "sample", "asset"]
    return S.fit_summary(S.expanding_fit(samples(splits(spark, sf_dir)), "x", "y", keys, "date"), "y", keys, "date").drop("corr", "last_forecast")


@query(
    f"""{SQL_splits}, c AS (SELECT method, signal, asset, sample, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM e GROUP BY ALL HAVING count(*) > 1), l AS (SELECT method, signal, asset, arg_max(x, date) AS value, arg_max(label, date) AS regime FROM k GROUP BY ALL)
    SELECT l.method, l.signal, l.asset, value, regime, o.a + o.b * value AS forecast_all, r.a + r.b * value AS forecast_regime FROM l JOIN c o ON o.method = l.method AND o.signal = l.signal AND o.asset = l.asset AND o.sample = 'all' LEFT JOIN c r ON r.method = l.method AND r.signal = l.signal AND r.asset = l.asset AND r.sample = CASE WHEN regime = 'middle' THEN 'middle' ELSE 'high_low' END""",
    "value forecast_all forecast_regime",
)
def b11_live_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signal's latest value and regime, and what the fits of all rows and of its regime's sample forecast."""
    keys = ["method", "signal", "asset"]
    labelled = splits(spark, sf_dir)
    fits = R.ols(samples(labelled), "x", "y", [*keys, "sample"]).where("n > 1").select(*keys, "sample", "slope", "intercept")
    last = S.latest(labelled, keys).select(*keys, F.col("x").alias("value"), F.col("label").alias("regime")).withColumn("own", F.when(F.col("regime") == "middle", "middle").otherwise("high_low"))
    fit = lambda n: fits.select(*keys, F.col("sample").alias(f"s_{n}"), F.col("slope").alias(f"b_{n}"), F.col("intercept").alias(f"a_{n}"))
    out = last.join(fit("all").where("s_all = 'all'"), keys).join(fit("own").withColumnRenamed("s_own", "own"), [*keys, "own"], "left")
    return out.select(*keys, "value", "regime", (F.col("a_all") + F.col("b_all") * F.col("value")).alias("forecast_all"), (F.col("a_own") + F.col("b_own") * F.col("value")).alias("forecast_regime"))


# ---- B7: monthly rebalances by variance and by entropy ----
_CANDS = "SELECT i * 11 + j AS cand, i / 10.0 AS wa, j / 10.0 AS wn, (10 - i - j) / 10.0 AS wr FROM range(11) t(i), range(11) u(j) WHERE i + j <= 10 AND greatest(i, j, 10 - i - j) <= 6"
WEEKS, BINS = 156, 20
SQL_rebalance = f"""WITH px AS (SELECT asset, date + CAST((5 - isodow(date) + 7) % 7 AS INTEGER) AS date, arg_max(close, date) AS close FROM ({SQL_daily()}) GROUP BY 1, 2), r AS (SELECT * FROM (SELECT asset, date, close / lag(close) OVER ({QW}) - 1 AS r FROM px) WHERE r IS NOT NULL),
w AS (SELECT *, row_number() OVER (ORDER BY date) AS pos, year(date) * 12 + month(date) AS m FROM (SELECT date, max(r) FILTER (asset = 'A') AS a, max(r) FILTER (asset = 'N') AS n, max(r) FILTER (asset = 'R') AS x FROM r GROUP BY 1) WHERE a + n + x IS NOT NULL), c AS ({_CANDS}), e AS (SELECT least(min(a), min(n), min(x)) AS lo, greatest(max(a), max(n), max(x)) AS hi FROM w),
cal AS (SELECT max(pos) AS pos, m FROM w GROUP BY m HAVING max(pos) >= {WEEKS}), p AS (SELECT cal.m, cand, wa * a + wn * n + wr * x AS p FROM cal JOIN w ON w.pos BETWEEN cal.pos - {WEEKS - 1} AND cal.pos, c), b AS (SELECT m, cand, greatest(0, least(19, floor((p - lo) / ((hi - lo) / 20)))) AS bin, count(*) / {WEEKS}.0 AS q FROM p, e GROUP BY ALL),
k AS (SELECT 'variance' AS method, m, cand, var_samp(p) AS risk FROM p GROUP BY ALL UNION ALL SELECT 'entropy', m, cand, sum(-q * ln(q)) FROM b GROUP BY ALL), g AS (SELECT method, m, arg_min(cand, (round(risk, 9), cand)) AS cand, min(risk) AS risk FROM k GROUP BY ALL),
f AS (SELECT method, g.m, cand, risk, exp(sum(ln(1 + wa * a + wn * n + wr * x))) - 1 AS r FROM g JOIN c USING (cand) JOIN w ON w.m = g.m + 1 GROUP BY ALL), h AS (SELECT f.*, wa, wn, wr, lag(wa) OVER o AS la, lag(wn) OVER o AS ln_, lag(wr) OVER o AS lr FROM f JOIN c USING (cand) WINDOW o AS (PARTITION BY method ORDER BY m))
SELECT method, m::INT AS month, cand::BIGINT AS cand, risk, r, (abs(wa - la) + abs(wn - ln_) + abs(wr - lr)) / 2 AS turnover FROM h"""


def rebalances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """method, month, cand, risk, r, turnover: at every month end the candidate of least variance and of least entropy over
    the trailing 156 weeks, its return in the month after, and how far it moved."""
    names = ["A", "N", "R"]
    r = weekly(spark, sf_dir).withColumn("r", S.change("close", S.by("asset"))).where("r is not null")
    panel = S.to_panel(r, names).dropna(subset=names).withColumn("month", F.year("date") * 12 + F.month("date"))
    panel = panel.withColumn("pos", F.row_number().over(Window.orderBy("date")).cast("long"))  # one row a week
    k = spark.range(121).select(F.floor(F.col("id") / 11).alias("i"), (F.col("id") % 11).alias("j"), F.col("id").alias("cand")).where("i + j <= 10 and greatest(i, j, 10 - i - j) <= 6")
    c = F.broadcast(k.select("cand", F.array(F.col("i") / 10, F.col("j") / 10, (10 - F.col("i") - F.col("j")) / 10).alias("w")))  # parameters
    row = F.array(*names)
    low, high = panel.agg(F.min(F.least(*names)), F.max(F.greatest(*names))).first()
    # a week is in the windows of the month ends from its own month on, until that of the week WEEKS later: it is added in one
    # month and taken off in the other, and running sums by candidate are every window's
    weeks = panel.withColumn("after", F.lead("month", WEEKS).over(Window.orderBy("pos")))  # one row a week
    steps = F.array(F.struct("month", F.lit(1).alias("sign")), F.struct(F.col("after").alias("month"), F.lit(-1).alias("sign")))
    p = weeks.join(c).select("cand", R.dot(row, "w").alias("p"), F.explode(steps).alias("s")).where("s.month is not null")
    bin_ = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("p") - low) / ((high - low) / BINS))))
    sums = {"n": F.lit(1), "s1": F.col("p"), "s2": F.col("p") * F.col("p")} | {f"b{k}": (bin_ == k).cast("int") for k in range(BINS)}
    moved = p.groupBy("cand", F.col("s.month").alias("month")).agg(*(F.sum(v * F.col("s.sign")).alias(k) for k, v in sums.items()))
    so_far = Window.partitionBy("cand").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)  # one row a month
    inside = moved.select("cand", "month", *(F.sum(k).over(so_far).alias(k) for k in sums)).where(F.col("n") == WEEKS)
    q = [F.col(f"b{k}") / WEEKS for k in range(BINS)]
    entropy = sum((F.when(x > 0, -x * F.log(x)).otherwise(0.0) for x in q[1:]), F.when(q[0] > 0, -q[0] * F.log(q[0])).otherwise(0.0))
    variance = (F.col("s2") - F.col("s1") * F.col("s1") / WEEKS) / (WEEKS - 1)
    risks = S.stacked({"variance": inside.select("month", "cand", variance.alias("risk")), "entropy": inside.select("month", "cand", entropy.alias("risk"))}, "method")
    best = risks.groupBy("method", "month").agg(F.min_by("cand", F.struct(F.round("risk", 9), "cand")).alias("cand"), F.min("risk").alias("risk")).join(c, "cand")
    after = best.join(panel.withColumn("month", F.col("month") - 1), "month").withColumn("p", R.dot(row, "w"))
    out = after.groupBy("method", "month", "cand", "w", "risk").agg(R.compound("p").alias("r"))
    last = F.lag("w").over(Window.partitionBy("method").orderBy("month"))
    return out.withColumn("turnover", F.aggregate(F.zip_with("w", last, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v) / 2).drop("w")


@query(SQL_rebalance, "risk r turnover")
def b7_rebalances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebalances(spark, sf_dir)


@query(f"SELECT method, count(*)::BIGINT AS n, avg(turnover) AS mean_turnover, median(turnover) AS middle_turnover, max(turnover) AS most_turnover, avg(r) AS mean, stddev_samp(r) AS vol, min(r) AS worst, count(DISTINCT cand)::BIGINT AS n_candidates FROM ({SQL_rebalance}) GROUP BY 1", "mean_turnover middle_turnover most_turnover mean vol worst")
def b7_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebalances(spark, sf_dir).groupBy("method").agg(
        F.count("*").alias("n"), F.avg("turnover").alias("mean_turnover"), F.median("turnover").alias("middle_turnover"), F.max("turnover").alias("most_turnover"),
        F.avg("r").alias("mean"), F.stddev_samp("r").alias("vol"), F.min("r").alias("worst"), F.countDistinct("cand").alias("n_candidates"),
    )


# ---- B2: the strategies' summary with excess ----
SQL_scores_by_date = SQL["b2_score_strategy"].removeprefix("SELECT * REPLACE").partition(" FROM (")[2].removesuffix(")")


@query(
    f"""WITH d AS ({SQL_scores_by_date}), r AS (SELECT date, unnest(['raw', 'enhanced', 'benchmark']) AS portfolio, unnest([raw, enhanced, benchmark]) AS r, unnest([ceil(n * 0.25), ceil(n * 0.25), n::DOUBLE]) AS names FROM d),
    c AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY portfolio ORDER BY date)) AS wealth FROM r), x AS (SELECT *, wealth / max(wealth) OVER (PARTITION BY portfolio ORDER BY date) - 1 AS dd FROM c),
    s AS (SELECT portfolio, count(*)::BIGINT AS n, exp(sum(ln(1 + r)) * 12 / count(*)) - 1 AS y, stddev_pop(r) * sqrt(12) AS v, CASE WHEN count(*) FILTER (r < 0) > 1 THEN stddev_pop(r) FILTER (r < 0) ELSE 0 END * sqrt(12) AS low, min(dd) AS m, avg((r > 0)::INT) AS h, avg(names) AS k FROM x GROUP BY 1)
    SELECT portfolio, n, y AS annual_return, v AS annual_vol, CASE WHEN v > 0 THEN y / v END AS sharpe, low AS downside, m AS max_drawdown, CASE WHEN m < 0 THEN y / -m END AS calmar, h AS hit_rate, k AS avg_names, y - (SELECT y FROM s WHERE portfolio = 'benchmark') AS excess FROM s""",
    "max_drawdown hit_rate avg_names",
    "annual_return annual_vol sharpe downside calmar excess",
)
def b2_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Performance of the raw, the enhanced and the benchmark portfolio, the average number
    of names, and the yearly return over the benchmark's."""
    by_date = score_returns(score_panel(monthly(spark, sf_dir)))
    names = F.ceil(F.col("n") * 0.25).cast("double")
    long = by_date.select("date", F.explode(F.array(*(F.struct(F.lit(p).alias("portfolio"), F.col(p).alias("r"), (F.col("n").cast("double") if p == "benchmark" else names).alias("names")) for p in ("raw", "enhanced", "benchmark")))).alias("x")).select("date", "x.*")
    out = R.performance(long, "r", ["portfolio"], ddof=0, names="names")
    base = out.where("portfolio = 'benchmark'").select(F.col("annual_return").alias("base"))
    return out.crossJoin(F.broadcast(base)).withColumn("excess", F.col("annual_return") - F.col("base")).drop("base")  # one row


# ---- B15: views merged with a prior over horizons ----
HORIZONS = (4, 12)


def views_and_prior(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Views (scenario, source, horizon, exposures, forecast, vol) from customers, a scenario a nation, and the weekly prior."""
    r = returns(spark, sf_dir, "l_returnflag", "week")
    mu = r.groupBy(F.col("asset").alias("i")).agg(F.avg("r").alias("mu"))
    prior = V.sample(r).join(mu, "i").select("i", "j", "cov", "mu")
    asset = lambda k: F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), ((F.col("c_custkey") + k) % 3 + 1).cast("int"))
    spread = F.when(F.col("c_custkey") % 4 == 0, F.create_map(asset(0), F.lit(1.0), asset(1), F.lit(-1.0))).otherwise(F.create_map(asset(0), F.lit(1.0)))
    horizon = F.when(F.col("c_custkey") % 2 == 0, HORIZONS[0]).otherwise(HORIZONS[1])
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_nationkey").alias("scenario"), F.col("c_mktsegment").alias("source"), F.col("c_custkey").alias("view"), horizon.alias("horizon"), spread.alias("exposures"), (F.col("c_acctbal") / 1e4).alias("forecast"), (0.3 + F.col("c_custkey") % 5 / 10).alias("vol")), prior


@query()
def b15_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prior and posterior mean and deviation of every asset over every horizon and over every segment between them."""
    views, prior = views_and_prior(spark, sf_dir)
    return G.horizon_frame(G.posterior(views, prior, HORIZONS, "scenario"), "scenario")


@query()
def b15_view_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far prior and posterior are from the views, by source."""
    views, prior = views_and_prior(spark, sf_dir)
    fit = G.view_fit(views, G.posterior(views, prior, HORIZONS, "scenario"), "scenario")
    gap = lambda c: F.avg(F.abs(F.col("forecast") - F.col(c)))
    return fit.groupBy("scenario", "source", "horizon").agg(F.count("*").alias("n"), gap("prior_implied").alias("prior_gap"), gap("implied").alias("posterior_gap"))


@query()
def b15_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source moves each asset's posterior mean by, over each horizon."""
    views, prior = views_and_prior(spark, sf_dir)
    return G.contributions(views, G.posterior(views, prior, HORIZONS, "scenario"), "scenario", "source")

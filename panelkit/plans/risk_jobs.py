"""Summaries, scenario risk, entropy, covariance and candidate search as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelkit.functions import columns as C
from panelkit.operators import covariance as V
from panelkit.operators import joins as J
from panelkit.operators import risk as R
from panelkit.operators import tails as T
from panelkit.operators.staging import staged
from panelkit.operators import series as S
from panelkit.plans.registry import query, read
from panelkit.plans.tables import SQL_daily, SQL_lattice, SQL_monthly, SQL_returns, SQL_scenarios, SQL_weekly_returns, daily, lattice, monthly, returns, scenarios

RM, RD = SQL_returns("l_suppkey", "month"), SQL_returns()
QW = "PARTITION BY asset ORDER BY date"


@query(
    f"""WITH c AS (SELECT asset, r, exp(sum(ln(1 + r)) OVER ({QW})) AS wealth, date FROM ({RM})), d AS (SELECT *, wealth / max(wealth) OVER ({QW}) - 1 AS dd FROM c),
    s AS (SELECT asset, count(*)::BIGINT AS n, exp(sum(ln(1 + r)) * 12 / count(*)) - 1 AS y, stddev_samp(r) * sqrt(12) AS v, CASE WHEN count(*) FILTER (r < 0) > 1 THEN stddev_samp(r) FILTER (r < 0) ELSE 0 END * sqrt(12) AS low, min(dd) AS m, avg((r > 0)::INT) AS h FROM d GROUP BY 1)
    SELECT asset, n, y AS annual_return, v AS annual_vol, CASE WHEN v > 0 THEN y / v END AS sharpe, low AS downside, m AS max_drawdown, CASE WHEN m < 0 THEN y / -m END AS calmar, h AS hit_rate FROM s""",
    "annual_return annual_vol sharpe downside max_drawdown calmar hit_rate",
)
def a6_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.performance(returns(spark, sf_dir, "l_suppkey", "month"), "r", ["asset"])


@query(
    f"""WITH v AS (SELECT asset, quantile_cont(r, 0.05) AS var FROM ({RM}) GROUP BY 1) SELECT asset, count(*)::BIGINT AS n, exp(sum(ln(1 + r))) - 1 AS total_return, any_value(var) AS var, avg(r) FILTER (r <= var) AS cvar, skewness(r) AS skew, kurtosis(r) AS kurtosis, min(dd) AS max_drawdown, exp(sum(ln(1 + r)) * 12 / count(*)) - 1 AS annual_return, (exp(sum(ln(1 + r)) * 12 / count(*)) - 1.02) / (stddev_samp(r) * sqrt(12)) AS sharpe
    FROM (SELECT *, wealth / max(wealth) OVER ({QW}) - 1 AS dd FROM (SELECT *, exp(sum(ln(1 + r)) OVER ({QW})) AS wealth FROM ({RM}))) JOIN v USING (asset) GROUP BY 1""",
    "total_return var cvar skew kurtosis max_drawdown annual_return sharpe",
)
def a8_a12_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tail_summary(returns(spark, sf_dir, "l_suppkey", "month"), "r", ["asset"], risk_free=0.02, periods=12)


@query(
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY r, date) AS k, count(*) OVER (PARTITION BY asset) AS n, avg(r) OVER (PARTITION BY asset) AS m, avg(r) OVER (PARTITION BY date) AS b FROM ({RM})), q AS (SELECT asset, quantile_cont(r, 0.05) AS q FROM r GROUP BY 1)
    SELECT asset, avg(r) AS mean, stddev_pop(r) AS sd, avg(abs(r - m)) AS mad, -any_value(q) AS var, -avg(r) FILTER (r < q) AS cvar, avg(greatest(-r, 0)) AS lpm, sum(least(r - m, 0) ** 2) / (count(*) - 1) AS semivariance, sqrt(sum(least(r - m, 0) ** 2) / (count(*) - 1)) AS semideviation, sqrt(avg((r - b) ** 2)) AS tracking_error, -avg(r) FILTER (k <= ceil(round(0.05 * n, 9))) AS tail_mean FROM r JOIN q USING (asset) GROUP BY 1""",
    "mean sd mad var cvar lpm semivariance semideviation tracking_error tail_mean",
)
def a13_a14_characteristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = returns(spark, sf_dir, "l_suppkey", "month")
    tail = R.tail_count_cvar(r, "r", ["asset"], 0.95, "date").select("asset", F.col("cvar").alias("tail_mean"))
    r = r.withColumn("every", F.avg("r").over(Window.partitionBy("date")))
    return R.characteristics(r, "r", ["asset"], benchmark="every").join(tail, "asset")


@query(
    """SELECT o_orderpriority AS grp, o_orderstatus AS status, count(*)::BIGINT AS n, count(*) FILTER (o_totalprice > 250000)::BIGINT AS n_large, avg(o_totalprice) AS mean, max(o_totalprice) AS top,
    sum(o_totalprice * (o_custkey % 7)) / sum(o_custkey % 7) AS weighted, median(o_totalprice) AS middle, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest FROM orders GROUP BY ALL""",
    "mean top weighted middle",
)
def a1_a3_group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumn("w", F.col("o_custkey") % 7)
    return o.groupBy(F.col("o_orderpriority").alias("grp"), F.col("o_orderstatus").alias("status")).agg(
        F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 250000).alias("n_large"), F.avg("o_totalprice").alias("mean"), F.max("o_totalprice").alias("top"),
        R.weighted_mean("o_totalprice", "w").alias("weighted"), F.median("o_totalprice").alias("middle"), F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("cheapest"),
    )


@query(
    """WITH g AS (SELECT c_nationkey, c_custkey, c_acctbal, quantile_cont(c_acctbal, 0.25) OVER p AS q25, quantile_cont(c_acctbal, 0.75) OVER p AS q75 FROM customer WINDOW p AS (PARTITION BY c_nationkey))
    SELECT c_nationkey, c_custkey, c_acctbal, q25, q75, CASE WHEN c_acctbal >= q75 THEN 'high' WHEN c_acctbal <= q25 THEN 'low' ELSE 'middle' END AS label FROM g""",
    "c_acctbal q25 q75",
)
def a15_quartile_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.quartile_labels(read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), "c_acctbal", ["c_nationkey"])


@query(
    """SELECT l_suppkey, count(*)::BIGINT AS n, corr(x, y) AS corr, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM (SELECT l_suppkey, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem) GROUP BY 1""",
    "corr slope intercept",
)
def a16_a17_simple_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ols(read(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y")), "x", "y", ["l_suppkey"])


@query(
    f"""WITH c AS (SELECT cand_id, w FROM ({SQL_lattice}) WHERE list_max(w) <= 0.6), l AS (SELECT cand_id, scen_id, q, -list_dot_product(r, w) AS loss FROM ({SQL_scenarios}), c), k AS (SELECT *, sum(q) OVER (PARTITION BY cand_id ORDER BY loss, scen_id) AS cum FROM l),
    v AS (SELECT cand_id, min(loss) FILTER (cum >= 0.95 - 1e-12) AS var FROM k GROUP BY 1) SELECT cand_id, any_value(var) AS var, any_value(var) + sum(greatest(loss - var, 0) * q) / 0.05 AS cvar FROM l JOIN v USING (cand_id) GROUP BY 1""",
    "var cvar",
)
def a11_j10_candidate_cvar(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = scenarios(spark, sf_dir), T.candidates(lattice(spark).where("array_max(w) <= 0.6"))
    found, cvar = T.weighted_var_cvar(s, c, 0.95)
    return T.frame(s, c, {"var": found.var, "cvar": cvar})


@query(
    f"""WITH s AS (SELECT scen_id, q, unnest(r) AS x, unnest([1, 2, 3, 4]) AS k FROM ({SQL_scenarios})) SELECT k::INT AS k, sum(q * x) AS mean, sqrt(greatest(sum(q * x * x) - sum(q * x) ** 2, 0)) AS vol, min(x) AS worst, arg_min(scen_id, (x, scen_id)) AS worst_scenario FROM s GROUP BY 1""",
    "mean vol worst",
)
def a31_a32_scenario_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scenarios(spark, sf_dir).select("scen_id", "q", F.posexplode("r").alias("k", "x"))
    m = F.sum(F.col("q") * F.col("x"))
    return s.groupBy((F.col("k") + 1).alias("k")).agg(m.alias("mean"), F.sqrt(F.greatest(F.sum(F.col("q") * F.col("x") ** 2) - m * m, F.lit(0.0))).alias("vol"), F.min("x").alias("worst"), F.min_by("scen_id", F.struct("x", "scen_id")).alias("worst_scenario"))


@query(
    """WITH e AS (SELECT user_id AS scen_id, event_type AS asset, ln(1 + value / 10000) AS r, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS month FROM events)
    SELECT scen_id, asset, exp(sum(r) FILTER (month <= 1)) - 1 AS ret_1, exp(sum(r) FILTER (month <= 3)) - 1 AS ret_3, exp(sum(r) FILTER (month <= 12)) - 1 AS ret_12, exp(sum(r) FILTER (month <= 1) * 12) - 1 AS yearly_1, exp(sum(r) FILTER (month <= 3) * 4) - 1 AS yearly_3, exp(sum(r) FILTER (month <= 12)) - 1 AS yearly_12 FROM e GROUP BY ALL""",
    "ret_1 ret_3 ret_12 yearly_1 yearly_3 yearly_12",
)
def a33_b18_terminal_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.terminal_returns(_paths(spark, sf_dir), ["scen_id", "asset"], (1, 3, 12))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("scen_id"), F.col("event_type").alias("asset"), F.log1p(F.col("value") / 10000).alias("log_ret"), month.alias("month"))


@query(
    """WITH e AS (SELECT user_id AS u, event_type AS t, count(*) AS c FROM events GROUP BY ALL), p AS (SELECT user_id AS u, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM events GROUP BY 1), h AS (SELECT m, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS m FROM events) GROUP BY 1)
    SELECT (SELECT count(DISTINCT c) FROM e)::BIGINT AS n_lengths, 0::BIGINT AS not_finite, (SELECT count(*) FROM p WHERE p < 0)::BIGINT AS negative_p, (SELECT (abs(sum(p) - 1) > 1e-8)::BIGINT FROM p) AS bad_sum,
    (SELECT 12 - count(*) FILTER (m <= 12 AND n = (SELECT count(*) FROM e)) FROM h)::BIGINT AS horizons_missing, (SELECT count(*) FILTER (m > 12) FROM h)::BIGINT AS horizons_unknown"""
)
def a34_scenario_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    p = events.groupBy(F.col("user_id").alias("scen_id")).agg(F.count("*").alias("n")).join(F.broadcast(events.agg(F.count("*").alias("total")))).select("scen_id", (F.col("n") / F.col("total")).alias("p"))  # one row
    return R.check_scenarios(_paths(spark, sf_dir), p, tuple(range(1, 13)))


@query(
    f"""WITH w AS (SELECT asset, date, close / sum(close) OVER (PARTITION BY date) AS w FROM ({SQL_monthly()})), k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY w DESC) AS n FROM w)
    SELECT date, sum(-w * ln(w)) AS entropy, sum(w * w) AS hhi, max(w) AS max_weight, sum(w) FILTER (n <= 3) AS top3, count(*) FILTER (w > 0.01)::BIGINT AS n_names, exp(sum(-w * ln(w))) AS effective_n, 1 / sum(w * w) AS effective_n_hhi FROM k GROUP BY 1""",
    "entropy hhi max_weight top3 effective_n effective_n_hhi",
)
def a29_diversification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.diversification(monthly(spark, sf_dir).select("asset", "date", S.share("close", "date").alias("w")), ["date"])


@query(
    f"""WITH r AS ({RM}), e AS (SELECT min(r) AS lo, max(r) AS hi FROM r), b AS (SELECT asset, greatest(0, least(19, floor((r - lo) / ((hi - lo) / 20)))) AS bin, count(*) AS n FROM r, e GROUP BY 1, 2),
    d AS (SELECT asset, CASE WHEN r > 0 THEN -1 ELSE greatest(0, least(18, floor((r - least(lo, -1e-12)) / (-least(lo, -1e-12) / 19)))) END AS bin, count(*) AS n FROM r, e GROUP BY 1, 2),
    x AS (SELECT asset, sum(-p * ln(p)) AS entropy FROM (SELECT asset, n / sum(n) OVER (PARTITION BY asset) AS p FROM b) GROUP BY 1), y AS (SELECT asset, sum(-p * ln(p)) AS downside FROM (SELECT asset, n / sum(n) OVER (PARTITION BY asset) AS p FROM d) GROUP BY 1)
    SELECT asset, entropy, entropy / ln(20) AS normalised, downside FROM x JOIN y USING (asset)""",
    "entropy normalised downside",
)
def a27_a28_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = returns(spark, sf_dir, "l_suppkey", "month")
    edges = R.bin_edges(r, "r")
    down = R.downside_entropy(r, "r", ["asset"], edges).select("asset", F.col("entropy").alias("downside"))
    return R.histogram_entropy(r, "r", ["asset"], edges).join(down, "asset")


@query(
    f"""WITH r AS ({RM}), p AS (SELECT a.asset AS i, b.asset AS j, covar_samp(a.r, b.r) AS cov FROM r a JOIN r b USING (date) WHERE a.asset <= b.asset GROUP BY ALL), v AS (SELECT i, cov AS v FROM p WHERE i = j)
    SELECT p.i, p.j, cov, greatest(-1, least(1, cov / sqrt(a.v * b.v))) AS corr FROM p JOIN v a ON a.i = p.i JOIN v b ON b.i = p.j""",
    "cov corr",
)
def a19_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.blocked(returns(spark, sf_dir, "l_suppkey", "month"), correlation=True)


@query(
    f"""WITH r AS (SELECT asset, date, r - avg(r) OVER (PARTITION BY asset) AS r FROM ({RD}) WHERE date IN (SELECT date FROM ({RD}) GROUP BY 1 HAVING count(*) = 3)), n AS (SELECT count(DISTINCT date) AS n FROM r),
    c AS (SELECT asset, date, r - avg(r) OVER (PARTITION BY asset) AS r FROM r), p AS (SELECT a.asset AS i, b.asset AS j, avg(a.r * b.r) AS s, avg((a.r * b.r) ** 2) AS s4 FROM c a JOIN c b USING (date) GROUP BY ALL),
    t AS (SELECT avg(s) FILTER (i = j) AS mu FROM p), d AS (SELECT sum((s - (i = j)::INT * mu) ** 2) / 3 AS delta, least(sum(s4 - s * s) / (3 * any_value(n)), sum((s - (i = j)::INT * mu) ** 2) / 3) AS beta FROM p, t, n)
    SELECT i, j, (1 - beta / delta) * s + beta / delta * mu * (i = j)::INT AS cov, beta / delta AS shrinkage FROM p, t, d WHERE i <= j""",
    "cov shrinkage",
)
def a20_shrunk_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.shrunk(S.complete_dates(returns(spark, sf_dir).withColumn("close", F.col("r"))).select("asset", "date", "r"))


@query(
    f"""WITH r AS (SELECT *, count(*) OVER (PARTITION BY asset) - row_number() OVER ({QW}) AS k, row_number() OVER ({QW}) AS rn FROM ({RM})), w AS (SELECT asset, r, pow(0.94, k) * CASE WHEN rn = 1 THEN 1 ELSE 0.06 END AS w FROM r), s AS (SELECT asset, sum(w) AS s, sum(w * w) AS ss, sum(w * r) AS sx, sum(w * r * r) AS sxx FROM w GROUP BY 1)
    SELECT asset, sqrt(greatest((sxx / s - (sx / s) ** 2) / (1 - ss / s ** 2), 1e-12)) AS vol FROM s""",
    "vol",
)
def a22_ewma_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.ewma_vol(returns(spark, sf_dir, "l_suppkey", "month"), 0.94, [])


@query(
    f"""WITH r AS (SELECT asset, date, r, exp(ln(2) / 63 * (row_number() OVER ({QW}) - count(*) OVER (PARTITION BY asset))) AS w FROM ({RD})), p AS (SELECT a.asset AS i, b.asset AS j, a.w, a.r AS x, b.r AS y FROM r a JOIN r b USING (date) WHERE a.asset <= b.asset),
    s AS (SELECT i, j, sum(w) AS s, sum(w * w) AS ss, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * y) AS sxy FROM p GROUP BY ALL) SELECT i, j, (sxy / s - sx * sy / s ** 2) / (1 - ss / s ** 2) AS cov FROM s""",
    "cov",
)
def a21_half_life_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.half_life(returns(spark, sf_dir), 63)


@query(
    f"""WITH d AS (SELECT asset, stddev_samp(r) * sqrt(21) AS vol FROM ({RD}) GROUP BY 1), m AS (SELECT * FROM ({SQL_returns('l_returnflag', 'month')})), p AS (SELECT a.asset AS i, b.asset AS j, covar_samp(a.r, b.r) AS cov FROM m a JOIN m b USING (date) WHERE a.asset <= b.asset GROUP BY ALL), v AS (SELECT i, cov AS v FROM p WHERE i = j),
    c AS (SELECT p.i, p.j, greatest(-1, least(1, cov / sqrt(a.v * b.v))) * x.vol * y.vol AS cov FROM p JOIN v a ON a.i = p.i JOIN v b ON b.i = p.j JOIN d x ON x.asset = p.i JOIN d y ON y.asset = p.j)
    SELECT 'mixed' AS setup, sum(CASE WHEN i = j THEN 1 ELSE 2 END * cov / 9) AS pv FROM c""",
    "pv",
)
def a23_a26_mixed_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    vol = returns(spark, sf_dir).groupBy("asset").agg((F.stddev_samp("r") * F.sqrt(F.lit(21.0))).alias("vol"))
    corr = V.with_correlation(V.sample(returns(spark, sf_dir, "l_returnflag", "month")), [])
    cov = V.mixed(corr, vol, []).withColumn("setup", F.lit("mixed"))
    return V.predicted_variance(cov, vol.select("asset", F.lit(1 / 3).alias("w")), ["setup"])


@query()
def a24_a25_denoised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in panels by nation, the returns of each in one task; the random-matrix edge from the number of dates."""
    r = returns(spark, sf_dir, "l_suppkey", "month").join(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("asset"), F.col("s_nationkey").alias("panel")), "asset").transform(staged)
    return V.panel_conditions(r, "panel", r.select("date").distinct().count())


@query(
    f"""SELECT k AS freq, asset, count(r)::BIGINT AS n, min(date) AS first_date, max(date) AS last_date, avg(r) AS mean, stddev_samp(r) AS vol, avg(r) * f AS yearly_mean, stddev_samp(r) * sqrt(f) AS yearly_vol
    FROM (SELECT 'day' AS k, 252 AS f, * FROM ({RD}) UNION ALL SELECT 'month', 12, * FROM ({SQL_returns('l_returnflag', 'month')}) UNION ALL SELECT 'week', 52, * FROM ({SQL_weekly_returns})) GROUP BY k, f, asset""",
    "mean vol yearly_mean yearly_vol",
)
def a37_a38_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [returns(spark, sf_dir, "l_returnflag", unit).withColumns({"freq": F.lit(unit), "f": F.lit(n)}) for unit, n in (("day", 252.0), ("month", 12.0), ("week", 52.0))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("freq", "f", "asset").agg(F.count("r").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("vol")).withColumns({"yearly_mean": F.col("mean") * F.col("f"), "yearly_vol": F.col("vol") * F.sqrt("f")}).drop("f")


@query(
    f"""WITH w AS (SELECT date, asset, 1.0 / count(*) OVER (PARTITION BY date) AS eq, CASE asset WHEN 'A' THEN 0.6 WHEN 'N' THEN 0.4 ELSE 0 END AS fixed, count(*) FILTER (asset IN ('A', 'N')) OVER (PARTITION BY date) AS n, r FROM ({RD})) SELECT date, sum(eq * r) AS equal, CASE WHEN any_value(n) = 2 THEN sum(fixed * r) END AS fixed FROM w GROUP BY 1""",
    "equal fixed",
)
def a41_a35_portfolio_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = C.label_value("asset", {"A": 0.6, "N": 0.4}, 0.0)
    return returns(spark, sf_dir).groupBy("date").agg(F.avg("r").alias("equal"), F.when(F.count_if(F.col("asset").isin("A", "N")) == 2, F.sum(fixed * F.col("r"))).alias("fixed"))


@query(
    "SELECT o_orderpriority AS grp, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS f, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS o, sum(o_totalprice) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1",
    "f o p",
)
def a36_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("grp")).pivot("o_orderstatus", ["F", "O", "P"]).sum("o_totalprice").withColumnsRenamed({"F": "f", "O": "o", "P": "p"})


@query(
    f"""WITH f AS (SELECT *, CASE WHEN close >= 1500 THEN 'high' ELSE 'low' END AS regime, lead(close) OVER ({QW}) / close - 1 AS nxt FROM ({SQL_monthly()})), l AS (SELECT asset, arg_max(regime, date) AS regime FROM f GROUP BY 1)
    SELECT l.asset, l.regime, avg(nxt) AS mean_next, count(nxt)::BIGINT AS n FROM l JOIN f USING (asset, regime) GROUP BY ALL""",
    "mean_next",
)
def a39_current_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = monthly(spark, sf_dir).withColumns({"regime": F.when(F.col("close") >= 1500, "high").otherwise("low"), "nxt": S.forward("close", S.by("asset"), 1)})
    return m.groupBy("asset").agg(F.max_by("regime", "date").alias("regime")).join(m, ["asset", "regime"]).groupBy("asset", "regime").agg(F.avg("nxt").alias("mean_next"), F.count("nxt").alias("n"))


@query(
    f"""WITH c AS ({SQL_lattice}), s AS ({SQL_scenarios}), m AS (SELECT cand_id, sum(q * list_dot_product(r, w)) AS expected, sqrt(sum(q * list_dot_product(r, w) ** 2) - sum(q * list_dot_product(r, w)) ** 2) + cand_id * 1e-9 AS risk FROM c, s GROUP BY cand_id),
    t AS (SELECT lo + (hi - lo) * i / 29 AS target FROM (SELECT min(expected) AS lo, max(expected) AS hi FROM m), range(30) x(i)) SELECT target, arg_min(cand_id, risk) AS cand_id, min(risk) AS risk FROM t JOIN m ON expected >= target - 1e-12 GROUP BY 1""",
    "target risk",
)
def j13_l5_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty returns between the candidates' lowest and highest, and the candidate of least deviation that reaches each."""
    both = lattice(spark).join(F.broadcast(R.asset_moments(scenarios(spark, sf_dir), 4, q="q")))  # one row
    m = both.select("cand_id", R.dot("w", "mu").alias("expected"), (F.sqrt(R.variance()) + F.col("cand_id") * 1e-9).alias("risk")).transform(staged)
    ends = m.agg(F.min("expected").alias("lo"), F.max("expected").alias("hi"))
    t = spark.range(30).join(F.broadcast(ends)).select((F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("id") / 29).alias("target"))  # one row
    return J.reaching(m, t)

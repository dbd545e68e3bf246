"""Covariance studies: three setups over month ends with their weights and outcomes, and estimators side by side.

Windows are never copied out row by row: power sums of each pair of assets are taken by month and added up over the months of
a window, which gives sample and shrunk covariances and exponentially weighted volatilities of every window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelkit.functions import columns as C
from panelkit.operators import covariance as V
from panelkit.operators import risk as R
from panelkit.operators import series as S
from panelkit.operators import spectrum as E
from panelkit.operators.staging import staged
from panelkit.plans.registry import query
from panelkit.plans.tables import SQL_daily, SQL_returns, daily, returns

ASSETS, MONTHS, LAM, SCALE, CAP, COST = ("A", "N", "R"), 12, 0.94, 21.0, 0.6, 0.001
MIX = {"A": 0.6, "N": 0.4}


def _month(date: str = "date"):
    return F.year(date) * 12 + F.month(date)


def candidate_weights(spark: SparkSession) -> DataFrame:
    """cand, w: weights of three assets in tenths that sum to one, none over the cap (a map from asset to weight)."""
    k = spark.range(121).select(F.floor(F.col("id") / 11).alias("i"), (F.col("id") % 11).alias("j"), F.col("id").alias("cand")).where("i + j <= 10")
    w = F.array(F.col("i") / 10, F.col("j") / 10, (10 - F.col("i") - F.col("j")) / 10)
    return k.select("cand", w.alias("w")).where(F.array_max("w") <= CAP + 1e-12)


def setups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Covariances (setup, month, i, j, cov) of each month end's window, and the daily returns (month, date, asset, r).

    A: shrunk, monthly returns. B: shrunk, daily returns, scaled to a month. C: exponentially weighted daily volatilities with
    the correlations of A.
    """
    px = S.complete_dates(daily(spark, sf_dir)).withColumn("month", _month())
    day = px.withColumn("r", S.change("close", S.by("asset"))).where("r is not null").select("month", "date", "asset", "r")
    ends = px.groupBy("asset", "month").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))
    month = ends.withColumn("r", S.change("close", S.by("asset"))).where("r is not null").select("month", "date", "asset", "r")
    a, b = V.shrunk_windows(month, MONTHS), V.shrunk_windows(day, MONTHS)
    vol = V.ewma_windows(day, LAM, MONTHS).withColumn("vol", F.col("vol") * SCALE**0.5)
    c = V.mixed(V.with_correlation(a.select("month", "i", "j", "cov"), ["month"]), vol, ["month"])
    parts = {"A": a, "B": b.withColumn("cov", F.col("cov") * SCALE), "C": c}
    return S.stacked({k: v.select("month", "i", "j", "cov") for k, v in parts.items()}, "setup"), day


def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """setup, month, cand, pv, rv, ale, r, turnover, net: A26, K10 of the least-variance weights of each month end and setup."""
    cov, day = setups(spark, sf_dir)
    c = candidate_weights(spark)
    weight = lambda k: F.get("w", F.array_position(F.array(*map(F.lit, ASSETS)), F.col(k)).cast("int") - 1)
    both = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    pv = cov.join(F.broadcast(c)).groupBy("setup", "month", "cand").agg(F.sum(both * F.col("cov") * weight("i") * weight("j")).alias("pv"))  # parameters
    best = pv.groupBy("setup", "month").agg(F.min_by("cand", F.struct(F.round("pv", 9), "cand")).alias("cand"), F.min_by("pv", F.struct(F.round("pv", 9), "cand")).alias("pv")).join(F.broadcast(c), "cand")
    moves = day.groupBy((F.col("month") - 1).alias("month"), "date").pivot("asset", list(ASSETS)).agg(F.first("r"))
    p = best.join(moves, "month").withColumn("p", sum((F.get("w", F.lit(k)) * F.col(a) for k, a in enumerate(ASSETS)), F.lit(0.0)))
    out = p.groupBy("setup", "month", "cand", "w", "pv").agg(F.sum(F.col("p") ** 2).alias("rv"), R.compound("p").alias("r"))
    last = F.lag("w").over(Window.partitionBy("setup").orderBy("month"))
    moved = F.aggregate(F.zip_with("w", last, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / 2
    out = out.withColumn("turnover", moved).withColumn("net", F.col("r") - COST * F.coalesce("turnover", F.lit(0.0)))
    return out.withColumn("ale", F.abs(F.log(F.greatest("rv", F.lit(1e-12)) / F.greatest("pv", F.lit(1e-12)))))


_LIST = ", ".join(f"'{a}'" for a in ASSETS)
SQL_setups = f"""WITH px AS (SELECT *, year(date) * 12 + month(date) AS month FROM ({SQL_daily()}) WHERE date IN (SELECT date FROM ({SQL_daily()}) GROUP BY 1 HAVING count(*) = 3)), day AS (SELECT * FROM (SELECT month, date, asset, close / lag(close) OVER (PARTITION BY asset ORDER BY date) - 1 AS r FROM px) WHERE r IS NOT NULL),
ends AS (SELECT month, asset, max(date) AS date, arg_max(close, date) AS close FROM px GROUP BY ALL), mon AS (SELECT * FROM (SELECT month, date, asset, close / lag(close) OVER (PARTITION BY asset ORDER BY date) - 1 AS r FROM ends) WHERE r IS NOT NULL),
src AS (SELECT 'A' AS setup, * FROM mon UNION ALL SELECT 'B', * FROM day), ms AS (SELECT DISTINCT setup, month FROM src), reb AS (SELECT s.setup, s.month AS ym FROM ms s JOIN ms z ON z.setup = s.setup AND z.month BETWEEN s.month - 11 AND s.month GROUP BY ALL HAVING count(*) = 12),
win AS (SELECT setup, ym, asset, date, r, r - avg(r) OVER (PARTITION BY setup, ym, asset) AS x FROM src JOIN reb USING (setup) WHERE month BETWEEN ym - 11 AND ym), pr AS (SELECT a.setup, a.ym, a.asset AS i, b.asset AS j, avg(a.x * b.x) AS s, avg((a.x * b.x) ** 2) AS s4, count(*) AS n FROM win a JOIN win b USING (setup, ym, date) GROUP BY ALL),
mu AS (SELECT setup, ym, avg(s) FILTER (i = j) AS mu FROM pr GROUP BY ALL), sh AS (SELECT setup, ym, sum((s - (i = j)::INT * mu) ** 2) / 3 AS delta, sum(s4 - s * s) / (3 * any_value(n)) AS beta, any_value(mu) AS mu FROM pr JOIN mu USING (setup, ym) GROUP BY ALL),
lw AS (SELECT setup, ym, i, j, (1 - least(beta, delta) / delta) * s + least(beta, delta) / delta * mu * (i = j)::INT AS cov FROM pr JOIN sh USING (setup, ym)), ew AS (SELECT ym, asset, r, pow({LAM}, count(*) OVER (PARTITION BY ym, asset) - row_number() OVER o) * CASE WHEN row_number() OVER o = 1 THEN 1 ELSE 1 - {LAM} END AS w FROM win WHERE setup = 'B' WINDOW o AS (PARTITION BY ym, asset ORDER BY date)),
vol AS (SELECT ym, asset, sqrt(greatest((sum(w * r * r) / sum(w) - (sum(w * r) / sum(w)) ** 2) / (1 - sum(w * w) / sum(w) ** 2), 1e-12)) * sqrt({SCALE}) AS vol FROM ew GROUP BY ALL), va AS (SELECT ym, i, cov AS v FROM lw WHERE setup = 'A' AND i = j),
co AS (SELECT 'C' AS setup, l.ym, l.i, l.j, greatest(-1, least(1, l.cov / sqrt(a.v * b.v))) * x.vol * y.vol AS cov FROM lw l JOIN va a ON a.ym = l.ym AND a.i = l.i JOIN va b ON b.ym = l.ym AND b.i = l.j JOIN vol x ON x.ym = l.ym AND x.asset = l.i JOIN vol y ON y.ym = l.ym AND y.asset = l.j WHERE l.setup = 'A'),
cov AS (SELECT 'A' AS setup, ym, i, j, cov FROM lw WHERE setup = 'A' UNION ALL SELECT 'B', ym, i, j, cov * {SCALE} FROM lw WHERE setup = 'B' UNION ALL SELECT * FROM co)"""
SQL_study = f"""{SQL_setups}, c AS (SELECT i * 11 + j AS cand, [i / 10.0, j / 10.0, (10 - i - j) / 10.0]::DOUBLE[] AS w FROM range(11) t(i), range(11) u(j) WHERE i + j <= 10 AND greatest(i, j, 10 - i - j) <= 6),
pv AS (SELECT setup, ym, cand, sum(cov * w[list_position([{_LIST}], i)] * w[list_position([{_LIST}], j)]) AS pv FROM cov, c GROUP BY ALL), be AS (SELECT setup, ym, arg_min(cand, (round(pv, 9), cand)) AS cand, arg_min(pv, (round(pv, 9), cand)) AS pv FROM pv GROUP BY ALL),
mv AS (SELECT month - 1 AS ym, date, max(r) FILTER (asset = 'A') AS a, max(r) FILTER (asset = 'N') AS n, max(r) FILTER (asset = 'R') AS x FROM day GROUP BY ALL), po AS (SELECT setup, ym, cand, w, pv, w[1] * a + w[2] * n + w[3] * x AS p FROM be JOIN c USING (cand) JOIN mv USING (ym)),
st AS (SELECT setup, ym AS month, cand, w, pv, sum(p * p) AS rv, exp(sum(ln(1 + p))) - 1 AS r FROM po GROUP BY ALL), la AS (SELECT *, lag(w) OVER (PARTITION BY setup ORDER BY month) AS v FROM st), tu AS (SELECT * EXCLUDE (v), CASE WHEN v IS NOT NULL THEN (abs(w[1] - v[1]) + abs(w[2] - v[2]) + abs(w[3] - v[3])) / 2 END AS turnover FROM la)"""


@query(f"{SQL_study} SELECT setup, month::INT AS month, cand::BIGINT AS cand, pv, rv, abs(ln(greatest(rv, 1e-12) / greatest(pv, 1e-12))) AS ale, r, turnover, r - {COST} * coalesce(turnover, 0) AS net FROM tu", "pv rv ale r turnover net")
def b4_frequency_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month ends x three setups: chosen candidate, predicted and realised variance, next month's return, turnover, net return."""
    return study(spark, sf_dir).drop("w")


@query(
    f"{SQL_study} SELECT setup, count(*)::BIGINT AS n, avg(abs(ln(greatest(rv, 1e-12) / greatest(pv, 1e-12)))) AS male, median(abs(ln(greatest(rv, 1e-12) / greatest(pv, 1e-12)))) AS middle, avg(greatest(rv, 1e-12) / greatest(pv, 1e-12)) AS mean_ratio, avg(turnover) AS turnover, avg(r - {COST} * coalesce(turnover, 0)) AS net FROM tu GROUP BY 1",
    "male middle mean_ratio turnover net",
)
def b4_a26_setup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and median absolute log error and mean ratio of each setup."""
    ratio = F.greatest("rv", F.lit(1e-12)) / F.greatest("pv", F.lit(1e-12))
    return study(spark, sf_dir).groupBy("setup").agg(F.count("*").alias("n"), F.avg("ale").alias("male"), F.median("ale").alias("middle"), F.avg(ratio).alias("mean_ratio"), F.avg("turnover").alias("turnover"), F.avg("net").alias("net"))


@query(
    f"""{SQL_study}, ba AS (SELECT ym AS month, exp(sum(ln(1 + (a + n + x) / 3))) - 1 AS equal, exp(sum(ln(1 + 0.6 * a + 0.4 * n))) - 1 AS fixed FROM mv WHERE ym IN (SELECT month FROM tu) GROUP BY 1), al AS (SELECT setup AS portfolio, month, r - {COST} * coalesce(turnover, 0) AS r FROM tu UNION ALL SELECT 'equal', month, equal FROM ba UNION ALL SELECT 'fixed', month, fixed FROM ba)
    SELECT portfolio, count(*)::BIGINT AS n, avg(r) AS mean, stddev_samp(r) AS vol, avg((r > 0)::INT) AS hit_rate, min(r) AS worst FROM al GROUP BY 1""",
    "mean vol hit_rate worst",
)
def b4_a41_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net returns of the optimised weights beside those of equal and of fixed ones, over the same months."""
    s = study(spark, sf_dir)
    _, day = setups(spark, sf_dir)
    moves = day.groupBy((F.col("month") - 1).alias("month"), "date").agg(F.avg("r").alias("equal"), F.when(F.count_if(F.col("asset").isin(*MIX)) == len(MIX), F.sum(C.label_value("asset", MIX, 0.0) * F.col("r"))).alias("fixed"))
    base = moves.join(s.select("month").distinct(), "month", "left_semi").groupBy("month").agg(R.compound("equal").alias("equal"), R.compound("fixed").alias("fixed"))
    base = base.select(F.explode(F.create_map(F.lit("equal"), "equal", F.lit("fixed"), "fixed")).alias("portfolio", "r"))
    every = s.select(F.col("setup").alias("portfolio"), F.col("net").alias("r")).union(base)
    return every.groupBy("portfolio").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("vol"), F.avg((F.col("r") > 0).cast("double")).alias("hit_rate"), F.min("r").alias("worst"))


@query(
    f"""{SQL_setups}, fx AS (SELECT setup, ym, sum(cov * CASE i WHEN 'A' THEN 0.6 WHEN 'N' THEN 0.4 ELSE 0 END * CASE j WHEN 'A' THEN 0.6 WHEN 'N' THEN 0.4 ELSE 0 END) AS pv FROM cov GROUP BY ALL),
    rv AS (SELECT ym, sum(p * p) AS rv FROM (SELECT month - 1 AS ym, date, sum(CASE asset WHEN 'A' THEN 0.6 WHEN 'N' THEN 0.4 ELSE 0 END * r) AS p FROM day GROUP BY ALL) GROUP BY 1)
    SELECT setup, ym::INT AS month, pv, rv, abs(ln(greatest(rv, 1e-12) / greatest(pv, 1e-12))) AS ale FROM fx JOIN rv USING (ym)""",
    "pv rv ale",
)
def b5_estimators_of_fixed_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each setup's variance of fixed weights against the month after."""
    cov, day = setups(spark, sf_dir)
    weights = spark.createDataFrame(list(MIX.items()), "asset string, w double")
    pv = V.predicted_variance(cov, weights, ["setup", "month"])
    p = day.groupBy((F.col("month") - 1).alias("month"), "date").agg(F.sum(C.label_value("asset", MIX, 0.0) * F.col("r")).alias("p"))
    rv = p.groupBy("month").agg(F.sum(F.col("p") ** 2).alias("rv"))
    return pv.join(rv, "month").withColumn("ale", F.abs(F.log(F.greatest("rv", F.lit(1e-12)) / F.greatest("pv", F.lit(1e-12)))))


@query(
    f"""WITH px AS ({SQL_daily()}), r AS (SELECT asset, close / lag(close) OVER (PARTITION BY asset ORDER BY date) - 1 AS r FROM px WHERE date IN (SELECT date FROM px GROUP BY 1 HAVING count(*) = 3)), m AS (SELECT avg(r) FILTER (asset = 'A') AS a, avg(r) FILTER (asset = 'N') AS n, avg(r) FILTER (asset = 'R') AS x FROM r),
    c AS (SELECT (i * 11 + j)::VARCHAR AS portfolio, [i / 10.0, j / 10.0, (10 - i - j) / 10.0]::DOUBLE[] AS w FROM range(11) t(i), range(11) u(j) WHERE i + j <= 10 AND greatest(i, j, 10 - i - j) <= 6 UNION ALL SELECT 'equal', [1 / 3, 1 / 3, 1 / 3]::DOUBLE[] UNION ALL SELECT 'fixed', [0.6, 0.4, 0.0]::DOUBLE[])
    SELECT portfolio, w[1] * a + w[2] * n + w[3] * x AS expected FROM c, m""",
    "expected",
)
def a41_expected_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected return of every candidate and of both baselines, the product of weights and mean returns."""
    px = S.complete_dates(daily(spark, sf_dir))
    mean = px.withColumn("r", S.change("close", S.by("asset"))).groupBy().pivot("asset", list(ASSETS)).agg(F.avg("r"))
    fixed = [("equal", [1 / len(ASSETS)] * len(ASSETS)), ("fixed", [MIX.get(a, 0.0) for a in ASSETS])]
    weights = candidate_weights(spark).select(F.col("cand").cast("string").alias("portfolio"), "w").union(spark.createDataFrame(fixed, "portfolio string, w array<double>"))
    return weights.join(F.broadcast(mean.select(F.array(*ASSETS).alias("mean")))).select("portfolio", R.dot("w", "mean").alias("expected"))  # one row


# ---- A20, A25, B19: estimators of one panel ----
_R3 = f"SELECT * FROM ({SQL_returns('l_returnflag', 'month')})"
SQL_estimators = f"""WITH r AS ({_R3}), z AS (SELECT asset, date, r, (r - avg(r) OVER p) / stddev_samp(r) OVER p AS u, r - avg(r) OVER p AS c, row_number() OVER (PARTITION BY asset ORDER BY date) - count(*) OVER p AS back FROM r WINDOW p AS (PARTITION BY asset)), g AS (SELECT *, u - avg(u) OVER (PARTITION BY asset) AS d, exp(ln(2) / 12 * back) AS w FROM z),
p AS (SELECT a.asset AS i, b.asset AS j, covar_samp(a.r, b.r) AS s, avg(a.c * b.c) AS c, avg((a.c * b.c) ** 2) AS c4, avg(a.d * b.d) AS d, avg((a.d * b.d) ** 2) AS d4, count(*) AS n, sum(a.w * a.r * b.r) / sum(a.w) - sum(a.w * a.r) / sum(a.w) * sum(a.w * b.r) / sum(a.w) AS h, 1 - sum(a.w * a.w) / sum(a.w) ** 2 AS k FROM g a JOIN g b USING (date) GROUP BY ALL),
m AS (SELECT avg(c) FILTER (i = j) AS mc, avg(d) FILTER (i = j) AS md FROM p), t AS (SELECT least(1, sum(c4 - c * c) / any_value(n) / sum((c - (i = j)::INT * mc) ** 2)) AS bc, least(1, sum(d4 - d * d) / any_value(n) / sum((d - (i = j)::INT * md) ** 2)) AS bd, any_value(mc) AS mc, any_value(md) AS md FROM p, m),
o AS (SELECT i, j, s, h / k AS h, (1 - bc) * c + bc * mc * (i = j)::INT AS l, (1 - bd) * d + bd * md * (i = j)::INT AS q FROM p, t), v AS (SELECT i, s AS vs, q AS vq FROM o WHERE i = j),
e AS (SELECT o.i, o.j, unnest(['sample', 'half_life', 'shrunk', 'shrunk_correlation']) AS estimator, unnest([s, h, l, q / sqrt(a.vq * b.vq) * sqrt(a.vs * b.vs)]) AS cov FROM o JOIN v a ON a.i = o.i JOIN v b ON b.i = o.j)"""


def estimators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """estimator, i, j, cov (i <= j) of one monthly panel: sample, half-life, shrunk, and shrunk by way of the correlation."""
    r = S.complete_dates(returns(spark, sf_dir, "l_returnflag", "month").withColumn("close", F.col("r"))).select("asset", "date", "r")
    parts = {"sample": V.sample(r), "half_life": V.half_life(r, 12), "shrunk": V.shrunk(r), "shrunk_correlation": V.shrunk(r, standardise=True)}
    return S.stacked({k: v.select("i", "j", "cov") for k, v in parts.items()}, "estimator")


@query(f"{SQL_estimators} SELECT estimator, i, j, cov FROM e WHERE i <= j", "cov")
def b19_estimators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimators(spark, sf_dir)


@query(f"{SQL_estimators} SELECT a.estimator AS one, b.estimator AS two, sqrt(sum((a.cov - b.cov) ** 2)) AS distance FROM e a JOIN e b USING (i, j) WHERE a.estimator < b.estimator GROUP BY ALL", "distance")
def b19_a25_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frobenius distances of all pairs of estimators."""
    return V.all_distances(estimators(spark, sf_dir), "estimator")


def with_denoised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`estimators` and the sample covariance with its correlation denoised."""
    e = staged(estimators(spark, sf_dir))
    sample = staged(V.with_correlation(e.where("estimator = 'sample'").select("i", "j", "cov"), []))
    n = returns(spark, sf_dir, "l_returnflag", "month").select("date").distinct().count()
    clean = E.denoise(E.matrix(sample, "corr"), n).rows(sample)
    vol = sample.where("i = j").select(F.col("i").alias("asset"), F.sqrt("cov").alias("vol"))
    return e.unionByName(V.mixed(clean, vol, []).withColumn("estimator", F.lit("denoised")))


@query()
def b19_a25_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Condition number of each estimator, the denoised one among them; eigenvalues are beyond SQL."""
    e = staged(with_denoised(spark, sf_dir))
    names = sorted(r[0] for r in e.select("estimator").distinct().collect())  # a few estimators
    rows = []
    for name in names:
        m = E.matrix(e.where(F.col("estimator") == name))
        rows.append((name, E.condition(m.product, len(m.names))))
    return spark.createDataFrame(rows, "estimator string, condition double")


@query()
def b19_all_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frobenius distances of all pairs of the five estimators."""
    return V.all_distances(staged(with_denoised(spark, sf_dir)), "estimator")


@query()
def a24_one_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers' monthly returns as one panel: eigenvalues over the random-matrix edge, their largest and sum, the mean of the
    others, and the condition number of the denoised correlation. The matrix is in no task and not on the driver."""
    r = staged(returns(spark, sf_dir, "l_suppkey", "month"))
    corr = E.correlation(r) or E.matrix(staged(V.blocked(r, correlation=True)), "corr")
    clean = E.denoise(corr, r.select("date").distinct().count())
    low, high = clean.extremes()
    row = (len(clean.names), len(clean.values), float(clean.values.max(initial=0.0)), float(clean.values.sum()), clean.rest, high / low)
    return spark.createDataFrame([row], "n_assets int, n_above int, largest double, sum_above double, rest double, condition double")

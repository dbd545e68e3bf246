"""Scenario studies over candidate weights: metrics, the benchmark's risk over a sweep, the sweep itself, its tables, and
searches by mixed measures and by entropy.

Candidates are a parameter table; scenarios pass by them in blocks, and what is left is one row a candidate, on which every grid
point is arithmetic. CVaR moves with a constant that is added to all losses, so demeaned figures follow from full ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelkit.functions import columns as C
from panelkit.operators import joins as J
from panelkit.operators import risk as R
from panelkit.operators import scenario_chain as K
from panelkit.operators import search as X
from panelkit.operators import tails as T
from panelkit.operators.staging import staged
from panelkit.plans.registry import query, read
from panelkit.plans.tables import SQL_lattice, SQL_scenarios, dirichlet_candidates, lattice, scenarios

BENCH = (0.3, 0.3, 0.2, 0.2)
MU_GRID, FACTORS, TE_LIMITS, TURNOVER_LIMITS = (-0.002, 0.0, 0.002), (0.8, 0.9, 1.0, 1.1), (0.01, 0.05), (0.4, 0.8, 2.0)
CONTROLS = ["mu", "risk_factor", "te_limit", "turnover_limit", "architecture"]
NEAR_BEST = 0.05


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.portfolio_metrics(scenarios(spark, sf_dir), lattice(spark), BENCH, 0.95)


_DOT = lambda a, b: f"list_dot_product({a}, {b})"
_B = f"({list(BENCH)}::DOUBLE[])"
SQL_metrics = f"""WITH c AS ({SQL_lattice}), s AS ({SQL_scenarios}), x AS (SELECT cand_id, scen_id, q, -{_DOT('r', 'w')} AS loss, {_DOT('r', _B)} AS b FROM s, c), e AS (SELECT cand_id, sum(-q * loss) AS expected, sum(q * b) AS eb FROM x GROUP BY 1),
l AS (SELECT x.cand_id, scen_id, q, unnest(['full', 'demeaned', 'te_full', 'te_demeaned']) AS kind, unnest([loss, loss + expected, loss + b, loss + b + expected - eb]) AS loss FROM x JOIN e USING (cand_id)), k AS (SELECT *, sum(q) OVER (PARTITION BY cand_id, kind ORDER BY loss, scen_id) AS cum FROM l),
v AS (SELECT cand_id, kind, min(loss) FILTER (cum >= 0.95 - 1e-12) AS var FROM k GROUP BY ALL), r AS (SELECT cand_id, kind, any_value(var) + sum(greatest(loss - var, 0) * q) / 0.05 AS cvar FROM l JOIN v USING (cand_id, kind) GROUP BY ALL),
p AS (SELECT cand_id, max(cvar) FILTER (kind = 'full') AS cvar_full, max(cvar) FILTER (kind = 'demeaned') AS cvar_demeaned, max(cvar) FILTER (kind = 'te_full') AS te_full, max(cvar) FILTER (kind = 'te_demeaned') AS te_demeaned FROM r GROUP BY 1)
SELECT cand_id, expected, cvar_full, cvar_demeaned, te_full, te_demeaned, list_sum(list_transform(range(1, 5), lambda i: abs(w[i] - {_B}[i]))) AS l1, sqrt(list_sum(list_transform(range(1, 5), lambda i: (w[i] - {_B}[i]) ** 2))) AS l2, {_DOT('w', 'w')} AS hhi, list_max(w) AS max_weight, 1 / {_DOT('w', 'w')} AS effective_n,
list_sum(list_transform(range(1, 5), lambda i: abs(w[i] - {_B}[i]))) AS turnover FROM p JOIN e USING (cand_id) JOIN c USING (cand_id)"""


@query(SQL_metrics, "expected cvar_full cvar_demeaned te_full te_demeaned l1 l2 hhi max_weight effective_n turnover")
def a30_active_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir)


def with_mu(m: DataFrame) -> DataFrame:
    """Each candidate at every mean of the first asset: its expected return and demeaned figures, and the benchmark's."""
    at = m.join(lattice(m.sparkSession), "cand_id").withColumn("mu", F.explode(F.array(*map(F.lit, MU_GRID))))
    moved = at.withColumn("expected", F.col("expected") + F.col("mu") * F.col("w")[0])
    own = F.max(F.when(F.col("l1") < 1e-9, F.col("expected"))).over(Window.partitionBy("mu"))  # a row for each candidate
    risk = F.max(F.when(F.col("l1") < 1e-9, F.col("cvar_full"))).over(Window.partitionBy("mu"))
    moved = moved.withColumns({"bench_expected": own, "bench_full": risk})
    return moved.withColumns({"cvar": F.col("cvar_full") + F.col("expected"), "te": F.col("te_full") + F.col("expected") - F.col("bench_expected"), "bench_cvar": F.col("bench_full") + F.col("bench_expected")})


SQL_at = f"""SELECT *, cvar_full + expected AS cvar, te_full + expected - be AS te, bf + be AS bench_cvar FROM (SELECT *, max(expected) FILTER (l1 < 1e-9) OVER (PARTITION BY mu) AS be, max(cvar_full) FILTER (l1 < 1e-9) OVER (PARTITION BY mu) AS bf
FROM (SELECT m.* REPLACE (expected + mu * w[1] AS expected), w, mu FROM ({SQL_metrics}) m JOIN ({SQL_lattice}) USING (cand_id), (SELECT unnest({list(MU_GRID)}::DOUBLE[]) AS mu)))"""


@query(
    f"""WITH b AS (SELECT mu, any_value(bench_cvar) AS c FROM ({SQL_at}) GROUP BY 1) SELECT min(c) AS lowest, arg_min(mu, c) AS at_lowest, max(c) AS highest, arg_max(mu, c) AS at_highest, avg(c) AS mean, greatest(max(c) + 0.001, 0.02) AS effective_limit, 0.02 < max(c) + 0.001 AS adjusted, min(c) * 0.9 AS factor_lowest, max(c) * 0.9 AS factor_highest FROM b""",
    "lowest at_lowest highest at_highest mean effective_limit factor_lowest factor_highest",
)
def a32_benchmark_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's CVaR over the sweep; an absolute limit of 0.02 gives way to the highest of them and a buffer, a relative
    one is 0.9 of each."""
    b = with_mu(metrics(spark, sf_dir)).groupBy("mu").agg(F.first("bench_cvar").alias("c"))
    return R.sweep_limits(b, "mu", "c", requested=0.02, buffer=0.001, factor=0.9)


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """controls, status, best, cand_id, expected, l2, n: what each architecture chooses at each grid point.

    A: the highest expected return under CVaR and turnover limits. B: under a limit of the active CVaR, too. C: of what B
    allows within NEAR_BEST of its best, the closest to the benchmark. Grid points that nothing fits are infeasible.
    """
    array = lambda xs: F.explode(F.array(*map(F.lit, xs)))
    grid = spark.range(1).select(array(FACTORS).alias("risk_factor")).withColumn("te_limit", array(TE_LIMITS)).withColumn("turnover_limit", array(TURNOVER_LIMITS)).withColumn("architecture", array("ABC"))
    points = with_mu(metrics(spark, sf_dir)).join(F.broadcast(grid))  # 72 rows of parameters
    fits = (F.col("cvar") <= F.col("bench_cvar") * F.col("risk_factor") + 1e-12) & (F.col("turnover") <= F.col("turnover_limit") + 1e-9) & ((F.col("architecture") == "A") | (F.col("te") <= F.col("te_limit") + 1e-12))
    ok = points.withColumn("fits", fits).withColumn("best", F.max(F.when(F.col("fits"), F.col("expected"))).over(Window.partitionBy(*CONTROLS)))
    near = F.col("expected") >= F.col("best") - NEAR_BEST * F.abs("best") - 1e-12
    order = F.when(F.col("architecture") != "C", -F.round("expected", 12)).when(near, F.round("l2", 9))
    chosen = F.min(F.when(F.col("fits") & order.isNotNull(), F.struct(order.alias("order"), "cand_id", "expected", "l2")))
    out = ok.groupBy(*CONTROLS).agg(F.first("best").alias("best"), chosen.alias("x"), F.count_if("fits").alias("n"))
    return out.select(*CONTROLS, F.when(F.col("n") > 0, "optimal").otherwise("infeasible").alias("status"), "best", "x.cand_id", "x.expected", "x.l2", "n")


SQL_sweep = f"""WITH a AS ({SQL_at}), g AS (SELECT * FROM (SELECT unnest({list(FACTORS)}::DOUBLE[]) AS risk_factor), (SELECT unnest({list(TE_LIMITS)}::DOUBLE[]) AS te_limit), (SELECT unnest({list(TURNOVER_LIMITS)}::DOUBLE[]) AS turnover_limit), (SELECT unnest(['A', 'B', 'C']) AS architecture)),
p AS (SELECT *, cvar <= bench_cvar * risk_factor + 1e-12 AND turnover <= turnover_limit + 1e-9 AND (architecture = 'A' OR te <= te_limit + 1e-12) AS fits FROM a, g), o AS (SELECT *, max(expected) FILTER (fits) OVER (PARTITION BY mu, risk_factor, te_limit, turnover_limit, architecture) AS best FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY mu, risk_factor, te_limit, turnover_limit, architecture ORDER BY CASE WHEN architecture <> 'C' THEN -round(expected, 12) ELSE round(l2, 9) END, cand_id) AS k FROM o WHERE fits AND (architecture <> 'C' OR expected >= best - {NEAR_BEST} * abs(best) - 1e-12)),
n AS (SELECT mu, risk_factor, te_limit, turnover_limit, architecture, any_value(best) AS best, count(*) FILTER (fits)::BIGINT AS n FROM o GROUP BY ALL)
SELECT n.mu, n.risk_factor, n.te_limit, n.turnover_limit, n.architecture, CASE WHEN n > 0 THEN 'optimal' ELSE 'infeasible' END AS status, n.best, r.cand_id, r.expected, r.l2, n FROM n LEFT JOIN r ON k = 1 AND n.mu = r.mu AND n.risk_factor = r.risk_factor AND n.te_limit = r.te_limit AND n.turnover_limit = r.turnover_limit AND n.architecture = r.architecture"""


@query(SQL_sweep, "mu risk_factor te_limit turnover_limit best expected l2")
def b8_architectures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep(spark, sf_dir)


@query(
    f"""WITH s AS ({SQL_sweep}), w AS (SELECT architecture, mu, te_limit, turnover_limit, expected, unnest(w) AS weight, unnest([1, 2, 3, 4]) AS asset FROM s JOIN ({SQL_lattice}) USING (cand_id) WHERE abs(risk_factor - 1.0) <= 1e-8 + 1e-5)
    SELECT architecture, mu, te_limit, turnover_limit, asset::INT AS asset, weight, {_B}[asset] AS benchmark_weight, weight - {_B}[asset] AS active_weight, expected AS expected_return FROM w""",
    "mu te_limit turnover_limit weight benchmark_weight active_weight expected_return",
)
def b10_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen weights of the slice at a risk factor of one, a row for each asset, keyed by the other controls."""
    s = sweep(spark, sf_dir).where(C.near("risk_factor", 1.0)).join(lattice(spark), "cand_id").withColumnRenamed("expected", "expected_return")
    s = s.select("architecture", "mu", "te_limit", "turnover_limit", "expected_return", F.posexplode("w").alias("k", "weight"))
    bench = F.element_at(F.array(*map(F.lit, BENCH)), F.col("k") + 1)
    return s.select("architecture", "mu", "te_limit", "turnover_limit", (F.col("k") + 1).alias("asset"), "weight", bench.alias("benchmark_weight"), (F.col("weight") - bench).alias("active_weight"), "expected_return").orderBy("architecture", "mu", "te_limit", "turnover_limit", "asset")


@query(
    f"""SELECT architecture, turnover_limit, count(*)::BIGINT AS n, count(*) FILTER (status = 'optimal')::BIGINT AS feasible, count(*) FILTER (status <> 'optimal')::BIGINT AS infeasible, avg(expected) AS avg_expected, avg(l2) AS avg_l2, avg(best) AS avg_best, max(l2) AS max_l2 FROM ({SQL_sweep}) GROUP BY ALL""",
    "turnover_limit avg_expected avg_l2 avg_best max_l2",
)
def b10_summary_by_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.feasible_summary(sweep(spark, sf_dir), ["architecture", "turnover_limit"], C.feasible("status"), ["expected", "l2", "best"], "l2")


# ---- B9: two-measure mixes under limits ----
@query(
    f"""WITH c AS (SELECT cand_id, w FROM ({SQL_lattice}) WHERE list_max(w) <= 0.7 AND 1 / {_DOT('w', 'w')} >= 1.5), x AS (SELECT cand_id, {_DOT('r', 'w')} AS p, {_DOT('r', _B)} AS b FROM ({SQL_scenarios}), c), q AS (SELECT cand_id, quantile_cont(p, 0.05) AS q, avg(p) AS m FROM x GROUP BY 1),
    k AS (SELECT cand_id, any_value(m) AS m, -avg(p) FILTER (p < q) AS cvar, avg(abs(p - m)) AS mad, avg(greatest(-p, 0)) AS lpm, sqrt(avg((p - b) ** 2)) AS te FROM x JOIN q USING (cand_id) GROUP BY 1), f AS (SELECT * FROM k WHERE te <= 0.03 AND m >= (SELECT min(m) FROM k)),
    n AS (SELECT cand_id, (cvar - min(cvar) OVER ()) / (max(cvar) OVER () - min(cvar) OVER ()) AS a, (mad - min(mad) OVER ()) / (max(mad) OVER () - min(mad) OVER ()) AS mad, (lpm - min(lpm) OVER ()) / (max(lpm) OVER () - min(lpm) OVER ()) AS lpm FROM f), u AS (SELECT cand_id, a, unnest(['mad', 'lpm']) AS measure, unnest([mad, lpm]) AS b FROM n)
    SELECT measure, l / 8.0::DOUBLE AS mix, arg_min(cand_id, (round(l / 8.0 * a + (1 - l / 8.0) * b, 9), cand_id)) AS cand_id, min(l / 8.0 * a + (1 - l / 8.0) * b) AS risk, count(*)::BIGINT AS n FROM u, range(9) t(l) GROUP BY ALL""",
    "mix risk",
)
def b9_two_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CVaR with the mean absolute deviation and with the lower partial moment, under limits of tracking error, effective
    number, weight and return."""
    c = lattice(spark).where((F.array_max("w") <= 0.7) & (1 / R.dot("w", "w") >= 1.5))
    k = T.characteristics(scenarios(spark, sf_dir), c, benchmark=BENCH)
    floor = k.agg(F.min("mean").alias("least"))
    return R.mixed_risk(k.crossJoin(F.broadcast(floor)).where("tracking_error <= 0.03 and mean >= least"), "cvar", ["mad", "lpm"], 9)  # one row


# ---- B6: entropy frontier, bin sensitivity ----
_BINS = (10, 20, 30)
SQL_risks = f"""WITH c AS (SELECT cand_id, w FROM ({SQL_lattice}) WHERE list_max(w) <= 0.6), s AS ({SQL_scenarios}), x AS (SELECT cand_id, {_DOT('r', 'w')} AS p FROM s, c), e AS (SELECT min(v) AS lo, max(v) AS hi, least(min(v), -1e-12) AS dl FROM (SELECT unnest(r) AS v FROM s)),
b AS (SELECT cand_id, 'entropy' AS measure, m, greatest(0, least(m - 1, floor((p - lo) / ((hi - lo) / m)))) AS bin, count(*) AS n FROM x, e, (SELECT unnest([10, 20, 30]) AS m) GROUP BY ALL UNION ALL
SELECT cand_id, 'downside', m, CASE WHEN p > 0 THEN -1 ELSE greatest(0, least(m - 2, floor((p - dl) / (-dl / (m - 1))))) END, count(*) FROM x, e, (SELECT unnest([10, 20, 30]) AS m) GROUP BY ALL),
h AS (SELECT cand_id, measure, m, sum(-q * ln(q)) AS risk FROM (SELECT cand_id, measure, m, n / sum(n) OVER (PARTITION BY cand_id, measure, m) AS q FROM b) GROUP BY ALL)
SELECT cand_id, measure, m::INT AS bins, risk FROM h UNION ALL SELECT cand_id, 'variance', 0, var_samp(p) * 1000 FROM x GROUP BY 1"""
SQL_means = f"SELECT cand_id, avg({_DOT('r', 'w')}) AS expected FROM ({SQL_scenarios}), ({SQL_lattice}) WHERE list_max(w) <= 0.6 GROUP BY 1"


def candidate_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cand_id, expected, measure, bins, risk: variance (in thousandths), entropy and downside entropy of every candidate."""
    s, c = scenarios(spark, sf_dir), T.candidates(lattice(spark).where("array_max(w) <= 0.6"))
    found = T.candidate_risks(s, c, _BINS, R.bin_edges(s.select(F.explode("r").alias("x")), "x"))
    wide = T.frame(s, c, found | {"variance": found["variance"] * 1000})
    part = lambda name, m: F.struct(F.lit(name).alias("measure"), F.lit(m).alias("bins"), F.col(f"{name}_{m}" if m else name).alias("risk"))
    parts = [part("variance", 0), *(part(name, m) for m in _BINS for name in ("entropy", "downside"))]
    return wide.select("cand_id", "expected", F.explode(F.array(*parts)).alias("x")).select("cand_id", "expected", "x.*")


@query(
    f"""WITH r AS ({SQL_risks}), m AS ({SQL_means}), t AS (SELECT i::INT AS step, lo + (hi - lo) * i / 10 AS target FROM (SELECT min(expected) AS lo, max(expected) AS hi FROM m), range(11) x(i))
    SELECT measure, bins, step, target, arg_min(cand_id, (round(risk, 9), cand_id)) AS cand_id, min(risk) AS risk, count(*)::BIGINT AS n FROM r JOIN m USING (cand_id) JOIN t ON expected >= target - 1e-12 GROUP BY ALL""",
    "target risk",
)
def b6_frontiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each measure and number of bins the candidate of least risk that reaches each of eleven returns."""
    r = candidate_risks(spark, sf_dir)
    ends = r.agg(F.min("expected").alias("lo"), F.max("expected").alias("hi"))
    t = spark.range(11).join(F.broadcast(ends)).select(F.col("id").cast("int").alias("step"), (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("id") / 10).alias("target"))  # one row
    reached = r.join(F.broadcast(t), F.col("expected") >= F.col("target") - 1e-12)  # eleven rows of parameters
    return reached.groupBy("measure", "bins", "step", "target").agg(F.min_by("cand_id", F.struct(F.round("risk", 9), "cand_id")).alias("cand_id"), F.min("risk").alias("risk"), F.count("*").alias("n"))


@query(
    f"""WITH y AS (SELECT measure, bins, arg_min(cand_id, (round(risk, 9), cand_id)) AS cand_id FROM ({SQL_risks}) GROUP BY ALL), z AS (SELECT measure, bins, w FROM y JOIN ({SQL_lattice}) USING (cand_id))
    SELECT a.measure, a.bins AS bins_a, b.bins AS bins_b, list_sum(list_transform(range(1, 5), lambda i: abs(a.w[i] - b.w[i]))) AS l1, sqrt(list_sum(list_transform(range(1, 5), lambda i: (a.w[i] - b.w[i]) ** 2))) AS l2 FROM z a JOIN z b ON a.measure = b.measure AND a.bins < b.bins""",
    "l1 l2",
)
def b6_bin_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far apart the least-risk weights of two numbers of bins are."""
    y = candidate_risks(spark, sf_dir).groupBy("measure", "bins").agg(F.min_by("cand_id", F.struct(F.round("risk", 9), "cand_id")).alias("cand_id"))
    z = y.join(lattice(spark), "cand_id").select("measure", "bins", "w")
    pairs = z.select("measure", F.col("bins").alias("bins_a"), F.col("w").alias("u")).join(z.select("measure", F.col("bins").alias("bins_b"), F.col("w").alias("v")), "measure").where("bins_a < bins_b")
    return pairs.select("measure", "bins_a", "bins_b", _add(F.zip_with("u", "v", lambda p, q: F.abs(p - q))).alias("l1"), F.sqrt(_add(F.zip_with("u", "v", lambda p, q: (p - q) * (p - q)))).alias("l2"))


def _add(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


@query()
def b16_dirichlet_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn and fixed candidates of eight assets, capped and distinct, with mean and deviation over all scenarios."""
    c = dirichlet_candidates(spark, 8, 400, 0.6)
    both = c.join(F.broadcast(R.asset_moments(scenarios(spark, sf_dir, 8), 8)))  # one row
    deviation = F.sqrt(R.variance() * (F.col("n") - 1) / F.col("n"))
    return both.select("cand_id", R.dot("w", "mu").alias("mean"), deviation.alias("deviation"), F.array_max("w").alias("max_weight"), R.dot("w", "w").alias("hhi"))


# ---- B6, B8 on nine assets: searches from coarse to fine ----
NINE, CAP, TARGETS = 9, 0.6, 21


def frontier_search(s: DataFrame, assets: int, cap: float = CAP, targets: int = TARGETS, bins: int = 20, steps: int = 5, halvings: int = 3):
    """Candidates that were evaluated, their values, the measures and the returns to be reached.

    The returns lie between the least and the largest of the coarse lattice's, whose corners the cap allows."""
    s = s.select("q", "r").transform(staged)
    edges = R.bin_edges(s.select(F.explode("r").alias("x")), "x")
    measures, levels = ("variance", f"entropy_{bins}", f"downside_{bins}"), []

    def best(c, values):
        if not levels:
            levels.extend(np.linspace(values["expected"].min(), values["expected"].max(), targets))
        return [X.least(values[m], values["expected"] >= t - 1e-12) for m in measures for t in levels]

    c, values = X.search(lambda c: T.candidate_risks(s, c, (bins,), edges), best, assets, cap, steps, halvings)
    return c, values, measures, levels


@query()
def b6_nine_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate of least variance, entropy and downside entropy that reaches each of 21 returns, of nine assets."""
    c, values, measures, levels = frontier_search(scenarios(spark, sf_dir, NINE), NINE)
    rows = []
    for m in measures:
        for k, t in enumerate(levels):
            (i,) = X.least(values[m], values["expected"] >= t - 1e-12, 1)
            w = c.weights[i]
            rows.append((m, k, float(t), float(values["expected"][i]), float(values[m][i]), int((w > 1e-9).sum()), float(w.max()), w.tolist(), len(c.ids)))
    return spark.createDataFrame(rows, "measure string, step int, target double, expected double, risk double, n_assets int, max_weight double, weights array<double>, n_candidates int")


@query()
def b8_nine_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three architectures of the sweep on nine assets: stage 1 the highest return under limits of CVaR, turnover and, for B
    and C, active CVaR; stage 2, for C, the closest to the benchmark of what is near B's best."""
    s = scenarios(spark, sf_dir, NINE).select("q", "r").transform(staged)
    bench = [0.2, 0.2, *[0.6 / (NINE - 2)] * (NINE - 2)]
    base = T.metrics(s, T.Candidates(np.zeros(1, np.int64), np.array([bench])), bench, 0.95)
    grid = [(f, te, to) for f in FACTORS for te in TE_LIMITS for to in TURNOVER_LIMITS]

    def fits(values, f, te, to, architecture):
        ok = (values["cvar_full"] <= f * base["cvar_full"][0] + 1e-12) & (values["turnover"] <= to + 1e-9)
        return ok if architecture == "A" else ok & (values["te_full"] <= te + 1e-12)

    def chosen(values, point, architecture, keep):
        ok = fits(values, *point, architecture)
        if architecture != "C" or not ok.any():
            return X.least(-values["expected"], ok, keep)
        top = values["expected"][ok].max()
        return X.least(values["l2"], ok & (values["expected"] >= top - NEAR_BEST * abs(top) - 1e-12), keep)

    c, values = X.search(lambda c: T.metrics(s, c, bench, 0.95), lambda _, values: [chosen(values, p, a, 1) for p in grid for a in "ABC"], NINE, CAP, halvings=2, most_rounds=7)
    rows = []
    for point in grid:
        for a in "ABC":
            found = chosen(values, point, a, 1)
            x = [float(values[m][found[0]]) for m in ("expected", "cvar_full", "te_full", "turnover", "l2")] + [c.weights[found[0]].tolist()] if len(found) else [None] * 6
            rows.append((*point, a, "optimal" if len(found) else "infeasible", *x, int(fits(values, *point, a).sum())))
    return spark.createDataFrame(rows, "risk_factor double, te_limit double, turnover_limit double, architecture string, status string, expected double, cvar double, te double, turnover double, l2 double, weights array<double>, n_fit int")


@query()
def b9_nine_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes of CVaR with the mean absolute deviation and with the lower partial moment, nine of each, on nine assets: the candidate
    of least mixed risk under limits of tracking error, effective number and weight. Measures are scaled by all that fit."""
    s = scenarios(spark, sf_dir, NINE).select("q", "r").transform(staged)
    bench = [1 / NINE] * NINE
    targets = [(m, k / 8) for m in ("mad", "lpm") for k in range(9)]

    def mixed(c, values):
        ok = (values["tracking_error"] <= 0.03) & (1 / (c.weights**2).sum(1) >= 1.5)
        unit = {m: (x - x[ok].min()) / max(x[ok].max() - x[ok].min(), 1e-300) for m in ("cvar", "mad", "lpm") for x in [values[m]]}
        return ok, [mix * unit["cvar"] + (1 - mix) * unit[m] for m, mix in targets]

    def best(c, values):
        ok, risks = mixed(c, values)
        return [X.least(risk, ok, 1) for risk in risks]

    c, values = X.search(lambda c: T.measures(s, c, benchmark=bench), best, NINE, CAP, halvings=2, most_rounds=8)
    ok, risks = mixed(c, values)
    rows = []
    for (m, mix), risk in zip(targets, risks):
        (i,) = X.least(risk, ok, 1)
        rows.append((m, mix, float(risk[i]), *(float(values[k][i]) for k in ("cvar", m, "mean", "tracking_error")), c.weights[i].tolist(), int(ok.sum())))
    return spark.createDataFrame(rows, "measure string, mix double, risk double, cvar double, other double, mean double, tracking_error double, weights array<double>, n_fit int")


# ---- B18: driver paths to terminal returns, checked on the way ----
_PATHS = "SELECT l_suppkey AS scen_id, l_returnflag AS asset, ln(1 + (l_discount - l_tax) / 10) AS log_ret, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber) AS month FROM lineitem"
_CHANCES = "SELECT s_suppkey AS scen_id, abs(s_acctbal) / sum(abs(s_acctbal)) OVER () AS p FROM supplier"
HORIZONS = (12, 36, 60)


def driver_paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A scenario for each supplier with three drivers, a month for each line, and the scenarios' probabilities."""
    order = Window.partitionBy("l_suppkey", "l_returnflag").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    line = read(spark, sf_dir, "lineitem")
    paths = line.select(F.col("l_suppkey").alias("scen_id"), F.col("l_returnflag").alias("asset"), F.log1p((F.col("l_discount") - F.col("l_tax")) / 10).alias("log_ret"), F.row_number().over(order).alias("month"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("scen_id"), F.abs("s_acctbal").alias("m"))
    total = s.agg(F.sum("m").alias("total"))
    return paths, s.join(F.broadcast(total)).select("scen_id", (F.col("m") / F.col("total")).alias("p"))  # one row


@query(
    f"""WITH r AS ({_PATHS}), fx AS (SELECT scen_id, month, log_ret AS rate FROM r WHERE asset = 'N'), c AS (SELECT scen_id, asset, month, CASE WHEN asset = 'R' THEN log_ret - rate ELSE log_ret END AS x FROM r JOIN fx USING (scen_id, month) WHERE asset <> 'N' AND month <= {max(HORIZONS)})
    SELECT scen_id, asset, p, {', '.join(f'exp(sum(x) FILTER (month <= {h})) - 1 AS ret_{h}, exp(sum(x) FILTER (month <= {h}) * 12 / {h}) - 1 AS yearly_{h}' for h in HORIZONS)} FROM c JOIN ({_CHANCES}) USING (scen_id) GROUP BY ALL""",
    " ".join(["p", *(f"{k}_{h}" for h in HORIZONS for k in ("ret", "yearly"))]),
)
def b18_terminal_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX mapping, paths of 60 months, terminal and yearly returns over one, three and five years; a broken rule is an error."""
    paths, p = driver_paths(spark, sf_dir)
    found, counts = K.terminal_returns(paths.where(F.col("month") <= max(HORIZONS)), p, "N", {"R"}, HORIZONS)
    K.require(counts)
    return found


@query(
    f"""WITH r AS ({_PATHS}), k AS (SELECT scen_id, asset, max(month) AS n FROM r GROUP BY ALL) SELECT unnest(['broken_paths', 'months_outside', 'negative_p', 'not_finite', 'p_not_finite', 'sum_not_one', 'without_p', 'without_rate']) AS rule,
    unnest([(SELECT count(*) FROM k WHERE asset <> 'N' AND n <> 24), (SELECT count(*) FROM r WHERE month > 24), 0, 0, 0, 0, 0, (SELECT count(*) FROM r LEFT JOIN (SELECT scen_id, n FROM k WHERE asset = 'N') f USING (scen_id) WHERE asset <> 'N' AND month > coalesce(n, 0))])::BIGINT AS n"""
)
def b18_broken_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the chain says of whole paths if they should have 24 months: a count for each rule."""
    paths, p = driver_paths(spark, sf_dir)
    _, counts = K.terminal_returns(paths, p, "N", {"R"}, (12, 24))
    return spark.createDataFrame(sorted(counts.items()), "rule string, n long")

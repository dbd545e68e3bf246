"""Order statistics over ranges and blocks, tails by histograms and searches, against plain numpy versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelkit.operators import covariance as V
from panelkit.operators import ordered as O
from panelkit.operators import risk as R
from panelkit.operators import search as X
from panelkit.operators import series as S
from panelkit.operators import spectrum as E
from panelkit.operators import tails as T
from panelkit.operators.staging import staged
from panelkit.plans import scenario_study


@pytest.mark.parametrize("block", [4096, 7])
def test_quantiles_of_earlier_rows(spark, block):
    rng = np.random.default_rng(block)
    rows = [(f"a{i}", t, None if rng.random() < 0.1 else float(rng.integers(0, 12))) for i, n in enumerate((40, 3, 25, 7)) for t in range(n)]
    rows += [("flat", t, 1.0) for t in range(30)]
    df = spark.createDataFrame(rows, "k string, t long, x double").repartition(3, "t")
    found = {(r.k, r.t): (r.n_before, r.q0, r.q1) for r in O.expanding_quantiles(df, "x", ["k"], "t", block=block).collect()}
    assert len(found) == len(rows)
    for k, t, _ in rows:
        past = [x for kk, tt, x in rows if kk == k and tt < t and x is not None]
        n, *q = found[k, t]
        assert n == len(past) and (np.allclose(q, np.quantile(past, [0.25, 0.75]), atol=1e-12) if past else q == [None, None])
    assert O.expanding_quantiles(df.limit(0), "x", ["k"], "t").count() == 0


def test_ranks_of_one_group_over_ranges(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([("g", k, float(rng.integers(0, 20))) for k in range(203)] + [("h", k, 1.0) for k in range(5)] + [("i", 0, 2.0)], "g string, k long, x double").repartition(5)
    w = Window.partitionBy("g")
    assert O.equal_buckets(df, ["g"], ["x", "k"], 4, "x").withColumn("want", F.ntile(4).over(w.orderBy("x", "k"))).where("bucket <> want").count() == 0
    pct = O.percentile_ranks(df, ["g"], "x").withColumn("want", S.percentile_rank("x", "g"))
    assert pct.count() == 209 and pct.where("abs(pct - want) > 1e-12").count() == 0
    placed = O.positions(df, ["g"], [F.desc("x"), "k"])
    assert placed.withColumn("want", F.row_number().over(w.orderBy(F.desc("x"), "k"))).where("place <> want").count() == 0
    top = O.top_shares(placed, ["g"], "x", 0.25, 2)
    assert {r.g: r.n for r in top.where("top").groupBy("g").agg(F.count("*").alias("n")).collect()} == {"g": 51, "h": 2, "i": 1}


@pytest.mark.parametrize("few,ties", [(64, False), (4, False), (4, True)])
def test_tails_equal_sorting(spark, monkeypatch, few, ties):
    monkeypatch.setattr(T, "FEW", few)
    monkeypatch.setattr(T, "BINS", 8)
    rng = np.random.default_rng(few)
    r = rng.normal(size=(700, 3))
    r = np.round(r) if ties else r
    q = rng.random(700)
    q /= q.sum()
    s = spark.createDataFrame([(float(a), b.tolist()) for a, b in zip(q, r)], "q double, r array<double>").repartition(4)
    c = T.Candidates(np.arange(20), rng.dirichlet(np.ones(3), 20))
    if ties:
        c = T.Candidates(np.arange(3), np.eye(3))
    t, cvar = T.weighted_var_cvar(s, c, 0.95)
    for k, w in enumerate(c.weights):
        loss = -T.returns_of(r, w[None])[:, 0]
        order = np.argsort(loss, kind="stable")
        var = loss[order][np.searchsorted(np.cumsum(q[order]), 0.95 - 1e-12)]
        assert np.isclose(t.var[k], var, atol=1e-12) and np.isclose(cvar[k], var + (q * np.maximum(loss - var, 0)).sum() / 0.05, atol=1e-12) and np.isclose(t.expected[k], -(q * loss).sum())
    table = spark.createDataFrame([(int(i), w.tolist()) for i, w in zip(c.ids, c.weights)], "cand_id long, w array<double>")
    for row in T.characteristics(s, table, benchmark=(1.0, 0.0, 0.0)).collect():
        p = r @ c.weights[row.cand_id]
        cut = np.quantile(p, 0.05)
        want = [p.mean(), cut, np.abs(p - p.mean()).mean(), np.maximum(-p, 0).mean(), np.sqrt(((p - r[:, 0]) ** 2).mean())]
        assert np.allclose([row.mean, row.quantile, row.mad, row.lpm, row.tracking_error], want, atol=1e-9)
        assert ties or np.isclose(row.cvar, -p[p < cut].mean())


def test_lattice_and_moves():
    assert len(X.lattice(4, 10)) == 286 and np.allclose(X.lattice(9, 5, 0.6).sum(1), 1) and X.lattice(9, 5, 0.6).max() <= 0.6 + 1e-12
    near = X.moves(np.array([[0.6, 0.4, 0.0]]), 0.1, 0.6)
    assert sorted(map(tuple, near.tolist())) == [(0.5, 0.4, 0.1), (0.5, 0.5, 0.0), (0.6, 0.3, 0.1)]


def test_search_is_as_good_as_a_full_lattice_on_four_assets(spark):
    rng = np.random.default_rng(8)
    r = rng.normal(0.01, 0.05, (300, 4)) @ rng.normal(size=(4, 4))
    s = spark.createDataFrame([(1 / 300, x.tolist()) for x in r], "q double, r array<double>")
    c, values, measures, levels = scenario_study.frontier_search(s, 4, cap=0.6, targets=5)
    full = X.lattice(4, 20, 0.6)
    every = T.candidate_risks(s, T.Candidates(np.arange(len(full)), full), (20,), (float(r.min()), float(r.max())))
    assert len(c.ids) < len(full)
    for m in measures:
        for t in levels[:-1]:
            mine, best = values[m][values["expected"] >= t - 1e-12].min(), every[m][every["expected"] >= t - 1e-12].min()
            assert mine <= best + 0.02 * abs(best), (m, t, mine, best)


@pytest.mark.parametrize("days,least", [(10, 2), (40, 5)])
def test_rolling_correlation_equals_a_window_each(spark, days, least):
    import datetime

    rng = np.random.default_rng(days)
    rows = [("ab"[k % 2], datetime.date(2020, 1, 1) + datetime.timedelta(int(d)), None if rng.random() < 0.1 else 1e3 + float(rng.normal()), float(rng.normal()) if d < 60 else 1.0) for k in range(2) for d in np.sort(rng.choice(120, 70, replace=False))]
    found = {(r.k, r.date): r.corr for r in S.rolling_correlations(spark.createDataFrame(rows, "k string, date date, x double, y double"), "x", "y", days, ["k"], least).collect()}
    assert len(found) == len(rows)
    for k, d, _, _ in rows:
        near = [(x, y) for kk, dd, x, y in rows if kk == k and 0 <= (d - dd).days < days and x is not None]
        if len(near) < least or len({y for _, y in near}) == 1:
            assert found[k, d] is None
        else:
            assert abs(found[k, d] - np.corrcoef(np.array(near).T)[0, 1]) < 1e-8


def correlated(assets, dates, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(dates, assets))
    x[:, : assets // 3] += 1.5 * rng.normal(size=(dates, 1))
    return np.corrcoef(x, rowvar=False)


@pytest.mark.parametrize("assets", [5, 40])
def test_eigenvalues_by_products(spark, monkeypatch, assets):
    monkeypatch.setattr(E, "WIDTH", 4)
    c = correlated(assets, 60, assets)
    names = [f"a{k:02d}" for k in range(assets)]
    df = spark.createDataFrame([(names[i], names[j], float(c[i, j])) for i in range(assets) for j in range(i, assets)], "i string, j string, corr double")
    m = E.matrix(df, "corr")
    values, vectors = np.linalg.eigh(c)
    assert m.names == names and np.allclose(E.extremes(m.product, assets), values[[0, -1]]) and np.isclose(m.trace, assets)
    edge = (1 + np.sqrt(assets / 60)) ** 2
    clean = vectors @ np.diag(np.where(values < edge, values[values < edge].mean(), values)) @ vectors.T
    clean /= np.sqrt(np.outer(np.diag(clean), np.diag(clean)))
    d = E.denoise(m, 60)
    assert np.allclose(d.product(np.eye(assets)), clean, atol=1e-9) and np.isclose(E.condition(d.product, assets), np.linalg.cond(clean))
    assert all(abs(r.corr - clean[names.index(r.i), names.index(r.j)]) < 1e-9 for r in d.rows(df).collect())


def test_moments_by_blocks(spark):
    import datetime

    rng = np.random.default_rng(2)
    rows = [("pq"[g], f"a{i}", datetime.date(2000, 1, 1) + datetime.timedelta(300 * d), float(rng.normal()), float(rng.random())) for g in range(2) for i in range(9) for d in range(30) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "g string, asset string, date date, r double, w double")
    found = {(r.g, r.i, r.j): r for r in V.block_moments(df, ["g"], "w", size=3).collect()}
    assert len(found) == 90
    for (g, i, j), r in found.items():
        of = lambda a: {d: (x, w) for gg, aa, d, x, w in rows if (gg, aa) == (g, a)}
        one, two = of(i), of(j)
        x, y, w = (np.array([f(d) for d in sorted(set(one) & set(two))]) for f in (lambda d: one[d][0], lambda d: two[d][0], lambda d: one[d][1]))
        assert i <= j and r.n == len(x) and np.allclose([r.s, r.ss, r.sx, r.sy, r.sxy, r.s22], [w.sum(), (w * w).sum(), (w * x).sum(), (w * y).sum(), (w * x * y).sum(), ((x * y) ** 2).sum()])


def test_rows_of_nine_assets_are_what_they_say(spark):
    from panelkit import jobs
    from panelkit.plans.tables import scenarios

    sf = "/root/testdata/sf0.01"
    rows = scenarios(spark, sf, 9).select("q", "r").collect()
    q, r = np.array([x.q for x in rows]), np.array([x.r for x in rows])

    def weights(row):
        w = np.array(row.weights)
        assert len(w) == 9 and w.min() >= 0 and w.max() <= 0.6 + 1e-9 and abs(w.sum() - 1) < 1e-9
        return w, r @ w

    for row in jobs.QUERIES["b9_nine_assets"](spark, sf).collect():
        w, p = weights(row)
        other = np.abs(p - p.mean()).mean() if row.measure == "mad" else np.maximum(-p, 0).mean()
        te = np.sqrt(((p - r.mean(1)) ** 2).mean())
        want = [-p[p < np.quantile(p, 0.05)].mean(), other, p.mean(), te]
        assert np.allclose([row.cvar, row.other, row.mean, row.tracking_error], want, atol=2e-6) and te <= 0.03 and 1 / (w @ w) >= 1.5
    for row in jobs.QUERIES["b6_nine_assets"](spark, sf).collect():
        w, p = weights(row)
        assert abs(row.expected - p.mean()) < 2e-6 and row.expected >= row.target - 2e-6
        if row.measure == "variance":
            assert abs(row.risk - p.var(ddof=1)) < 2e-6
    for row in jobs.QUERIES["b8_nine_assets"](spark, sf).collect():
        if row.status == "optimal":
            w, p = weights(row)
            order = np.argsort(-p, kind="stable")
            var = -p[order][np.searchsorted(np.cumsum(q[order]), 0.95 - 1e-12)]
            cvar = var + (q * np.maximum(-p - var, 0)).sum() / 0.05
            assert abs(row.cvar - cvar) < 2e-6 and abs(row.expected - q @ p) < 2e-6 and row.turnover <= row.turnover_limit + 1e-6
            assert row.architecture == "A" or row.te <= row.te_limit + 1e-6


def test_rows_at_a_quantile_are_judged_by_the_returns_that_gave_it(spark):
    noise = F.udf(lambda x: x + random.random() * 1e-9, "double").asNondeterministic()  # sums of doubles in another order, but larger
    df = spark.range(21 * 40).select((F.col("id") % 40).alias("g"), F.to_date(F.lit("2020-01-01")).alias("d"), F.expr("id div 40").cast("int").alias("k"))
    df = df.select("g", F.date_add("d", F.col("k")).alias("date"), noise((F.col("k") - 10) / 100.0).alias("r"))
    for r in R.characteristics(df, "r", ["g"]).collect():  # the quantile is the second of 21 returns: one is under it, none between
        assert abs(r.cvar - 0.1) < 1e-8 and abs(r["var"] - 0.09) < 1e-8
    for r in R.tail_summary(df, "r", ["g"]).collect():  # two are at or under it
        assert abs(r.cvar + 0.095) < 1e-8


def test_long_series_are_written_a_few_times_only(spark, monkeypatch):
    rng, written = np.random.default_rng(2), []

    def counting(df):
        found = staged(df)
        written.append(found.count())
        return found

    monkeypatch.setattr(O, "staged", counting)
    x = np.where(rng.random(6000) < 0.3, 5.0, np.round(rng.normal(5, 2, 6000), 2))
    df = spark.createDataFrame([("s", t, float(v)) for t, v in enumerate(x)], "k string, t long, x double")
    found = {r.t: (r.n_before, r.q0, r.q1) for r in O.expanding_quantiles(df, "x", ["k"], "t", block=50).collect()}
    assert sum(written) < 4 * len(x)  # not a row for each statistic of each row
    assert all(found[t][0] == t and np.allclose(found[t][1:], np.quantile(x[:t], [0.25, 0.75]), atol=1e-12) for t in range(1, len(x), 37)) and found[0] == (0, None, None)


def test_a_block_of_scenarios_is_small_and_histograms_leave_in_slices(spark):
    batch = pa.RecordBatch.from_pydict({"q": [1.0] * 5000, "r": [[0.1, 0.2]] * 5000})
    assert max(len(q) for q, _ in T.blocks(iter([batch]), 1024)) * 1024 <= 1 << 18  # arrays of 2 MB, some ten at a time

"""Studies and operators that SQL can't express, and operators by themselves, against plain numpy versions."""

import datetime
import math
import tracemalloc
import warnings

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelkit import jobs
from panelkit.functions import columns as C
from panelkit.operators import covariance as V
from panelkit.operators import joins as J
from panelkit.operators import merging as G
from panelkit.operators import regression as Q
from panelkit.operators import risk as R
from panelkit.operators import series as S
from panelkit.operators import spectrum as E
from panelkit.plans import strategies, value_study

SF = "/root/testdata/sf0.01"


def panel(spark, assets=7, dates=60, missing=0.1, seed=1):
    rng = np.random.default_rng(seed)
    days = [datetime.date(2020, 1, 1) + datetime.timedelta(9 * k) for k in range(dates)]
    rows = [(f"a{i}", d, float(rng.normal(0.01, 0.1))) for i in range(assets) for d in days if rng.random() >= missing]
    return spark.createDataFrame(rows, "asset string, date date, r double"), pd.DataFrame(rows, columns=["asset", "date", "r"]).pivot(index="date", columns="asset", values="r").sort_index()


@pytest.mark.parametrize("size", [2, 3, 100])
def test_covariance_by_blocks_equals_pairwise_covariance(spark, size):
    df, wide = panel(spark)
    expected = wide.cov()
    found = V.blocked(df, size).collect()
    assert len(found) == 28 and all(r.i <= r.j and math.isclose(r["cov"], expected.loc[r.i, r.j], rel_tol=1e-9, abs_tol=1e-12) for r in found)
    assert {(r.i, r.j): r.n for r in found} == {(r.i, r.j): r.n for r in V.sample(df).collect()}


@pytest.mark.parametrize("size,missing", [(2, 0.1), (100, 0.9)])
def test_blocks_give_correlations_and_distances_without_a_row_for_a_pair_and_date(spark, size, missing):
    df, wide = panel(spark, missing=missing)
    found = V.blocked(df, size, correlation=True)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    expected = {(r.i, r.j): (r["cov"], r["corr"]) for r in V.with_correlation(V.sample(df).where("n > 1"), []).collect()}
    assert all(np.allclose((r["cov"], r["corr"]), expected.pop((r.i, r.j)), atol=1e-12) for r in found.collect()) and not expected
    two = V.pairs(df, []).groupBy("i", "j").agg(F.covar_pop("x", "y").alias("cov"))
    assert math.isclose(V.sample_population_distance(df, size).first()[0], V.distance(V.sample(df), two, []).first()[0], rel_tol=1e-12)


def plain_shrunk(x):
    x = x - x.mean(0)
    n, p = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = ((x**2).T @ (x**2) / n - s**2).sum() / (p * n)
    k = min(beta, delta) / delta
    return (1 - k) * s + k * mu * np.eye(p)


def test_window_estimates_equal_those_of_the_rows(spark):
    df, wide = panel(spark, 4, 80, 0.0)
    df = df.withColumn("month", F.year("date") * 12 + F.month("date"))
    month = np.array([d.year * 12 + d.month for d in wide.index])
    found, vols = {}, {}
    for r in V.shrunk_windows(df, 5).collect():
        found.setdefault(r.month, {})[r.i, r.j] = r["cov"]
    for r in V.ewma_windows(df, 0.9, 5).collect():
        vols[r.month, r.asset] = r.vol
    assert sorted(found) == [m for m in sorted(set(month)) if m - 4 in month]
    for m, cov in found.items():
        x = wide.to_numpy()[(month > m - 5) & (month <= m)]
        expected = plain_shrunk(x)
        assert all(math.isclose(v, expected[int(i[1]), int(j[1])], rel_tol=1e-7, abs_tol=1e-12) for (i, j), v in cov.items())
        w = 0.9 ** np.arange(len(x) - 1, -1, -1) * np.where(np.arange(len(x)) == 0, 1, 0.1)
        for k in range(4):
            mean = (w * x[:, k]).sum() / w.sum()
            var = ((w * x[:, k] ** 2).sum() / w.sum() - mean**2) / (1 - (w**2).sum() / w.sum() ** 2)
            assert math.isclose(vols[m, f"a{k}"], math.sqrt(var), rel_tol=1e-9)


def test_denoised_correlation_and_condition_number(spark):
    df, wide = panel(spark, 12, 60, 0.0)
    corr = V.with_correlation(V.sample(df), []).withColumn("p", F.lit("x"))
    clean = V.denoise(corr.select("p", "i", "j", "corr"), "p", 60)
    names = sorted(wide.columns)
    values, vectors = np.linalg.eigh(wide[names].corr().to_numpy())
    low = values < (1 + math.sqrt(12 / 60)) ** 2
    values[low] = values[low].mean()
    expected = vectors @ np.diag(values) @ vectors.T
    expected /= np.sqrt(np.outer(np.diag(expected), np.diag(expected)))
    for r in clean.collect():
        assert math.isclose(r["corr"], expected[names.index(r.i), names.index(r.j)], abs_tol=1e-9)
    (c,) = V.condition_number(clean.select("p", "i", "j", F.col("corr").alias("cov")), "p").collect()
    values = np.linalg.eigvalsh(expected)
    assert math.isclose(c.condition, values[-1] / values[0], rel_tol=1e-6)


def test_conditions_of_panels_without_a_table_of_pairs(spark):
    df, _ = panel(spark, 12, 60, 0.1)
    df = df.withColumn("p", F.length("asset"))
    found = V.panel_conditions(df, "p", 60)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    corr = V.with_correlation(V.sample(df, ["p"]), ["p"]).select("p", "i", "j", "corr")
    named = S.stacked({"sample": corr, "denoised": V.denoise(corr, "p", 60)}, "kind").select(F.concat_ws(":", "kind", "p").alias("m"), "i", "j", F.col("corr").alias("cov"))
    want = {r.m: r.condition for r in V.condition_number(named, "m").collect()}
    assert {r.matrix for r in found.collect()} == set(want) and all(math.isclose(r.condition, want[r.matrix], rel_tol=1e-8) for r in found.collect())


def test_products_with_a_correlation_without_its_pairs(spark):
    df, wide = panel(spark, 40, 60, 0.03)
    found = E.correlation(df)
    x = np.random.default_rng(0).normal(size=(40, 3))
    assert np.allclose(found.product(x), E.matrix(V.blocked(df, correlation=True), "corr").product(x), atol=1e-10)
    few, _ = panel(spark, 12, 6, 0.5)
    assert E.correlation(few) is None  # pairs over two dates, cut at one


def test_pairs_that_are_cut_at_one_need_no_table_of_all_pairs(spark):
    df, wide = panel(spark, 60, 60, 0.03)
    dates, names = wide.index, sorted(wide.columns)
    full = [a for a in names if wide[a].notna().all()]
    lone = [a for a in names if 50 < wide[a].notna().sum() < 60 and wide[a].notna().iloc[7]][:3]
    day = F.col("date") == F.lit(dates[7])  # one date's returns are so large that assets correlate by it alone
    df = df.withColumn("r", F.when(day & F.col("asset").isin(*lone, *full[:2]), 1e4).otherwise(F.col("r")))
    expected = E.matrix(V.blocked(df, correlation=True), "corr")
    plain = V.with_correlation(V.sample(df), []).where("i < j and abs(corr) = 1").count()
    assert plain  # some are cut
    for size in (3, 256):
        x = np.random.default_rng(0).normal(size=(60, 3))
        found = E.correlation(df)
        assert found is not None and found.names == expected.names and np.allclose(found.product(x), expected.product(x), atol=1e-10)
        cut = [(r.i, r.j) for r in V.tiles(df, listed, "i string, j string", size, outside=True).collect()]
        assert len(set(cut)) == len(cut) == plain


def listed(tiles):
    for t in tiles:
        yield pa.RecordBatch.from_arrays([pa.array(t.names[t.i], pa.string()), pa.array(t.names[t.j], pa.string())], ["i", "j"])


def test_conditions_of_a_large_panel_need_no_matrix():
    rng = np.random.default_rng(1)
    size, dates = 1500, 60
    x = rng.normal(size=(size, 3)) @ rng.normal(size=(3, dates)) + 2 * rng.normal(size=(size, dates))
    has = (rng.random((size, dates)) > 0.02 * (rng.random((size, 1)) < 0.4)).astype(float)
    x = (x - ((x * has).sum(1) / has.sum(1))[:, None]) * has
    tracemalloc.start()
    sample, denoised = V.conditions(x, has, dates)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    m, _ = V.cross(x, has, x, has)
    m = np.clip(m / np.sqrt(np.outer(np.diag(m), np.diag(m))), -1, 1)
    assert peak < 3 * m.nbytes and math.isclose(denoised, V._condition(V._denoised(m, dates, "usual")), rel_tol=1e-8) and math.isclose(sample, V._condition(m), rel_tol=1e-8)
    found = E.denoise(E.Matrix([""] * size, lambda v: m @ v, float(size)), dates)
    assert len(found.values) == (np.linalg.eigvalsh(m) >= (1 + (size / dates) ** 0.5) ** 2).sum() > 0
    assert np.allclose(found.extremes(), np.linalg.eigvalsh(found.product(np.eye(size)))[[0, -1]], rtol=1e-9)


def test_regressions_equal_least_squares(spark):
    rng = np.random.default_rng(5)
    rows = [(k, "uv"[k % 2], *(float(v) if rng.random() > 0.1 else None for v in rng.normal(3, 2, 4))) for k in range(200)] + [(900, "w", None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, g string, y double, a double, b double, c double")
    specs = (Q.Spec("one", "y", ("a",)), Q.Spec("two", "y", ("a", "b", "c"), lower_is_cheaper=False))
    out, summary = Q.regress_suite(df, specs, "g")
    assert out.columns == [*df.columns, *(f"{s.name}_{c}" for s in specs for c in ("fitted", "residual", "mispricing", "z"))]
    got, table = out.toPandas().set_index("id"), pd.DataFrame(rows, columns=df.columns).set_index("id")
    for s in specs:
        for g in "uv":
            used = table[table.g == g][["y", *s.predictors]].dropna()
            x = np.column_stack([np.ones(len(used)), used[list(s.predictors)]])
            beta = np.linalg.lstsq(x, used.y, rcond=None)[0]
            residual = used.y - x @ beta
            np.testing.assert_allclose(got.loc[used.index, f"{s.name}_residual"], residual, atol=1e-9)
            sign = -1 if s.lower_is_cheaper else 1
            np.testing.assert_allclose(got.loc[used.index, f"{s.name}_z"], sign * residual / residual.std(ddof=0), atol=1e-8)
            (r,) = summary.where((F.col("g") == g) & (F.col("spec") == s.name)).collect()
            assert r.n == len(used) and math.isclose(r.r_squared, 1 - (residual**2).sum() / ((used.y - used.y.mean()) ** 2).sum(), rel_tol=1e-9)
            np.testing.assert_allclose([r.coefficients[k] for k in ("intercept", *s.predictors)], beta, atol=1e-9)
            assert got.loc[table.index[(table.g == g) & ~table.index.isin(used.index)], f"{s.name}_z"].isna().all()
    assert got.loc[900, "one_fitted"] is None or np.isnan(got.loc[900, "one_fitted"])


def test_coefficients_of_the_registered_suite(spark):
    frame = value_study.frame(spark, SF).toPandas()
    found = jobs.QUERIES["a18_coefficients"](spark, SF).toPandas().set_index(["region", "spec", "predictor"]).coefficient
    for s in value_study.SPECS:
        used = frame[frame.region == "Brand#1"].dropna(subset=[s.target, *s.predictors])
        beta = np.linalg.lstsq(np.column_stack([np.ones(len(used)), used[list(s.predictors)]]), used[s.target], rcond=None)[0]
        np.testing.assert_allclose([found["Brand#1", s.name, p] for p in ("intercept", *s.predictors)], beta, rtol=1e-5, atol=2e-6)


def merge_case(spark):
    rng = np.random.default_rng(8)
    root = rng.normal(0, 0.1, (3, 3))
    sigma, mu, names = root @ root.T + 0.01 * np.eye(3), rng.normal(0, 0.05, 3), ["A", "B", "C"]
    prior = spark.createDataFrame([(names[i], names[j], float(sigma[i, j]), float(mu[i])) for i in range(3) for j in range(i, 3)], "i string, j string, cov double, mu double")
    rows = []
    for k in range(40):
        e = {a: float(rng.normal()) for a in rng.choice(names, rng.integers(1, 4), replace=False)}
        rows.append((k % 3, f"s{k % 4}", k, int(rng.choice([4, 12])), e, float(rng.normal(0, 0.3)), float(rng.uniform(0.1, 0.5))))
    return sigma, mu, names, prior, spark.createDataFrame(rows, "scenario int, source string, view int, horizon int, exposures map<string,double>, forecast double, vol double"), rows


def test_merged_forecasts_equal_the_gain_form(spark):
    sigma, mu, names, prior, views, rows = merge_case(spark)
    post = G.posterior(views, prior, (4, 12), "scenario")
    frame = G.horizon_frame(post, "scenario").toPandas().set_index(["scenario", "kind", "step", "asset"])
    parts = G.contributions(views, post, "scenario", "source").toPandas()
    fit = G.view_fit(views, post, "scenario").toPandas().set_index("view")
    nu, omega = np.concatenate([4 * mu, 8 * mu]), np.kron(np.diag([4.0, 8.0]), sigma)
    for scenario in range(3):
        own = [r for r in rows if r[0] == scenario]
        z = np.array([np.concatenate([[r[4].get(a, 0.0) for a in names], [r[4].get(a, 0.0) * (r[3] == 12) for a in names]]) for r in own])
        y, h = np.array([r[5] for r in own]), np.diag([r[6] ** 2 for r in own])
        gain = omega @ z.T @ np.linalg.inv(z @ omega @ z.T + h)
        mean, cov = nu + gain @ (y - z @ nu), omega - gain @ z @ omega
        for k, a in enumerate(names):
            for step, c in ((4, np.eye(6)[k]), (12, np.eye(6)[k] + np.eye(6)[k + 3])):
                r = frame.loc[scenario, "horizon", step, a]
                np.testing.assert_allclose([r.prior, r.prior_vol, r.posterior, r.posterior_vol], [c @ nu, math.sqrt(c @ omega @ c), c @ mean, math.sqrt(c @ cov @ c)], rtol=1e-6, atol=1e-9)
                moved = parts[(parts.scenario == scenario) & (parts.horizon == step) & (parts.asset == a)].contribution.sum()
                assert math.isclose(moved, c @ (mean - nu), rel_tol=1e-6, abs_tol=1e-9)
            assert math.isclose(frame.loc[scenario, "segment", 12, a].posterior, mean[k + 3], rel_tol=1e-6, abs_tol=1e-9)
        np.testing.assert_allclose(fit.loc[[r[2] for r in own], "implied"], z @ mean, rtol=1e-6, atol=1e-9)
        np.testing.assert_allclose(fit.loc[[r[2] for r in own], "prior_implied"], z @ nu, rtol=1e-9, atol=1e-12)


def test_views_that_do_not_fit_are_errors(spark):
    *_, prior, views, _ = merge_case(spark)
    for change in ({"exposures": F.create_map(F.lit("Z"), F.lit(1.0))}, {"horizon": F.lit(5)}, {"vol": F.lit(0.0)}):
        with pytest.raises(Exception, match="unknown asset or horizon"):
            G.posterior(views.withColumns(change), prior, (4, 12), "scenario").collect()


def test_merged_forecasts_of_the_registered_study_add_up(spark):
    frame = jobs.QUERIES["b15_horizons"](spark, SF).where("kind = 'horizon'").toPandas()
    parts = jobs.QUERIES["b15_contributions"](spark, SF).toPandas().groupby(["scenario", "horizon", "asset"]).contribution.sum()
    for r in frame.itertuples():
        assert abs(r.posterior - r.prior - parts[r.scenario, r.step, r.asset]) < 1e-4 and r.posterior_vol <= r.prior_vol + 1e-9
    assert len(frame) == 25 * 2 * 3
    fit = jobs.QUERIES["b15_view_fit"](spark, SF).toPandas()
    assert fit.n.sum() == 1500


def test_frontier_equals_pairing_everything(spark):
    rng = np.random.default_rng(2)
    cands = [(k, float(round(v, 2)), float(round(r, 2))) for k, (v, r) in enumerate(rng.normal(0, 1, (300, 2)))]
    targets = [(float(t),) for t in np.round(np.linspace(-4, 4, 41), 3)]
    for ranges in (2, 7, 64):
        found = {r.target: (r.cand_id, r.risk) for r in J.reaching(spark.createDataFrame(cands, "cand_id long, expected double, risk double"), spark.createDataFrame(targets, "target double"), ranges=ranges).collect()}
        for (t,) in targets:
            best = min(((r, k) for k, v, r in cands if v >= t - 1e-12), default=(None, None))
            assert found[t] == (best[1], best[0])


def test_checks_of_columns_values_and_panels(spark):
    df = spark.createDataFrame([(1, "A"), (2, "Z"), (3, None)], "x int, name string")
    assert J.missing_columns(df, ["x", "y"]) == ["y"] and [r[0] for r in J.unknown_values(df, "name", ["A"]).collect()] == ["Z"]
    assert J.require(df, ["x"]).count() == 3
    with pytest.raises(ValueError, match="missing columns: y"):
        J.require(df, ["x", "y"])
    with pytest.raises(ValueError, match="unknown values of name: Z"):
        J.require(df, ["x"], "name", ["A"])
    wide = spark.createDataFrame([("d1", 1.0, None), ("d2", 2.0, 3.0)], "date string, a double, b double")
    with pytest.raises(ValueError, match="b"):
        S.require_full(wide, ["a", "b"])
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert [r.date for r in S.require_full(wide, ["a", "b"], fail=False).collect()] == ["d2"]
    assert any("lack values" in str(w.message) for w in seen)


def test_free_form_dates_vectors_and_cases(spark):
    days = {"March 5, 2021": "2021-03-05", "5 March 2021": "2021-03-05", "mar 5 2021": "2021-03-05", "3-5-2021": "2021-03-05", "25-3-2021": "2021-03-25", "25. 3. 2021": "2021-03-25", "Dec-86": "1986-12-01", "2021/3/5": "2021-03-05", "rubbish": None, "": None}
    out = spark.createDataFrame([(k,) for k in days], "t string").select("t", C.date_token("t").cast("string").alias("d")).collect()
    assert {r.t: r.d for r in out} == days
    e = spark.createDataFrame([({"A": 1.0},), ({"B": 2.0, "A": -1.0},), ({"Z": 1.0},), ({},)], "e map<string,double>")
    assert [r[0] for r in e.select(C.exposure_vector("e", ("A", "B"))).collect()] == [[1.0, 0.0], [-1.0, 2.0], None, [0.0, 0.0]]
    t = spark.createDataFrame([("Case 12 b", " a, ,b.c ,")], "c string, l string").select(C.case_number("c").alias("n"), C.ticker_list("l").alias("l"), C.feasible(F.lit("Optimal")).alias("f"), C.feasible(F.lit(None).cast("string")).alias("u")).first()
    assert (t.n, t.l, t.f, t.u) == (12, ["A", "B.C"], True, False)


def test_simulated_strategy_equals_a_plain_loop(spark):
    found = jobs.QUERIES["b3_constrained_strategy"](spark, SF).toPandas().set_index("portfolio")
    table = strategies.score_panel(strategies.monthly(spark, SF)).select("date", "asset", "raw", "enhanced", "next").toPandas()
    for s in ("raw", "enhanced"):
        w, net = {}, []
        for k, (_, g) in enumerate(table.groupby("date")):
            g = g.sort_values([s, "asset"], ascending=[False, True])
            names = list(g.asset[: min(len(g), max(4, math.ceil(0.25 * len(g))))])
            target = {a: 1 / len(names) for a in names}
            turned = 0.0
            w = {a: w.get(a, 0.0) for a in g.asset}  # who has no row is not held
            w = {a: x / sum(w.values()) if sum(w.values()) > 0 else 0.0 for a, x in w.items()}
            if k % 3 == 0:
                gap = {a: target.get(a, 0) - w.get(a, 0) for a in {*target, *w}}
                turned = sum(map(abs, gap.values())) / 2
                if turned > 0.35:
                    new = {a: w.get(a, 0) + x * 0.35 / turned for a, x in gap.items()}
                else:
                    new = target
                total = sum(new.values())
                new = {a: x / total for a, x in new.items()}
                turned = sum(abs(new.get(a, 0) - w.get(a, 0)) for a in {*new, *w}) / 2
                w = new
            move = dict(zip(g.asset, g.next))
            net.append(sum(x * move.get(a, 0.0) for a, x in w.items()) - 0.001 * turned)
            w = {a: x * (1 + move.get(a, 0.0)) for a, x in w.items()}
            total = sum(w.values())
            w = {a: x / total for a, x in w.items()} if total > 0 else w
        net = np.array(net)
        assert found.n[s] == len(net) and math.isclose(found.annual_vol[s], net.std() * math.sqrt(12), rel_tol=1e-6)
        assert math.isclose(found.hit_rate[s], (net > 0).mean(), abs_tol=1e-6)


def test_mixed_measures_and_limits(spark):
    m = spark.createDataFrame([(1, 0.0, 5.0), (2, 1.0, 1.0), (3, 2.0, 0.0)], "cand_id long, cvar double, mad double")
    out = {r.mix: (r.cand_id, r.n) for r in R.mixed_risk(m, "cvar", ["mad"], 3).collect()}
    assert out == {0.0: (3, 3), 0.5: (2, 3), 1.0: (1, 3)}
    (r,) = R.sweep_limits(spark.createDataFrame([(1.0, 0.02), (2.0, 0.05)], "at double, c double"), "at", "c", 0.03, 0.01, 0.5).collect()
    assert (r.lowest, r.at_lowest, r.highest, r.at_highest, r.adjusted) == (0.02, 1.0, 0.05, 2.0, True) and math.isclose(r.effective_limit, 0.06)


def test_summary_with_excess(spark):
    by_date = jobs.QUERIES["b2_score_strategy"](spark, SF).toPandas().sort_values("date")
    found = jobs.QUERIES["b2_summary"](spark, SF).toPandas().set_index("portfolio")
    yearly = {}
    for p in ("raw", "enhanced", "benchmark"):
        r = by_date[p].to_numpy()
        yearly[p] = np.prod(1 + r) ** (12 / len(r)) - 1
        wealth = np.cumprod(1 + r)
        assert math.isclose(found.annual_return[p], yearly[p], rel_tol=1e-4) and math.isclose(found.annual_vol[p], r.std() * math.sqrt(12), rel_tol=1e-4)
        assert math.isclose(found.max_drawdown[p], (wealth / np.maximum.accumulate(wealth) - 1).min(), abs_tol=1e-4)
        names = by_date.n if p == "benchmark" else np.ceil(by_date.n * 0.25)
        assert math.isclose(found.avg_names[p], names.mean(), rel_tol=1e-6)
    assert all(math.isclose(found.excess[p], yearly[p] - yearly["benchmark"], rel_tol=1e-4, abs_tol=1e-4) for p in yearly)


def test_single_score_model(spark):
    b = strategies._brands(spark, SF).toPandas()
    z = lambda x: (x - x.mean()) / x.std(ddof=0)
    adjusted = (z(b.disc) - z(b.price) + 0.25 * z(b.qty)) / 3
    x = np.column_stack([np.ones(len(b)), b.disc, b.tax, b.qty])
    residual = b.price - x @ np.linalg.lstsq(x, b.price, rcond=None)[0]
    final = pd.Series((0.6 * adjusted + 0.4 * z(-residual)).to_numpy(), b.brand)
    lo, hi = final.quantile([0.25, 0.75])
    for r in jobs.QUERIES["b13_relative_value"](spark, SF).collect():
        assert math.isclose(r.final, final[r.brand], abs_tol=1e-4)
        assert r.regime == ("cheap" if final[r.brand] >= hi else "expensive" if final[r.brand] <= lo else "neutral") or min(abs(final[r.brand] - lo), abs(final[r.brand] - hi)) < 1e-6


def test_drawn_candidates_over_scenarios(spark):
    from panelkit.plans.tables import dirichlet_candidates, scenarios

    w = {r.cand_id: np.array(r.w) for r in dirichlet_candidates(spark, 8, 400, 0.6).collect()}
    x = np.array([r.r for r in scenarios(spark, SF, 8).collect()])
    assert len({tuple(v) for v in w.values()}) == len(w) > 300 and all(abs(v.sum() - 1) < 1e-9 and v.max() <= 0.6 + 1e-9 for v in w.values())
    found = jobs.QUERIES["b16_dirichlet_risks"](spark, SF).collect()
    assert len(found) == len(w)
    for r in found:
        p = x @ w[r.cand_id]
        assert abs(r["mean"] - p.mean()) < 2e-6 and abs(r.deviation - p.std()) < 2e-6 and abs(r.hhi - (w[r.cand_id] ** 2).sum()) < 2e-6

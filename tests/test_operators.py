"""Facts, identities and plain numpy versions of the panel, risk and covariance operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.functions import columns as C
from panelkit.operators import covariance as V
from panelkit.operators import joins as J
from panelkit.operators import risk as R
from panelkit.operators import series as S
from panelkit.operators.holdings import simulate
from panelkit.plans.strategies import merge_forecasts, regress
from panelkit.sources import files


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


@pytest.mark.parametrize(("text", "value"), [("1.234,5", 1.2345), ("1,234.5", 1234.5), ("12,5", 12.5), (" 12.5", 12.5), ("N/A", None), ("", None), ("USD 12.5", 12.5), ("-3e2", -300.0), (None, None)])
def test_number_tokens(spark, text, value):
    assert one(spark, C.number_token(F.lit(text))) == value


@pytest.mark.parametrize(("text", "value"), [("Dec-86", dt.date(1986, 12, 1)), ("Jan-68", dt.date(2068, 1, 1)), ("2020-01", dt.date(2020, 1, 1)), ("31.12.2020", dt.date(2020, 12, 31)), ("13/01/2020", dt.date(2020, 1, 13)), ("02/01/2020", dt.date(2020, 2, 1)), ("junk", None)])
def test_date_tokens(spark, text, value):
    assert one(spark, C.date_token(F.lit(text))) == value


def test_labels(spark):
    assert one(spark, C.country_key(F.lit("  Côte d'Ivoire & Co."))) == "cote d ivoire and co"
    assert one(spark, C.country_key(F.lit("South Korea"))) == "korea"
    assert one(spark, C.sector_of(F.lit("Software (Entertainment)"))) == "Communication Services"
    assert one(spark, C.sector_of(F.lit("R.E.I.T. banks"))) == "Financials" and one(spark, C.sector_of(F.lit(None).cast("string"))) == "Industrials"
    assert one(spark, C.combine_actions(F.lit("overweight"), F.lit("underweight"))) == "relative_underweight"
    assert one(spark, C.combine_actions(F.lit("?"), F.lit("underweight"))) == "market_weight"
    assert one(spark, C.decimal_month(F.lit(1871.10))) == dt.date(1871, 10, 1) and one(spark, C.decimal_month(F.lit(1871.13))) is None
    assert one(spark, C.exposures_text(F.create_map(F.lit("B"), F.lit(-1.0), F.lit("A"), F.lit(1.0)))) == "A:+1.00; B:-1.00"
    assert one(spark, C.grid(0.0, 0.3, 0.1)) == [0.0, 0.1, 0.2, 0.3]
    assert one(spark, C.row_mean(F.lit(1.0), F.lit(None).cast("double"), F.lit(3.0))) == 2.0
    assert one(spark, C.to_number(F.lit(float("inf")))) is None


def test_currency_carry_and_cash(spark):
    r = spark.createDataFrame([(day(30), 0.02)], "date date, r double")
    fx = spark.createDataFrame([(day(30), 0.01)], "date date, fx double")
    assert abs(S.convert(r, fx, ["date"]).first().r_converted - 0.01) < 1e-10
    x = spark.createDataFrame([(0.01, 2.0, 0.5, 2.4)], "r double, eur double, usd double, rate double").select(S.hedged("r", "eur", "usd").alias("h"), S.cash_return("rate").alias("c")).first()
    assert abs(x.h - (0.01 + 1.5 / 12 / 100)) < 1e-10 and abs(x.c - 0.001998) < 1e-5


def test_index_file_with_lines_before_its_data(spark, tmp_path):
    (tmp_path / "i.csv").write_text("Index Performance\nIndex: X\nCurrency: USD\n\nDate,Index Level\nDec-86,100.00\nJan-87,103.42\nJan-87,999\n")
    rows = sorted(files.read_index_csv(spark, f"{tmp_path}/i.csv").collect())
    assert [tuple(r) for r in rows] == [(dt.date(1986, 12, 1), 100.0), (dt.date(1987, 1, 1), 103.42)]


def test_files_round_trip(spark, tmp_path):
    for t, days in (("aa", (0, 1, 2)), ("bb", (0, 2))):
        (tmp_path / f"{t}.csv").write_text("Date,Close\n" + "".join(f"{day(d)},{10 + d}\n" for d in days))
    panel = files.read_close_panel(spark, f"{tmp_path}/*.csv")
    assert sorted((r.asset, r.date) for r in panel.collect()) == [(a, day(d)) for a in ("aa", "bb") for d in (0, 2)]
    df = spark.createDataFrame([("a", 1.0), ("b", float("nan"))], "k string, v double")
    files.write_both(df, f"{tmp_path}/t")
    assert files.read_table(spark, str(tmp_path), "t").count() == 2
    spark.createDataFrame([("1", "x")], "v string, k string").write.option("header", True).csv(f"{tmp_path}/u.csv")
    assert files.read_table(spark, str(tmp_path), "u").count() == 1
    assert sorted(r.value for r in files.json_rows(df).collect()) == ['{"k":"a","v":1.0}', '{"k":"b","v":null}']
    status = spark.createDataFrame([("A", "optimal"), ("A", "infeasible"), ("B", "optimal")], "g string, status string")
    assert '"total":3' in files.manifest(status, "g", "status").where("g = 'A'").first().manifest
    s = files.read_scenarios(spark.createDataFrame([("1", "2", "3", "x")], ["Prob-ability", "Asset A", "beta", "Unnamed: 0"]), {"asset_a": [], "B": ["Beta"]}).first()
    assert (s.q, s.r) == (1.0, [2.0, 3.0])
    with pytest.raises(ValueError):
        files.read_scenarios(df, {"missing": []})


def test_regime_needs_history_and_tests_high_first(spark):
    df = spark.createDataFrame([("a", day(k), 5.0) for k in range(38)], "asset string, date date, dy double")
    out = [r.x for r in df.withColumn("x", S.expanding_regime("dy", S.by("asset"))).orderBy("date").collect()]
    assert out == [None] * 36 + ["high"] * 2


def test_z_score_of_a_constant_group_is_zero(spark):
    from pyspark.sql.window import Window

    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, None), (2, 1.0), (2, 3.0)], "g int, x double")
    assert sorted((r.g, str(r.z)) for r in df.withColumn("z", S.z_score("x", Window.partitionBy("g"))).collect()) == [(1, "0.0"), (1, "0.0"), (2, "-1.0"), (2, "1.0"), (2, "None")]


def test_fill_forward_and_complete_dates(spark):
    df = spark.createDataFrame([("a", day(0), 1.0), ("a", day(2), 3.0), ("b", day(1), 5.0), ("c", day(0), 7.0), ("c", day(1), 8.0), ("c", day(2), 9.0)], "asset string, date date, close double")
    out = {(r.asset, r.date): r.close for r in S.fill_forward(df).collect()}
    assert {a for a, _ in out} == {"a", "c"} and out["a", day(1)] == 1.0
    assert S.complete_dates(df.where("asset <> 'b'")).count() == 4


def test_instability_chain_breaks_at_a_null(spark):
    df = spark.createDataFrame([(1, 3, 0.1, 0.9), (1, 2, None, None), (1, 1, 0.3, 0.7), (1, 0, 0.5, 0.5)], "g int, mu int, a double, b double")
    out = [r.l1 for r in S.instability(df, ["a", "b"], ["g"], F.desc("mu")).orderBy(F.desc("mu")).collect()]
    assert out[:3] == [None, None, None] and abs(out[3] - 0.4) < 1e-12


def test_weighted_var_cvar(spark):
    rng = np.random.default_rng(1)
    loss, q = rng.normal(size=200), rng.random(200)
    q /= q.sum()
    df = spark.createDataFrame([(1, k, float(a), float(b)) for k, (a, b) in enumerate(zip(loss, q))], "c int, scen_id int, loss double, q double")
    got = R.weighted_var_cvar(df, ["c"], 0.9).first()
    order = np.argsort(loss)
    var = loss[order][np.searchsorted(np.cumsum(q[order]), 0.9)]
    assert abs(got["var"] - var) < 1e-12 and abs(got.cvar - (var + (q * np.maximum(loss - var, 0)).sum() / 0.1)) < 1e-12 and got.cvar >= got["var"]


def test_var_on_an_exact_step(spark):
    df = spark.createDataFrame([(1, k, float(k), 0.1) for k in range(10)], "c int, scen_id int, loss double, q double")
    assert R.weighted_var_cvar(df, ["c"], 0.3).first()["var"] == 2.0


def returns(spark, n=60, assets=4, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, assets)) @ rng.normal(size=(assets, assets)) * 0.01
    return x, spark.createDataFrame([(f"a{j}", day(t), float(x[t, j])) for t in range(n) for j in range(assets)], "asset string, date date, r double")


def as_matrix(df, value="cov"):
    return V.matrix(df.toPandas(), value)[1]


def test_covariances(spark):
    x, df = returns(spark)
    n, p = x.shape
    assert np.allclose(as_matrix(V.sample(df)), np.cov(x.T))
    assert np.allclose(as_matrix(V.with_correlation(V.sample(df), []), "corr"), np.corrcoef(x.T))
    w = np.exp(np.log(2) / 10 * (np.arange(1, n + 1) - n))
    assert np.allclose(as_matrix(V.half_life(df, 10)), np.cov(x.T, aweights=w))
    c = x - x.mean(0)
    s = c.T @ c / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = min(((c**2).T @ (c**2) / n - s**2).sum() / (n * p), delta)
    assert np.allclose(as_matrix(V.shrunk(df)), (1 - beta / delta) * s + beta / delta * mu * np.eye(p))


def test_ewma_vol_equals_the_recursion_on_pairs_of_weights(spark):
    import pandas as pd

    x, df = returns(spark)
    got = {r.asset: r.vol for r in V.ewma_vol(df, 0.94, []).collect()}
    want = pd.DataFrame(x).ewm(alpha=0.06, adjust=False).std().iloc[-1]
    assert all(abs(got[f"a{j}"] - want[j]) < 1e-12 for j in range(4))


def test_denoise_and_conditions(spark):
    _, df = returns(spark, 40, 8)
    corr = V.with_correlation(V.sample(df), []).withColumn("g", F.lit("x"))
    clean = V.denoise(corr.select("g", "i", "j", "corr"), "g", 40)
    m = as_matrix(clean, "corr")
    assert np.allclose(np.diag(m), 1) and np.linalg.eigvalsh(m)[0] > 0
    both = corr.select(F.lit("raw").alias("kind"), "i", "j", F.col("corr").alias("cov")).unionByName(clean.select(F.lit("clean").alias("kind"), "i", "j", F.col("corr").alias("cov")))
    c = {r.kind: r.condition for r in V.condition_number(both, "kind").collect()}
    assert c["clean"] < c["raw"]


def test_trailing_rows_are_an_equi_join(spark):
    px = spark.createDataFrame([(k, float(k)) for k in range(1, 41)], "pos long, x double")
    cal = spark.createDataFrame([(12, "a"), (13, "b"), (40, "c"), (3, "d")], "pos long, rebalance string")
    for inclusive in (True, False):
        out = J.trailing_rows(cal, px, 5, inclusive).groupBy("rebalance").agg(F.collect_set("pos").alias("p")).collect()
        assert {r.rebalance: sorted(r.p) for r in out} == {n: list(range(max(1, at - 4 - (not inclusive)), at + inclusive)) for n, at in (("a", 12), ("b", 13), ("c", 40), ("d", 3))}


def test_frontier_by_running_minimum(spark):
    rng = np.random.default_rng(4)
    c = [(k, float(rng.random()), float(rng.random())) for k in range(200)]
    got = J.reaching(spark.createDataFrame(c, "cand_id long, expected double, risk double"), spark.createDataFrame([(x / 10,) for x in range(12)], "target double")).collect()
    for r in got:
        ok = [(risk, k) for k, e, risk in c if e >= r.target - 1e-12]
        assert (r.risk, r.cand_id) == (min(ok) if ok else (None, None))


def test_regression_equals_lstsq(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50, 2))
    y = x @ [1.0, -2.0] + 3 + rng.normal(size=50) * 0.1
    df = spark.createDataFrame([(k, float(a), float(b), float(v)) for k, ((a, b), v) in enumerate(zip(x, y))] + [(99, None, 1.0, 1.0)], "k int, a double, b double, y double")
    got = {r.k: r for r in regress(df, "y", ["a", "b"], "k").collect()}
    d = np.c_[np.ones(50), x]
    fit = d @ np.linalg.lstsq(d, y, rcond=None)[0]
    assert all(abs(got[k].fitted - fit[k]) < 1e-9 for k in range(50)) and got[99].fitted is None


def test_drift_and_turnover_cap(spark):
    rows = [("s", day(k), a, t, r) for k in range(5) for a, t, r in (("x", 1.0 if k < 3 else 0.0, 0.1), ("y", 0.0 if k < 3 else 1.0, 0.0))]
    dates, rebalances = simulate(spark.createDataFrame(rows, "s string, date date, asset string, target double, next double"), "s")
    out = sorted(dates.collect(), key=lambda r: r.date)
    assert [round(r.turnover, 6) for r in out] == [0.5, 0, 0, 0.35, 0] and abs(out[0].net - (0.1 - 0.0005)) < 1e-12 and abs(out[3].gross - 0.065) < 1e-12
    w = np.array([0.65 * 1.1, 0.35])
    assert abs(out[4].gross - 0.1 * w[0] / w.sum()) < 1e-12
    assert [(r.n_positions, r.top_positions) for r in sorted(rebalances.collect(), key=lambda r: r.date)] == [(1, "x:100.00%"), (2, "x:65.00% | y:35.00%")]


@pytest.mark.parametrize("seed", [1, 2])
def test_simulation_equals_a_loop_when_assets_come_and_go(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [("ab"[s], day(k), f"n{i}", float(rng.random() < 0.4), float(rng.normal(0, 0.2)) if rng.random() < 0.9 else None) for s in range(2) for k in range(17) for i in range(6) if rng.random() < 0.8]
    total = {}
    for s, d, _, t, n in rows:
        total[s, d] = total.get((s, d), 0) + (t if n is not None else 0)
    rows = [(s, d, a, t / total[s, d] if total[s, d] else 0.0, n) for s, d, a, t, n in rows]
    dates, _ = simulate(spark.createDataFrame(rows, "s string, date date, asset string, target double, next double"), "s", 0.3, 0.01, 4)
    found = {(r.s, r.date): r for r in dates.collect()}
    for s in "ab":
        w, wealth = {}, 1.0
        for k, d in enumerate(sorted({r[1] for r in rows if r[0] == s and r[4] is not None})):
            here = {r[2]: r for r in rows if r[:2] == (s, d) and r[4] is not None}
            now = {a: w.get(a, 0.0) for a in here}
            now = {a: x / sum(now.values()) if sum(now.values()) > 0 else 0.0 for a, x in now.items()}
            target, turned = {a: r[3] for a, r in here.items()}, 0.0
            if k % 4 == 0 and sum(target.values()) > 0:
                gap = sum(abs(target[a] - now[a]) for a in here) / 2
                new = target if gap <= 0.3 else {a: now[a] + (target[a] - now[a]) * 0.3 / gap for a in here}
                new = {a: x / sum(new.values()) for a, x in new.items()}
                turned, now = sum(abs(new[a] - now[a]) for a in here) / 2, new
            gross = sum(now[a] * here[a][4] for a in here)
            wealth *= 1 + gross - 0.01 * turned
            r = found[s, d]
            assert np.allclose([r.gross, r.turnover, r.net, r.equity, r.largest_weight], [gross, turned, gross - 0.01 * turned, wealth, max(now.values())], atol=1e-12) and r.n_positions == sum(x > 1e-8 for x in now.values()), (s, k)
            w = {a: x * (1 + here[a][4]) for a, x in now.items()}


def test_forecast_merge_properties(spark):
    prior = spark.createDataFrame([("AAA", "AAA", 0.0025, 0.004), ("AAA", "BBB", 0.0004, 0.004), ("BBB", "BBB", 0.0012, 0.001)], "i string, j string, cov double, mu double")
    v = [("loose", {"AAA": 1.0, "BBB": -1.0}, 0.03, 1e6), ("tight", {"AAA": 1.0, "BBB": -1.0}, 0.03, 1e-8)]
    out = {(r.scenario, r.asset): r for r in merge_forecasts(prior, spark.createDataFrame(v, "scenario string, exposures map<string,double>, forecast double, vol double")).collect()}
    assert abs(out["loose", "AAA"].posterior - 0.004) < 1e-10 and abs(out["loose", "BBB"].posterior - 0.001) < 1e-10
    assert abs(out["tight", "AAA"].posterior - out["tight", "BBB"].posterior - 0.03) < 1e-8 and all(r.variance > -1e-10 for r in out.values())


def test_forecast_merge_of_many_views_in_one_scenario(spark):
    rng = np.random.default_rng(7)
    half = rng.normal(size=(3, 3))
    sigma, mu, names = half @ half.T * 1e-3, np.array([0.01, -0.02, 0.03]), ["a", "b", "c"]
    prior = spark.createDataFrame([(names[i], names[j], float(sigma[i, j]), float(mu[i])) for i in range(3) for j in range(i, 3)], "i string, j string, cov double, mu double")
    views = [("few", {"a": 1.0, "c": -0.5}, 0.02, 0.05), ("few", {"b": 2.0}, 0.01, 0.1), ("exact", {"a": 1.0}, 0.05, 0.0), ("exact", {"b": 1.0, "c": 1.0}, 0.02, 0.03), ("mixed", {"a": 1.0, "b": 1.0}, 0.02, 1e-7), ("mixed", {"c": 1.0}, 0.01, 0.02), ("none", {}, 0.1, 0.1)]
    views += [("many", {names[k % 3]: 1.0 + k % 2}, float(f), 0.05) for k, f in enumerate(rng.normal(0, 0.1, 400))]
    df = spark.createDataFrame(views, "scenario string, exposures map<string,double>, forecast double, vol double")
    found = {}
    for r in merge_forecasts(prior, df).collect():
        found.setdefault(r.scenario, {})[r.asset] = (r.posterior, r.variance)
    for name in ("few", "exact", "mixed", "none", "many"):
        own = [v for v in views if v[0] == name]
        p = np.array([[v[1].get(a, 0.0) for a in names] for v in own])
        gain = sigma @ p.T @ np.linalg.pinv(p @ sigma @ p.T + np.diag([v[3] ** 2 for v in own]))
        want = mu + gain @ (np.array([v[2] for v in own]) - p @ mu), np.diag(sigma - gain @ p @ sigma)
        assert np.allclose([found[name][a] for a in names], np.transpose(want), rtol=1e-9, atol=1e-12), name
    big = spark.range(60_000).selectExpr("'s' AS scenario", "map(element_at(array('a', 'b', 'c'), cast(id % 3 + 1 AS int)), 1.0D) AS exposures", "0.01D AS forecast", "0.05D AS vol")
    assert {r.asset for r in merge_forecasts(prior, big).collect()} == set(names)  # by views, a matrix of 29 GB


def test_entropy_bounds_and_terminal_returns(spark):
    _, df = returns(spark, 200, 3)
    e = R.histogram_entropy(df, "r", ["asset"], R.bin_edges(df, "r"), 20).collect()
    assert all(0 < r.entropy <= math.log(20) and 0 < r.normalised <= 1 for r in e)
    assert all(r.entropy >= 0 for r in R.downside_entropy(df, "r", ["asset"], R.bin_edges(df, "r"), 20).collect())
    p = spark.createDataFrame([(1, "a", m, 0.01) for m in range(1, 61)], "scen_id int, asset string, month int, log_ret double")
    t = R.terminal_returns(p, ["scen_id", "asset"], (12, 60)).first()
    assert abs(t.ret_12 - math.expm1(0.12)) < 1e-12 and abs(t.yearly_60 - math.expm1(0.12)) < 1e-12


def test_candidate_weights(spark):
    from panelkit.plans.tables import dirichlet_candidates

    c = dirichlet_candidates(spark, 5, 400, cap=0.6).collect()
    assert all(abs(sum(r.w) - 1) < 1e-9 and max(r.w) <= 0.6 + 1e-12 and min(r.w) >= 0 for r in c)
    assert len({tuple(r.w) for r in c}) == len(c) > 150 and [0.2] * 5 in [r.w for r in c] and [0.6, 0.4, 0, 0, 0] in [r.w for r in c]
    assert sorted(map(str, c)) == sorted(map(str, dirichlet_candidates(spark, 5, 400, cap=0.6).collect()))
    means = np.mean([r.w for r in dirichlet_candidates(spark, 3, 4000).where("cand_id >= 0").collect()], axis=0)
    assert np.allclose(means, 1 / 3, atol=0.02)

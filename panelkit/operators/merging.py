"""Linear views with noise merged with a Gaussian prior over horizons.

A horizon is a sum of segments; a view is on a horizon, so on all segments up to it. In information form a scenario's views
are sums - of z z' / vol^2 and of z (forecast - z prior) / vol^2 - which one aggregate takes over all scenarios and views; what is
solved for each scenario has as many unknowns as assets times segments, however many views there are.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.functions.columns import exposure_vector
from panelkit.operators.risk import dot

MOST_ASSETS = 200


def _model(prior: DataFrame, horizons: Sequence[int]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The assets, and mean and covariance of all segments; prior: i, j, cov (i <= j), mu of i."""
    rows = prior.limit(MOST_ASSETS * (MOST_ASSETS + 1) // 2 + 1).collect()
    names = sorted({r["i"] for r in rows} | {r["j"] for r in rows})
    if len(names) > MOST_ASSETS or len(rows) > MOST_ASSETS * (MOST_ASSETS + 1) // 2:
        raise ValueError(f"a prior of more than {MOST_ASSETS} assets")
    at = {a: k for k, a in enumerate(names)}
    sigma, mu = np.zeros((len(names), len(names))), np.zeros(len(names))
    for r in rows:
        sigma[at[r["i"]], at[r["j"]]] = sigma[at[r["j"]], at[r["i"]]] = r["cov"]
        if r["i"] == r["j"]:
            mu[at[r["i"]]] = r["mu"]
    steps = np.diff([0, *sorted(horizons)]).astype(float)
    return names, np.concatenate([s * mu for s in steps]), np.kron(np.diag(steps), sigma)


def _lit(x: np.ndarray):
    return F.array(*(F.lit(float(v)) for v in x))


def _with_z(views: DataFrame, names: list[str], horizons: Sequence[int]) -> DataFrame:
    """views with z, the exposures to every segment's assets; a view with an unknown asset or horizon has none and is an error."""
    e = exposure_vector("exposures", names)
    upto = lambda h: lambda x: F.when(F.col("horizon") >= h, x).otherwise(0.0)
    parts = [F.transform(e, upto(h)) for h in sorted(horizons)]
    z = F.when(F.col("horizon").isin(*horizons) & (F.col("vol") > 0) & e.isNotNull(), F.concat(*parts))
    return views.withColumn("z", F.coalesce(z, F.raise_error(F.lit("a view has an unknown asset or horizon, or no positive vol")).cast("array<double>")))


def posterior(views: DataFrame, prior: DataFrame, horizons: Sequence[int], key: str) -> DataFrame:
    """key, mean, cov (row by row), and assets, horizons, prior_mean, prior_cov, one row for each scenario of the views
    (key, horizon, exposures, forecast, vol)."""
    names, nu, omega = _model(prior, horizons)
    n, inverse = len(nu), np.linalg.pinv(omega)
    v = _with_z(views, names, horizons).select(key, "z", F.try_divide(F.lit(1.0), F.col("vol") ** 2).alias("q"), (F.col("forecast") - dot("z", _lit(nu))).alias("gap"))
    own = v.select(key, "z", "q", "gap", F.posexplode("z").alias("i", "zi")).where("zi <> 0")
    right = own.select(key, "i", F.lit(-1).alias("j"), (F.col("zi") * F.col("q") * F.col("gap")).alias("v"))
    left = own.select(key, "i", "zi", "q", F.posexplode("z").alias("j", "zj")).where("zj <> 0").select(key, "i", "j", (F.col("zi") * F.col("zj") * F.col("q")).alias("v"))
    sums = left.unionByName(right).groupBy(key, "i", "j").agg(F.sum("v").alias("v"))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        m, b = inverse.copy(), np.zeros(n)
        i, j, v = (rows[c].to_numpy() for c in ("i", "j", "v"))
        np.add.at(m, (i[j >= 0], j[j >= 0]), v[j >= 0])
        b[i[j < 0]] = v[j < 0]
        cov = np.linalg.inv(m)
        return pd.DataFrame({key: [rows[key].iloc[0]], "mean": [(nu + cov @ b).tolist()], "cov": [((cov + cov.T) / 2).ravel().tolist()]})

    kind = views.schema[key].dataType.simpleString()
    solved = sums.groupBy(key).applyInPandas(solve, f"{key} {kind}, mean array<double>, cov array<double>")  # n * (n + 1) rows at most
    return solved.withColumns({"assets": F.array(*map(F.lit, names)), "horizons": F.array(*map(F.lit, sorted(horizons))), "prior_mean": _lit(nu), "prior_cov": _lit(omega.ravel())})


def _sum(xs):
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def horizon_frame(post: DataFrame, key: str) -> DataFrame:
    """key, kind (horizon or segment), step, asset, prior, prior_vol, posterior, posterior_vol."""
    a, n = F.size("assets"), F.size("mean")
    cell = lambda m, r, c: F.get(F.col(m), r * n + c)
    rows = post.select("*", F.posexplode("assets").alias("a", "asset")).select("*", F.posexplode("horizons").alias("s", "step")).withColumn("kind", F.explode(F.array(F.lit("horizon"), F.lit("segment"))))
    first = F.when(F.col("kind") == "horizon", 0).otherwise(F.col("s"))
    steps = F.sequence(first, F.col("s"))
    mean = lambda m: _sum(F.transform(steps, lambda s: F.get(F.col(m), s * a + F.col("a"))))
    vol = lambda m: F.sqrt(_sum(F.transform(steps, lambda s: _sum(F.transform(steps, lambda t: cell(m, s * a + F.col("a"), t * a + F.col("a")))))))
    return rows.select(key, "kind", "step", "asset", mean("prior_mean").alias("prior"), vol("prior_cov").alias("prior_vol"), mean("mean").alias("posterior"), vol("cov").alias("posterior_vol"))


def _joined(views: DataFrame, post: DataFrame, key: str) -> DataFrame:
    """Views beside their scenario's posterior, with z. Scenarios share assets and horizons."""
    one = post.select("assets", "horizons").first()
    return _with_z(views, list(one[0]), list(one[1])).join(post, key) if one else views.join(post, key).withColumn("z", F.col("mean"))


def view_fit(views: DataFrame, post: DataFrame, key: str) -> DataFrame:
    """Views with what prior and posterior imply for them."""
    j = _joined(views, post, key)
    return j.withColumns({"prior_implied": dot("z", "prior_mean"), "implied": dot("z", "mean")}).select(*views.columns, "prior_implied", "implied")


def contributions(views: DataFrame, post: DataFrame, key: str, source: str) -> DataFrame:
    """key, source, horizon, asset, contribution: posterior less prior, parted by where it comes from; parts add up to it."""
    n, a = F.size("mean"), F.size("assets")
    pull = (F.col("forecast") - dot("z", "prior_mean")) / F.col("vol") ** 2
    moved = F.transform(F.sequence(F.lit(0), n - 1), lambda r: _sum(F.zip_with(F.slice("cov", r * n + 1, n), "z", lambda c, z: c * z)))
    rows = _joined(views, post, key).select(key, source, "assets", "horizons", pull.alias("pull"), moved.alias("moved"), "mean")
    rows = rows.select("*", F.posexplode("assets").alias("a", "asset")).select("*", F.posexplode("horizons").alias("s", "h"))
    part = _sum(F.transform(F.sequence(F.lit(0), F.col("s")), lambda s: F.get("moved", s * a + F.col("a"))))
    return rows.groupBy(key, source, F.col("h").alias("horizon"), "asset").agg(F.sum(F.col("pull") * part).alias("contribution"))

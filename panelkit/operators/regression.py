"""Least squares in groups, from sums of products: only a system of a few coefficients for each group leaves the cluster."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


MOST_GROUPS = 100_000  # their coefficients come to the driver


@dataclass(frozen=True)
class Spec:
    """What is explained by what; whether a value under the fitted one is attractive."""

    name: str
    target: str
    predictors: tuple[str, ...]
    lower_is_cheaper: bool = True


def regress_suite(df: DataFrame, specs: Sequence[Spec], by: str) -> tuple[DataFrame, DataFrame]:
    """Df with NAME_fitted, NAME_residual, NAME_mispricing and NAME_z of each spec, fitted in each group of `by` (few),
    and a summary: by, spec, n, r_squared, coefficients (map; the intercept is `intercept`).

    All specs come from one aggregate. Rows with a null in a spec's columns are left out of it and get nulls. The residuals'
    mean is 0 by the intercept, so the z-score needs no second pass.
    """
    sums, layout = [], []
    for s in specs:
        used = F.lit(True)
        for c in (s.target, *s.predictors):
            used = used & F.col(c).isNotNull()
        terms = [F.when(used, F.col(c).cast("double")) for c in (*s.predictors, s.target)]
        cells = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
        sums += [F.count(terms[0]), *map(F.avg, terms), *(F.covar_pop(terms[i], terms[j]) for i, j in cells)]  # centred as they are summed up
        layout.append((s, len(terms), cells))
    groups = df.groupBy(by).agg(*(x.alias(f"_{k}") for k, x in enumerate(sums))).limit(MOST_GROUPS + 1).collect()
    if len(groups) > MOST_GROUPS:
        raise ValueError(f"{by} has more than {MOST_GROUPS} groups")
    fits, summary = [], []
    for row in groups:
        at, fit = 1, [row[0]]
        for s, size, cells in layout:
            n, mean = row[at], np.array([x if x is not None else np.nan for x in row[at + 1 : at + 1 + size]])
            at += 1 + size
            m = np.zeros((size, size))
            for (i, j), v in zip(cells, row[at : at + len(cells)]):
                m[i, j] = m[j, i] = v or 0.0
            at += len(cells)
            # solved in units of each column's deviation; a constant column explains nothing
            sd = np.sqrt(np.diag(m))
            moves = sd[:-1] > 1e-12 * np.abs(mean[:-1])
            unit = np.where(moves, sd[:-1], 1.0)
            r = np.where(np.outer(moves, moves), m[:-1, :-1] / np.outer(unit, unit), 0.0)
            slope = np.where(moves, np.linalg.lstsq(r, np.where(moves, m[:-1, -1] / unit, 0.0), rcond=1e-10)[0] / unit, 0.0) if n else np.full(size - 1, np.nan)
            beta = np.concatenate([[mean[-1] - slope @ mean[:-1]], slope])
            left = max(0.0, float(m[-1, -1] - 2 * slope @ m[:-1, -1] + slope @ m[:-1, :-1] @ slope)) if n else np.nan
            fit += [*map(float, beta), float(np.sqrt(left)) if n else None]
            names = ("intercept", *s.predictors)
            summary.append((row[0], s.name, int(n), float(1 - left / m[-1, -1]) if n and m[-1, -1] > 0 else None, {k: float(b) for k, b in zip(names, beta)} if n else {}))
        fits.append([None if isinstance(v, float) and np.isnan(v) else v for v in fit])
    spark, kind = df.sparkSession, df.schema[by].dataType.simpleString()
    columns = [f"`{by}` {kind}"] + [f"{s.name}_b{k} double" for s in specs for k in range(len(s.predictors) + 1)]
    order = [0] + [1 + sum(len(z.predictors) + 2 for z in specs[:q]) + k for q, s in enumerate(specs) for k in range(len(s.predictors) + 1)]
    spread = [1 + sum(len(z.predictors) + 2 for z in specs[:q]) + len(s.predictors) + 1 for q, s in enumerate(specs)]
    table = spark.createDataFrame([[f[k] for k in (*order, *spread)] for f in fits], ", ".join(columns + [f"{s.name}_sd double" for s in specs]))
    out = df.join(F.broadcast(table), by, "left")  # a row for each group
    for s in specs:
        fitted = sum((F.col(f"{s.name}_b{k + 1}") * F.col(c) for k, c in enumerate(s.predictors)), F.col(f"{s.name}_b0"))
        fitted = F.when(F.col(s.target).isNotNull(), fitted)
        residual = F.col(s.target) - fitted
        attractive = -residual if s.lower_is_cheaper else residual
        sd = F.col(f"{s.name}_sd")
        out = out.withColumns({f"{s.name}_fitted": fitted, f"{s.name}_residual": residual, f"{s.name}_mispricing": attractive, f"{s.name}_z": F.when(residual.isNotNull(), F.when(sd == 0, 0.0).otherwise(attractive / sd))})
    own = [c.split(" ")[0] for c in columns[1:]] + [f"{s.name}_sd" for s in specs]
    out = out.drop(*own)
    return out.select(*df.columns, *(c for c in out.columns if c not in df.columns)), spark.createDataFrame(summary, f"`{by}` {kind}, spec string, n long, r_squared double, coefficients map<string, double>")


def fitted_sql(table: str, key: str, by: str, y: str, xs: Sequence[str]) -> str:
    """SQL for key, by, y, avg_y, fitted and residual: predictors are made orthogonal one after the other, by window sums."""
    centred = ", ".join(f"{x} - avg({x}) OVER p AS u{k}" for k, x in enumerate(xs))
    used = " AND ".join(f"{c} IS NOT NULL" for c in (y, *xs))
    sql = f"SELECT {key}, {by}, {y} AS y, avg({y}) OVER p AS avg_y, {y} - avg({y}) OVER p AS v, {centred} FROM {table} WHERE {used} WINDOW p AS (PARTITION BY {by})"
    for k in range(1, len(xs)):
        less = " - ".join([f"u{k}", *(f"coalesce(sum(u{k} * u{j}) OVER p / nullif(sum(u{j} * u{j}) OVER p, 0), 0) * u{j}" for j in range(k))])
        sql = f"SELECT * REPLACE ({less} AS u{k}) FROM ({sql}) WINDOW p AS (PARTITION BY {by})"
    part = " + ".join(f"coalesce(sum(v * u{k}) OVER p / nullif(sum(u{k} * u{k}) OVER p, 0), 0) * u{k}" for k in range(len(xs)))
    return f"SELECT {key}, {by}, y, avg_y, avg_y + f AS fitted, v - f AS residual FROM (SELECT *, {part} AS f FROM ({sql}) WINDOW p AS (PARTITION BY {by}))"


def coefficients_sql(table: str, by: str, y: str, xs: Sequence[str]) -> str:
    """SQL for by, predictor, coefficient: the last of predictors that are made orthogonal has its own coefficient, so each of them
    is the last one once."""
    used = " AND ".join(f"{c} IS NOT NULL" for c in (y, *xs))
    parts = []
    for last in range(len(xs)):
        order = [x for k, x in enumerate(xs) if k != last] + [xs[last]]
        centred = ", ".join(f"{x} - avg({x}) OVER p AS u{k}" for k, x in enumerate(order))
        sql = f"SELECT {by}, {y} - avg({y}) OVER p AS v, {centred} FROM {table} WHERE {used} WINDOW p AS (PARTITION BY {by})"
        for k in range(1, len(order)):
            less = " - ".join([f"u{k}", *(f"coalesce(sum(u{k} * u{j}) OVER p / nullif(sum(u{j} * u{j}) OVER p, 0), 0) * u{j}" for j in range(k))])
            sql = f"SELECT * REPLACE ({less} AS u{k}) FROM ({sql}) WINDOW p AS (PARTITION BY {by})"
        u = f"u{len(order) - 1}"
        parts.append(f"SELECT {by}, '{xs[last]}' AS predictor, coalesce(sum(v * {u}) / nullif(sum({u} * {u}), 0), 0) AS coefficient FROM ({sql}) GROUP BY 1")
    slopes = " UNION ALL ".join(parts)
    means = f"SELECT {by}, avg({y}) AS my, {', '.join(f'avg({x}) AS m_{x}' for x in xs)} FROM {table} WHERE {used} GROUP BY 1"
    at = " ".join(f"WHEN '{x}' THEN m_{x}" for x in xs)
    return f"SELECT * FROM ({slopes}) UNION ALL SELECT {by}, 'intercept', any_value(my) - sum(coefficient * CASE predictor {at} END) FROM ({slopes}) JOIN ({means}) USING ({by}) GROUP BY 1"

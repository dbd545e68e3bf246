"""Risk of many candidate weights over many scenarios, without a row for each candidate in each scenario.

A task multiplies its scenarios with the matrix of candidates and keeps sums and histograms alone; what is shuffled grows with
candidates times bins, and not with scenarios. A quantile is exact all the same: the histogram tells the bin that it lies in,
further passes cut that bin into bins until few losses are left in it (or equal ones), and only those are listed.

Candidates are a table of parameters. It is held by the driver, so its size is checked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS, FEW, MOST = 256, 64, 1 << 21  # bins of a histogram, losses of a bin that are listed, numbers of a candidate matrix


@dataclass
class Candidates:
    ids: np.ndarray
    weights: np.ndarray  # a row for each candidate

    def less(self, benchmark: Sequence[float]) -> Candidates:
        """The active weights."""
        return Candidates(self.ids, self.weights - np.asarray(benchmark))


def candidates(table: DataFrame) -> Candidates:
    """cand_id, w of a parameter table, in order of cand_id."""
    rows = table.select("cand_id", "w").limit(MOST + 1).toPandas().sort_values("cand_id")
    weights = np.array(rows["w"].tolist(), np.float64).reshape(len(rows), -1)
    if weights.size > MOST:
        raise ValueError(f"candidates are parameters: {MOST} numbers at most")
    return Candidates(rows["cand_id"].to_numpy(np.int64), weights)


def returns_of(r: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Return of each candidate (column) in each scenario (row), added up asset by asset: the same in every pass."""
    out = np.zeros((len(r), len(weights)))
    for k in range(weights.shape[1]):
        out += r[:, k : k + 1] * weights[:, k]
    return out


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Weights q and returns r of some scenarios at a time, so many that a block of results stays moderate."""
    step = max(1, (1 << 18) // max(width, 1))
    for batch in batches:
        r = batch.column("r").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
        q = batch.column("q").to_numpy(zero_copy_only=False)
        for k in range(0, len(batch), step):
            yield q[k : k + step], r[k : k + step]


def _table(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], list(columns))


def _ranges(s: DataFrame, c: Candidates) -> dict[str, np.ndarray]:
    """Of each candidate's losses: least and largest, number, sum of weights and of weighted losses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(c.ids)
        low, high, count, mass, total = np.full(n, np.inf), np.full(n, -np.inf), 0, 0.0, np.zeros(n)
        for q, r in blocks(batches, n):
            loss = -returns_of(r, c.weights)
            low, high = np.minimum(low, loss.min(0)), np.maximum(high, loss.max(0))
            count, mass, total = count + len(q), mass + q.sum(), total + (q[:, None] * loss).sum(0)
        if count:
            yield _table({"k": np.arange(n), "low": low, "high": high, "n": np.full(n, count), "mass": np.full(n, mass), "total": total})

    sums = s.mapInArrow(run, "k long, low double, high double, n long, mass double, total double").groupBy("k")
    rows = sums.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.sum("mass").alias("mass"), F.sum("total").alias("total")).orderBy("k").toPandas()
    return {x: rows[x].to_numpy() for x in rows}


def _cut(s: DataFrame, c: Candidates, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, aim: np.ndarray) -> dict[str, np.ndarray]:
    """One pass of histograms over [low, high] of the wanted candidates: of the bin where the weights of losses so far reach
    aim its least and largest loss, number and the weights before it, and weight, weighted losses and the least loss above it."""
    at = np.flatnonzero(wanted)
    w, lo, hi = c.weights[at], low[at], high[at]
    width = np.where(hi > lo, (hi - lo) / BINS, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(at) * BINS
        n, mass, total, least, most = np.zeros(size, np.int64), np.zeros(size), np.zeros(size), np.full(size, np.inf), np.full(size, -np.inf)
        for q, r in blocks(batches, len(at)):
            loss = -returns_of(r, w)
            inside = (loss >= lo) & (loss <= hi)
            row, col = np.nonzero(inside)
            x = loss[row, col]
            cell = col * BINS + np.minimum((x - lo[col]) / width[col], BINS - 1).astype(np.int64)
            n += np.bincount(cell, minlength=size)
            mass += np.bincount(cell, q[row], size)
            total += np.bincount(cell, q[row] * x, size)
            np.minimum.at(least, cell, x)
            np.maximum.at(most, cell, x)
        cell = np.flatnonzero(n)
        for cell in np.array_split(cell, -(-len(cell) // (1 << 16))) if len(cell) else ():
            yield _table({"k": at[cell // BINS], "bin": cell % BINS, "n": n[cell], "mass": mass[cell], "total": total[cell], "least": least[cell], "most": most[cell]})

    found = s.mapInArrow(run, "k long, bin long, n long, mass double, total double, least double, most double").groupBy("k", "bin")
    found = found.agg(F.sum("n").alias("n"), F.sum("mass").alias("mass"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))
    goal = s.sparkSession.createDataFrame([(int(k), float(a)) for k, a in zip(at, aim[at])], "k long, aim double")
    so_far = Window.partitionBy("k").orderBy("bin")  # BINS rows at most
    over = so_far.rowsBetween(1, Window.unboundedFollowing)
    none = lambda x: F.coalesce(x, F.lit(0.0))
    found = found.join(F.broadcast(goal), "k").select(  # a row for each candidate, a parameter
        "k", "n", "least", "most", "aim", F.sum("mass").over(so_far).alias("upto"), "mass", none(F.sum("mass").over(over)).alias("mass_above"), none(F.sum("total").over(over)).alias("total_above"), F.min("least").over(over).alias("next"), F.max("bin").over(Window.partitionBy("k")).alias("last"), "bin")
    hit = found.where((F.col("upto") >= F.col("aim")) | (F.col("bin") == F.col("last")))
    rows = hit.groupBy("k").agg(F.min_by(F.struct("n", "least", "most", (F.col("upto") - F.col("mass")).alias("before"), "mass_above", "total_above", "next"), "bin").alias("x")).select("k", "x.*").orderBy("k").toPandas()
    return {x: rows[x].to_numpy() for x in rows}


@dataclass
class Tails:
    """Of each candidate: expected return, the loss at which the weights reach the aim, the weight and weighted losses of larger
    losses, the weight up to it, and the next larger loss (the same one if it is the largest)."""

    n: int
    mass: np.ndarray
    expected: np.ndarray
    var: np.ndarray
    mass_above: np.ndarray
    total_above: np.ndarray
    upto: np.ndarray
    next: np.ndarray


def tails(s: DataFrame, c: Candidates, aim: float | Callable[[int], float]) -> Tails:
    """s: scenarios q, r. aim: what the weights q, added up from the least loss on, have to reach; or a function of how many."""
    s = s.select(F.col("q").cast("double").alias("q"), F.col("r").cast("array<double>").alias("r"))
    ends = _ranges(s, c)
    size = len(c.ids)
    n = int(ends["n"][0]) if len(ends["n"]) else 0
    if not n:
        raise ValueError("no scenarios")
    goal = np.full(size, aim(n) if callable(aim) else aim)
    low, high, count = ends["low"].copy(), ends["high"].copy(), ends["n"].copy()
    before, mass_above, total_above, following = np.zeros(size), np.zeros(size), np.zeros(size), np.full(size, np.nan)
    while (open_ := (count > FEW) & (low < high)).any():
        got = _cut(s, c, low, high, open_, goal - before)
        k = got["k"]
        low[k], high[k], count[k] = got["least"], got["most"], got["n"]
        before[k] += got["before"]
        mass_above[k] += got["mass_above"]
        total_above[k] += got["total_above"]
        following[k] = np.where(np.isnan(got["next"].astype(float)), following[k], got["next"].astype(float))

    listed = np.flatnonzero(low < high)
    w, lo, hi = c.weights[listed], low[listed], high[listed]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, r in blocks(batches, len(listed)):
            loss = -returns_of(r, w)
            row, col = np.nonzero((loss >= lo) & (loss <= hi))
            yield _table({"k": listed[col], "loss": loss[row, col], "q": q[row]})

    var, upto = low.copy(), before.copy()
    flat = low == high
    if len(listed):
        few = s.mapInArrow(rows, "k long, loss double, q double").toPandas()  # FEW rows of a candidate at most
        for k, own in few.groupby("k"):
            own = own.sort_values("loss")
            loss, q = own["loss"].to_numpy(), own["q"].to_numpy()
            cum = before[k] + np.cumsum(q)
            i = min(int(np.searchsorted(cum, goal[k] - 1e-15, "left")), len(loss) - 1)
            var[k] = loss[i]
            more = loss > loss[i]
            mass_above[k] += q[more].sum()
            total_above[k] += (q[more] * loss[more]).sum()
            upto[k] = cum[~more][-1]
            if more.any():
                following[k] = loss[more][0]
    upto[flat] = ends["mass"][flat] - mass_above[flat]
    return Tails(n, ends["mass"], -ends["total"], var, mass_above, total_above, upto, np.where(np.isnan(following), var, following))


def weighted_var_cvar(s: DataFrame, c: Candidates, alpha: float) -> tuple[Tails, np.ndarray]:
    """VaR is the first loss at which the cumulated probability reaches alpha; CVaR adds the mean excess over it."""
    t = tails(s, c, alpha - 1e-12)
    return t, t.var + (t.total_above - t.var * t.mass_above) / (1 - alpha)


def frame(like: DataFrame, c: Candidates, columns: dict[str, np.ndarray]) -> DataFrame:
    """A row for each candidate."""
    rows = zip(c.ids.tolist(), *(x.astype(float).tolist() for x in columns.values()))
    return like.sparkSession.createDataFrame(list(rows), "cand_id long, " + ", ".join(f"{x} double" for x in columns))


def portfolio_metrics(s: DataFrame, table: DataFrame, benchmark: Sequence[float], alpha: float) -> DataFrame:
    """cand_id, expected, CVaR of full and of demeaned returns, the same of what is active against the benchmark,
    distances to it, concentration, turnover from it.

    CVaR moves with a constant added to all losses: demeaned figures are the full ones plus the expected return.
    """
    c = candidates(table)
    return frame(s, c, metrics(s, c, benchmark, alpha))


def metrics(s: DataFrame, c: Candidates, benchmark: Sequence[float], alpha: float) -> dict[str, np.ndarray]:
    """The columns of `portfolio_metrics`; full and active weights go through the passes together."""
    n, gap, hhi = len(c.ids), c.less(benchmark).weights, (c.weights**2).sum(1)
    found, cvar = weighted_var_cvar(s, Candidates(np.concatenate([c.ids, c.ids]), np.vstack([c.weights, gap])), alpha)
    expected, ahead, full, te, l1 = found.expected[:n], found.expected[n:], cvar[:n], cvar[n:], np.abs(gap).sum(1)
    return {
        "expected": expected, "cvar_full": full, "cvar_demeaned": full + expected, "te_full": te, "te_demeaned": te + ahead, "l1": l1, "l2": np.sqrt((gap**2).sum(1)),
        "hhi": hhi, "max_weight": c.weights.max(1), "effective_n": 1 / hhi, "turnover": l1,
    }


def characteristics(s: DataFrame, table: DataFrame, alpha: float = 0.95, tau: float = 0.0, benchmark: Sequence[float] | None = None) -> DataFrame:
    """A14 of every candidate, all scenarios alike: mean, mean absolute deviation, CVaR (the mean strictly beyond the interpolated
    quantile), lower partial moment and, with a benchmark, tracking error."""
    c = candidates(table)
    return frame(s, c, measures(s, c, alpha, tau, benchmark))


def measures(s: DataFrame, c: Candidates, alpha: float = 0.95, tau: float = 0.0, benchmark: Sequence[float] | None = None) -> dict[str, np.ndarray]:
    """The columns of `characteristics`."""
    s = s.select(F.lit(1.0).alias("q"), F.col("r").cast("array<double>").alias("r"))
    # the quantile of returns lies between the order statistics at and after (n - 1) (1 - alpha): between two losses
    at = lambda n: (n - 1) * round(1 - alpha, 12)
    t = tails(s, c, lambda n: n - 1 - int(at(n)))  # the loss before the one at that place from the top
    share = at(t.n) - int(at(t.n))
    # losses from the least: place n - int(at) from 1 is the return at int(at); the one before is the return after it
    upper = np.where(t.upto >= t.n - int(at(t.n)), t.var, t.next)
    quantile = -(upper + (t.var - upper) * share)
    mean, bench = t.expected / t.n, np.asarray(benchmark if benchmark is not None else np.zeros(c.weights.shape[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(c.ids)
        far, below, count, part, te = (np.zeros(n) for _ in range(5))
        for _, r in blocks(batches, n):
            p = returns_of(r, c.weights)
            beyond = p < quantile
            far += np.abs(p - mean).sum(0)
            below += np.where(beyond, p, 0.0).sum(0)
            count += beyond.sum(0)
            part += np.maximum(tau - p, 0.0).sum(0)
            te += ((p - returns_of(r, bench[None])) ** 2).sum(0)
        yield _table({"k": np.arange(n), "far": far, "below": below, "count": count, "part": part, "te": te})

    kinds = ("far", "below", "count", "part", "te")
    sums = s.mapInArrow(run, "k long, " + ", ".join(f"{x} double" for x in kinds)).groupBy("k").agg(*(F.sum(x).alias(x) for x in kinds)).orderBy("k").toPandas()
    with np.errstate(invalid="ignore", divide="ignore"):
        out = {"mean": mean, "quantile": quantile, "mad": sums["far"].to_numpy() / t.n, "cvar": -sums["below"].to_numpy() / sums["count"].to_numpy(), "lpm": sums["part"].to_numpy() / t.n}
    if benchmark is not None:
        out["tracking_error"] = np.sqrt(sums["te"].to_numpy() / t.n)
    return out


def candidate_risks(s: DataFrame, c: Candidates, bins: Sequence[int], edges: tuple[float, float]) -> dict[str, np.ndarray]:
    """A27, A28 in one pass: expected return and variance of every candidate, and for each number of bins the entropy of its
    returns (entropy_N) and of those up to zero with one bin for all gains (downside_N)."""
    s = s.select(F.lit(1.0).alias("q"), F.col("r").cast("array<double>").alias("r"))
    low, high = edges
    down = min(low, -1e-12)
    centre = s.select(F.posexplode("r").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("x")).orderBy("k").toPandas()["x"].to_numpy() @ c.weights.T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, count, one, two = len(c.ids), 0, np.zeros(len(c.ids)), np.zeros(len(c.ids))
        found = {(kind, m): np.zeros((n, m), np.int64) for m in bins for kind in (0, 1)}
        for _, r in blocks(batches, n):
            p = returns_of(r, c.weights)
            count += len(p)
            one += (p - centre).sum(0)
            two += ((p - centre) ** 2).sum(0)
            for (kind, m), sums in found.items():
                if kind:
                    cell = np.where(p > 0, m - 1, np.clip(np.floor((p - down) / (-down / (m - 1))), 0, m - 2))
                else:
                    cell = np.clip(np.floor((p - low) / ((high - low) / m)), 0, m - 1)
                flat = (np.arange(n) * m + cell.astype(np.int64)).ravel()
                sums += np.bincount(flat, minlength=n * m).reshape(n, m)
        if count:
            k = np.arange(n)
            yield _table({"k": k, "kind": np.full(n, -1), "bins": np.zeros(n, np.int64), "n": np.full(n, float(count)), "one": one, "two": two, "bin": np.full(n, -1)})
            for (kind, m), sums in found.items():
                row, bin_ = np.nonzero(sums)
                zero = np.zeros(len(row))
                yield _table({"k": row, "kind": np.full(len(row), kind), "bins": np.full(len(row), m), "n": sums[row, bin_].astype(float), "one": zero, "two": zero, "bin": bin_})

    sums = s.mapInArrow(run, "k long, kind long, bins long, n double, one double, two double, bin long").groupBy("k", "kind", "bins", "bin")
    sums = sums.agg(F.sum("n").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two"))
    total = F.max(F.when(F.col("kind") < 0, F.col("n"))).over(Window.partitionBy("k"))  # a row for each bin
    part = F.col("n") / total
    value = F.when(F.col("kind") >= 0, -part * F.log(part)).otherwise((F.col("two") - F.col("one") * F.col("one") / F.col("n")) / (F.col("n") - 1))
    rows = sums.withColumn("value", value).groupBy("k", "kind", "bins").agg(F.sum("value").alias("value"), F.max(F.when(F.col("kind") < 0, F.col("one") / F.col("n"))).alias("shift")).toPandas()
    out = {"expected": centre.copy(), "variance": np.zeros(len(c.ids))} | {f"{name}_{m}": np.zeros(len(c.ids)) for m in bins for name in ("entropy", "downside")}
    for k, kind, m, value, shift in rows.itertuples(index=False):
        name = "variance" if kind < 0 else f"{('entropy', 'downside')[kind]}_{m}"
        out[name][k] = value
        if kind < 0:
            out["expected"][k] += shift
    return out

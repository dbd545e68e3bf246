"""Order statistics where no group has to fit into one task: ranks over ranges of rows, quantiles of growing frames.

A rank is a position in a table that is sorted over ranges: each range counts its own rows of a group, and the counts of earlier
ranges are added. So one group may hold all rows.

A quantile of all earlier rows is found by counting. A series is cut into ranges of time and into cells of values, by some of its
quantiles; one that many rows share is a cell of its own. Counts by range and cell, summed over time, tell for each row of a range in
which cell its order statistic lies and which of it. A range meets few cells, and only their earlier values are sent to it: what
is shuffled is the series itself, some times over, and not rows for each statistic. Series of one block need no cutting.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.operators.staging import staged

BLOCK = 4096  # rows of a series that is held at a time
MOST_PARTS, MOST_CUTS = 256, 1024  # ranges of time of all long series, cuts between the values of one


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "place") -> DataFrame:
    """df with each row's position in its group of keys, from 1; rows that order leaves equal have any order of them."""
    sort = [F.col(k) for k in keys] + [F.col(c) if isinstance(c, str) else c for c in order]
    rows = df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    rows = staged(rows)
    parts = rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_start"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parts = staged(parts.select(*keys, "_part", (F.col("_start") - F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_zero")))
    same = [rows[k].eqNullSafe(parts[k]) for k in (*keys, "_part")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return rows.join(parts, on).select(*(rows[c] for c in df.columns), (F.col("_at") - F.col("_zero") + 1).alias(name))


def group_sizes(df: DataFrame, keys: Sequence[str], value: str, name: str = "size") -> DataFrame:
    """df with the number of non-null values of its group."""
    sizes = staged(df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.count(value).alias(name)))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (df.join(sizes, on) if keys else df.crossJoin(F.broadcast(sizes))).select(*df.columns, name)  # without keys, one row


def equal_buckets(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int, value: str, name: str = "bucket") -> DataFrame:
    """K3: df with the row's bucket of k by order, as ntile deals them: larger buckets first."""
    placed = group_sizes(positions(df, keys, order, "_place"), keys, value, "_size")
    base, more = F.expr(f"_size div {k}"), F.col("_size") % k
    first = more * (base + 1)  # rows of the larger buckets
    bucket = F.when(F.col("_place") <= first, F.ceil(F.col("_place") / (base + 1))).otherwise(more + F.ceil((F.col("_place") - first) / F.nullif(base, F.lit(0))))
    return placed.withColumn(name, bucket.cast("int")).drop("_place", "_size")


def percentile_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str = "pct") -> DataFrame:
    """K7: df with the share of its group's rows at or below, ties at their mean rank. Rows of one value are counted, not ranked,
    so a value may have any number of them."""
    levels = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    levels = positions(levels, keys, [value], "_place")
    ranks = staged(levels)
    # counts of lower values: the positions of values are summed up in ranges of them
    lower = _running(ranks, keys, "_place", "_n")
    return group_sizes(_joined(df, lower, [*keys, value]).withColumn("_r", F.col("_below") + (F.col("_n") + 1) / 2), keys, value, "_size").withColumn(name, F.col("_r") / F.col("_size")).select(*df.columns, name)


def top_shares(placed: DataFrame, keys: Sequence[str], value: str, part: float = 0.25, least: int = 1, name: str = "top") -> DataFrame:
    """L1: df, with its rows' place, and whether the row is among the best part of its group, at least `least` of them."""
    sized = group_sizes(placed, keys, value, "_size")
    return sized.withColumn(name, F.col("place") <= F.least("_size", F.greatest(F.lit(least), F.ceil(F.col("_size") * part)))).drop("_size")


def _joined(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    named = other.select(*(F.col(k).alias(f"_j{i}") for i, k in enumerate(keys)), *(c for c in other.columns if c not in keys))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_j{i}"))
    return df.join(named, on).drop(*(f"_j{i}" for i in range(len(keys))))


def _running(df: DataFrame, keys: Sequence[str], place: str, n: str) -> DataFrame:
    """df with _below: the sum of n over earlier places of the group, by blocks of places."""
    df = df.withColumn("_block", F.expr(f"({place} - 1) div {BLOCK}"))
    own = F.coalesce(F.sum(n).over(Window.partitionBy(*keys, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = df.groupBy(*keys, "_block").agg(F.sum(n).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    blocks = staged(blocks.select(*keys, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")))
    return _joined(df.withColumn("_own", own), blocks, [*keys, "_block"]).withColumn("_below", F.col("_own") + F.col("_before")).drop("_own", "_before", "_block", place)


def _wanted(n: int, q: float) -> tuple[int, int, float]:
    """The two order statistics of n values, from 0, between which the quantile lies, and how far."""
    at = (n - 1) * q
    low = int(at)
    return low, min(low + 1, n - 1), at - low


def _between(low: float, high: float, share: float) -> float:
    return low + (high - low) * share


def _present(x: float | None) -> bool:
    return x is not None and x == x


def _short(df: DataFrame, value: str, keys: Sequence[str], order: str, qs: Sequence[float]) -> DataFrame:
    """Series of one block: sorted by time, one after the other, a sorted list of the values so far."""
    names = [*df.columns, "n_before", *(f"q{k}" for k in range(len(qs)))]
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "n_before long", *(f"q{k} double" for k in range(len(qs)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, []
        for batch in batches:
            counts, found = [], [[] for _ in qs]
            for key, x in zip(zip(*(batch.column(k).to_pylist() for k in keys)), batch.column(value).to_pylist()):
                if key != now:
                    now, seen = key, []
                n = len(seen)
                counts.append(n)
                for q, out in zip(qs, found):
                    low, high, share = _wanted(n, q) if n else (0, 0, 0.0)
                    out.append(_between(seen[low], seen[high], share) if n else None)
                if _present(x):
                    insort(seen, x)
            new = [pa.array(counts, pa.int64()), *(pa.array(x, pa.float64()) for x in found)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names)

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, kinds)


def _cell(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The cell of each value, in their order: odd ones are the bounds, even ones what lies between; -1 of NaN."""
    k = np.searchsorted(bounds, x)
    on = (k < len(bounds)) & (np.append(bounds, np.nan)[k] == x)
    return np.where(np.isnan(x), -1, 2 * k + on)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy()


def _bounds(side: pa.Table) -> np.ndarray:
    return np.unique(np.asarray(side.column("_bounds")[0].as_py() or [], np.float64))


def _walk(cells: np.ndarray, before: Sequence[int], qs: Sequence[float]) -> tuple[list[int], list[list[tuple[int, int]]]]:
    """Of one time block's rows, whose cells are given in order of time after `before` values of each cell: the number of earlier values,
    and for each row that has some the cells and places in them of its order statistics."""
    counts = list(before) + [0] * max(0, int(cells.max(initial=-1)) + 1 - len(before))
    n, sizes, out = sum(counts), [], []
    at, below = [0] * len(qs) * 2, [0] * len(qs) * 2  # a cell for each statistic, and the counts of those below it
    for own in cells.tolist():
        row = []
        if n:
            for k, q in enumerate(qs):
                for s, want in enumerate(_wanted(n, q)[:2]):
                    j = 2 * k + s
                    while want < below[j]:
                        at[j] -= 1
                        below[j] -= counts[at[j]]
                    while want >= below[j] + counts[at[j]]:
                        below[j] += counts[at[j]]
                        at[j] += 1
                    row.append((at[j], want - below[j]))
        sizes.append(n)
        out.append(row)
        if own >= 0:
            counts[own] += 1
            n += 1
            for j in range(len(at)):
                below[j] += own < at[j]
    return sizes, out


def _long(df: DataFrame, value: str, keys: Sequence[str], order: str, qs: Sequence[float], block: int, rows: int, longest: int) -> DataFrame:
    """Series of many blocks; see the module's text."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    series = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    parts, cuts = min(MOST_PARTS, -(-rows // (4 * block))), min(MOST_CUTS, -(-longest // block))
    timed = staged(df.repartitionByRange(parts, *keys, order).withColumn("_part", F.spark_partition_id()))
    known = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    bounds = known.groupBy(*keys).agg(F.percentile_approx(F.col(value).cast("double"), [k / (cuts + 1) for k in range(1, cuts + 1)], 16 * MOST_CUTS).alias("_bounds"))
    bounds = staged(_outer(timed.select(*keys, "_part").distinct(), bounds, keys))
    of = lambda t: t.groupBy(*keys, "_part")

    def in_cells(left: pa.Table, right: pa.Table) -> pa.Table:
        return left.append_column("_cell", pa.array(_cell(_numbers(left.column(value)), _bounds(right)).astype(np.int64)))

    timed = staged(of(timed).cogroup(of(bounds)).applyInArrow(in_cells, f"{columns}, _part int, _cell long"))

    def add_up(rows: pd.DataFrame) -> pd.DataFrame:
        which, at = np.unique(rows["_part"], return_inverse=True)
        grid, held = np.zeros((len(which), max(int(rows["_cell"].max()) + 1, 0)), np.int64), rows["_cell"].to_numpy() >= 0
        grid[at[held], rows["_cell"].to_numpy()[held]] = rows["n"].to_numpy()[held]
        return _with_keys(rows, pd.DataFrame({"_part": which, "_before": list(np.cumsum(grid, 0) - grid)}), keys)

    counts = timed.groupBy(*keys, "_part", "_cell").agg(F.count("*").alias("n"))  # of a series at most a row for each part and cell
    before = staged(counts.groupBy(*keys).applyInPandas(add_up, f"{series}, _part int, _before array<long>").join(bounds, [*keys, "_part"]))

    def visited(left: pa.Table, right: pa.Table) -> pa.Table:
        cells = left.sort_by(order).column("_cell").to_numpy()
        found = sorted({c for row in _walk(cells, right.column("_before")[0].as_py(), qs)[1] for c, _ in row if c % 2 == 0})
        out = left.select([*keys, "_part"]).take(pa.array([0] * len(found), pa.int64()))
        return out.append_column("_cell", pa.array(found, pa.int64()))

    wanted = staged(of(timed.select(*keys, "_part", order, "_cell")).cogroup(of(before)).applyInArrow(visited, f"{series}, _part int, _cell long"))
    even = timed.where("_cell >= 0 and _cell % 2 = 0").select(*keys, F.col("_part").alias("_from"), "_cell", F.col(value).cast("double").alias("_x"))
    values = even.join(wanted, [*keys, "_cell"]).where("_from < _part")
    none = lambda t: F.lit(None).cast(t)
    side = before.select(*keys, "_part", "_before", "_bounds", none("long").alias("_cell"), none("double").alias("_x")).union(
        values.select(*keys, "_part", none("array<long>"), none("array<double>"), "_cell", "_x")
    )

    def pick(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by(order)
        first = right.filter(pc.is_valid(right.column("_before")))
        bounds, seen = _bounds(first), {}
        cells, x = left.column("_cell").to_numpy(), _numbers(left.column(value)).tolist()
        sizes, aims = _walk(cells, first.column("_before")[0].as_py(), qs)
        for c in {c for row in aims for c, _ in row if c % 2 == 0}:
            seen[c] = []
        rest = right.filter(pc.is_null(right.column("_before")))
        for c, v in zip(rest.column("_cell").to_pylist(), rest.column("_x").to_pylist()):
            seen[c].append(v)
        for own in seen.values():
            own.sort()
        found = [[] for _ in qs]
        for n, row, c, v in zip(sizes, aims, cells.tolist(), x):
            got = [float(bounds[cell // 2]) if cell % 2 else seen[cell][place] for cell, place in row]
            for k, q in enumerate(qs):
                found[k].append(_between(got[2 * k], got[2 * k + 1], _wanted(n, q)[2]) if n else None)
            if c in seen:
                insort(seen[c], v)
        out = left.drop_columns(["_part", "_cell"]).append_column("n_before", pa.array(sizes, pa.int64()))
        for k, q in enumerate(found):
            out = out.append_column(f"q{k}", pa.array(q, pa.float64()))
        return out

    return of(timed).cogroup(of(side)).applyInArrow(pick, ", ".join([columns, "n_before long", *(f"q{k} double" for k in range(len(qs)))]))


def _with_keys(rows: pd.DataFrame, out: pd.DataFrame, keys: Sequence[str]) -> pd.DataFrame:
    for i, k in enumerate(keys):
        out.insert(i, k, rows[k].iat[0])
    return out


def _outer(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other, list(keys), "left")


def expanding_quantiles(df: DataFrame, value: str, keys: Sequence[str], order: str, qs: Sequence[float] = (0.25, 0.75), block: int = BLOCK) -> DataFrame:
    """df with n_before, the number of earlier values of the series, and q0, q1, ...: their interpolated quantiles.

    keys aren't null and order is unique in a series; null and NaN values aren't counted, their rows have quantiles all the same.
    """
    long = staged(df.groupBy(*keys).count().where(F.col("count") > block))
    rows, longest = long.agg(F.sum("count"), F.max("count")).first()
    if not rows:
        return _short(df, value, keys, order, qs)
    long, df = long.select(*keys), staged(df)
    return _short(df.join(long, list(keys), "left_anti"), value, keys, order, qs).unionByName(_long(df.join(long, list(keys), "left_semi"), value, keys, order, qs, block, rows, longest))


def expanding_regimes(df: DataFrame, value: str, keys: Sequence[str], order: str, least: int = 36, name: str = "regime") -> DataFrame:
    """K1: df with high / middle / low against the quartiles of earlier rows; null before enough of them. High is tested first."""
    found = expanding_quantiles(df, value, keys, order)
    label = F.when(F.col(value) >= F.col("q1"), "high").when(F.col(value) <= F.col("q0"), "low").otherwise("middle")
    return found.withColumn(name, F.when((F.col("n_before") >= least) & F.col(value).isNotNull(), label)).drop("n_before", "q0", "q1")

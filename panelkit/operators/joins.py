"""Joins on time and by priority."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelkit.functions.columns import COUNTRY_ALIASES, country_key, name_key


def next_period(rebalances: DataFrame, daily: DataFrame, key: str = "asset") -> DataFrame:
    """Each daily row with the month end that it follows: period of the day = period after the rebalance's.

    An equi-join on the period's number, so it is shuffled by it and never a nested loop.
    """
    number = lambda d: F.year(d) * 12 + F.month(d)
    left = rebalances.select(F.col("date").alias("rebalance"), (number("date") + 1).alias("number"))
    return daily.withColumn("number", number("date")).join(left, "number").drop("number")


def trailing_rows(calendar: DataFrame, daily: DataFrame, rows: int, inclusive: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """For each position of the calendar (keys, pos, rebalance) the last `rows` rows by position, of the same keys.

    Positions fall into blocks of `rows`, and a window touches two of them: an equi-join on the block, then a filter.
    """
    last = F.col("at") if inclusive else F.col("at") - 1
    left = calendar.select(*keys, F.col("pos").alias("at"), "rebalance").withColumn("block", F.explode(F.array_distinct(F.array(F.floor((last - rows + 1) / rows), F.floor(last / rows)))))
    right = daily.withColumn("block", F.floor(F.col("pos") / rows))
    return right.join(left, [*keys, "block"]).where((F.col("pos") <= last) & (F.col("pos") > last - rows)).drop("block")


def by_priority(sources: Sequence[DataFrame], key: str, fields: Mapping[str, Sequence[tuple[int, str]]]) -> DataFrame:
    """All keys of all sources; each field from the first source of its list that has a value.

    Sources are stacked with their number and folded by one aggregate, instead of one outer join for each.
    """
    wanted = {(k, c) for order in fields.values() for k, c in order}
    stacked = None
    for k, df in enumerate(sources):
        own = sorted(c for n, c in wanted if n == k)
        part = df.select(key, *(F.col(c).cast("double").alias(f"{k}:{c}") for c in own))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    firsts = [F.coalesce(*(F.max(f"`{k}:{c}`") for k, c in order)).alias(field) for field, order in fields.items()]
    return stacked.groupBy(key).agg(*firsts)


def reaching(candidates: DataFrame, targets: DataFrame, value: str = "expected", target: str = "target", ranges: int = 64) -> DataFrame:
    """For each target the candidate of least risk whose value reaches it, null where none does.

    Instead of pairing every target with every candidate: sorted by value from the top, a running minimum of
    (risk, cand_id) is the answer for every target between two values. Values fall into ranges by approximate quantiles;
    each is sorted by itself, and the minimum of those above it is carried into it.
    """
    marks = targets.select(F.col(target).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("struct<risk:double,cand_id:bigint>").alias("best"))
    rows = candidates.select((F.col(value) + 1e-12).alias("at"), F.lit(0).alias("kind"), F.struct(F.col("risk").cast("double").alias("risk"), F.col("cand_id").cast("bigint").alias("cand_id")).alias("best"))
    ends = candidates.agg(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], 100 * ranges)).first()[0] or []
    part = F.size(F.filter(F.array(*map(F.lit, sorted(set(ends)))) if ends else F.array().cast("array<double>"), lambda b: b <= F.col("at")))
    every = rows.unionByName(marks).withColumn("part", part)
    higher = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carried = every.groupBy("part").agg(F.min("best").alias("own")).select("part", F.min("own").over(higher).alias("carried"))
    w = Window.partitionBy("part").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = every.withColumn("here", F.min("best").over(w)).where("kind = 1").join(F.broadcast(carried), "part")  # a row for each range
    return found.select(F.col("at").alias(target), F.least("here", "carried").alias("found")).select(target, "found.cand_id", "found.risk")


def missing_keys(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """J14, U4."""
    return wanted.select(key).distinct().join(present.select(key).distinct(), key, "left_anti")


def unknown_values(df: DataFrame, column: str, known: Sequence[str]) -> DataFrame:
    """The distinct values that aren't known, sorted by name."""
    return df.select(column).distinct().where(~F.col(column).isin(*known)).orderBy(column)


def missing_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """J14."""
    return [c for c in wanted if c not in df.columns]


def require(df: DataFrame, wanted: Sequence[str], column: str | None = None, known: Sequence[str] = ()) -> DataFrame:
    """Df, if it has the wanted columns and, in the given one, known values alone; an error that names the others if not."""
    if lost := missing_columns(df, wanted):
        raise ValueError(f"missing columns: {', '.join(lost)}")
    if column and (bad := [r[0] for r in unknown_values(df, column, known).take(20)]):
        raise ValueError(f"unknown values of {column}: {', '.join(map(str, bad))}")
    return df


def _called(df: DataFrame, name: str, aliases: Mapping[str, str]) -> DataFrame:
    """df with _called: the name by its letters, or what its alias stands for."""
    known = df.sparkSession.createDataFrame(list(aliases.items()), "_spelled string, _meant string").select(name_key("_spelled").alias("_spelled"), "_meant")
    keyed = df.withColumn("_called", name_key(name)).join(F.broadcast(known), F.col("_called") == F.col("_spelled"), "left")  # parameters
    return keyed.withColumn("_called", F.when(F.col("_meant").isNotNull(), name_key("_meant")).otherwise(F.col("_called"))).drop("_spelled", "_meant")


def on_name(left: DataFrame, right: DataFrame, left_name: str, right_name: str, aliases: Mapping[str, str] = COUNTRY_ALIASES) -> DataFrame:
    """Left with the columns of right whose names are the same by their letters, or by an alias; the first of right's rows of
    one name. name_key has the name of left in plain words."""
    others = [c for c in right.columns if c != right_name]
    keyed = _called(right, right_name, aliases).where("_called is not null").groupBy("_called").agg(F.min(F.struct(*others)).alias("_x")).select("_called", "_x.*")
    named = _called(left.withColumn("name_key", country_key(left_name, aliases)), left_name, aliases)
    return named.join(keyed, "_called", "left").select("name_key", *(c for c in (*left.columns, *others)))


def side_by_side(df: DataFrame, keys: Sequence[str], part: str, names: tuple[str, str], values: Sequence[str]) -> DataFrame:
    """The values of two parts in one row of keys, as value_name, and the first less the second as value_gap."""
    picked = [F.max(F.when(F.col(part) == n, F.col(v))).alias(f"{v}_{n}") for v in values for n in names]
    out = df.where(F.col(part).isin(*names)).groupBy(*keys).agg(*picked)
    return out.withColumns({f"{v}_gap": F.col(f"{v}_{names[0]}") - F.col(f"{v}_{names[1]}") for v in values})


def parameter_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Name, value, place: the distinct values of each parameter column in their order."""
    values = df.select(F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c).cast("double"))))).alias("name", "value")).distinct()
    return values.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy("value")))  # parameters have few values


def order_flips(a: str, b: str, size: int, eps: float = 1e-12) -> Column:
    """Pairs of positions that two arrays order in opposite ways, by more than eps."""
    gap = lambda w, i, j: F.get(w, F.lit(i)) - F.get(w, F.lit(j))
    one, two = F.col(a), F.col(b)
    flipped = [((gap(one, i, j) > eps) & (gap(two, i, j) < -eps) | (gap(one, i, j) < -eps) & (gap(two, i, j) > eps)).cast("int") for i in range(size) for j in range(i + 1, size)]
    return sum(flipped[1:], flipped[0])

"""Score strategies under a turnover cap, by month, by rebalance and in sum."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelkit.operators import holdings as H
from panelkit.operators import risk as R
from panelkit.operators import series as S
from panelkit.plans.registry import query
from panelkit.plans.strategies import QW, score_panel
from panelkit.plans.tables import SQL_monthly, monthly

CAP, COST, EVERY, LEAST = 0.35, 0.001, 3, 4


def strategy_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """portfolio, date, asset, target, next: equal weights of the best quarter by raw and by enhanced score, and of all names."""
    panel = score_panel(monthly(spark, sf_dir))
    picks = {s: S.top_share(s, ["date"], "asset", least=LEAST).cast("double") for s in ("raw", "enhanced")} | {"benchmark": F.lit(1.0)}
    panel = panel.withColumns({f"in_{s}": x for s, x in picks.items()})
    panel = panel.withColumns({f"in_{s}": F.col(f"in_{s}") / F.sum(f"in_{s}").over(Window.partitionBy("date")) for s in picks})
    one = lambda s: F.struct(F.lit(s).alias("portfolio"), F.col(f"in_{s}").alias("target"))
    return panel.select("date", "asset", "next", F.explode(F.array(*map(one, picks))).alias("x")).select("x.portfolio", "date", "asset", "x.target", "next")


_norm = lambda x: f"list_transform({x}, lambda e: CASE WHEN list_sum({x}) > 0 THEN e / list_sum({x}) ELSE 0.0 END)"
_both = lambda a, b, f: f"list_transform(range(1, len({a}) + 1), lambda i: {f.format(a=f'{a}[i]', b=f'{b}[i]')})"

SQL_strategy = f"""WITH RECURSIVE f AS (SELECT asset, date, close, close / lag(close) OVER w - 1 AS r, lead(close) OVER w / close - 1 AS nxt, CASE WHEN count(dividends) OVER b = 12 THEN sum(dividends) OVER b END / close AS dy, close / lag(close, 12) OVER w - 1 AS mom FROM ({SQL_monthly()}) WINDOW w AS ({QW}), b AS ({QW} ROWS 11 PRECEDING)),
g AS (SELECT *, CASE WHEN count(r) OVER b = 12 THEN stddev_pop(r) OVER b END AS vol, dy / lag(dy, 12) OVER w - 1 AS growth FROM f WINDOW w AS ({QW}), b AS ({QW} ROWS 11 PRECEDING)), u AS (SELECT * FROM g WHERE dy + mom + vol + growth + nxt IS NOT NULL),
z AS (SELECT asset, date, nxt, (dy - avg(dy) OVER p) / stddev_pop(dy) OVER p AS zd, (growth - avg(growth) OVER p) / stddev_pop(growth) OVER p AS zg, (mom - avg(mom) OVER p) / stddev_pop(mom) OVER p AS zm, (vol - avg(vol) OVER p) / stddev_pop(vol) OVER p AS zv FROM u WINDOW p AS (PARTITION BY date)),
k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY zd DESC, asset) AS a, row_number() OVER (PARTITION BY date ORDER BY zd + 0.35 * zg + 0.25 * zm - 0.35 * zv DESC, asset) AS e, least(count(*) OVER (PARTITION BY date), greatest({LEAST}, ceil(count(*) OVER (PARTITION BY date) * 0.25))) AS n FROM z),
t AS (SELECT asset, date, nxt, unnest(['raw', 'enhanced', 'benchmark']) AS portfolio, unnest([(a <= n)::INT, (e <= n)::INT, 1]) AS picked FROM k),
names AS (SELECT DISTINCT portfolio, asset FROM t), dates AS (SELECT portfolio, date, row_number() OVER (PARTITION BY portfolio ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT portfolio, date FROM t)),
d AS (SELECT portfolio, pos, date, list(asset ORDER BY asset) AS assets, list(coalesce(picked / total, 0) ORDER BY asset) AS t, list(coalesce(nxt, 0) ORDER BY asset) AS r, list((nxt IS NOT NULL)::INT::DOUBLE ORDER BY asset) AS p
  FROM dates JOIN names USING (portfolio) LEFT JOIN (SELECT *, sum(picked) OVER (PARTITION BY portfolio, date) AS total FROM t) USING (portfolio, date, asset) GROUP BY ALL),
s AS (SELECT portfolio, -1::BIGINT AS pos, NULL::DATE AS date, any_value(assets) AS assets, any_value(r) AS r, list_transform(any_value(t), lambda x: 0.0::DOUBLE) AS w, 0.0::DOUBLE AS turnover, list_transform(any_value(t), lambda x: 0.0::DOUBLE) AS ending FROM d GROUP BY 1
  UNION ALL SELECT portfolio, pos, date, assets, r, w, turnover, {_both('w', 'r', '{a} * (1 + {b})')} FROM (
    SELECT *, CASE WHEN pos % {EVERY} = 0 THEN list_sum({_both('w', 'cur', 'abs({a} - {b})')}) / 2 ELSE 0.0 END AS turnover FROM (
      SELECT *, CASE WHEN pos % {EVERY} <> 0 THEN cur WHEN turn <= {CAP} THEN t ELSE {_norm('adj')} END AS w FROM (
        SELECT *, list_transform(range(1, len(t) + 1), lambda i: cur[i] + (t[i] - cur[i]) * {CAP} / turn) AS adj FROM (
          SELECT *, list_sum({_both('t', 'cur', 'abs({a} - {b})')}) / 2 AS turn FROM (
            SELECT * EXCLUDE (v), {_norm('v')} AS cur FROM (SELECT d.*, {_both('s.ending', 'd.p', '{a} * {b}')} AS v FROM s JOIN d ON d.portfolio = s.portfolio AND d.pos = s.pos + 1))))))),
m AS (SELECT portfolio, date, pos, turnover, assets, w, list_dot_product(w, r) AS gross FROM s WHERE pos >= 0),
h AS (SELECT portfolio, date, count(*) FILTER (x > 1e-8) AS n_positions, max(x) AS largest_weight, coalesce(string_agg(asset, ' | ' ORDER BY round(x, 12) DESC, asset) FILTER (x > 1e-8), '') AS names,
  string_agg(asset || ':' || printf('%.2f%%', round(x, 12) * 100), ' | ' ORDER BY round(x, 12) DESC, asset) FILTER (x > 1e-8 AND place <= 5) AS top_positions FROM (SELECT *, row_number() OVER (PARTITION BY portfolio, date ORDER BY round(x, 12) DESC, asset) AS place FROM (SELECT portfolio, date, unnest(assets) AS asset, unnest(w) AS x FROM m)) GROUP BY ALL),
b3 AS (SELECT portfolio, date, pos % {EVERY} = 0 AS rebalance, gross, turnover, {COST} * turnover AS cost, gross - {COST} * turnover AS net, n_positions, largest_weight, names, top_positions FROM m JOIN h USING (portfolio, date))"""


@query(f"{SQL_strategy} SELECT * EXCLUDE (top_positions), product(1 + net) OVER (PARTITION BY portfolio ORDER BY date) AS equity FROM b3", "gross turnover cost net largest_weight", "equity")
def b3_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.simulate(strategy_targets(spark, sf_dir), "portfolio", CAP, COST, EVERY)[0]


@query(f"{SQL_strategy} SELECT portfolio, date, turnover, cost, n_positions, top_positions FROM b3 WHERE rebalance", "turnover cost")
def b3_rebalances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.simulate(strategy_targets(spark, sf_dir), "portfolio", CAP, COST, EVERY)[1]


@query(
    f"""{SQL_strategy}, c AS (SELECT *, product(1 + net) OVER (PARTITION BY portfolio ORDER BY date) AS wealth FROM b3), x AS (SELECT *, wealth / max(wealth) OVER (PARTITION BY portfolio ORDER BY date) - 1 AS dd FROM c),
    y AS (SELECT portfolio, count(*)::BIGINT AS n, exp(sum(ln(1 + net)) * 12 / count(*)) - 1 AS annual_return, stddev_pop(net) * sqrt(12) AS annual_vol, CASE WHEN count(*) FILTER (net < 0) > 1 THEN stddev_pop(net) FILTER (net < 0) ELSE 0 END * sqrt(12) AS downside, min(dd) AS max_drawdown, avg((net > 0)::INT) AS hit_rate,
      avg(n_positions) AS avg_positions, avg(turnover) FILTER (rebalance) AS avg_rebalance_turnover, avg(turnover) FILTER (rebalance) * 12 / {EVERY} AS annual_turnover, avg(cost) FILTER (rebalance) AS avg_rebalance_cost, avg(cost) FILTER (rebalance) * 12 / {EVERY} AS annual_cost, max(largest_weight) AS largest_weight FROM x GROUP BY 1)
    SELECT portfolio, n, annual_return, annual_vol, CASE WHEN annual_vol > 0 THEN annual_return / annual_vol END AS sharpe, downside, max_drawdown, CASE WHEN max_drawdown < 0 THEN annual_return / -max_drawdown END AS calmar, hit_rate, avg_positions, avg_rebalance_turnover, annual_turnover, avg_rebalance_cost, annual_cost, largest_weight,
      annual_return - (SELECT annual_return FROM y WHERE portfolio = 'raw') AS over_raw FROM y""",
    "max_drawdown hit_rate avg_positions avg_rebalance_turnover annual_turnover avg_rebalance_cost annual_cost largest_weight",
    "annual_return annual_vol sharpe downside calmar over_raw",
)
def b3_constrained_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Performance of each portfolio, its positions, turnover and costs, and its yearly return over the raw score's."""
    dates, _ = H.simulate(strategy_targets(spark, sf_dir), "portfolio", CAP, COST, EVERY)
    of = lambda c: F.avg(F.when(F.col("rebalance"), F.col(c)))
    more = dates.groupBy("portfolio").agg(
        F.avg("n_positions").alias("avg_positions"), of("turnover").alias("avg_rebalance_turnover"), (of("turnover") * 12 / EVERY).alias("annual_turnover"),
        of("cost").alias("avg_rebalance_cost"), (of("cost") * 12 / EVERY).alias("annual_cost"), F.max("largest_weight").alias("largest_weight"))
    out = R.performance(dates, "net", ["portfolio"], ddof=0).join(more, "portfolio")
    base = out.where("portfolio = 'raw'").select(F.col("annual_return").alias("base"))
    return out.crossJoin(F.broadcast(base)).withColumn("over_raw", F.col("annual_return") - F.col("base")).drop("base")  # one row

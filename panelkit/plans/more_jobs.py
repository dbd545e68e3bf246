"""Further operators of the inventory as queries: cross-section filters, scenario paths, sweeps, rolling searches, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelkit.functions import columns as C
from panelkit.operators import joins as J
from panelkit.operators import risk as R
from panelkit.operators import series as S
from panelkit.operators.staging import staged
from panelkit.plans.registry import query, read
from panelkit.plans.tables import SQL_daily, SQL_lattice, SQL_monthly, SQL_returns, SQL_scenarios, daily, lattice, monthly, returns, scenarios

QW = "PARTITION BY asset ORDER BY date"
BENCH = (0.3, 0.3, 0.2, 0.2)


@query(
    """WITH a AS (SELECT c_nationkey AS k, count(*) AS n, sum(abs(c_acctbal)) AS cap, avg(c_acctbal) AS pe, max(c_acctbal) / 1e6 AS erp FROM customer GROUP BY 1), e AS (SELECT n_name AS country, n, cap, 100 / pe - erp AS spread, 100 / pe AS yield_, erp FROM a JOIN nation ON n_nationkey = k WHERE n >= 3 AND cap >= 1000 AND pe > 0 AND erp IS NOT NULL AND n_name <> 'Global'),
    q AS (SELECT quantile_cont(spread, 0.25) AS lo, quantile_cont(spread, 0.75) AS hi FROM e) SELECT country, n::BIGINT AS n, cap, spread, CASE WHEN spread >= hi THEN 'cheap' WHEN spread <= lo THEN 'expensive' ELSE 'neutral' END AS label, (rank() OVER (ORDER BY spread) + (count(*) OVER (PARTITION BY spread) - 1) / 2.0) / count(*) OVER () AS percentile FROM e, q""",
    "cap spread percentile",
)
def b12_c11_c12_country_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum(F.abs("c_acctbal")).alias("cap"), F.avg("c_acctbal").alias("pe"), (F.max("c_acctbal") / 1e6).alias("erp"))
    e = a.join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).where("n >= 3 and cap >= 1000 and pe > 0 and erp is not null and n_name <> 'Global'")
    e = e.select(F.col("n_name").alias("country"), "n", "cap", (C.ratio(F.lit(100.0), "pe") - F.col("erp")).alias("spread")).withColumn("all", F.lit(1))
    return R.quartile_labels(e, "spread", [], ("expensive", "neutral", "cheap")).select("country", "n", "cap", "spread", "label", S.percentile_rank("spread", "all").alias("percentile"))  # a row for each country


@query(
    """WITH a AS (SELECT c_nationkey % 5 AS g, sum(c_acctbal * (c_custkey % 9)) / sum(c_custkey % 9) / 1000 AS yield_, avg(c_acctbal) / 2000 AS erp FROM customer GROUP BY 1)
    SELECT g::INT AS g, yield_, 1 / yield_ AS pe, CASE WHEN yield_ - erp >= 2.3 THEN 'overweight' WHEN yield_ - erp <= 2.2 THEN 'underweight' ELSE 'neutral' END AS signal, CASE WHEN (1.0 + CASE WHEN yield_ - erp >= 2.3 THEN 1 WHEN yield_ - erp <= 2.2 THEN -1 ELSE 0 END) / 2 >= 0.5 THEN 'overweight' ELSE 'neutral' END AS composite FROM a""",
    "yield_ pe",
)
def a4_a40_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").withColumn("w", F.col("c_custkey") % 9)
    a = c.groupBy((F.col("c_nationkey") % 5).alias("g")).agg((R.weighted_mean("c_acctbal", "w") / 1000).alias("yield_"), (F.avg("c_acctbal") / 2000).alias("erp"))
    gap = F.col("yield_") - F.col("erp")
    a = a.withColumn("signal", F.when(gap >= 2.3, "overweight").when(gap <= 2.2, "underweight").otherwise("neutral"))
    score = C.row_mean(F.lit(1.0), C.label_value("signal", {"overweight": 1.0, "underweight": -1.0}, 0.0))
    return a.select("g", "yield_", C.ratio(F.lit(1.0), "yield_").alias("pe"), "signal", F.when(score >= 0.5, "overweight").when(score <= -0.5, "underweight").otherwise("neutral").alias("composite"))


@query(
    f"""WITH w AS (SELECT asset, date, close / sum(close) OVER (PARTITION BY date) AS w FROM ({SQL_monthly()})), d AS (SELECT date, sum(abs(w - l)) / 2 AS t FROM (SELECT date, w, lag(w) OVER ({QW}) AS l FROM w) GROUP BY 1)
    SELECT year(date)::INT AS year, avg(t) AS mean, median(t) AS middle, max(t) AS top, count(t)::BIGINT AS n FROM d GROUP BY 1""",
    "mean middle top",
)
def a10_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = S.turnover(monthly(spark, sf_dir).select("asset", "date", S.share("close", "date").alias("w")), [])
    return t.groupBy(F.year("date").alias("year")).agg(F.avg("turnover").alias("mean"), F.median("turnover").alias("middle"), F.max("turnover").alias("top"), F.count("turnover").alias("n"))


@query(
    f"""WITH c AS ({SQL_lattice}), m AS (SELECT cand_id, list_sum(list_transform(range(1, 5), lambda i: abs(w[i] - {list(BENCH)}[i]))) AS l1, sqrt(list_sum(list_transform(range(1, 5), lambda i: (w[i] - {list(BENCH)}[i]) ** 2))) AS l2, list_dot_product(w, w) AS hhi FROM c), s AS ({SQL_scenarios}), e AS (SELECT cand_id, sum(q * list_dot_product(r, w)) AS expected FROM c, s GROUP BY 1)
    SELECT cand_id, expected, l1, l2, hhi, l1 / 2 AS turnover FROM m JOIN e USING (cand_id)""",
    "expected l1 l2 hhi turnover",
)
def a30_portfolio_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lattice(spark)
    gap = F.zip_with("w", F.array(*map(F.lit, BENCH)), lambda x, y: x - y)
    add = lambda xs, f: F.aggregate(F.transform(xs, f), F.lit(0.0), lambda s, x: s + x)
    m = c.select("cand_id", add(gap, F.abs).alias("l1"), F.sqrt(add(gap, lambda x: x * x)).alias("l2"), R.dot("w", "w").alias("hhi")).withColumn("turnover", F.col("l1") / 2)
    mean = R.asset_moments(scenarios(spark, sf_dir), 4, q="q").select("mu")
    return c.join(F.broadcast(mean)).select("cand_id", R.dot("w", "mu").alias("expected")).join(m, "cand_id")  # one row


SQL_least_risk = f"""WITH s AS ({SQL_scenarios}), c AS (SELECT cand_id, w FROM ({SQL_lattice}) WHERE list_max(w) <= 0.5),
x AS (SELECT e.label::INT AS g, cand_id, var_samp(list_dot_product(r, w)) AS v FROM embeddings e JOIN s ON vec_id = scen_id, c GROUP BY ALL) SELECT g, arg_min(cand_id, (round(v, 12), cand_id)) AS cand_id, min(v) * 1e4 AS risk, count(*)::BIGINT AS n FROM x GROUP BY 1"""


@query(SQL_least_risk, "risk")
def b7_l5_minimum_risk_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scenarios(spark, sf_dir).join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("scen_id"), F.col("label").cast("int").alias("g")), "scen_id")
    groups = R.asset_moments(s, 4, ("g",))
    v = groups.join(F.broadcast(lattice(spark).where("array_max(w) <= 0.5"))).select("g", "cand_id", R.variance().alias("v"))  # parameters
    return v.groupBy("g").agg(F.min_by("cand_id", F.struct(F.round("v", 12), "cand_id")).alias("cand_id"), (F.min("v") * 1e4).alias("risk"), F.count("*").alias("n"))


@query(
    f"""WITH px AS (SELECT * FROM ({SQL_daily()}) WHERE date IN (SELECT date FROM ({SQL_daily()}) GROUP BY 1 HAVING count(*) = 3)), r AS (SELECT * FROM (SELECT asset, date, close / lag(close) OVER ({QW}) - 1 AS r FROM px) WHERE r IS NOT NULL),
    m AS (SELECT date, year(date) * 12 + month(date) AS m, max(r) FILTER (asset = 'A') AS a, max(r) FILTER (asset = 'N') AS n, max(r) FILTER (asset = 'R') AS x FROM r GROUP BY 1, 2), c AS (SELECT i / 10.0 AS wa, j / 10.0 AS wn, (10 - i - j) / 10.0 AS wx, i * 11 + j AS cand FROM range(11) t(i), range(11) u(j) WHERE i + j <= 10),
    p AS (SELECT m, cand, count(*) AS k, sum(wa * a + wn * n + wx * x) AS s1, sum((wa * a + wn * n + wx * x) ** 2) AS s2 FROM m, c GROUP BY ALL), w AS (SELECT m, cand, sum(k) OVER b AS k, sum(s1) OVER b AS s1, sum(s2) OVER b AS s2, count(*) OVER b AS months FROM p WINDOW b AS (PARTITION BY cand ORDER BY m ROWS 11 PRECEDING))
    SELECT m::INT AS month, arg_min(cand, (round((s2 - s1 * s1 / k) / (k - 1), 9), cand)) AS cand, min((s2 - s1 * s1 / k) / (k - 1)) AS risk FROM w WHERE months = 12 GROUP BY 1""",
    "risk",
)
def b4_rolling_minimum_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate of least variance over each trailing year: sums by month and candidate, added up over twelve months."""
    px = S.complete_dates(daily(spark, sf_dir))
    panel = S.to_panel(px.withColumn("r", S.change("close", S.by("asset"))).where("r is not null"), ["A", "N", "R"]).withColumn("month", F.year("date") * 12 + F.month("date"))
    k = spark.range(121).select(F.floor(F.col("id") / 11).alias("i"), (F.col("id") % 11).alias("j"), F.col("id").alias("cand")).where("i + j <= 10")
    p = panel.join(F.broadcast(k)).withColumn("p", F.col("i") / 10 * F.col("A") + F.col("j") / 10 * F.col("N") + (10 - F.col("i") - F.col("j")) / 10 * F.col("R"))  # 66 candidates
    s = p.groupBy("month", "cand").agg(F.count("*").alias("k"), F.sum("p").alias("s1"), F.sum(F.col("p") ** 2).alias("s2"))
    b = S.back(S.by("cand", order="month"), 12)
    w = s.select("month", "cand", *(F.sum(c).over(b).alias(c) for c in ("k", "s1", "s2")), F.count("*").over(b).alias("months")).where("months = 12")
    w = w.withColumn("v", (F.col("s2") - F.col("s1") ** 2 / F.col("k")) / (F.col("k") - 1))
    return w.groupBy("month").agg(F.min_by("cand", F.struct(F.round("v", 9), "cand")).alias("cand"), F.min("v").alias("risk"))


@query(
    """WITH e AS (SELECT user_id AS scen_id, event_type AS asset, ln(1 + value / 10000) AS r, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)::INT AS month FROM events), fx AS (SELECT scen_id, month, r AS fx FROM e WHERE asset = (SELECT min(event_type) FROM events))
    SELECT e.scen_id, e.asset, e.month, CASE WHEN e.asset IN ('purchase', 'view') THEN r - fx ELSE r END AS r FROM e JOIN fx USING (scen_id, month) WHERE e.asset <> (SELECT min(event_type) FROM events)""",
    "r",
)
def t15_b18_fx_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("scen_id"), F.col("event_type").alias("asset"), F.log1p(F.col("value") / 10000).alias("r"), month.alias("month"))
    first = e.agg(F.min("asset")).first()[0]
    fx = e.where(F.col("asset") == first).select("scen_id", "month", F.col("r").alias("fx"))
    out = S.convert(e.where(F.col("asset") != first), fx, ["scen_id", "month"])
    return out.select("scen_id", "asset", "month", F.when(F.col("asset").isin("purchase", "view"), F.col("r_converted")).otherwise(F.col("r")).alias("r"))


@query(
    f"""WITH px AS ({SQL_monthly('l_returnflag')}), fx AS (SELECT date, close AS fx FROM px WHERE asset = 'N') SELECT asset, date, close * fx / 1000 AS price, dividends * fx / 1000 AS dividends FROM px JOIN fx USING (date) WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""",
    "price dividends",
)
def t13_c19_price_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = monthly(spark, sf_dir, "l_returnflag")
    fx = px.where("asset = 'N'").select("date", F.col("close").alias("fx"))
    return px.where(F.col("date").between("1996-01-01", "1999-12-31")).join(fx, "date").select("asset", "date", (F.col("close") * F.col("fx") / 1000).alias("price"), (F.col("dividends") * F.col("fx") / 1000).alias("dividends"))


@query(
    """SELECT o_custkey, o_orderdate::DATE AS day, o_orderpriority AS p, o_orderstatus AS s, sum(o_totalprice) AS total, any_value(c_mktsegment) AS segment, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END AS place FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus IN ('O', 'F') GROUP BY ALL""",
    "total",
)
def j5_l4_c15_keyed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [F.col("o_custkey"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s")]
    o = read(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "F")).groupBy(*keys).agg(F.sum("o_totalprice").alias("total"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return o.join(c, "o_custkey", "left").withColumn("place", C.label_value("p", {"1-URGENT": 1, "2-HIGH": 2}, 3)).orderBy("o_custkey", "place", "day")


@query(
    f"""WITH y AS (SELECT g, cand_id, w FROM ({SQL_least_risk}) JOIN ({SQL_lattice}) USING (cand_id)), n AS (SELECT count(DISTINCT list_transform(w, lambda x: round(x, 12))) AS n FROM y),
    p AS (SELECT a.g AS one, z.g AS two, a.w AS u, z.w AS v FROM y a JOIN y z ON a.g < z.g) SELECT one, two, list_sum(list_transform(range(1, 5), lambda i: abs(u[i] - v[i]))) AS l1, sqrt(list_sum(list_transform(range(1, 5), lambda i: (u[i] - v[i]) ** 2))) AS l2,
    list_sum(list_transform(range(1, 5), lambda i: list_sum(list_transform(range(i + 1, 5), lambda j: ((u[i] - u[j] > 1e-12 AND v[i] - v[j] < -1e-12) OR (u[i] - u[j] < -1e-12 AND v[i] - v[j] > 1e-12))::INT))))::INT AS flips, n::BIGINT AS n_distinct FROM p, n""",
    "l1 l2",
)
def j11_u5_u6_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of least risk of each group: their pairwise distances, how many pairs of assets they order in opposite
    ways, and how many distinct ones there are after rounding to twelve digits."""
    y = b7_l5_minimum_risk_by_group(spark, sf_dir).select("g", "cand_id").join(lattice(spark), "cand_id").select("g", "w").transform(staged)
    distinct = y.select(F.transform("w", lambda x: F.round(x, 12)).alias("w")).dropDuplicates(["w"]).agg(F.count("*").alias("n_distinct"))
    pairs = y.select(F.col("g").alias("one"), F.col("w").alias("u")).join(y.select(F.col("g").alias("two"), F.col("w").alias("v")), F.col("one") < F.col("two"))  # a row for each group
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    l1, l2 = add(F.zip_with("u", "v", lambda p, q: F.abs(p - q))), F.sqrt(add(F.zip_with("u", "v", lambda p, q: (p - q) * (p - q))))
    return pairs.crossJoin(F.broadcast(distinct)).select("one", "two", l1.alias("l1"), l2.alias("l2"), J.order_flips("u", "v", 4).alias("flips"), "n_distinct")  # one row


@query(
    """WITH c AS (SELECT c_mktsegment AS g, c_custkey AS k, c_acctbal AS v FROM customer), f AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY v, k) AS n, count(*) OVER (PARTITION BY g) AS m FROM c) SELECT g, k, v, CASE n WHEN 1 THEN 'first' WHEN m THEN 'last' ELSE 'middle' END AS point FROM f WHERE n IN (1, m, (m + 1) // 2)""",
    "v",
)
def l6_representative_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("g"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    f = c.withColumns({"n": F.row_number().over(Window.partitionBy("g").orderBy("v", "k")), "m": F.count("*").over(Window.partitionBy("g"))})
    return f.where("n in (1, m, int((m + 1) / 2))").select("g", "k", "v", F.when(F.col("n") == 1, "first").when(F.col("n") == F.col("m"), "last").otherwise("middle").alias("point"))


@query(
    f"""WITH k AS (SELECT asset, date, close, row_number() OVER (PARTITION BY date ORDER BY close DESC, asset) AS n, count(*) OVER (PARTITION BY date) AS m FROM ({SQL_monthly()})) SELECT asset, date, 1.0 / least(m, greatest(4, ceil(m * 0.25))) AS w FROM k WHERE n <= least(m, greatest(4, ceil(m * 0.25)))""",
    "w",
)
def l7_equal_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = monthly(spark, sf_dir).withColumn("top", S.top_share("close", ["date"], "asset", least=4)).where("top")
    return m.select("asset", "date", (1 / F.count("*").over(Window.partitionBy("date"))).alias("w"))


@query(
    f"""SELECT asset AS key, 'flag' AS kind, avg(r) AS mean, count(*)::BIGINT AS n FROM ({SQL_returns()}) GROUP BY 1 UNION ALL SELECT asset, 'supplier', avg(r), count(*) FROM ({SQL_returns('l_suppkey', 'month')}) GROUP BY 1""",
    "mean",
)
def u1_union_of_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = returns(spark, sf_dir), returns(spark, sf_dir, "l_suppkey", "month")
    agg = lambda df, kind: df.groupBy(F.col("asset").alias("key")).agg(F.avg("r").alias("mean"), F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    return agg(one, "flag").unionByName(agg(two, "supplier"), allowMissingColumns=True)


@query(
    """SELECT o_orderpriority AS grp, '{"rows":' || count(*) || ',"feasible":' || count(*) FILTER (o_orderstatus = 'F') || '}' AS payload FROM orders GROUP BY 1"""
)
def s7_s8_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("grp")).agg(F.count("*").alias("rows"), F.count_if(F.col("o_orderstatus") == "F").alias("feasible"))
    return o.select("grp", F.to_json(F.struct("rows", "feasible")).alias("payload"))


@query(
    f"""WITH r AS (SELECT asset, date, ln(1 + r) AS r FROM ({SQL_returns('l_returnflag', 'month')})), fx AS (SELECT date, r AS fx FROM r WHERE asset = 'N') SELECT date, max(r - fx) FILTER (asset = 'A') AS a, max(r - fx) FILTER (asset = 'R') AS r, max(ln(1 + abs(fx) * 100 / 1200)) AS cash FROM r JOIN fx USING (date) GROUP BY 1""",
    "a r cash",
)
def b17_driver_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = returns(spark, sf_dir, "l_returnflag", "month").withColumn("r", F.log1p("r"))
    fx = r.where("asset = 'N'").select("date", F.col("r").alias("fx"))
    own = S.convert(r.where("asset <> 'N'"), fx, ["date"]).select("date", "asset", F.col("r_converted").alias("r"))
    cash = fx.join(own.select("date").distinct(), "date", "left").select("date", F.lit("cash").alias("asset"), F.log1p(F.abs("fx") * 100 / 1200).alias("r"))
    return S.to_panel(own.unionByName(cash), ["A", "R", "cash"]).select("date", F.col("A").alias("a"), F.col("R").alias("r"), "cash")


@query(
    """WITH p AS (SELECT trim(p_brand || ' ' || p_type) AS name, p_partkey, p_retailprice FROM part WHERE trim(p_type) <> '' AND NOT starts_with(lower(trim(p_brand)), 'total')), n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_partkey) AS k FROM p) SELECT name, p_partkey, p_retailprice FROM n WHERE k = 1""",
    "p_retailprice",
)
def c13_l9_industry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").where((F.trim("p_type") != "") & ~F.lower(F.trim("p_brand")).startswith("total"))
    return S.first_rows(p.select(F.trim(F.concat_ws(" ", "p_brand", "p_type")).alias("name"), "p_partkey", "p_retailprice"), ["name"], ["p_partkey"])


@query(
    f"""WITH w AS (SELECT asset, date, close / sum(close) OVER (PARTITION BY date) AS a, dividends / sum(dividends) OVER (PARTITION BY date) AS b FROM ({SQL_monthly()})) SELECT date, sum(abs(a - b)) AS l1, max(abs(a - b)) AS widest, count(*)::BIGINT AS n FROM w GROUP BY 1""",
    "l1 widest",
)
def a35_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two setups' weights on each date: the L1 distance between them."""
    w = monthly(spark, sf_dir).select("asset", "date", S.share("close", "date").alias("a"), S.share("dividends", "date").alias("b"))
    gap = F.abs(F.col("a") - F.col("b"))
    return w.groupBy("date").agg(F.sum(gap).alias("l1"), F.max(gap).alias("widest"), F.count("*").alias("n"))


@query(
    f"""WITH w AS (SELECT asset, avg(close) AS close, avg(dividends) AS dividends FROM ({SQL_monthly()}) GROUP BY 1) SELECT asset, close / sum(close) OVER () AS weight, dividends / sum(dividends) OVER () AS yield_weight, abs(close - 1500) <= 1e-8 + 0.2 * 1500 AS in_slice FROM w""",
    "weight yield_weight",
)
def b10_c14_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = monthly(spark, sf_dir).groupBy("asset").agg(F.avg("close").alias("close"), F.avg("dividends").alias("dividends")).withColumn("all", F.lit(1))  # one row for each asset
    return w.select("asset", S.share("close", "all").alias("weight"), S.share("dividends", "all").alias("yield_weight"), (F.abs(F.col("close") - 1500) <= 1e-8 + 0.2 * 1500).alias("in_slice"))


@query(
    f"""WITH f AS (SELECT asset, date, CASE WHEN close >= 1500 THEN 'high' ELSE 'low' END AS regime, lead(close) OVER ({QW}) / close - 1 AS nxt FROM ({SQL_monthly()})) SELECT date, coalesce(avg(nxt) FILTER (regime = 'high'), avg(nxt)) AS picked, avg(nxt) AS every, count(*) FILTER (regime = 'high')::BIGINT AS n_high, exp(sum(ln(1 + nxt / 100))) - 1 AS compound FROM f WHERE nxt IS NOT NULL GROUP BY 1""",
    "picked every compound",
)
def l2_a5_select_or_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = monthly(spark, sf_dir).withColumns({"regime": F.when(F.col("close") >= 1500, "high").otherwise("low"), "nxt": S.forward("close", S.by("asset"), 1)}).where("nxt is not null")
    high = F.avg(F.when(F.col("regime") == "high", F.col("nxt")))
    return m.withColumn("small", F.col("nxt") / 100).groupBy("date").agg(F.coalesce(high, F.avg("nxt")).alias("picked"), F.avg("nxt").alias("every"), F.count_if(F.col("regime") == "high").alias("n_high"), R.compound("small").alias("compound"))

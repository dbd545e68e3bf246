"""Cleaning, checking, matching and comparing tables: the operators around the studies as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.functions import columns as C
from panelkit.operators import joins as J
from panelkit.operators import risk as R
from panelkit.operators import series as S
from panelkit.plans.registry import query, read
from panelkit.plans.strategies import SQL_signal_study, b11_j12_signal_study
from panelkit.plans.tables import SQL_monthly, SQL_returns, SQL_weekly_returns, daily, monthly, returns
from panelkit.sources import files

QW = "PARTITION BY asset ORDER BY date"
KINDS = ("signup", "click", "error", "purchase")


@query(
    """WITH p AS (SELECT CASE p_partkey % 13 WHEN 0 THEN ' nan ' WHEN 1 THEN 'Total Market (all)' WHEN 2 THEN '   ' ELSE ' ' || p_brand || ' ' || p_type END AS raw, p_partkey, p_retailprice FROM part),
    n AS (SELECT trim(raw) AS name, p_partkey, p_retailprice, row_number() OVER (PARTITION BY trim(raw) ORDER BY p_partkey) AS k FROM p WHERE trim(raw) <> '' AND lower(trim(raw)) <> 'nan' AND NOT starts_with(lower(trim(raw)), 'total market')) SELECT name, p_partkey, p_retailprice FROM n WHERE k = 1""",
    "p_retailprice",
)
def c13_industry_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 13
    raw = F.when(k == 0, " nan ").when(k == 1, "Total Market (all)").when(k == 2, "   ").otherwise(F.concat(F.lit(" "), "p_brand", F.lit(" "), "p_type"))
    named = read(spark, sf_dir, "part").select(C.industry_name(raw).alias("name"), "p_partkey", "p_retailprice").where("name is not null")
    return S.first_rows(named, ["name"], ["p_partkey"])


@query("SELECT user_id, event_type AS region, CASE WHEN event_id % 3 = 0 THEN 'overweight' WHEN event_id % 3 = 1 THEN 'market_weight' ELSE 'underweight' END AS sector, CASE WHEN event_type = 'click' THEN CASE event_id % 3 WHEN 0 THEN 'high_conviction_overweight' WHEN 1 THEN 'overweight' ELSE 'relative_underweight' END WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'relative_overweight' WHEN 1 THEN 'underweight' ELSE 'high_conviction_underweight' END WHEN event_type = 'view' THEN CASE event_id % 3 WHEN 0 THEN 'overweight' WHEN 1 THEN 'market_weight' ELSE 'underweight' END ELSE 'market_weight' END AS action FROM events")
def c7_combined_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    region = C.label_value("event_type", {"click": "overweight", "error": "underweight", "view": "neutral"}, "none")
    sector = F.when(F.col("event_id") % 3 == 0, "overweight").when(F.col("event_id") % 3 == 1, "market_weight").otherwise("underweight")
    return e.select("user_id", F.col("event_type").alias("region"), sector.alias("sector"), C.combine_actions(region, sector).alias("action"))


@query("SELECT c_nationkey, count(*)::BIGINT AS n, unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS point, unnest([quantile_cont(c_acctbal, 0.0), quantile_cont(c_acctbal, 0.25), quantile_cont(c_acctbal, 0.5), quantile_cont(c_acctbal, 0.75), quantile_cont(c_acctbal, 1.0)]) AS balance FROM customer GROUP BY 1", "point balance")
def c21_grid_of_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances at every point of an inclusive grid."""
    points = [0.25 * k for k in range(5)]
    q = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.percentile("c_acctbal", F.array(*map(F.lit, points))).alias("q"))
    return q.select("c_nationkey", "n", F.posexplode(C.grid(0.0, 1.0, 0.25)).alias("k", "point"), "q").select("c_nationkey", "n", F.col("point").cast("double").alias("point"), F.get("q", F.col("k")).alias("balance"))


@query(
    f"""WITH px AS (SELECT asset, date, close / lag(close) OVER ({QW}) - 1 AS r FROM ({SQL_monthly('l_returnflag')}) WHERE date BETWEEN DATE '1995-11-01' AND DATE '1999-12-31') SELECT asset, date, r, CASE WHEN date < DATE '1998-01-01' THEN 'in' ELSE 'out' END AS sample FROM px WHERE date >= DATE '1996-01-01'""",
    "r",
)
def c19_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In and out of sample; the cut starts two months early, so the first month has a return."""
    px = monthly(spark, sf_dir, "l_returnflag").where(F.col("date").between(C.padded_start("1996-01-01"), "1999-12-31"))
    r = px.withColumn("r", S.change("close", S.by("asset"))).where("date >= '1996-01-01'")
    return r.select("asset", "date", "r", C.sample_of("date", "1998-01-01").alias("sample"))


@query("""WITH g AS (SELECT o_orderpriority AS grp, count(*)::DOUBLE AS n FROM orders GROUP BY 1) SELECT '{"grp":"' || grp || '","n":' || CASE WHEN grp = '2-HIGH' THEN 'null' ELSE CAST(n AS VARCHAR) END || '}' AS value FROM g""")
def s7_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("grp")).agg(F.count("*").cast("double").alias("n"))
    return files.json_rows(g.withColumn("n", F.when(F.col("grp") == "2-HIGH", float("nan")).otherwise(F.col("n"))))


@query(
    f"""WITH s AS (SELECT o_orderpriority AS g, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL), v AS (SELECT string_agg('{{"asset":"' || asset || '","vol":' || round(vol, 2)::VARCHAR || '}}', ',' ORDER BY asset) AS v FROM (SELECT asset, stddev_samp(r) AS vol FROM ({SQL_returns('l_returnflag', 'month')}) GROUP BY 1))
    SELECT g AS o_orderpriority, '{{"total":' || sum(sum(n)) OVER () || ',"o_orderpriority":"' || g || '","rows":' || sum(n) || ',"feasible":' || sum(n) FILTER (s = 'F') || ',"by_status":[' || string_agg('{{"status":"' || s || '","n":' || n || '}}', ',' ORDER BY s) || '],"volatility":[' || any_value(v) || ']}}' AS manifest FROM s, v GROUP BY g"""
)
def s8_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vol = returns(spark, sf_dir, "l_returnflag", "month").groupBy("asset").agg(F.round(F.stddev_samp("r"), 2).alias("vol"))
    return files.manifest(read(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", "F", vol)


SQL_wide = f"SELECT date, max(r) FILTER (asset = 'A') AS a, max(r) FILTER (asset = 'N') AS n, max(r) FILTER (asset = 'R') AS r FROM ({SQL_returns()}) GROUP BY 1"


@query(f"SELECT count(*) FILTER (a IS NULL)::BIGINT AS a_null, count(*) FILTER (n IS NULL)::BIGINT AS n_null, count(*) FILTER (r IS NULL)::BIGINT AS r_null FROM ({SQL_wide})")
def t14_null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.null_counts(S.to_panel(returns(spark, sf_dir), ["A", "N", "R"]), ["A", "N", "R"]).toDF("a_null", "n_null", "r_null")


@query(f"SELECT * FROM ({SQL_wide}) WHERE a IS NOT NULL AND n IS NOT NULL AND r IS NOT NULL", "a n r")
def t14_full_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver panel; dates that a driver lacks are warned of and left out."""
    return S.require_full(S.to_panel(returns(spark, sf_dir), ["A", "N", "R"]), ["A", "N", "R"], fail=False).toDF("date", "a", "n", "r")


@query(f"SELECT date FROM ({SQL_wide}) WHERE a IS NOT NULL AND n IS NOT NULL AND r IS NOT NULL")
def u3_common_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = returns(spark, sf_dir)
    return S.common_dates(*(r.where(F.col("asset") == a) for a in ("A", "N", "R")))


@query("SELECT 'discount' AS name, value, row_number() OVER (ORDER BY value)::INT AS place FROM (SELECT DISTINCT l_discount AS value FROM lineitem) UNION ALL SELECT 'tax', value, row_number() OVER (ORDER BY value)::INT FROM (SELECT DISTINCT l_tax AS value FROM lineitem)", "value")
def u5_parameter_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    return J.parameter_values(line.select(F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax")), ["discount", "tax"])


@query(
    """WITH a AS (SELECT c_nationkey AS k, count(*) AS n, sum(c_acctbal) AS cap FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, avg(s_acctbal) AS erp FROM supplier GROUP BY 1)
    SELECT coalesce(CASE WHEN n_nationkey % 4 > 0 THEN 'Market ' || n_nationkey END, n_name) AS name, 'nation ' || n_nationkey AS name_key, n::BIGINT AS n, cap, erp FROM nation JOIN a ON a.k = n_nationkey LEFT JOIN b ON b.k = n_nationkey""",
    "cap erp",
)
def j3_j4_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-sections that spell names in two ways meet on the normalised name; a market without a name is called by its key."""
    nation = read(spark, sf_dir, "nation")
    a = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("cap"))
    left = nation.join(a, F.col("n_nationkey") == F.col("c_nationkey")).select("n_nationkey", F.initcap(F.regexp_replace("n_name", "_", " - ")).alias("country"), F.col("n_name").alias("market"), "n", "cap")
    right = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.lower("n_name").alias("country")).agg(F.avg("s_acctbal").alias("erp"))
    both = J.on_name(left, right, "country", "country")
    names = nation.where("n_nationkey % 4 > 0").select("n_nationkey", F.concat(F.lit("Market "), F.col("n_nationkey").cast("string")).alias("name"))
    return both.join(names, "n_nationkey", "left").select(F.coalesce("name", "market").alias("name"), "name_key", "n", "cap", "erp")


@query("SELECT n_name AS name, n_nationkey AS a, n_nationkey AS b, n_nationkey AS c FROM nation")
def c4_j3_names_by_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in full-width capitals, with combining marks and with ligatures meet the plain ones."""
    nation = read(spark, sf_dir, "nation")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    wide = F.translate("n_name", letters + "_", "".join(chr(0xFEE0 + ord(x)) for x in letters) + "\uff3f")
    marked = F.regexp_replace(F.lower("n_name"), "([aeiou])", "$1\u0301")
    joined = F.regexp_replace(F.regexp_replace(F.initcap(F.lower("n_name")), "fi", "\ufb01"), "st", "\ufb06")
    out = nation.select(F.col("n_name").alias("name"))
    for column, spelled in (("a", wide), ("b", marked), ("c", joined)):
        out = J.on_name(out, nation.select(spelled.alias("spelled"), F.col("n_nationkey").alias(column)), "name", "spelled").drop("name_key")
    return out


_SIX = "l_returnflag AS f, l_linestatus AS s, year(l_shipdate)::INT AS y, month(l_shipdate)::INT AS m, round(l_discount * 100)::INT AS d, round(l_tax * 100)::INT AS t"


@query(f"WITH a AS (SELECT {_SIX}, sum(l_quantity) AS qty FROM lineitem WHERE l_quantity > 25 GROUP BY ALL), b AS (SELECT {_SIX}, count(*)::BIGINT AS small FROM lineitem WHERE l_quantity <= 25 GROUP BY ALL) SELECT f, s, y, m, d, t, qty, small FROM a LEFT JOIN b USING (f, s, y, m, d, t)", "qty")
def j5_six_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem").select("l_quantity", F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"), F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m"), F.round(F.col("l_discount") * 100).cast("int").alias("d"), F.round(F.col("l_tax") * 100).cast("int").alias("t"))
    six = ["f", "s", "y", "m", "d", "t"]
    large = line.where("l_quantity > 25").groupBy(*six).agg(F.sum("l_quantity").alias("qty"))
    return large.join(line.where("l_quantity <= 25").groupBy(*six).agg(F.count("*").alias("small")), six, "left")


@query("SELECT o_orderkey, o_orderstatus, o_orderstatus IN ('O', 'F') AS feasible FROM orders")
def c15_feasible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", C.feasible("o_orderstatus", ("o", "f")).alias("feasible"))


@query(
    f"""WITH s AS ({SQL_signal_study}) SELECT signal, asset, a.corr AS corr_high_low, b.corr AS corr_middle, a.corr - b.corr AS corr_gap, a.slope AS slope_high_low, b.slope AS slope_middle, a.slope - b.slope AS slope_gap FROM (SELECT * FROM s WHERE sample = 'high_low') a FULL JOIN (SELECT * FROM s WHERE sample = 'middle') b USING (signal, asset)""",
    "corr_high_low corr_middle corr_gap slope_high_low slope_middle slope_gap",
)
def j12_extremes_against_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.side_by_side(b11_j12_signal_study(spark, sf_dir), ["signal", "asset"], "sample", ("high_low", "middle"), ["corr", "slope"])


@query("SELECT 'unknown value' AS kind, event_type AS name FROM (SELECT DISTINCT event_type FROM events) WHERE event_type NOT IN ('signup', 'click', 'error', 'purchase') UNION ALL SELECT 'missing column', name FROM (VALUES ('price'), ('venue')) t(name) UNION ALL SELECT 'missing driver', c_custkey::VARCHAR FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j14_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    lost = J.missing_columns(events, ["user_id", "price", "event_type", "venue"])
    drivers = J.missing_keys(read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")
    parts = [J.unknown_values(events, "event_type", KINDS).select(F.lit("unknown value").alias("kind"), F.col("event_type").alias("name")), spark.createDataFrame([("missing column", c) for c in lost], "kind string, name string"), drivers.select(F.lit("missing driver").alias("kind"), F.col("c_custkey").cast("string").alias("name"))]
    return parts[0].union(parts[1]).union(parts[2])


@query(
    """WITH a AS (SELECT l_suppkey, l_returnflag, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL), f AS (SELECT l_suppkey, l_returnflag, avg(l_extendedprice) AS price, avg(l_discount) AS discount, avg(l_tax) AS tax, avg(l_quantity) AS quantity, max(l_extendedprice) AS most, count(l_extendedprice)::BIGINT AS feasible FROM lineitem WHERE l_quantity > 47 GROUP BY ALL)
    SELECT a.l_suppkey, a.l_returnflag, n, coalesce(feasible, 0)::BIGINT AS feasible, n - coalesce(feasible, 0) AS infeasible, price AS avg_l_extendedprice, discount AS avg_l_discount, tax AS avg_l_tax, quantity AS avg_l_quantity, most AS max_l_extendedprice FROM a LEFT JOIN f USING (l_suppkey, l_returnflag)""",
    "avg_l_extendedprice avg_l_discount avg_l_tax avg_l_quantity max_l_extendedprice",
)
def a1_feasible_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    return R.feasible_summary(line, ["l_suppkey", "l_returnflag"], F.col("l_quantity") > 47, ["l_extendedprice", "l_discount", "l_tax", "l_quantity"], "l_extendedprice")


@query(f"WITH w AS (SELECT asset, date, close / sum(close) OVER (PARTITION BY date) AS a, dividends / sum(dividends) OVER (PARTITION BY date) AS b FROM ({SQL_monthly()})) SELECT asset, 'close' AS setup, avg(a) AS weight, count(*)::BIGINT AS n FROM w GROUP BY 1 UNION ALL SELECT asset, 'dividends', avg(b), count(*) FROM w GROUP BY 1", "weight")
def a35_average_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = monthly(spark, sf_dir).select("asset", S.share("close", "date").alias("a"), S.share("dividends", "date").alias("b"))
    w = m.select("asset", F.explode(F.create_map(F.lit("close"), "a", F.lit("dividends"), "b")).alias("setup", "w"))
    return w.groupBy("asset", "setup").agg(F.avg("w").alias("weight"), F.count("*").alias("n"))


@query(
    f"""WITH f AS (SELECT asset, date, close / 1000 AS x, lead(close, 3) OVER ({QW}) / close - 1 AS y FROM ({SQL_monthly()})), g AS (SELECT *, row_number() OVER ({QW}) AS rn, regr_slope(y, x) OVER s AS beta, regr_intercept(y, x) OVER s AS alpha FROM f WHERE y IS NOT NULL WINDOW s AS ({QW} ROWS UNBOUNDED PRECEDING)), h AS (SELECT *, alpha + beta * x AS forecast FROM g WHERE rn >= 20)
    SELECT asset, count(*)::BIGINT AS n, corr(forecast, y) AS corr, avg(y - forecast) AS mean_error, avg(abs(y - forecast)) AS mad, arg_max(alpha, date) AS last_alpha, arg_max(beta, date) AS last_beta, arg_max(forecast, date) AS last_forecast FROM h GROUP BY 1""",
    "corr mean_error mad last_alpha last_beta last_forecast",
)
def k2_forecast_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = monthly(spark, sf_dir).select("asset", "date", (F.col("close") / 1000).alias("x"), S.forward("close", S.by("asset"), 3).alias("y"))
    return S.fit_summary(S.expanding_fit(m, "x", "y", ["asset"], "date"), "y", ["asset"], "date")


_QUARTERS = "SELECT asset, date, close / lag(close) OVER (PARTITION BY asset ORDER BY date) - 1 AS r FROM (SELECT asset, CAST(date_trunc('quarter', date) AS DATE) AS date, arg_max(close, date) AS close FROM ({}) GROUP BY 1, 2)"


@query(
    f"""WITH r AS (SELECT 'day' AS freq, * FROM ({SQL_returns()}) UNION ALL SELECT 'week', * FROM ({SQL_weekly_returns}) UNION ALL SELECT 'quarter', * FROM ({_QUARTERS.format(SQL_monthly('l_returnflag'))}) WHERE r IS NOT NULL),
    p AS (SELECT a.freq, a.date, a.r AS x, b.r AS y FROM r a JOIN r b ON a.freq = b.freq AND a.date = b.date WHERE a.asset = 'A' AND b.asset = 'N')
    SELECT freq, date, corr FROM (SELECT freq, date, CASE WHEN count(*) OVER w >= 8 THEN corr(x, y) OVER w END AS corr FROM p WINDOW w AS (PARTITION BY freq ORDER BY date RANGE BETWEEN INTERVAL 3649 DAYS PRECEDING AND CURRENT ROW)) WHERE corr IS NOT NULL""",
    "corr",
)
def k9_three_samplings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten years' correlation of two series at daily, weekly and quarterly sampling, in one pass."""
    px = daily(spark, sf_dir)
    quarter = S.bars(px, "quarter").withColumnRenamed("period", "date").withColumn("r", S.change("close", S.by("asset"))).where("r is not null")
    parts = {"day": returns(spark, sf_dir), "week": returns(spark, sf_dir, "l_returnflag", "week"), "quarter": quarter.select("asset", "date", "r")}
    r = S.stacked({k: v for k, v in parts.items()}, "freq")
    p = r.groupBy("freq", "date").agg(F.max(F.when(F.col("asset") == "A", F.col("r"))).alias("x"), F.max(F.when(F.col("asset") == "N", F.col("r"))).alias("y")).where("x is not null and y is not null")
    return S.rolling_correlations(p, "x", "y", 3650, ["freq"], 8).select("freq", "date", "corr").where("corr is not null")


@query(
    "SELECT x + 0.0 AS x, y + 0.0 AS y, z + 0.0 AS z, min(vec_id) AS first_id, count(*)::BIGINT AS n FROM (SELECT vec_id, round(embedding[1]::DOUBLE, 1) AS x, round(embedding[2]::DOUBLE, 1) AS y, round(embedding[3]::DOUBLE, 1) AS z FROM embeddings) GROUP BY x + 0.0, y + 0.0, z + 0.0",
    "x y z",
)
def u6_distinct_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that agree to so many digits are one, with the first of them and how many they are."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", *(F.round(F.element_at("embedding", k + 1).cast("double"), 1).alias(c) for k, c in enumerate("xyz")))
    return e.select("vec_id", *((F.col(c) + 0.0).alias(c) for c in "xyz")).groupBy("x", "y", "z").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))

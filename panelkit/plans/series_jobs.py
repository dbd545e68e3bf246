"""Cleaning, bars, returns, windows and rankings as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelkit.functions import columns as C
from panelkit.operators import joins as J
from panelkit.operators import ordered as O
from panelkit.operators import series as S
from panelkit.plans.registry import query, read
from panelkit.plans.tables import SQL_daily, SQL_monthly, SQL_returns, daily, monthly, returns

D3, M = SQL_daily(), SQL_monthly()
QW = "PARTITION BY asset ORDER BY date"


@query(
    """SELECT p_partkey, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS label_key, trim(regexp_replace(regexp_replace(lower(p_name), '&', ' and ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS name_key,
    CASE WHEN n ~ 'reit|real estate' THEN 'Real Estate' WHEN n ~ 'bank|insurance|broker|financial' THEN 'Financials' WHEN n ~ 'telecom|cable|broadcast|publishing|entertainment|information services|advertising' THEN 'Communication Services'
    WHEN n ~ 'software|semiconductor|computer|electronics|internet|it services' THEN 'Technology' WHEN n ~ 'drug|health|hospital|medical|biotech|pharma' THEN 'Health Care' WHEN n ~ 'utility|power' THEN 'Utilities'
    WHEN n ~ 'oil|gas|coal|energy' THEN 'Energy' WHEN n ~ 'chemical|metals|mining|paper|forest|packaging|steel|precious' THEN 'Materials' WHEN n ~ 'food|beverage|tobacco|household|grocery|consumer products' THEN 'Consumer Staples'
    WHEN n ~ 'restaurant|retail|hotel|gaming|furn|apparel|auto|shoe|leisure|homebuild|building supply' THEN 'Consumer Discretionary' ELSE 'Industrials' END AS sector
    FROM (SELECT *, lower(p_type || ' ' || p_name) AS n FROM part)"""
)
def c4_c6_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    return part.select("p_partkey", C.label_key("p_brand").alias("label_key"), C.country_key("p_name").alias("name_key"), C.sector_of(F.concat_ws(" ", "p_type", "p_name")).alias("sector"))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS price, round(o_totalprice, 2) AS coerced, CAST(o_orderdate AS DATE) AS day FROM orders", "price coerced")
def c1_c3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices and days written in several ways each, free forms among them, and read back."""
    k = F.col("o_orderkey") % 6
    plain = F.format_string("%.2f", "o_totalprice")
    token = F.when(k == 0, F.format_number("o_totalprice", 2)).when(k == 1, F.translate(plain, ".", ",")).when(k == 2, F.concat(F.lit("USD "), plain)).otherwise(F.concat(F.lit(" "), plain))
    day = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "dd.MM.yyyy")).when(k == 2, F.date_format("o_orderdate", "MM/dd/yyyy"))
    day = day.when(k == 3, F.date_format("o_orderdate", "MMM d, yyyy")).when(k == 4, F.lower(F.date_format("o_orderdate", "d-MMMM-yyyy"))).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    return read(spark, sf_dir, "orders").select("o_orderkey", C.number_token(token).alias("price"), C.to_number(plain).alias("coerced"), C.date_token(day).alias("day"))


@query(
    """SELECT o_orderkey, make_date(year(o_orderdate), month(o_orderdate), 1) AS month, CASE WHEN o_totalprice <> 0 THEN 1 / o_totalprice * 1e5 END AS yield_, CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.6 WHEN '5-LOW' THEN -1.0 ELSE 0.0 END::DOUBLE AS score,
    abs(o_totalprice - 200000) <= 1e-8 + 1e-5 * 200000 AS is_near, exp(ln(1 + o_totalprice / 1e6) * 12 / 36) - 1 AS yearly, lower(replace(o_orderpriority, '.', '-')) || '.us' AS ticker, array_to_string(list_filter(list_transform(string_split(lower(o_orderpriority) || ' , ,' || o_orderstatus || ',x.y', ','), lambda s: upper(trim(s))), lambda s: s <> ''), '|') AS tickers, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 7 END::INT AS case_no FROM orders""",
    "yield_ score yearly",
)
def c8_c18_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.year("o_orderdate") + F.month("o_orderdate") / 100
    scores = {"1-URGENT": 1.0, "2-HIGH": 0.6, "5-LOW": -1.0}
    listed = F.concat(F.lower("o_orderpriority"), F.lit(" , ,"), "o_orderstatus", F.lit(",x.y"))
    case = F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("run of Case "), (F.col("o_orderkey") % 7).cast("string"), F.lit(" done"))).otherwise("no case")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", C.decimal_month(code).alias("month"), (C.ratio(F.lit(1.0), "o_totalprice") * 1e5).alias("yield_"), C.label_value("o_orderpriority", scores, 0.0).alias("score"),
        C.near("o_totalprice", 200000.0).alias("is_near"), C.annualise(F.col("o_totalprice") / 1e6, 36).alias("yearly"), C.ticker("o_orderpriority", ".us").alias("ticker"),
        F.array_join(C.ticker_list(listed), "|").alias("tickers"), C.case_number(case).alias("case_no"),
    )


@query(
    """WITH e AS (SELECT user_id, event_type, sum(value) AS v FROM events GROUP BY ALL), t AS (SELECT unnest(['signup', 'click', 'error', 'purchase', 'view']) AS t, unnest(range(5)) AS k), u AS (SELECT DISTINCT user_id FROM e)
    SELECT user_id, string_agg(event_type || ':' || printf('%+.2f', v), '; ' ORDER BY event_type) AS exposures, any_value(w.vector) AS vector, count(*) FILTER (event_type = 'view') = 0 AS is_known, count(*)::BIGINT AS n
    FROM e LEFT JOIN (SELECT user_id, string_agg(printf('%.2f', v), ' ' ORDER BY k) AS vector FROM (SELECT u.user_id, t.k, coalesce(sum(e.v), 0) AS v FROM u CROSS JOIN t LEFT JOIN e ON e.user_id = u.user_id AND e.event_type = t.t GROUP BY ALL) GROUP BY 1) w USING (user_id) GROUP BY 1"""
)
def c16_c17_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17: a vector in the order of known tickers; is_known tells who has a vector without the last of them (view)."""
    sums = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    maps = sums.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "v")))).alias("m"))  # a few types for each user
    tickers = ("signup", "click", "error", "purchase", "view")
    vector = F.array_join(F.transform(C.exposure_vector("m", tickers), lambda x: F.format_string("%.2f", x)), " ")
    return maps.select("user_id", C.exposures_text("m").alias("exposures"), vector.alias("vector"), C.exposure_vector("m", tickers[:-1]).isNotNull().alias("is_known"), F.size("m").cast("long").alias("n"))


@query(f"SELECT * FROM ({D3}) WHERE date IN (SELECT date FROM ({D3}) GROUP BY 1 HAVING count(DISTINCT asset) = (SELECT count(DISTINCT asset) FROM ({D3})))", "close dividends")
def s1_j9_complete_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.complete_dates(daily(spark, sf_dir))


@query(
    f"""SELECT 'month' AS unit, asset, CAST(date_trunc('month', date) AS DATE) AS period, max(date) AS last_date, arg_max(close, date) AS close, sum(dividends) AS dividends FROM ({D3}) GROUP BY 2, 3
    UNION ALL SELECT 'quarter', asset, CAST(date_trunc('quarter', date) AS DATE), max(date), arg_max(close, date), sum(dividends) FROM ({D3}) GROUP BY 2, 3
    UNION ALL SELECT 'friday_week', asset, date + CAST((5 - isodow(date) + 7) % 7 AS INTEGER), max(date), arg_max(close, date), sum(dividends) FROM ({D3}) GROUP BY 2, 3""",
    "close dividends",
)
def t1_t2_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = daily(spark, sf_dir)
    parts = [S.bars(px, u, ("close",), ("dividends",)).select(F.lit(u).alias("unit"), "*") for u in ("month", "quarter", "friday_week")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    f"""SELECT asset, date, close / lag(close) OVER w - 1 AS r, ln(close / lag(close) OVER w) AS log_r, lead(close, 1) OVER w / close - 1 AS next_1, lead(close, 12) OVER w / close - 1 AS next_12,
    pow(lead(close, 24) OVER w / close, 0.5) - 1 AS next_24, CASE WHEN count(dividends) OVER b = 12 THEN sum(dividends) OVER b END / close AS dy, close / lag(close, 12) OVER w - 1 AS momentum FROM ({M}) WINDOW w AS ({QW}), b AS ({QW} ROWS 11 PRECEDING)""",
    "r log_r next_1 next_12 next_24 dy momentum",
)
def t3_t9_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = S.by("asset")
    return monthly(spark, sf_dir).select(
        "asset", "date", S.change("close", w).alias("r"), S.log_change("close", w).alias("log_r"), S.forward("close", w, 1).alias("next_1"), S.forward("close", w, 12).alias("next_12"), S.forward("close", w, 24, 2.0).alias("next_24"),
        (S.trailing(F.sum("dividends"), "dividends", w, 12) / F.col("close")).alias("dy"), S.change("close", w, 12).alias("momentum"),
    )


@query(f"SELECT asset, date, CASE WHEN count(r) OVER b = 12 THEN stddev_pop(r) OVER b END * sqrt(12) AS vol FROM ({SQL_returns('l_suppkey', 'month')}) WINDOW b AS ({QW} ROWS 11 PRECEDING)", "vol")
def t8_trailing_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = S.by("asset")
    return returns(spark, sf_dir, "l_suppkey", "month").select("asset", "date", (S.trailing(F.stddev_pop("r"), "r", w, 12) * F.sqrt(F.lit(12.0))).alias("vol"))


@query(
    f"""WITH px AS ({D3}), firsts AS (SELECT asset FROM px GROUP BY 1 HAVING min(date) = (SELECT min(date) FROM px)), g AS (SELECT DISTINCT d.date, f.asset FROM px d, firsts f)
    SELECT g.asset, g.date, last_value(px.close IGNORE NULLS) OVER (PARTITION BY g.asset ORDER BY g.date) AS close FROM g LEFT JOIN px USING (asset, date)""",
    "close",
)
def t5_fill_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fill_forward(daily(spark, sf_dir))


@query(
    f"""WITH r AS (SELECT asset, date, ln(1 + r) AS r FROM ({SQL_returns()})), fx AS (SELECT date, r AS fx FROM r WHERE asset = 'N')
    SELECT asset, date, r - fx AS additive, CASE WHEN 1 + (exp(r) - 1) / exp(fx) > 0 THEN ln(1 + (exp(r) - 1) / exp(fx)) END AS exact, r + (fx * 100 - r * 50) / 12 / 100 AS hedged, ln(1 + abs(r) * 100 / 1200) AS cash FROM r JOIN fx USING (date) WHERE asset <> 'N'""",
    "additive exact hedged cash",
)
def t10_t12_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = returns(spark, sf_dir).withColumn("r", F.log1p("r"))
    fx = r.where("asset = 'N'").select("date", F.col("r").alias("fx"))
    own = r.where("asset <> 'N'")
    both = S.convert(own, fx, ["date"]).withColumnRenamed("r_converted", "additive").drop("fx")
    both = S.convert(both, fx, ["date"], "exact").withColumnRenamed("r_converted", "exact")  # null where the quotient is -1 or less
    both = both.withColumns({"home": F.col("fx") * 100, "foreign": F.col("r") * 50, "rate": F.abs("r") * 100})
    return both.select("asset", "date", "additive", "exact", S.hedged("r", "home", "foreign").alias("hedged"), S.cash_return("rate").alias("cash"))


@query(
    f"SELECT date, max(r) FILTER (asset = 'A') AS a, max(r) FILTER (asset = 'N') AS n, max(r) FILTER (asset = 'R') AS r, (count(*) FILTER (asset = 'A') = 0)::INT AS gap FROM ({SQL_returns()}) GROUP BY 1",
    "a n r",
)
def t14_u3_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = S.to_panel(returns(spark, sf_dir), ["A", "N", "R"])
    return panel.select("date", *(F.col(c).alias(c.lower()) for c in ("A", "N", "R")), F.col("A").isNull().cast("int").alias("gap"))


@query(
    f"""WITH f AS (SELECT *, CASE WHEN count(dividends) OVER (PARTITION BY asset ORDER BY date ROWS 11 PRECEDING) = 12 THEN sum(dividends) OVER (PARTITION BY asset ORDER BY date ROWS 11 PRECEDING) END / close AS dy FROM ({M})),
    h AS (SELECT asset, date, dy, quantile_cont(dy, [0.25, 0.75]) OVER p AS q, count(dy) OVER p AS n FROM f WINDOW p AS (PARTITION BY asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT asset, date, dy, CASE WHEN n >= 36 AND dy IS NOT NULL THEN CASE WHEN dy >= q[2] THEN 'high' WHEN dy <= q[1] THEN 'low' ELSE 'middle' END END AS regime FROM h""",
    "dy",
)
def k1_expanding_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = monthly(spark, sf_dir).withColumn("dy", S.trailing(F.sum("dividends"), "dividends", S.by("asset"), 12) / F.col("close"))
    return O.expanding_regimes(m.select("asset", "date", "dy"), "dy", ["asset"], "date")


@query(
    """WITH f AS (SELECT o_orderkey, o_totalprice AS x FROM orders), h AS (SELECT *, quantile_cont(x, [0.25, 0.75]) OVER p AS q, count(x) OVER p AS n FROM f WINDOW p AS (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT o_orderkey, CASE WHEN n >= 36 AND x IS NOT NULL THEN CASE WHEN x >= q[2] THEN 'high' WHEN x <= q[1] THEN 'low' ELSE 'middle' END END AS regime, q[1] AS low, q[2] AS high FROM h""",
    "low high",
)
def k1_one_long_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as one series, against the quartiles of the earlier ones: no task holds more of it than a block."""
    orders = read(spark, sf_dir, "orders").select(F.lit("all").alias("series"), "o_orderkey", F.col("o_totalprice").alias("x"))
    found = O.expanding_quantiles(orders, "x", ["series"], "o_orderkey")
    label = F.when(F.col("x") >= F.col("q1"), "high").when(F.col("x") <= F.col("q0"), "low").otherwise("middle")
    return found.select("o_orderkey", F.when(F.col("n_before") >= 36, label).alias("regime"), F.col("q0").alias("low"), F.col("q1").alias("high"))


@query(
    """WITH f AS (SELECT *, ntile(4) OVER (ORDER BY x, k) AS bucket, (rank() OVER (ORDER BY level) + (count(*) OVER (PARTITION BY level) - 1) / 2.0) / count(*) OVER () AS pct, row_number() OVER (ORDER BY level DESC, k) AS place, count(*) OVER () AS n FROM (SELECT o_orderkey AS k, o_totalprice AS x, floor(o_totalprice / 10000) AS level FROM orders))
    SELECT k, bucket::INT AS bucket, pct, place, place <= greatest(1, ceil(n * 0.25)) AS top FROM f""",
    "pct",
)
def k3_k7_k12_l1_one_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal buckets, percentile ranks, places and the best quarter of all orders in one group, over ranges of rows."""
    orders = read(spark, sf_dir, "orders").select(F.lit("all").alias("g"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("x"), F.floor(F.col("o_totalprice") / 10000).alias("level"))
    ranked = O.percentile_ranks(O.equal_buckets(orders, ["g"], ["x", "k"], 4, "x"), ["g"], "level")
    return O.top_shares(O.positions(ranked, ["g"], [F.desc("level"), "k"]), ["g"], "level").select("k", "bucket", "pct", "place", "top")


@query(
    f"""WITH f AS (SELECT asset, date, close, ntile(4) OVER (PARTITION BY date ORDER BY close, asset) AS bucket FROM ({M}))
    SELECT asset, date, CASE bucket WHEN 1 THEN 'low' WHEN 4 THEN 'high' ELSE 'middle' END AS label, max(close) FILTER (bucket = 1) OVER p AS low_cut, min(close) FILTER (bucket = 4) OVER p AS high_cut,
    CASE WHEN close >= avg(close) OVER p + stddev_pop(close) OVER p THEN 'high' WHEN close <= avg(close) OVER p - stddev_pop(close) OVER p THEN 'low' ELSE 'middle' END AS sigma,
    CASE WHEN stddev_pop(close) OVER p = 0 THEN 0 ELSE (close - avg(close) OVER p) / stddev_pop(close) OVER p END AS z, close / sum(close) OVER p AS share FROM f WINDOW p AS (PARTITION BY date)""",
    "low_cut high_cut z share",
)
def k3_k5_cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.buckets(monthly(spark, sf_dir), "close", ["date"], ["asset"])
    w = Window.partitionBy("date")
    return out.select("asset", "date", "label", "low_cut", "high_cut", S.sigma_split("close", "date").alias("sigma"), S.z_score("close", w).alias("z"), S.share("close", "date").alias("share"))


@query(
    f"""SELECT asset, date, (rank() OVER (PARTITION BY date ORDER BY level) + (count(*) OVER (PARTITION BY date, level) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS pct,
    row_number() OVER (PARTITION BY date ORDER BY level DESC, asset)::INT AS place FROM (SELECT asset, date, floor(close / 100) AS level FROM ({M}))""",
    "pct",
)
def k7_k12_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = monthly(spark, sf_dir).withColumn("level", F.floor(F.col("close") / 100))
    return m.select("asset", "date", S.percentile_rank("level", "date").alias("pct"), F.row_number().over(Window.partitionBy("date").orderBy(F.desc("level"), "asset")).alias("place"))


@query(
    f"""WITH f AS (SELECT asset, date, close / 1000 AS x, lead(close, 3) OVER (PARTITION BY asset ORDER BY date) / close - 1 AS y FROM ({M})), g AS (SELECT *, row_number() OVER ({QW}) AS rn, regr_slope(y, x) OVER s AS beta, regr_intercept(y, x) OVER s AS alpha FROM f WHERE y IS NOT NULL WINDOW s AS ({QW} ROWS UNBOUNDED PRECEDING))
    SELECT asset, date, alpha, beta, alpha + beta * x AS forecast FROM g WHERE rn >= 20""",
    "alpha beta forecast",
)
def k2_expanding_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = monthly(spark, sf_dir).select("asset", "date", (F.col("close") / 1000).alias("x"), S.forward("close", S.by("asset"), 3).alias("y"))
    return S.expanding_fit(m, "x", "y", ["asset"], "date").select("asset", "date", "alpha", "beta", "forecast")


@query(
    f"WITH c AS (SELECT asset, date, r, exp(sum(ln(1 + r)) OVER ({QW})) AS wealth FROM ({SQL_returns('l_suppkey', 'month')})) SELECT *, wealth / max(wealth) OVER ({QW}) - 1 AS drawdown FROM c",
    "r wealth drawdown",
)
def k8_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_curve(returns(spark, sf_dir, "l_suppkey", "month"), "r", ["asset"])


@query(
    f"""WITH r AS ({SQL_returns()}), p AS (SELECT a.date, a.r AS x, b.r AS y, year(a.date) % 2 AS part FROM r a JOIN r b USING (date) WHERE a.asset = 'A' AND b.asset = 'N')
    SELECT * FROM (SELECT date, part, CASE WHEN count(*) OVER w >= 30 THEN corr(x, y) OVER w END AS corr FROM p WINDOW w AS (PARTITION BY part ORDER BY date RANGE BETWEEN INTERVAL 364 DAYS PRECEDING AND CURRENT ROW)) WHERE corr IS NOT NULL""",
    "corr",
)
def k9_rolling_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = returns(spark, sf_dir)
    p = r.where("asset = 'A'").select("date", F.col("r").alias("x")).join(r.where("asset = 'N'").select("date", F.col("r").alias("y")), "date").withColumn("part", (F.year("date") % 2).cast("long"))
    return S.rolling_correlations(p, "x", "y", 365, ["part"], 30).select("date", "part", "corr").where("corr is not null")


@query(
    f"""WITH w AS (SELECT asset, date, close / sum(close) OVER (PARTITION BY date) AS w FROM ({M})), d AS (SELECT asset, date, abs(w - lag(w) OVER ({QW})) AS moved FROM w)
    SELECT date, sum(moved) / 2 AS turnover, 0.001 * coalesce(sum(moved) / 2, 0) AS cost FROM d GROUP BY 1""",
    "turnover cost",
)
def k10_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = monthly(spark, sf_dir).select("asset", "date", S.share("close", "date").alias("w"))
    return S.turnover(w, [])


@query(
    f"""WITH p AS (SELECT asset, date, close / 1000 AS x, dividends AS y FROM ({M})), d AS (SELECT asset, date, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM p WINDOW w AS (PARTITION BY asset ORDER BY date DESC))
    SELECT asset, date, abs(dx) + abs(dy) AS l1, sqrt(dx * dx + dy * dy) AS l2, CASE WHEN dx IS NOT NULL THEN greatest(abs(dx), abs(dy)) END AS max_jump FROM d""",
    "l1 l2 max_jump",
)
def k11_instability(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = monthly(spark, sf_dir).select("asset", "date", (F.col("close") / 1000).alias("x"), F.col("dividends").alias("y"))
    return S.instability(p, ["x", "y"], ["asset"], F.desc("date")).select("asset", "date", "l1", "l2", "max_jump")


@query(
    f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY close DESC, asset) AS best, row_number() OVER (PARTITION BY date ORDER BY close, asset DESC) AS worst, count(*) OVER (PARTITION BY date) AS n FROM ({M}))
    SELECT asset, date, close, (best <= greatest(1, ceil(n * 0.25))) AS top FROM f WHERE best <= 3 OR worst <= 3 OR best <= greatest(1, ceil(n * 0.25))""",
    "close",
)
def l1_l3_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = monthly(spark, sf_dir).withColumn("top", S.top_share("close", ["date"], "asset"))
    best = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("close"), "asset"))
    worst = F.row_number().over(Window.partitionBy("date").orderBy("close", F.desc("asset")))
    return m.withColumns({"best": best, "worst": worst}).where("best <= 3 or worst <= 3 or top").select("asset", "date", "close", "top")


@query(f"SELECT asset, max(date) AS last_date, arg_max(close, date) AS last_close, min(date) AS first_date, arg_min(close, date) AS first_close FROM ({D3.replace('l_returnflag', 'l_suppkey')}) GROUP BY 1", "last_close first_close")
def l8_l9_first_and_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = daily(spark, sf_dir, "l_suppkey")
    last = S.latest(px, ["asset"]).select("asset", F.col("date").alias("last_date"), F.col("close").alias("last_close"))
    first = S.first_rows(px, ["asset"], ["date"]).select("asset", F.col("date").alias("first_date"), F.col("close").alias("first_close"))
    return last.join(first, "asset")


@query(
    f"""WITH w AS (SELECT asset, date, close / sum(close) OVER (PARTITION BY date) AS w FROM ({D3})), s AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY w DESC, asset) AS n FROM w)
    SELECT date, string_agg(asset || ':' || printf('%.2f%%', w * 100), ' | ' ORDER BY n) AS positions FROM s WHERE n <= 5 GROUP BY 1"""
)
def l10_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.positions_text(daily(spark, sf_dir).select("asset", "date", S.share("close", "date").alias("w")), ["date"])


@query(
    f"""WITH px AS ({D3}), me AS (SELECT asset, CAST(date_trunc('month', date) AS DATE) AS m, max(date) AS date FROM px GROUP BY 1, 2), cal AS (SELECT DISTINCT m, max(date) OVER (PARTITION BY m) AS rebalance FROM me)
    SELECT rebalance, asset, count(*)::BIGINT AS n, avg(close) AS close FROM px JOIN cal ON date_trunc('month', px.date) = cal.m + INTERVAL 1 MONTH GROUP BY 1, 2""",
    "close",
)
def j7_next_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = daily(spark, sf_dir)
    cal = px.groupBy(F.trunc("date", "month").alias("m")).agg(F.max("date").alias("date")).drop("m")
    return J.next_period(cal, px).groupBy("rebalance", "asset").agg(F.count("*").alias("n"), F.avg("close").alias("close"))


@query(
    f"""WITH px AS (SELECT *, row_number() OVER ({QW}) AS pos FROM ({SQL_monthly()})), cal AS (SELECT pos, date AS rebalance, asset FROM px WHERE pos >= 12)
    SELECT cal.asset, rebalance, count(*)::BIGINT AS n, avg(px.close) AS mean, min(px.date) AS since FROM cal JOIN px ON px.asset = cal.asset AND px.pos BETWEEN cal.pos - 11 AND cal.pos GROUP BY 1, 2""",
    "mean",
)
def j8_trailing_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = monthly(spark, sf_dir).withColumn("pos", F.row_number().over(S.by("asset")).cast("long"))
    cal = px.where("pos >= 12").select("asset", "pos", F.col("date").alias("rebalance"))
    hit = J.trailing_rows(cal, px, 12, keys=["asset"])
    return hit.groupBy("asset", "rebalance").agg(F.count("*").alias("n"), F.avg("close").alias("mean"), F.min("date").alias("since"))


@query(
    """WITH c AS (SELECT c_nationkey AS k, sum(c_acctbal) AS bal, count(*)::DOUBLE AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, sum(s_acctbal) AS bal, max(s_acctbal) AS top FROM supplier GROUP BY 1)
    SELECT coalesce(c.k, s.k)::INT AS k, coalesce(c.bal, s.bal) AS balance, coalesce(s.top, c.bal) AS top, n FROM c FULL JOIN s ON c.k = s.k""",
    "balance top n",
)
def j6_u2_priority_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.sum("c_acctbal").alias("bal"), F.count("*").alias("n"))
    s = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.sum("s_acctbal").alias("bal"), F.max("s_acctbal").alias("top"))
    return J.by_priority([c, s], "k", {"balance": [(0, "bal"), (1, "bal")], "top": [(1, "top"), (0, "bal")], "n": [(0, "n")]})


@query(
    """WITH a AS (SELECT c_nationkey AS k, count(*) AS n, sum(c_acctbal) AS cap FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, avg(s_acctbal) AS erp FROM supplier GROUP BY 1)
    SELECT n_name AS country, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS country_key, n::BIGINT AS n, cap, coalesce(b.erp, 0) AS erp, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN a ON a.k = n_nationkey LEFT JOIN b ON b.k = n_nationkey WHERE n >= 3""",
    "cap erp",
)
def j1_j4_cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("cap"))
    b = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("erp"))
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = nation.join(a, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(b, F.col("n_nationkey") == F.col("s_nationkey"), "left").where("n >= 3")
    return out.select(F.col("n_name").alias("country"), C.country_key("n_name").alias("country_key"), "n", "cap", F.coalesce("erp", F.lit(0.0)).alias("erp"), F.col("r_name").alias("region"))


@query(
    """SELECT k::BIGINT AS k, coalesce(d.size, p.size, e.size) AS size, coalesce(l.quality, e.label) AS grade, coalesce(p.size, d.size) AS page, l.toxic AS toxic FROM (SELECT doc_id AS k, length(text)::DOUBLE AS size FROM documents) d
    FULL JOIN (SELECT doc_id AS k, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic FROM labels) l USING (k) FULL JOIN (SELECT vec_id AS k, len(embedding)::DOUBLE AS size, label::DOUBLE AS label FROM embeddings) e USING (k)
    FULL JOIN (SELECT page_id AS k, length(html)::DOUBLE AS size FROM pages) p USING (k)""",
    "size grade page toxic",
)
def u2_four_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four tables of different key sets; each field from the first of them that has a value."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.char_length("text").alias("size"))
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("k"), "quality", "toxic")
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), F.size("embedding").alias("size"), "label")
    p = read(spark, sf_dir, "pages").select(F.col("page_id").alias("k"), F.char_length("html").alias("size"))
    return J.by_priority([d, labels, e, p], "k", {"size": [(0, "size"), (3, "size"), (2, "size")], "grade": [(1, "quality"), (2, "label")], "page": [(3, "size"), (0, "size")], "toxic": [(1, "toxic")]})


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j14_u4_missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that have no label."""
    return J.missing_keys(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id")

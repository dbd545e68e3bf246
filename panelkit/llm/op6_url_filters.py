"""URL filters as a sort-merge range join.

A rule is a host and the beginning of a path. A host's canonical key has its labels reversed, each closed by a separator, so
a rule's host and all its subdomains are an interval of keys, and intervals are nested or apart. Starts and ends of the rules'
intervals and the keys of the urls are sorted together; a sweep over them keeps the stack of the rule hosts that are open (one
column for each depth of nesting), so every url learns from one sort which rule hosts are above it. A second sweep of the
same kind, over paths under each of those hosts, reads the rule off the top of its stack: paths that begin alike are
intervals, too. The longest of a url's hits wins.

Sweeps run in ranges of keys: the first two labels of the host. What is open where a range begins, the rules of one label,
is opened again in each range, and ranges with very many urls are dealt over salts together with their rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelkit.llm.common import staged, table

# The rules of the registered query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
HOT = 256


def rules_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join(f"({', '.join(map(quote, r))})" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(verdict, host, path)")


def _host_key(labels: Column) -> Column:
    """The labels in reverse order, each followed by a zero byte, so that a rule's key begins those of all its subdomains."""
    return F.encode(F.concat(F.array_join(F.reverse(labels), "\0"), F.lit("\0")), "utf-8")


def _labels(host: str) -> Column:
    return F.split(F.replace(F.col(host), F.lit("\0"), F.lit("\uffff")), r"\.")


def _range(labels: Column, n: int = 2) -> Column:
    return F.array_join(F.reverse(F.slice(F.concat(F.array_repeat(F.lit(None).cast("string"), n), labels), -n, n)), "\0")


def _events(rules: DataFrame) -> DataFrame:
    """The start and the end of each rule's interval: what lies between begins with its key (no UTF-8 text has a byte FF)."""
    return rules.withColumns({"kind": F.lit(0), "step": F.lit(1)}).unionByName(rules.withColumns({"kind": F.lit(0), "step": F.lit(-1), "key": F.concat("key", F.unhex(F.lit("FF")))}))


def _sweep(points: DataFrame, rules: DataFrame, within: str, deepest: int) -> DataFrame:
    """points (within, key, ...) with open: the array of found of all rules (within, key, found) whose keys begin theirs,
    outermost first; points under no rule are left out."""
    points = points.join(rules.select(within).distinct(), within, "left_semi")
    counts = staged(points.groupBy(within).count())
    total = counts.agg(F.sum("count")).first()[0] or 1
    salts = counts.withColumn("share", F.col("count") / total).where(F.col("share") > 1 / HOT).select(within, F.ceil(F.col("share") * 2 * HOT).cast("int").alias("salts"))
    salts = F.broadcast(staged(salts))  # fewer than HOT rows
    salted = lambda df, salt: df.join(salts, within, "left").withColumn("salt", salt(F.coalesce("salts", F.lit(1)))).drop("salts")
    events = salted(_events(rules), lambda n: F.explode(F.sequence(F.lit(0), n - 1)))
    points = salted(points, lambda n: F.pmod(F.xxhash64("page_id", "row"), n).cast("int")).withColumns({"kind": F.lit(1), "step": F.lit(0)})
    order = Window.partitionBy(within, "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.unionByName(points, allowMissingColumns=True).withColumn("depth", F.sum("step").over(order))
    stack = [F.last(F.when((F.col("step") == 1) & (F.col("depth") == d), F.col("found")), ignorenulls=True).over(order).alias(f"open{d}") for d in range(1, deepest + 1)]
    swept = swept.select("page_id", "row", "host", "path", "kind", "depth", *stack).where("kind = 1 and depth > 0")
    return swept.select("page_id", "row", "host", "path", F.slice(F.array(*(f"open{d}" for d in range(1, deepest + 1))), F.lit(1), F.col("depth").cast("int")).alias("open"))


def _deepest(rules: DataFrame, within: str) -> int:
    nested = Window.partitionBy(within).orderBy("key", F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    return _events(rules).select(F.sum("step").over(nested).alias("depth")).agg(F.max("depth")).first()[0] or 0


def judge_urls(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict: a row for each input row.

    rules: verdict, host, path. A rule fits its host and all subdomains if the url's path starts with its path; of several
    the longest (then the one with the longer host) wins, of equal ones with two verdicts "block". rule is null and the
    verdict `otherwise` where none fits. A null url, or one without ://, has an empty host and path and fits no rule but those
    for an empty host. Repeated rows are judged each by itself; null ids are allowed; rules with a null are skipped; urls are
    read whole, however long; other columns are ignored. A range or host that holds a notable share of all urls is spread
    over salts, and its rules with it.
    """
    part = lambda k: F.coalesce(F.regexp_extract(url_col, _URL, k), F.lit(""))
    urls = staged(
        pages.select(F.col(id_col).cast("long").alias("page_id"), F.monotonically_increasing_id().alias("row"), F.translate(part(1), _UPPER, _LOWER).alias("host"), part(2).alias("path"))
    )
    rules = rules.where("verdict is not null and host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    labels = _labels("host")
    rules = staged(rules.select("host", "path", "verdict", _host_key(labels).alias("host_key"), F.size(labels).alias("labels"), _range(labels).alias("range"), _range(labels, 1).alias("top")))

    keyed = urls.select("page_id", "row", "host", "path", _range(labels).alias("range"), _range(labels, 1).alias("top"), _host_key(labels).alias("key"))
    hosts = rules.select("range", "top", "labels", F.col("host_key").alias("key"), F.col("host_key").alias("found")).distinct()
    ranges = keyed.select("range", "top").distinct()  # a rule of one label is open at the beginning of every range under it
    carried = ranges.join(hosts.where("labels = 1").select("top", "key", "found"), "top").select("range", "key", "found")
    opened = staged(carried.union(hosts.where("labels > 1").select("range", "key", "found")))
    above = _sweep(keyed.drop("top"), opened, "range", _deepest(hosts.select("top", "key", "found"), "top"))

    under = above.select("page_id", "row", "host", "path", F.explode("open").alias("under"), F.encode("path", "utf-8").alias("key"))
    found = F.struct((F.char_length("host") + F.char_length("path")).alias("size"), F.char_length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict")
    paths = rules.select(F.col("host_key").alias("under"), F.encode("path", "utf-8").alias("key"), found.alias("found"))
    hits = _sweep(under, paths, "under", _deepest(paths, "under")).select("page_id", "row", "host", "path", F.element_at("open", -1).alias("found"))

    every = urls.select("page_id", "row", "host", "path", F.lit(None).cast(paths.schema["found"].dataType).alias("found"))
    best = every.unionByName(hits).groupBy("page_id", "row", "host", "path").agg(F.max("found").alias("found"))
    return best.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(otherwise)).alias("verdict"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rules_table(spark))


OP6_SQL = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), hit AS (
  SELECT p.page_id, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC) AS n
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT p.page_id, p.host, p.path, hit.rule, coalesce(hit.verdict, 'allow') AS verdict FROM p LEFT JOIN hit ON p.page_id = hit.page_id AND hit.n = 1
"""

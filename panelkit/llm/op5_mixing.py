"""Mixing sources by temperature.

Each source's share of the tokens is raised to an exponent and normalised. The exponent is found by bisection (sixty-four
points a round, each round one small job over the sources): the smallest at which the entropy is down to its target, or at which
repetitions are within their limit. Weights become token budgets, and budgets become rows: an epoch of a source is its
documents in a hashed order, cut into blocks of about a million tokens; whole epochs are taken whole, the last one up to the
block, and in it the document, where its budget ends. That end is one row per source, so documents are chosen where they
are read: no row is shuffled, and no source, however large, is sorted.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelkit.llm.common import clean_text, staged, table

BLOCK_TOKENS = 1_000_000
ROW = 4096  # blocks
NO_SOURCE = "\x00"


def _tokens(text_col: str) -> Column:
    """Words of the text, and one for its end."""
    return (F.regexp_count(clean_text(text_col), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def source_sizes(docs: DataFrame, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """source, size (tokens), share (of the largest source's size); a null source is one of its own."""
    sums = staged(docs.select(F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE)).alias("source"), _tokens(text_col).alias("tokens")).groupBy("source").agg(F.sum("tokens").alias("size")))
    total = sums.agg(F.max("size")).first()[0] or 1
    return sums.withColumn("share", F.col("size") / F.lit(float(total)))


def _measures(sizes: DataFrame, points: list[float], budget: float | None) -> list[tuple[float, float, float]]:
    """(exponent, entropy as a share of the largest possible, most repetitions) at each point; one job."""
    at = sizes.select("share", "size", F.explode(F.lit(points)).alias("exponent")).withColumn("raised", F.pow("share", "exponent"))
    sums = at.groupBy("exponent").agg(
        F.sum("raised").alias("z"), F.sum(F.col("raised") * F.log("share")).alias("s"), F.count("*").alias("n"),
        F.max(F.col("raised") / F.col("size")).alias("most"), F.max(F.when(F.col("raised") > 0, F.col("size") / F.col("raised")).otherwise(float("inf"))).alias("least"),
    )
    entropy = F.when(F.col("n") > 1, (F.log("z") - F.col("exponent") * F.col("s") / F.col("z")) / F.log("n")).otherwise(1.0)
    repeats = F.col("most") * (F.lit(float(budget)) / F.col("z") if budget else F.col("least"))
    return sorted((r[0], r[1], r[2]) for r in sums.select("exponent", entropy, repeats).collect())  # sixty-five rows


def find_exponent(sizes: DataFrame, target_entropy: float | None, max_repeats: float | None, budget: float | None, rounds: int = 4) -> tuple[float, bool]:
    """The exponent, and whether it reaches the target. Both entropy and repetitions fall as the exponent rises from 0 (all
    sources alike) to 1 (as they are) and on. Where 4 is not enough for an entropy the interval grows, to 256 at most; what
    no exponent reaches (equal sources keep the full entropy) is not reached, and the end of the interval is taken."""
    low, high = 0.0, 4.0 if target_entropy is not None else 1.0
    reached = (lambda e, r: e <= target_entropy + 1e-9) if target_entropy is not None else (lambda e, r: r <= max_repeats + 1e-9)
    if target_entropy is not None and not (ends := [x for x, e, r in _measures(sizes, [4.0, 16.0, 64.0, 256.0], budget) if reached(e, r)]):
        return high, False
    elif target_entropy is not None:
        high = min(ends)
    for _ in range(rounds):
        points = [low + (high - low) * k / 64 for k in range(65)]
        found = [x for x, e, r in _measures(sizes, points, budget) if reached(e, r)]
        if not found:
            return high, False
        high = min(found)
        low = max(low, high - (points[1] - points[0]))
    return high, True


def _key(epoch: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), epoch, F.col("mix_id"), F.col("mix_text"))


def _holding(parts: DataFrame, by: list[str], order: str, so_far: Column) -> DataFrame:
    """Of each source's parts in order, after so_far tokens, the one in which its rest ends; before: the tokens up to it."""
    before = so_far + F.sum("tokens").over(Window.partitionBy(*by).orderBy(order)) - F.col("tokens")
    return parts.withColumn("before", before).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("tokens") >= F.col("rest")))


def mix_plan(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None, seed: int = 7, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """source, size, weight, repeats, exponent, entropy, met, epochs, rest, blocks, last_block, last_key: a row for each source.

    With a target_entropy (share of the largest, 0 to 1) or a max_repeats, one of which is needed. budget: tokens of the
    whole mix; without one it is the least that takes every document of every source once. entropy is that of the weights,
    met whether they meet the target; where no exponent does, a warning says so, too.
    """
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give either target_entropy or max_repeats")
    sizes = source_sizes(docs, source_col, text_col)
    exponent, met = find_exponent(sizes, target_entropy, max_repeats, budget)
    if not met and not sizes.isEmpty():
        warnings.warn(f"no exponent meets target_entropy={target_entropy}, max_repeats={max_repeats}; {exponent} is taken", stacklevel=2)
    reached = next((e for x, e, _ in _measures(sizes, [exponent], budget)), None)
    raised = sizes.withColumn("raised", F.pow("share", F.lit(exponent)))
    z, least = raised.agg(F.sum("raised"), F.max(F.when(F.col("raised") > 0, F.col("size") / F.col("raised")).otherwise(float("inf")))).first()
    total = float(budget) if budget else float((least or 0) * (z or 0))
    if not total < 2**62:
        raise ValueError("a source's weight is next to nothing: taking all of it once needs a budget")
    plan = raised.withColumn("weight", F.col("raised") / F.lit(float(z or 1))).withColumn("repeats", F.col("weight") * total / F.col("size"))
    plan = plan.withColumns({"exponent": F.lit(exponent), "entropy": F.lit(reached).cast("double"), "met": F.lit(met)})
    plan = plan.withColumn("epochs", F.floor(F.col("repeats") + 1e-9).cast("int")).withColumn("blocks", F.ceil(F.col("size") / BLOCK_TOKENS).cast("long"))
    plan = staged(plan.withColumn("rest", F.round((F.col("repeats") - F.col("epochs")) * F.col("size")).cast("long")).drop("raised", "share"))

    rows = docs.select(F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE)).alias("source"), F.col(id_col).cast("long").alias("mix_id"), F.xxhash64(F.col(text_col)).alias("mix_text"), _tokens(text_col).alias("tokens"))
    last = rows.join(plan.where("rest > 0").select("source", "epochs", "blocks", "rest"), "source").withColumn("key", _key(F.col("epochs"), seed))
    last = staged(last.select("source", "rest", "tokens", "key", F.pmod("key", F.col("blocks")).alias("block")))
    by_block = staged(last.groupBy("source", "rest", "block").agg(F.sum("tokens").alias("tokens")))
    # first the run of ROW blocks in which the budget ends, then the block in it: no task numbers all blocks of a large source
    runs = by_block.groupBy("source", "rest", F.floor(F.col("block") / ROW).alias("run")).agg(F.sum("tokens").alias("tokens"))
    run = _holding(runs, ["source"], "run", F.lit(0)).select("source", "run", F.col("before").alias("so_far"))
    ends = _holding(by_block.withColumn("run", F.floor(F.col("block") / ROW)).join(run, ["source", "run"]), ["source", "so_far"], "block", F.col("so_far")).select("source", "block", "before")
    inside = F.sum("tokens").over(Window.partitionBy("source", "block").orderBy("key").rangeBetween(Window.unboundedPreceding, 0))
    # the end of the budget lies in one block of a source; the row where the sum is nearest to it is the last
    cut = last.join(ends, ["source", "block"]).withColumn("sum", inside + F.col("before")).where(F.col("sum") - F.col("tokens") / 2 <= F.col("rest"))
    cut = cut.groupBy("source", "block").agg(F.max("key").alias("last_key"))
    ends = ends.join(cut, ["source", "block"], "left").select("source", F.col("block").alias("last_block"), "last_key")
    return staged(plan.join(ends, "source", "left"))


def realise(docs: DataFrame, plan: DataFrame, seed: int = 7, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix as rows (doc, source, epoch, block, position): doc has all columns of a row of docs.

    position, 0 to 1, orders each source's part; sorted by it, every stretch of the mix has about the target weights.
    """
    rows = docs.select(F.struct("*").alias("doc"))
    rows = rows.select("doc", F.coalesce(F.col(f"doc.{source_col}").cast("string"), F.lit(NO_SOURCE)).alias("source"), F.col(f"doc.{id_col}").cast("long").alias("mix_id"), F.xxhash64(F.col(f"doc.{text_col}")).alias("mix_text"))
    rows = rows.join(plan.select("source", "repeats", "epochs", "blocks", "last_block", "last_key"), "source")  # one row a source: Spark broadcasts it by its size, and splits large sources if it can't
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs")))).withColumn("key", _key(F.col("epoch"), seed)).withColumn("block", F.pmod("key", F.col("blocks")))
    taken = (F.col("epoch") < F.col("epochs")) | (F.col("block") < F.col("last_block")) | ((F.col("block") == F.col("last_block")) & (F.col("key") <= F.col("last_key")))
    within = (F.shiftright("key", 40) + (1 << 23)) / F.lit(float(1 << 24))  # rises with the signed key
    position = (F.col("epoch") + (F.col("block") + within) / F.col("blocks")) / F.greatest(F.col("repeats"), F.lit(1e-9))
    return rows.where(taken).select("doc", "source", "epoch", "block", F.least(position, F.lit(1.0)).alias("position"))


def mix_sources(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None, seed: int = 7) -> DataFrame:
    """The columns of docs, for the documents that the mix takes, as often as it takes them.

    Null sources are one source; null and empty texts weigh one token (their end); null ids are allowed. Repeated rows are
    taken or left together. An empty table stays empty. Columns of any other names are kept as they are.
    """
    plan = mix_plan(docs, target_entropy, max_repeats, budget, seed)
    mixed = realise(docs, plan, seed)
    return mixed.select([F.col("doc").getField(c).alias(c) for c in docs.columns])


def op5_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of documents at 95 % of the largest entropy, with as many tokens as they have: one row for each document taken."""
    docs = table(spark, sf_dir, "documents")
    total = docs.select(_tokens("text").alias("t")).agg(F.sum("t")).first()[0] or 0
    plan = mix_plan(docs, target_entropy=0.95, budget=total)
    mixed = realise(docs, plan)
    return mixed.select("doc.doc_id", "doc.source", _tokens("doc.text").alias("tokens"), "epoch", "block", "position")

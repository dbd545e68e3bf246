"""Document fingerprints by threshold-scaled sketches.

A document's sketch is every hash of its five-word shingles that lies under a fixed fraction of the hash range. Sketches of
different documents are samples by the same rule, whatever the documents' lengths: their union is the sketch of the joined
texts, and the share of one in the other estimates containment, also between a page and a book. A short text may have an
empty sketch: nothing is known of it then, and its containment in another is estimated as 0.

Each document is compared with its edited text and with the next document by descending id. "Next" needs an order over the
whole table, not one task: ids fall into ranges by approximate quantiles, and these into steps of equal width, as many as
their rows ask for. Each step is ordered by itself; the head of the following step, or of the following range, completes it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelkit.llm.common import NOT_WORD, clean_text, staged, table

WORDS, FRACTION_BITS, STEP_ROWS, RANGES = 5, 2, 2_000, 1024


def word_hashes(text: str | Column) -> Column:
    return F.transform(F.filter(F.split(text, NOT_WORD), lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle_hashes(words: str) -> Column:
    """Hashes of the shingles of a column of word hashes. With fewer words than a shingle has, the whole sequence is one."""
    n = F.size(words)
    shingle = lambda _, i: F.xxhash64(*(F.get(F.col(words), i + k) for k in range(WORDS)))
    runs = F.transform(F.slice(words, F.lit(1), F.greatest(n - (WORDS - 1), F.lit(0))), shingle)
    return F.when(n >= WORDS, runs).when(n > 0, F.array(F.xxhash64(F.col(words)))).otherwise(F.lit([]).cast("array<bigint>"))


def keep(shingles: str) -> Column:
    """Sorted distinct hashes under the threshold, and nothing else: the sketch of joined texts is the union of theirs."""
    return F.array_sort(F.array_distinct(F.filter(shingles, lambda h: F.shiftrightunsigned(h, 64 - FRACTION_BITS) == 0)))


def with_sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the column out. In steps, so that no lambda computes again what stands outside it."""
    df = df.withColumn(f"{out}_words", word_hashes(text))
    df = df.withColumn(f"{out}_shingles", shingle_hashes(f"{out}_words")).drop(f"{out}_words")
    return df.withColumn(out, keep(f"{out}_shingles")).drop(f"{out}_shingles")


def containment(a: str, b: str) -> Column:
    """Estimated share of the smaller sketch's document in the other: 0 to 1; 0 if a sketch is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def as_text(hashes: str) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def id_ranges(docs: DataFrame) -> np.ndarray:
    """Bounds of ranges of ids with about as many rows each, by approximate quantiles: RANGES at most, of STEP_ROWS at least."""
    n = docs.where("doc_id is not null").count()
    ranges = min(RANGES, -(-n // STEP_ROWS))
    if ranges < 2:
        return np.zeros(0, np.int64)
    found = docs.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0]
    return np.unique(np.array(found, np.int64))


def range_of(col: str, bounds: np.ndarray) -> Column:
    """How many bounds are at most the value: counted in blocks of 64, then in one block. A null is in range -1."""
    count = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col(col)))
    found = F.lit(0)
    if 0 < len(bounds) <= 64:
        found = count(F.lit(bounds))
    elif len(bounds):
        block = count(F.lit(bounds[63::64]))
        found = block * 64 + count(F.slice(F.lit(bounds), block * 64 + 1, F.lit(64)))
    return F.when(F.col(col).isNull(), F.lit(-1)).otherwise(found)


def with_steps(docs: DataFrame, bounds: np.ndarray) -> DataFrame:
    """docs (doc_id, tie) with part and step. Both rise with the id, within range -1 (null ids) with the tie; a range has a
    step for every STEP_ROWS of its rows, or for a millionth of all rows where that is more."""
    docs = docs.withColumn("part", range_of("doc_id", bounds)).withColumn("place", F.when(F.col("doc_id").isNull(), F.shiftright("tie", 2)).otherwise(F.shiftright("doc_id", 2)))
    spans = staged(docs.groupBy("part").agg(F.min("place").alias("low"), F.max("place").alias("high"), F.count("*").alias("n")))
    each = max(STEP_ROWS, (spans.agg(F.sum("n")).first()[0] or 0) >> 20)
    spans = spans.withColumn("steps", F.ceil(F.col("n") / each)).drop("n")
    docs = docs.join(F.broadcast(spans), "part")  # a row for each range: RANGES + 1 at most
    width = (F.col("high") - F.col("low")) / F.col("steps") + 1
    return docs.withColumn("step", F.floor((F.col("place") - F.col("low")) / width)).drop("low", "high", "steps", "place")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_text, sketch, edited_sketch, next_sketch: one row for each input row.

    The edited text has the last third of the code points (rounded down) replaced by the first as many, or all, of the next
    document by descending id; after the last comes the first, and a single document follows itself. Rows with equal ids
    are ordered by a hash of their texts; null ids come last. Null texts count as empty ones, whose sketch is empty. Other
    columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), clean_text(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    docs = with_steps(docs, id_ranges(docs))
    order = [F.desc_nulls_last("doc_id"), F.desc("tie")]

    # the first row of each step: by id and tie only, then its text, which joins the rows that it follows
    rank = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id"), F.col("tie"))
    heads = staged(docs.groupBy("part", "step").agg(F.max(rank).alias("r")))
    below = Window.partitionBy("part").orderBy(F.desc("step"))  # a part's steps: a row for every STEP_ROWS of its rows
    tops = staged(heads.groupBy("part").agg(F.max("step").alias("top")))
    by_part = Window.orderBy(F.desc("part"))  # over a row for each range
    after = F.coalesce(F.lead(F.struct("part", "top")).over(by_part), F.first(F.struct("part", "top")).over(by_part))
    following = staged(tops.select("part", after.alias("after")))
    last = heads.select("part", "step", F.lead("step").over(below).alias("lower")).join(F.broadcast(following), "part")  # a row for each range
    next_of = staged(last.select("part", "step", F.when(F.col("lower").isNotNull(), F.col("part")).otherwise(F.col("after.part")).alias("next_part"), F.coalesce("lower", "after.top").alias("next_step")))
    texts = docs.join(F.broadcast(heads), ["part", "step"]).where("doc_id <=> r.doc_id and tie = r.tie").groupBy("part", "step").agg(F.min("text").alias("head_text"))  # a row for each step: about a million at most
    texts = staged(with_sketch(texts, "head_text", "head_sketch"))
    follow = next_of.join(texts.withColumnsRenamed({"part": "next_part", "step": "next_step"}), ["next_part", "next_step"]).select("part", "step", "head_text", "head_sketch")

    within = Window.partitionBy("part", "step").orderBy(*order)
    rows = docs.join(follow, ["part", "step"]).withColumn("next_text", F.coalesce(F.lead("text").over(within), F.col("head_text"))).drop("head_text")
    rows = with_sketch(rows, "text", "sketch")
    rows = rows.withColumn("next_sketch", F.coalesce(F.lead("sketch").over(within), F.col("head_sketch"))).drop("head_sketch")
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited_text"), "sketch", "next_sketch")
    return with_sketch(rows, "edited_text", "edited_sketch")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprint(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), as_text("sketch").alias("fingerprint"), as_text("edited_sketch").alias("edited_fingerprint"),
        containment("sketch", "edited_sketch").alias("near_edited"), containment("sketch", "next_sketch").alias("near_next"),
    )

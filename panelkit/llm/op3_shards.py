"""Shards by vector bin packing: bytes, tokens and rows balanced together.

Groups of equal texts go to one shard. What is packed is a bounded list of items, whatever the corpus: groups that hold a
notable share of anything are items of their own, one that is larger than a shard is cut into as few equal parts as fit, and
all others are collected by hash into a fixed number of units. Items go, largest first, to the shard where the dot product of
their demand with what is left of each capacity is highest, and exchanges level out what is left uneven in any dimension.
Shares decide at every size, so a small corpus is packed group by group and a large one mostly by units.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelkit.llm.common import clean_text, staged, table

UNITS, PIECES = 256, 1024
DIMENSIONS = ("size", "tokens", "rows")
ROOM = 0.9  # of a shard that a part of a split group fills at most: the rest is for what evens out the other dimensions
#: The law is that of bytes: they weigh more than the others, and much more where they are uneven by over a hundredth still.
WEIGHTS, BYTES_FIRST = np.array([3.0, 1.0, 1.0]), np.array([16.0, 1.0, 1.0])


def pack(demand: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item. demand: items x dimensions, as shares of the totals."""
    left = np.full((shards, demand.shape[1]), 1 / shards)
    out = np.zeros(len(demand), np.int32)
    for i in np.lexsort((np.arange(len(demand)), -demand.max(axis=1))) if len(demand) else ():
        need = demand[i]
        fits = (left >= need).all(axis=1)
        # where it fits, the highest dot product; nowhere: where the tightest dimension is exceeded least
        score = np.where(fits, left @ need, -np.inf) if fits.any() else (left - need).min(axis=1)
        out[i] = best = int(score.argmax())
        left[best] -= need
    return out


def level(demand: np.ndarray, shard: np.ndarray, shards: int, rounds: int = 1000, within: float = 1e-3) -> np.ndarray:
    """Exchanges between the fullest and the emptiest shard of a dimension, until all dimensions are within a thousandth.

    An item moves alone or for another. Of those whose difference is nearest to half of the gap, the exchange that leaves
    the two shards least uneven, in all dimensions together, is made, if that is better than none; the most uneven
    dimension in which there is such an exchange comes first.
    """
    shard = shard.copy()
    for _ in range(rounds):
        total = np.stack([np.bincount(shard, d, shards) for d in demand.T], 1)
        spread = np.ptp(total, axis=0) * shards
        if not any(_exchange(demand, shard, total, d) for d in np.argsort(-spread, kind="stable") if spread[d] > within):
            break
    return shard


def _exchange(demand: np.ndarray, shard: np.ndarray, total: np.ndarray, d: int) -> bool:
    """Makes the best exchange between the two shards furthest apart in dimension d, if it is better than none."""
    high, low = int(total[:, d].argmax()), int(total[:, d].argmin())
    gap = total[high] - total[low]
    own, other = np.flatnonzero(shard == high), np.append(-1, np.flatnonzero(shard == low))
    given = np.concatenate([np.zeros((1, demand.shape[1])), demand[other[1:]]])
    order = np.argsort(given[:, d], kind="stable")
    at = np.searchsorted(given[order, d], demand[own, d] - gap[d] / 2)
    near = order[np.clip(at[:, None] + np.arange(-4, 5), 0, len(order) - 1)]
    left = ((gap - 2 * (demand[own][:, None] - given[near])) ** 2).sum(2)
    i, k = np.unravel_index(int(left.argmin()), left.shape)
    if left[i, k] >= (gap**2).sum() * (1 - 1e-9):
        return False
    shard[own[i]] = low
    if other[near[i, k]] >= 0:
        shard[other[near[i, k]]] = high
    return True


def parts_of(group: np.ndarray, demand: np.ndarray, shards: int) -> np.ndarray:
    """The part of each piece: a group's pieces go, largest first, to the emptiest of as few parts as each fit a shard with ROOM."""
    out = np.zeros(len(group), np.int64)
    for g in np.unique(group):
        own = np.flatnonzero(group == g)
        loads = np.zeros(max(1, math.ceil(demand[own].sum(0).max() * shards / ROOM - 1e-9)))
        for i in own[np.lexsort((own, -demand[own].max(1)))]:
            out[i] = loads.argmin()
            loads[out[i]] += demand[i].max()
    return out


def _facts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = clean_text("text")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    size = (F.octet_length(text) + 8).cast("long")
    return docs.select(
        "doc_id", "row", size.alias("size"), F.crc32(text).alias("text_crc32"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
        F.xxhash64(text, F.octet_length(text)).alias("text_group"), F.pmod(F.xxhash64("doc_id"), F.lit(PIECES)).cast("int").alias("piece"),
    )


def placement(facts: DataFrame, shards: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shards of the pieces of split groups, of large groups, and of units: three tables of bounded size."""
    spark = facts.sparkSession
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows")]
    facts = facts.withColumn("rows", F.lit(1))
    groups = staged(facts.groupBy("text_group").agg(*sums))
    total = groups.agg(*sums).first()
    shares = [F.col(d) / max(1, total[d] or 0) for d in DIMENSIONS]
    groups = groups.withColumn("share", F.greatest(*shares))
    units = shards * UNITS
    split = staged(groups.where(F.col("share") > 1 / shards).select("text_group"))  # fewer than 3 * shards rows
    pieces = facts.join(F.broadcast(split), "text_group").groupBy("text_group", "piece").agg(*sums)  # PIECES for each
    own = groups.where((F.col("share") <= 1 / shards) & (F.col("share") >= 1 / units)).select("text_group", *DIMENSIONS)  # at most 3 * units rows
    light = groups.where(F.col("share") < 1 / units).groupBy(F.pmod("text_group", F.lit(units)).alias("unit")).agg(*sums)
    keys = [("text_group", "piece"), ("text_group",), ("unit",)]
    found = [t.sort_by([(k, "ascending") for k in names]) for t, names in zip((p.toArrow() for p in (pieces, own, light)), keys)]
    demand = [np.stack([t[d].to_numpy().astype(float) / max(1, total[d] or 0) for d in DIMENSIONS], 1) for t in found]
    part = np.unique(np.stack([found[0]["text_group"].to_numpy(), parts_of(found[0]["text_group"].to_numpy(), demand[0], shards)]), axis=1, return_inverse=True)[1].reshape(-1)
    cut = np.stack([np.bincount(part, d) for d in demand[0].T], 1) if len(part) else demand[0]
    items = np.concatenate([cut, *demand[1:]])
    shard = level(items * WEIGHTS, pack(items, shards), shards) if len(items) else np.zeros(0, np.int32)
    if len(items) and np.ptp(np.bincount(shard, items[:, 0], shards)) * shards > 0.01:
        shard = level(items * BYTES_FIRST, shard, shards)
    of = [shard[: len(cut)][part], *np.split(shard[len(cut) :], [len(demand[1])])]
    return tuple(spark.createDataFrame(t.select(list(names)).append_column("shard", pa.array(x, pa.int32()))) for t, names, x in zip(found, keys, of))


def _placed(facts: DataFrame, shards: int, places: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    pieces, groups, units = (p.withColumnRenamed("shard", f"shard{i}") for i, p in enumerate(places))
    found = facts.withColumn("unit", F.pmod("text_group", F.lit(shards * UNITS)))
    found = found.join(F.broadcast(pieces), ["text_group", "piece"], "left").join(F.broadcast(groups), "text_group", "left").join(F.broadcast(units), "unit", "left")  # all of bounded size
    return found.withColumn("shard", F.coalesce("shard0", "shard1", "shard2")).drop("shard0", "shard1", "shard2", "unit")


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", rows_a_block: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, tokens, shard, slot: a row for each input row.

    size is the text's UTF-8 bytes and 8 more; a null text has none. slot counts a shard's rows from 0 without gaps, in
    blocks by a hash of the id and by id within them, so no task numbers a whole shard. Equal texts share a shard; a group
    larger than one shard has the fewest that hold it in equal parts of nine tenths of a shard at most. Texts are read whole. Repeated rows are rows like others; null ids are allowed. Other columns are
    ignored; an empty table gives no rows.
    """
    facts = staged(_facts(docs, id_col, text_col))
    placed = _placed(facts, shards, placement(facts, shards))
    blocks = max(4, facts.count() // (shards * rows_a_block))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc_id", "row"), F.lit(blocks)))
    sizes = placed.groupBy("shard", "block").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "row")) - 1
    numbered = placed.withColumn("inside", inside).join(sizes.select("shard", "block", before.alias("before")), ["shard", "block"])
    return numbered.select("doc_id", "size", "text_crc32", "tokens", "shard", (F.col("before") + F.col("inside")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes every row of docs as column doc, whatever its columns are called, to the folder shard=N of its shard."""
    facts = staged(_facts(docs, id_col, text_col))
    places = placement(facts, shards)
    whole = docs.select(F.struct("*").alias("doc"))
    text = clean_text(F.col(f"doc.{text_col}"))
    keyed = whole.select("doc", F.xxhash64(text, F.octet_length(text)).alias("text_group"), F.pmod(F.xxhash64(F.col(f"doc.{id_col}").cast("long")), F.lit(PIECES)).cast("int").alias("piece"))
    _placed(keyed, shards, places).select("doc", "shard").write.partitionBy("shard").parquet(path)


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")

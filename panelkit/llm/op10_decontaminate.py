"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of what they join.

1. The items' runs of four words are the seeds; of a shorter item all its words, which whole documents only may equal. A
   bitmap of fixed size tells the tasks which runs of a document may be one.
2. One pass cuts a passage around each cluster of seeds, with room for the longest item on both sides. No seed is left out
   for being frequent. Equal passages are one from here on, so what very many documents repeat is aligned once.
3. A join on the seed gives pairs of passage and item, each once. A pair goes on if the passage has as many of the item's
   words as the score has to be, which no alignment can do without.
4. Words of passage and item are aligned locally (match 1, mismatch -1, gap -1). The alignment's score decides, so copies
   with words replaced, dropped, added or put in between are found, too. A join gives the documents of each passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import kernels as K
from panelkit.llm.common import bitmap, clean_text, has_bit, staged, table, text_tie, without

SEED, BITS = 4, 24
#: Words are runs of letters and digits here, so punctuation and case don't hide a copy.
_PLAIN = np.array([b if b > 127 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


def _words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, _, _, first = K.words(_PLAIN[raw], bounds, fold=True)
    return codes, first


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def item_words(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, words: hashes of each item's words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, raw, bounds in K.slices(batch.column("text")):
                codes, first = _words(raw, bounds)
                yield pa.RecordBatch.from_arrays([batch.column("item_id")[start:end], pa.ListArray.from_arrays(pa.array(first, pa.int32()), _long(codes))], ["item_id", "words"])

    return benchmark.select(F.col(id_col).cast("long").alias("item_id"), clean_text(text_col).alias("text")).mapInArrow(read, "item_id long, words array<long>")


def item_seeds(items: DataFrame) -> DataFrame:
    """item_id, seed: the runs of four words of each item, each once; of a shorter one all its words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = [K.shingles(w.values.to_numpy().view(np.uint64), SEED).view(np.int64) for w in batch.column("words")]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(seeds, pa.list_(pa.int64()))], ["item_id", "seeds"])

    return items.mapInArrow(read, "item_id long, seeds array<long>").select("item_id", F.explode("seeds").alias("seed"))


def _may_be(seeds: DataFrame) -> np.ndarray:
    """Bitmap of the top bits of the seeds: 2 MB, however many there are."""
    return bitmap(seeds.select(F.shiftrightunsigned("seed", 64 - BITS).alias("cell")), BITS)


def _hits(batch: pa.RecordBatch, cells: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Row of the batch, its words, and position and hash of the runs that may be seeds; of a document of fewer words than a
    seed has, all its words are the one run."""
    for start, end, raw, bounds in K.slices(batch.column("text")):
        codes, first = _words(raw, bounds)
        count = np.diff(first)
        for r in np.flatnonzero((count > 0) & (count < SEED)).tolist():
            whole = K.runs(codes[first[r] : first[r + 1]], int(count[r]))
            if has_bit(cells, whole >> np.uint64(64 - BITS))[0]:
                yield start + r, codes[first[r] : first[r + 1]], np.zeros(1, np.int64), whole
        runs = K.runs(codes, SEED)
        hit = np.flatnonzero(has_bit(cells, runs >> np.uint64(64 - BITS)))
        row = np.searchsorted(first, hit, "right") - 1
        ok = hit + SEED <= first[row + 1]
        hit, row = hit[ok], row[ok]
        for r in np.unique(row):
            own = hit[np.searchsorted(row, r) : np.searchsorted(row, r, "right")]
            yield start + int(r), codes[first[r] : first[r + 1]], own - first[r], runs[own]


def passages(docs: DataFrame, seeds: DataFrame, reach: int) -> DataFrame:
    """doc_id, row, tie, start, passage, words, seeds: clusters of seeds with reach words around them; passage is a hash of words,
    and seeds follow from words."""
    cells = docs.sparkSession.sparkContext.broadcast(_may_be(seeds))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r, codes, at, runs in _hits(batch, cells.value):
                for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 2 * reach) + 1):
                    a, b = max(0, int(at[part[0]]) - reach), min(len(codes), int(at[part[-1]]) + SEED + reach)
                    words = codes[a:b].view(np.int64)
                    out.append((*(batch.column(c)[r].as_py() for c in ("doc_id", "row", "tie")), a, hashlib.blake2b(words.tobytes(), digest_size=16).digest(), words, np.unique(runs[part]).view(np.int64)))
            types = (*[pa.int64()] * 4, pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 7, types)], ["doc_id", "row", "tie", "start", "passage", "words", "seeds"])

    return docs.mapInArrow(cut, "doc_id long, row long, tie long, start long, passage binary, words array<long>, seeds array<long>")


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local score and the passage position after its last word. A row at a time: a gap along the row is a running maximum."""
    ramp = np.arange(len(passage) + 1)
    above, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for word in item:
        here = np.maximum(0, above - 1)
        np.maximum(here[1:], above[:-1] + np.where(passage == word, 1, -1), out=here[1:])
        here = np.maximum.accumulate(here + ramp) - ramp
        if (top := int(here.max())) > best:
            best, end = top, int(here.argmax())
        above = here
    return best, end


def least_score(n_words: int) -> int:
    """Half of a short item's words, but six or all of them; thirteen of a long one's."""
    return min(13, max(min(6, n_words), (n_words + 1) // 2))


def _leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """What `find_leaks` returns, and tie, of docs (doc_id, row, tie, text)."""
    items = staged(item_words(benchmark).withColumn("item", F.monotonically_increasing_id()))
    by_row = items.select(F.col("item").alias("item_id"), "words")
    seeds = staged(item_seeds(by_row).withColumnRenamed("item_id", "item"))
    reach = items.agg(F.max(F.size("words"))).first()[0] or 0
    found = staged(passages(docs, seeds, reach))
    each = staged(found.groupBy("passage").agg(F.first("words").alias("words"), F.first("seeds").alias("seeds")))
    pairs = each.select("passage", F.explode("seeds").alias("seed")).join(seeds, "seed").select("passage", "item").distinct()
    both = pairs.join(each.drop("seeds"), "passage").join(items.withColumnRenamed("words", "item_words"), "item")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, (item, passage) in enumerate(zip(batch.column("item_words"), batch.column("words"))):
                item, passage = item.values.to_numpy(), passage.values.to_numpy()
                if np.isin(passage, item).sum() < least_score(len(item)):
                    continue
                best, end = align(item, passage)
                if best >= least_score(len(item)):
                    _, back = align(item[::-1], passage[:end][::-1])
                    out.append((i, best, best / len(item), end - back, end))
            i, best, share, a, b = zip(*out) if out else [()] * 5
            kept = batch.select(["passage", "item", "item_id"]).take(pa.array(i, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(best, pa.int64()), pa.array(share, pa.float64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], [*kept.schema.names, "score", "likeness", "a", "b"])

    schema = "passage binary, item long, item_id long, score long, likeness double, a long, b long"
    scored = staged(both.select("passage", "item", "item_id", "words", "item_words").mapInArrow(score, schema))
    hits = found.select("doc_id", "row", "tie", "start", "passage").join(scored, "passage")
    best = hits.groupBy("doc_id", "tie", "row", "item").agg(F.max(F.struct("score", (-F.col("start")).alias("early"), "item_id", "likeness", (F.col("start") + F.col("a")).alias("start_word"), (F.col("start") + F.col("b")).alias("end_word"))).alias("x"))
    return best.select("doc_id", "row", "tie", "x.item_id", "x.score", "x.likeness", "x.start_word", "x.end_word")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, item_id, score, likeness, start_word, end_word: the best alignment of each document and item that it copies.

    likeness is the score as a share of the item's words, start_word and end_word the aligned words of the document. A
    document copies an item if the score is at least half the item's words and six (of an item of fewer words, all of them),
    or thirteen. An item of fewer than four words is copied by documents that have these words and no others. Null and empty
    texts hold nothing; repeated rows and items are found each by itself (row tells repeated rows apart); null ids stay. An
    empty benchmark gives no rows. Texts are searched whole, however long. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_tie(text_col).alias("tie"), clean_text(text_col).alias("text"))
    return _leaks(docs, benchmark).drop("tie")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, as they are, that copy no item. Every row is judged by its own text, whatever its id: null and
    repeated ids make no difference, and repeated rows go or stay together."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("row"), text_tie(text_col).alias("tie"), clean_text(text_col).alias("text"))
    # rows equal in id and text are one here, so no row number has to last from one read to the next
    return without(docs, _leaks(own, benchmark).select("doc_id", "tie").distinct(), None, id_col, text_col)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")

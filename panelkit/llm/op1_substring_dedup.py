"""Substring deduplication: a count-min prefilter, then exact groups of the windows that it can't rule out.

Pass 1. Every window of 50 words has a minimiser: the smallest hash among its runs of ten words. Equal windows have equal
minimisers, so the number of documents with a minimiser overestimates the number of those with the window. Tasks count
minimisers into the cells of a count-min sketch (sparse: only cells in use are sent), Spark sums the partitions' cells,
and a bitmap of the cells with a count of two or more returns to the tasks. Its size is bounded by `max_bits`.

Pass 2. A window whose minimiser has a count under two in any row of the sketch starts in one document only and is
skipped. The others, as 96-bit hashes with document and position, are grouped exactly: the smallest doc_id of each is a
partial aggregate (a window that a third of the documents share leaves each task as one row), and a join, whose skewed
partitions Spark splits, marks the windows of later documents. Texts of documents with marks meet them in a join; the
others, as a bitmap of the marked ids tells, are never shuffled.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import kernels as K
from panelkit.llm.common import ID_BITS, bitmap, clean_text, has_bit, id_cell, id_cells, staged, table

GRAM, ROWS = 10, 2


def _windows(codes: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position in the row and index among all words of each window that lies in one row."""
    count = np.maximum(0, np.diff(first) - window + 1)
    row = np.repeat(np.arange(len(count)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return row, at, first[row] + at


def _cells(key: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The key's cell in each row of the sketch."""
    for r in range(ROWS):
        yield (K.mix(key + np.uint64(r * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(64 - bits)) + np.uint64(r << bits)


def _minimisers(codes: np.ndarray, index: np.ndarray, window: int) -> np.ndarray:
    gram = min(GRAM, window)
    return K.sliding_min(K.runs(codes, gram), window - gram + 1)[index] if len(index) else np.zeros(0, np.uint64)


def sketch_bits(docs: DataFrame, text_col: str, max_bits: int) -> int:
    """Cells for about ten times the minimisers to come: one in some hundred bytes of text, rounded up to a power of 2."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return min(max_bits, max(16, int(size // 10).bit_length()))


def repeated_cells(docs: DataFrame, window: int, bits: int) -> np.ndarray:
    """Bitmap of the sketch's cells that count two documents or more. docs: doc_id, text without nulls."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, bounds in K.slices(batch.column("text")):
                codes, _, _, first = K.words(raw, bounds)
                row, _, index = _windows(codes, first, window)
                key = _minimisers(codes, index, window)
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                for cells in _cells(key[new], bits):
                    cell, n = np.unique(cells, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(n)], ["cell", "n"])

    sums = docs.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return bitmap(sums.where("n >= 2").select("cell"), bits + (ROWS - 1).bit_length())


def estimated_repeats(docs: DataFrame, window: int, bits: int, cells: np.ndarray) -> DataFrame:
    """hash1, hash2, doc_id, at: the windows that the sketch holds for repeated."""
    shared = docs.sparkSession.sparkContext.broadcast(cells)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for start, end, raw, bounds in K.slices(batch.column("text")):
                codes, _, _, first = K.words(raw, bounds)
                row, at, index = _windows(codes, first, window)
                key = _minimisers(codes, index, window)
                keep = np.ones(len(key), bool)
                for c in _cells(key, bits):
                    keep &= has_bit(shared.value, c)
                at, index, row = at[keep], index[keep], row[keep]
                if len(index):
                    one, two = K.runs(codes, window)[index], K.runs(codes, window, second=True)[index] >> np.uint64(32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(one.view(np.int64)), pa.array(two.astype(np.uint32).view(np.int32)), pa.array(ids[start:end][row]), pa.array(at.astype(np.int32))],
                        ["hash1", "hash2", "doc_id", "at"],
                    )

    return docs.where("doc_id is not null").mapInArrow(find, "hash1 long, hash2 int, doc_id long, at int")


def dedup_substrings(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 30) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: each document without the words that a repeated window covers.

    A window is `window` consecutive words; it is repeated if its words also start in a document with a smaller id. The
    windows of the input decide, not those of what is left. kept_text has the other words, joined by single spaces.

    Null and empty texts: no words, nothing removed. A null id is never smaller and loses nothing. Rows with equal ids
    are one document in several rows: they don't remove each other, and positions removed from one are removed from all
    (repeated rows thus stay alike). Other columns are ignored. max_bits bounds the sketch: 2 ** max_bits cells a row,
    one bit each when it is sent to the tasks; a fuller sketch rules out less and loses nothing.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), clean_text(text_col).alias("text"))
    bits = sketch_bits(docs, "text", max_bits)
    repeats = estimated_repeats(docs, window, bits, repeated_cells(docs, window, bits))
    first = repeats.groupBy("hash1", "hash2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    # written, so that both sides of the join are plain exchanges, of which Spark splits large partitions
    marks = staged(
        repeats.join(staged(first), ["hash1", "hash2"]).where("doc_id > first").groupBy("doc_id").agg(F.collect_set("at").alias("marks"))
    )
    marked = docs.sparkSession.sparkContext.broadcast(bitmap(marks.mapInArrow(id_cells, "cell long"), ID_BITS))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, marks in zip(batch.column("text"), batch.column("marks")):
                found = text.as_buffer().to_pybytes().split()
                total.append(len(found))
                gone = 0
                if marks.is_valid:
                    at = marks.values.to_numpy()
                    edge = np.zeros(len(found) + window + 1, np.int32)
                    at = at[at < len(found)]
                    edge[at] += 1
                    edge[at + window] -= 1
                    keep = np.cumsum(edge[: len(found)]) == 0
                    gone = len(found) - int(keep.sum())
                    found = itertools.compress(found, keep.tolist())
                removed.append(gone)
                kept.append(b" ".join(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), K.strings(kept)],
                ["doc_id", "n_words", "n_removed", "kept_text"],
            )

    def part(batches: Iterator[pa.RecordBatch], with_marks: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            found = has_bit(marked.value, id_cell(ids.fill_null(0).to_numpy())) & ids.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(found if with_marks else ~found))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = pa.list_(pa.int32())
        return drop(b.append_column("marks", pa.nulls(len(b), none)) for b in part(batches, False))

    schema = "doc_id long, n_words long, n_removed long, kept_text string"
    cut = docs.mapInArrow(lambda it: part(it, True), "doc_id long, text string").join(marks, "doc_id", "left")
    return docs.mapInArrow(whole, schema).unionByName(cut.select("doc_id", "text", "marks").mapInArrow(drop, schema))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: Windows as text: a smaller document id anywhere with the same 50 words; exact, for the sizes that SQL is run on.
OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, u.i AS pos, array_to_string(ws[u.i:u.i + 49], ' ') AS k
  FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 48)) AS i) u WHERE len(ws) >= 50
), firsts AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)
), hit AS (SELECT DISTINCT win.doc_id, win.pos FROM win JOIN firsts USING (k) WHERE win.doc_id > f
), gone AS (SELECT DISTINCT doc_id, pos + o AS p FROM hit, (SELECT unnest(range(0, 50)) AS o)
), lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
    CASE WHEN ps IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(ps, i)), lambda i: ws[i]) END AS left_
  FROM w LEFT JOIN lists USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(left_, ' ')) AS kept_sha256 FROM kept
"""

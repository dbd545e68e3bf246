"""SimHash near-duplicates by covering locality-sensitive hashing: no pair within the radius of two bits is missed.

Every bit position has a non-zero vector of three bits. Each of the seven non-zero vectors v makes a mask of the positions
whose vector has an odd product with v. The vectors of any two positions leave some v orthogonal to both, so fingerprints that
differ in two bits at most are equal under that v's mask: they meet in one of seven tables, each on 36 or 37 of the 64 bits.

Equal fingerprints are one node. In a bucket of few nodes all of them are compared. In a larger one, where all pairs would be
too many, each node is listed under itself and under every fingerprint that differs from it in one of the bits outside the
mask. Nodes listed under the same one differ in two bits at most, and nodes of the bucket that do are listed under a common
one: so lists of 29 nodes at most give exactly the links, with work linear in the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import kernels as K
from panelkit.llm.common import clean_text, staged, table
from panelkit.llm.components import components

WORDS, SEED, RADIUS = 3, 42, 2
FEW = 64  # nodes of a bucket that are all compared with each other
CHUNK = 1 << 20  # bytes of a text that are split into words at a time
_LOWER = bytes(K.LOWER)


def masks() -> list[int]:
    """The seven masks, as unsigned numbers; bit position i has the vector 1 + i % 7."""
    return [sum(1 << i for i in range(64) if bin(v & (1 + i % 7)).count("1") % 2) for v in range(1, 2 ** (RADIUS + 1))]


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, A-Z as a-z, about CHUNK bytes at a time."""
    rest = b""
    for at in range(0, len(text), CHUNK):
        block = rest + text[at : at + CHUNK].translate(_LOWER)
        cut = max(block.rfind(c) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")) if at + CHUNK < len(text) else len(block)
        rest = block[max(cut, 0) :]
        if cut > 0:
            yield block[:cut].split()


def fingerprint(text: bytes) -> int:
    """A bit is set if it is in over half the XXH64 hashes of the runs of three words, repeats included."""
    bits, n, last = np.zeros(64, np.int64), 0, []

    def count(words: list[bytes], size: int) -> int:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        line = b" ".join(words)
        hashes = [xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())]
        of_bytes = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        for k in range(0, len(of_bytes), 1 << 14):
            bits[:] += np.unpackbits(of_bytes[k : k + (1 << 14)], axis=1, bitorder="little").sum(0, dtype=np.int64)
        return len(hashes)

    for part in word_lists(text):
        last += part
        if len(last) >= WORDS:
            n += count(last, WORDS)
            last = last[1 - WORDS :]
    if not n and last:
        n = count(last, len(last))
    return sum(1 << k for k in np.flatnonzero(2 * bits > n).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp of docs (doc_id, text); fp has the 64 bits as a signed number."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, raw, bounds in K.slices(batch.column("text")):
                found = [fingerprint(raw[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, end - start), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.mapInArrow(read, "doc_id long, fp long")


def links(nodes: DataFrame) -> DataFrame:
    """a, b: links between different fingerprints fp of nodes, at two bits at most. Nodes that are linked are joined by a
    path of these, not each pair by a row of its own."""
    signed = [m - 2**64 if m >> 63 else m for m in masks()]
    entries = nodes.select("fp", F.explode(F.array([F.struct(F.lit(t).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(signed)])).alias("e")).select("fp", "e.*")
    entries = staged(entries)
    # written first: both sides of the join are plain exchanges then, and Spark splits a bucket that is too large for a task
    widths = staged(entries.groupBy("mask", "key").agg(F.count("*").alias("width")).where("width > 1"))
    met = staged(entries.join(widths, ["mask", "key"]))
    near = f"filter(slice(fps, i + 2, {FEW}), y -> bit_count(x ^ y) <= {RADIUS})"
    few = met.where(F.col("width") <= FEW).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))
    few = few.select(F.expr(f"inline(flatten(transform(fps, (x, i) -> transform({near}, y -> struct(x AS a, y AS b)))))"))
    free = F.array([F.array([F.lit(b) for b in (np.uint64(1) << np.arange(64, dtype=np.uint64)).view(np.int64).tolist() if not b & m]) for m in signed])
    flips = F.transform(free[F.col("mask")], lambda bit: F.col("fp").bitwiseXOR(bit))
    many = met.where(F.col("width") > FEW).select("mask", "fp", F.explode(F.concat(F.array("fp"), flips)).alias("at"))
    many = many.groupBy("mask", "at").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")  # 29 at most
    many = many.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    return few.union(many)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, fingerprint, component_id: a row for each input row.

    Words are runs of anything but ASCII white space, A-Z as a-z. A text of one or two words is hashed as a whole; null, empty
    and blank texts have the fingerprint zero and are linked like any other. Fingerprints that differ in two bits at most
    are linked; component_id is the smallest id that links reach. A null id is never the smallest, and where no other is
    there the component is null. Repeated rows stay, each with its row. Other columns are ignored, whatever their names;
    an empty table gives an empty one.
    """
    found = staged(fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), clean_text(text_col).alias("text"))))
    nodes = staged(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp")))
    placed = staged(nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    first = staged(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    placed = staged(placed.join(first, "root").select("fp", "component_id"))
    return found.join(placed, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")

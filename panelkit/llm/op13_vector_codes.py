"""Vector codes by ball k-means: every part of a vector is assigned to one of few entries, exactly, without most comparisons.

The parts that an entry has make a ball around it, whose radius is the farthest part's distance. A part at distance d from its
entry can only be as near to another entry that lies within 2 d of its own, so:

* entries farther off than twice the radius are no neighbours of the ball: none of its parts is compared with them;
* a part whose 2 d is under the distance of the nearest neighbour lies in the stable core: it keeps its entry, unseen;
* the others lie in rings, between half the distances of one neighbour and the next, and are compared with the neighbours
  inside their ring only.

All of it is integer arithmetic on squares, and candidates that are just as far off are kept, so the result is that of a full
search with ties to the lower index. A round is one pass: it assigns, writes the codes that the next round starts from, and
leaves one row of sums for each entry and task. The entries themselves are a parameter table of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm.common import discard, staged, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096


def largest(dim: int) -> int:
    """Components beyond this count as this, so that a squared distance of two vectors fits into 64 bits."""
    return int(2**30 / dim**0.5)


def neighbours(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry, all entries by squared distance, and those distances; the entry itself is the first."""
    apart = ((book[:, None] - book[None]) ** 2).sum(-1)
    np.fill_diagonal(apart, -1)  # before any entry that is equal to it
    order = np.argsort(apart, axis=1, kind="stable")
    return order, np.take_along_axis(apart, order, 1)


def assign(part: np.ndarray, own: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row and its squared distance, ties to the lower index; own is any entry of each row, the nearer the
    fewer comparisons."""
    order, apart = neighbours(book)
    dist = ((part - book[own]) ** 2).sum(1)
    radius = np.full(len(book), -1)
    np.maximum.at(radius, own, dist)
    wide = max((int(np.searchsorted(apart[i], 4 * radius[i], "right")) for i in range(len(book)) if radius[i] >= 0), default=1)
    if wide == 1:  # no ball has a neighbour
        return own, dist
    ring = (apart[own, :wide] <= 4 * dist[:, None]).sum(1)  # neighbours that may be as near, and the entry itself
    rows = np.flatnonzero(ring > 1)  # all but the stable cores
    if not len(rows):
        return own, dist
    ring = ring[rows]
    first = np.cumsum(ring) - ring
    row = np.repeat(rows, ring)
    entry = order[own[row], np.arange(len(row)) - np.repeat(first, ring)]
    found = ((part[row] - book[entry]) ** 2).sum(1)
    least = np.minimum.reduceat(found, first)
    best = np.minimum.reduceat(np.where(found == np.repeat(least, ring), entry, len(book)), first)
    own, dist = own.copy(), dist.copy()
    own[rows], dist[rows] = best, least
    return own, dist


def one_round(df: DataFrame, books: np.ndarray, label_type: str, scale: int) -> DataFrame:
    """Rows of vectors: vec_id, label, vec, code, error by the nearest entries of books (part, entry, position); and rows of the
    sums of each task: part, entry, n, sums. df has embedding (the first time) or vec and code."""
    parts, entries, width = books.shape
    names = ["vec_id", "label", "vec", "code", "error", "part", "entry", "n", "sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, kind = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64), None
        for batch in batches:
            if not len(batch):
                continue
            kind = batch.column("label").type
            if "embedding" in batch.schema.names:
                x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
                most = largest(x.shape[1])
                vec = np.clip(np.floor(x * scale), -most, most).astype("<i4")
                code = np.zeros((len(batch), parts), np.uint8)
            else:
                vec = np.frombuffer(b"".join(batch.column("vec").to_pylist()), "<i4").reshape(len(batch), -1)
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(batch), -1)
            new, error = np.empty_like(code), np.zeros(len(batch), np.int64)
            for p in range(parts):
                part = vec[:, p * width : (p + 1) * width].astype(np.int64)
                own, dist = assign(part, code[:, p].astype(np.int64), books[p])
                new[:, p] = own
                error += dist
                n[p] += np.bincount(own, minlength=entries)
                order = np.argsort(own, kind="stable")
                have, first = np.unique(own[order], return_index=True)
                sums[p, have] += np.add.reduceat(part[order], first, axis=0)
            rows = lambda a: pa.array([x.tobytes() for x in a], pa.binary())
            nulls = [pa.nulls(len(batch), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), rows(vec), rows(new), pa.array(error), *nulls], names)
        if kind is not None:
            p, e = np.nonzero(n)
            nulls = [pa.nulls(len(p), t) for t in (pa.int64(), kind, pa.binary(), pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*nulls, pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], names)

    return df.mapInArrow(run, f"vec_id long, label {label_type}, vec binary, code binary, error long, part int, entry int, n long, sums array<long>")


def moved(books: np.ndarray, done: DataFrame) -> np.ndarray:
    """Every entry as the floor of its parts' mean; entries without parts stay. A row for each component comes to the driver."""
    sums = done.where("part is not null").select("part", "entry", "n", F.posexplode("sums")).groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("sum"))
    out = books.copy()
    for r in sums.collect():
        out[r["part"], r["entry"], r["pos"]] = r["sum"] // r["n"]
    return out


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: a row for each kept input row.

    Left out are null and empty vectors, those with a null or a component that isn't finite, and those whose length isn't
    that of the first kept one (by id), or isn't a multiple of parts. Components are floors of scale times the value; beyond
    `largest` they count as that. Codebooks start from the smallest ids, null as the last of them; of rows of one id, from the
    smallest vector. Repeated rows each have a row, and weight. Null labels are one label; label_error is null if it
    exceeds 64 bits. Other columns are ignored, whatever their names; an empty table gives an empty one.
    """
    name = f"`{label_col}`"
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(name).alias("label"), F.col(vector_col).alias("embedding"))
    kept = kept.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    label_type = kept.schema["label"].dataType.simpleString().replace("void", "int")
    by_id = F.col("vec_id").asc_nulls_last()
    first = kept.orderBy(by_id, "embedding").select(F.size("embedding")).first()
    kept = kept.where(F.size("embedding") == (first[0] if first else 0))
    ids = [r[0] for r in kept.groupBy("vec_id").count().orderBy(by_id).limit(entries).collect()]
    chosen = F.coalesce(F.col("vec_id").isin([i for i in ids if i is not None]), F.lit(None in ids))
    start = kept.where(chosen).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy(by_id).collect()
    if not start:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    x = np.array([r["embedding"] for r in start], np.float64)
    most = largest(x.shape[1])
    books = np.clip(np.floor(x * scale), -most, most).astype(np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2)

    done = staged(one_round(kept, books, label_type, scale))
    for _ in range(rounds):
        books = moved(books, done)
        last, done = done, staged(one_round(done.where("part is null").select("vec_id", "label", "vec", "code"), books, label_type, scale))
        discard(last)
    seal = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    found = done.where("part is null").select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error")
    labels = staged(found.groupBy("label").agg(F.try_sum("error").alias("label_error"))).withColumnRenamed("label", "of")
    return found.join(labels, found["label"].eqNullSafe(labels["of"]), "left").select("vec_id", "code", "error", "label_error", F.lit(seal).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """All distances of all rounds, for the sizes that SQL is run on."""
    steps = [f"""kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), comp AS MATERIALIZED (
  SELECT vec_id, (i - 1) // (len(v) // {PARTS}) AS part, (i - 1) % (len(v) // {PARTS}) AS pos, v[i] AS x FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM kept)
), book0 AS MATERIALIZED (
  SELECT part, entry, pos, x FROM comp JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id)
)"""]  # fmt: skip
    for r in range(ROUNDS + 1):
        steps.append(f"""best{r} AS MATERIALIZED (
  SELECT vec_id, part, min(d * {ENTRIES} + entry) AS k FROM (SELECT vec_id, part, entry, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS d FROM comp c JOIN book{r} b USING (part, pos) GROUP BY ALL) GROUP BY ALL
)""")
        if r < ROUNDS:
            steps.append(f"""book{r + 1} AS MATERIALIZED (
  SELECT part, entry, pos, coalesce((s - ((s % n) + n) % n) // n, x) AS x FROM book{r} LEFT JOIN (
    SELECT part, k % {ENTRIES} AS entry, pos, sum(x)::BIGINT AS s, count(*) AS n FROM comp JOIN best{r} USING (vec_id, part) GROUP BY ALL) USING (part, entry, pos)
)""")
    return "WITH " + ", ".join(steps) + f""", coded AS (
  SELECT vec_id, string_agg(lpad(to_hex(k % {ENTRIES}), 2, '0'), '' ORDER BY part) AS code, sum(k // {ENTRIES})::BIGINT AS error FROM best{ROUNDS} GROUP BY vec_id)
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""  # fmt: skip


OP13_SQL = _sql()

"""What the operators share: reading a table, cutting lineage in the shared folder, and bounded bitmaps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import kernels as K

#: Bits of the bitmaps of document ids: 8 MB.
ID_BITS = 26
#: Words, as the operators on words see them: maximal runs of anything but ASCII white space.
NOT_WORD = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Rows with texts are large: unless the session says otherwise, a thousand of them go to Python at once."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a local session without one gets a temporary folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read from there: it is computed once and outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a staged table whose readers have all been written themselves: nothing computes it again."""
    jvm = df.sparkSession.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/staged-" not in folder:
            raise ValueError(f"not a staged table: {folder}")
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean_text(col: str | Column = "text") -> Column:
    """The text, an empty one for null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def text_tie(col: str | Column = "text") -> Column:
    """A hash of the text, the same for null and for an empty one: with the id it tells a document's rows apart."""
    return F.xxhash64(clean_text(col), F.octet_length(clean_text(col)))


def without(docs: DataFrame, gone: DataFrame, once: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id and text hash gone (doc_id, tie) doesn't have; of those that once has, one for each.

    Rows that a bitmap of both tables rules out, nearly all, pass through: only the others are joined. The bitmap has about
    eight bits a row, 2 ** 28 at most (32 MB); beyond that it rules out less, with the same result.
    """
    named = gone.select("doc_id", "tie", F.lit(True).alias("gone"))
    if once is not None:
        named = named.union(once.select("doc_id", "tie", F.lit(False)))
    named = staged(named)
    bits = min(28, max(16, (8 * named.count()).bit_length()))
    cell = lambda i, tie: F.shiftrightunsigned(F.xxhash64(i, tie), 64 - bits)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(named.select(cell(F.col("doc_id"), F.col("tie")).alias("cell")), bits))

    def listed(cells: pa.Array) -> pa.Array:
        return pa.array(has_bit(shared.value, cells.to_numpy(zero_copy_only=False).view(np.uint64)))

    own_id, own_tie = F.col(id_col).cast("long"), text_tie(text_col)
    hit = F.arrow_udf(listed, "boolean")(cell(own_id, own_tie))
    rows = docs.where(hit).select(F.struct("*").alias("doc"), own_id.alias("id"), own_tie.alias("tie"))
    key = rows["id"].eqNullSafe(named["doc_id"]) & (rows["tie"] == named["tie"])
    rows = rows.join(named, key, "left").select("doc", "id", rows["tie"], "gone")
    kept = rows.where("gone is null").select("doc")
    if once is not None:
        kept = kept.union(rows.where("not gone").groupBy("id", "tie").agg(F.first("doc").alias("doc")).select("doc"))
    return docs.where(~hit).union(kept.select([F.col("doc").getField(c).alias(c) for c in docs.columns]))


def bitmap(cells: DataFrame, bits: int) -> np.ndarray:
    """Bit set of the column cell (0 to 2 ** bits - 1) as 2 ** (bits - 6) 64-bit words.

    Executors fold the cells into words before the shuffle, so the driver gets a word and its number for each 64 cells, at most
    2 ** (bits - 2) bytes, whatever the input.
    """
    words = (
        cells.groupBy(F.shiftright("cell", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(cell & 63 as int)))").alias("set"))
        .toArrow()
    )
    out = np.zeros(max(1, 1 << (bits - 6)), np.uint64)
    out[words["word"].to_numpy()] = words["set"].to_numpy().view(np.uint64)
    return out


def has_bit(words: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (words[cell >> np.uint64(6)] >> (cell & np.uint64(63))) & np.uint64(1) != 0


def id_cell(ids: np.ndarray) -> np.ndarray:
    return K.mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - ID_BITS)


def id_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The column doc_id as cells of a bitmap of ids; a bitmap may hold other ids, too, and so only rules out."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(id_cell(batch.column("doc_id").to_numpy()).view(np.int64))], ["cell"])

"""Token ids in a content-addressed store.

A store is a folder of Parquet tables:

* `parts/kind=chunk` - key, payload: the distinct chunks of all id streams. A rolling hash over sixteen ids says where a
  chunk ends, so equal passages give equal chunks wherever they stand; the key is a hash of the payload (little-endian
  ids of the smallest width that the vocabulary allows).
* `recipes` - in ascending document order, for each document the keys of its chunks, the number of its ids and the root
  of its Merkle tree; `part` and `slot` say where it stands.
* `manifest` - for each part its number of ids, the id at which it starts and the root over its documents: their ids,
  numbers of token ids and roots.
* `seal` - one row: the root over the whole manifest.

One shuffle writes chunks and recipes: a task sends a payload once, however often it meets it. Reading back never moves
payloads: chunk files are hashed where they are read, and a document's digest is put together from those of its chunks.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelkit.llm import kernels as K
from panelkit.llm.common import clean_text, shared_dir, staged, table

REACH, MEAN, LEAST, MOST = 16, 512, 64, 4096
KEPT_WORDS = 900_000
_ZEROS = memoryview(bytes(4 * MOST))
_PLAIN = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-/:-@\[-`{-~]*)").fullmatch


def _byte_letters() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte: itself, or the next one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(own)))}


class _Codes(dict):
    """Numbers for words, in the order in which they are first asked for; new has those since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        code = self[word] = len(self)
        return code


class _Encoder:
    """Ids of texts, word by word. The tokenizer drops white space and never joins what stands on its two sides, so a
    text's ids are those of its words; each distinct word is encoded once for as long as it is kept.

    A word of Latin letters, with ASCII signs after them at most, is two parts at most to the tokenizer, which its own steps
    before the model leave as they are but for case, so the model alone gives their ids. Whether that holds for a tokenizer
    is tried once on some words.
    """

    loaded: dict[str, _Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.kind = "H" if self.width.itemsize == 2 else "I"
        self.letters = _byte_letters()
        self.clear()
        probes = [b"The", b"then,", b"que.&&&", b"it'", b"de***", "\u00c9tait.".encode(), "stra\u00dfe".encode(), b"onwhingin", b"a", "\u00e7\u00f1,".encode()]
        self.by_model = [self._by_model(w) for w in probes] == self._whole(probes)
        self.clear()

    @classmethod
    def of(cls, path: str) -> _Encoder:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def clear(self) -> None:
        self.code = _Codes()
        self.parts: dict[str, bytes] = {}
        self.ids, self.lens, self.again = np.zeros(0, self.width), np.zeros(0, np.int64), np.zeros(0, bool)

    def forget(self, most: int) -> None:
        """Leaves words that were met again since the last call, most at most. Most distinct words of a corpus are met once."""
        kept = np.flatnonzero(self.again)[:most]
        words, size, start = list(self.code), self.lens[kept], (np.cumsum(self.lens) - self.lens)[kept]
        ids = self.ids[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        self.clear()
        self.code.update((words[k], code) for code, k in enumerate(kept.tolist()))
        self.ids, self.lens, self.again = ids, size, np.zeros(len(kept), bool)

    def _whole(self, words: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, self.width).tobytes() for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def _model(self, letters: str) -> bytes:
        got = self.parts.get(letters)
        if got is None:
            tokens = self.tokenizer.model.tokenize(letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.letters))
            got = self.parts[letters] = array(self.kind, [t.id for t in tokens]).tobytes()
        return got

    def _by_model(self, word: bytes) -> bytes | None:
        """Ids by the model alone; None if the word isn't plain."""
        text = word.decode()
        plain = _PLAIN(text) or _PLAIN(text.lower())
        return self._model(plain[1]) + (self._model(plain[2]) if plain[2] else b"") if plain else None

    def encode(self, texts: list[bytes], end_id: int, kept_words: int = KEPT_WORDS) -> tuple[np.ndarray, np.ndarray]:
        """All ids, with end_id after each text, and the texts' bounds in them. Beyond kept_words words, most are forgotten."""
        if len(self.code) > kept_words:
            self.forget(kept_words // 4)
        found = [t.split() for t in texts]
        count = np.fromiter(map(len, found), np.int64, len(found))
        code = np.fromiter(map(self.code.__getitem__, itertools.chain.from_iterable(found)), np.int64, count.sum())
        self.again[code[code < len(self.again)]] = True
        if new := self.code.new:
            got: list[bytes] = [self._by_model(w) for w in new] if self.by_model else [None] * len(new)
            rest = [k for k, g in enumerate(got) if g is None]
            for k, g in zip(rest, self._whole([new[k] for k in rest])):
                got[k] = g
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(got), self.width)])
            self.lens = np.concatenate([self.lens, np.fromiter(map(len, got), np.int64, len(got)) // self.width.itemsize])
            self.again = np.append(self.again, np.zeros(len(new), bool))
            self.code.new = []
        size = self.lens[code]
        into = np.cumsum(size) - size
        plain = self.ids[np.repeat((np.cumsum(self.lens) - self.lens)[code] - into, size) + np.arange(size.sum())]
        bounds = np.append(into, size.sum())[np.concatenate([[0], np.cumsum(count)])]
        return np.insert(plain, bounds[1:], np.array(end_id, self.width)), bounds + np.arange(len(bounds))


def _cuts(ids: np.ndarray, bounds: np.ndarray) -> Iterator[list[int]]:
    """Bounds of each document's chunks."""
    roll = K.runs(K.mix(ids.astype(np.uint64)), REACH)
    marks = np.flatnonzero((roll & np.uint64(MEAN - 1)) == 0) + REACH
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        cut = [a]
        for m in marks[np.searchsorted(marks, a + REACH) : np.searchsorted(marks, b)].tolist():
            while m - cut[-1] > MOST:
                cut.append(cut[-1] + MOST)
            if m - cut[-1] >= LEAST:
                cut.append(m)
        while b - cut[-1] > MOST:
            cut.append(cut[-1] + MOST)
        if cut[-1] < b:
            cut.append(b)
        yield cut


def _key(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of the binary tree over leaves; a last odd one moves up as it is."""
    level = leaves or [b""]
    while len(level) > 1:
        level = [_key(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


_PARTS = "kind string, key binary, row long, payload binary, doc_id long, n_tokens long, keys array<binary>, root binary"


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", kept_words: int = KEPT_WORDS) -> None:
    """Encodes docs into a new store at path. A worker keeps the ids of kept_words words, some 300 bytes each: fewer take less
    memory and more time.

    Null texts count as empty ones; an empty text is a stream of end_id alone. Repeated rows and equal ids stay separate
    documents, in a fixed order among themselves; null ids come first. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), clean_text(text_col).alias("text"))
    schema = _PARTS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder.of(tokenizer)
        sent: set[bytes] = set()
        for batch in batches:
            for start, end, raw, bounds in K.slices(batch.column("text")):
                data = raw.tobytes()
                if b"<|" not in data and encoder.by_model:  # case makes no difference but in special tokens
                    data = K.LOWER[raw].tobytes()
                ids, at = encoder.encode([data[a:b] for a, b in zip(bounds[:-1], bounds[1:])], end_id, kept_words)
                recipes, payloads = [], {}
                for cuts in _cuts(ids, at):
                    keys = []
                    for a, b in zip(cuts[:-1], cuts[1:]):
                        payload = ids[a:b].tobytes()
                        keys.append(key := _key(payload))
                        if key not in sent:
                            sent.add(key)
                            payloads[key] = payload
                    recipes.append(keys)
                if len(sent) > 500_000:  # a bound on memory only; what is sent again is merged after the shuffle
                    sent.clear()
                n, m = len(recipes), len(payloads)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(["recipe"] * n + ["chunk"] * m), pa.array([None] * n + list(payloads), pa.binary()),
                        pa.array(batch.column("row")[start:end].to_pylist() + [None] * m, pa.int64()),
                        pa.array([None] * n + list(payloads.values()), pa.binary()),
                        pa.array(batch.column("doc_id")[start:end].to_pylist() + [None] * m, pa.int64()),
                        pa.array(np.diff(at).tolist() + [None] * m, pa.int64()),
                        pa.array(recipes + [None] * m, pa.list_(pa.binary())), pa.array([merkle_root(k) for k in recipes] + [None] * m, pa.binary()),
                    ],
                    names=["kind", "key", "row", "payload", "doc_id", "n_tokens", "keys", "root"],
                )

    parts = docs.mapInArrow(cut, schema).dropDuplicates(["kind", "key", "row"])
    parts.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/parts")

    recipes = spark.read.schema(schema).parquet(f"{path}/parts").where("kind = 'recipe'").select("doc_id", "row", "n_tokens", "keys", "root")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = recipes.repartitionByRange(ranges, "doc_id", "row").sortWithinPartitions("doc_id", "row").withColumn("part", F.spark_partition_id())
    ordered.write.parquet(f"{path}/recipes")
    manifest = _part_roots(spark.read.schema(ordered.schema).parquet(f"{path}/recipes"))
    # one row for each part: the number of parts is a setting, not a count of documents
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    manifest.withColumn("start", F.coalesce(before, F.lit(0))).write.parquet(f"{path}/manifest")
    _seal(spark.read.parquet(f"{path}/manifest")).write.parquet(f"{path}/seal")


def _ordered_root(by: str, leaf: Column) -> Column:
    leaves = F.transform(F.array_sort(F.collect_list(F.struct(by, leaf.alias("leaf")))), lambda x: x["leaf"])
    return F.sha2(F.array_join(leaves, ""), 256)


def _part_roots(recipes: DataFrame) -> DataFrame:
    """part, n_tokens, root: documents hash in blocks of 1024 slots first, so no list grows with the corpus."""
    slot = F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "row")) - 1
    document = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "n_tokens", F.hex("root")), 256)
    block = recipes.select("part", "n_tokens", document.alias("leaf"), slot.alias("slot")).groupBy("part", F.shiftright("slot", 10).alias("block"))
    blocks = block.agg(_ordered_root("slot", F.col("leaf")).alias("root"), F.sum("n_tokens").alias("n_tokens"))
    return blocks.groupBy("part").agg(_ordered_root("block", F.col("root")).alias("root"), F.sum("n_tokens").alias("n_tokens"))


def _seal(manifest: DataFrame) -> DataFrame:
    """seal: the root over all parts in order; one row, also for no parts."""
    return manifest.agg(_ordered_root("part", F.concat_ws(":", "part", "start", "n_tokens", "root")).alias("seal"))


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    chunks = spark.read.schema(_PARTS).parquet(f"{path}/parts").where("kind = 'chunk'").select("key", "payload")
    return chunks, spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/manifest")


def read_digests(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, verified: every document of a store, from its files.

    n_tokens and ids_crc32 (of the ids as little-endian 32-bit integers) come from the stored chunks. verified says that
    the chunks' contents hash to their keys and these to the document's root, that their ids are as many as the recipe says,
    that the documents of its part hash to the part's root, and that the store is complete: its parts hash to the seal, and
    recipes have these parts and no others. So whatever is lost or altered, what comes back incomplete is not verified.
    """
    chunks, recipes, manifest = _tables(spark, path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = _Encoder.of(tokenizer).width
        for batch in batches:
            payloads = batch.column("payload").to_pylist()
            ids = [np.frombuffer(p, width) for p in payloads]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([_key(p) for p in payloads], pa.binary()), pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64())],
                ["key", "found", "n", "crc"],
            )

    digests = chunks.mapInArrow(digest, "key binary, found binary, n long, crc long")
    used = recipes.select("doc_id", "row", F.posexplode("keys").alias("pos", "key")).join(digests, "key", "left")
    listed = used.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("pos", "found", "n", "crc"))).alias("chunks"))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for chunks in batch.column("chunks").to_pylist():
                crc = total = 0
                for c in chunks:
                    n = c["n"] or 0
                    crc = zlib.crc32(_ZEROS[: 4 * n], crc) ^ zlib.crc32(_ZEROS[: 4 * n]) ^ (c["crc"] or 0)  # crc of the joined bytes
                    total += n
                out.append((total, crc, merkle_root([c["found"] or b"" for c in chunks])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), *(pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary())))], ["doc_id", "row", "n_tokens", "ids_crc32", "found_root"]
            )

    read = listed.mapInArrow(combine, "doc_id long, row long, n_tokens long, ids_crc32 long, found_root binary")
    found = _part_roots(recipes).select("part", F.col("root").alias("found"), F.lit(True).alias("stored"))
    parts = staged(manifest.withColumn("listed", F.lit(True)).join(found, "part", "full").select("part", "start", "listed", "stored", (F.col("root") == F.col("found")).alias("whole")))
    complete = parts.where("listed is null or stored is null").isEmpty() and _seal(manifest).collect() == spark.read.parquet(f"{path}/seal").collect()
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, -1))
    placed = recipes.select("doc_id", "row", "root", F.col("n_tokens").alias("said"), "part", F.coalesce(inside, F.lit(0)).alias("inside"))
    placed = placed.join(F.broadcast(parts), "part", "left")  # a row for each part
    placed = placed.withColumns({"id": F.coalesce("doc_id", F.lit(0)), "none": F.col("doc_id").isNull()}).drop("doc_id")
    read = read.withColumns({"id": F.coalesce("doc_id", F.lit(0)), "none": F.col("doc_id").isNull()})
    proved = F.col("whole") & (F.col("root") == F.col("found_root")) & (F.col("said") == F.col("n_tokens")) & F.lit(complete)
    return read.join(placed, ["id", "none", "row"]).select("doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", F.coalesce(proved, F.lit(False)).alias("verified"))


def read_ids(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """doc_id, row, ids: the documents' whole id streams, rebuilt from recipes and chunks.

    A store that has lost recipes is an error here; one that has lost or altered chunks is an error when the rows that need
    them are read. What comes back is complete.
    """
    chunks, recipes, manifest = _tables(spark, path)
    stored = recipes.groupBy("part").agg(F.sum("n_tokens").alias("stored"))
    if not manifest.join(stored, "part", "full").where("not (n_tokens <=> stored)").isEmpty():
        raise ValueError(f"recipes are lost in {path}")
    used = recipes.select("doc_id", "row", "n_tokens", F.posexplode("keys").alias("pos", "key")).join(chunks, "key", "left")
    listed = used.groupBy("doc_id", "row", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "payload"))).alias("chunks"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = _Encoder.of(tokenizer).width
        for batch in batches:
            ids = []
            for doc_id, n, parts in zip(batch.column("doc_id"), batch.column("n_tokens"), batch.column("chunks")):
                parts = parts.as_py()  # one document at a time
                if any(c["payload"] is None or _key(c["payload"]) != c["key"] for c in parts):
                    raise ValueError(f"a chunk of document {doc_id} is lost or altered")
                ids.append(np.frombuffer(b"".join(c["payload"] for c in parts), width).astype(np.int32))
                if len(ids[-1]) != n.as_py():
                    raise ValueError(f"document {doc_id} has {len(ids[-1])} ids, not {n}")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "row", "ids"])

    return listed.mapInArrow(join, "doc_id long, row long, ids array<int>")


def store_and_read(docs: DataFrame, tokenizer: str | None = None, path: str | None = None, kept_words: int = KEPT_WORDS) -> DataFrame:
    """Writes docs to a store (in the shared folder unless path is given) and returns what `read_digests` finds there."""
    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    path = path or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_store(docs, path, tokenizer, kept_words=kept_words)
    return read_digests(docs.sparkSession, path, tokenizer)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_read(table(spark, sf_dir, "documents"))

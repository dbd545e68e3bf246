"""Prefix trie of conversations by whole-sequence collapse.

Identical conversations become one sequence with a weight (how many there are) and a list of where they end, before anything
is done by prefix. Sequences that are proper prefixes of others are dropped by an anti-join: what is left are the leaves. Then
the prefixes of each distinct sequence are aggregated with its weight. A prefix is known by 128 bits, an exclusive or of hashes
of its turns at their positions, so that prefixes are running values which can be carried from block to block.

What is summed over a subtree needs no walk through the tree. Over its conversations it is a sum of sequences' remainders,
by weight. Over its nodes, each once, every node belongs to the conversation with the smallest id in it; the nodes of a
conversation are the lower end of its path, so one depth and one total for each sequence tell its share in every subtree.

Nothing depends on how long a conversation is or how many are alike: orders come from ranges of rows, running values are
carried over blocks, end lists are folded in pieces of ids before they meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkit.llm.common import NOT_WORD, clean_text, staged, table

BLOCK = 4096  # turns of a conversation whose prefixes are made at a time
PIECE = 12  # bits of an id: ids that are equal without them are a piece of an end list
SHARED, HEADS = 20, 4  # the query's rule: conversations of so many ids share their first turns, fewer than HEADS
NO_ENDS = hashlib.sha256(b"").hexdigest()


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, NOT_WORD), lambda w: w != "")).cast("long")


def ordered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos, one, two, words: a row for each turn; pos counts from 0, one and two are hashes of role and text.

    Turns are sorted over ranges of (conv_id, turn), so a conversation may cover many ranges; its turns in a range are counted
    from the number of those in earlier ones.
    """
    role, text = clean_text(role_col), clean_text(text_col)
    turns = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.xxhash64(F.lit(1), role, text).alias("one"), F.xxhash64(F.lit(2), role, text).alias("two"), n_words(text).alias("words"))
    order = ["conv_id", "turn", "one", "two"]
    turns = staged(turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    parts = turns.groupBy("conv_id", "part").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parts = staged(parts.select("conv_id", "part", (F.col("start") - F.coalesce(F.sum("n").over(before), F.lit(0))).alias("zero")))
    return turns.join(parts, ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("zero")).alias("pos"), "one", "two", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of another one: the turns, as `ordered_turns` has them, and all conv_id.

    Of conversation c, the first h = crc32(c) % HEADS turns become the first h of conversation c - c % SHARED, as many as it has.
    """
    n = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    heads = turns.where((F.col("conv_id") % SHARED == 0) & (F.col("pos") < HEADS - 1)).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "one", "two", "words"))).alias("heads"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    convs = n.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % SHARED)
    convs = convs.join(heads.withColumnRenamed("conv_id", "base"), "base", "left")
    convs = staged(convs.select("conv_id", "n", "h", F.slice("heads", F.lit(1), F.col("h")).alias("heads")))
    own = turns.join(convs.select("conv_id", "h", F.coalesce(F.array_size("heads"), F.lit(0)).alias("k")), "conv_id").where("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("k"))
    return convs.select("conv_id", F.inline("heads")).union(own.select("conv_id", "pos", "one", "two", "words")), convs.select("conv_id")


def digests(members: DataFrame) -> DataFrame:
    """depth, h1, h2, ends_sha256: of members (conv_id, depth, h1, h2), the hash of each group's ids in ascending order.

    Groups meet as pieces of up to 2 ** PIECE ids, and a piece goes through the hash at a time: no list of all is ever built.
    """
    key = ["depth", "h1", "h2"]
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    pieces = members.groupBy(*key, F.shiftright("conv_id", PIECE).alias("piece")).agg(ids.alias("ids"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), pa.array([r[3] for r in rows], pa.string())], [*key, "ends_sha256"])

        for batch in batches:
            done = []
            for *now, piece in zip(*(batch.column(c).to_pylist() for c in key), batch.column("ids")):
                if now == at:
                    state.update(b"," + piece.as_py().encode())
                    continue
                if state:
                    done.append((*at, state.hexdigest()))
                at, state = now, hashlib.sha256(piece.as_py().encode())
            yield out(done)
        if state:
            yield out([(*at, state.hexdigest())])

    return pieces.repartition(*key).sortWithinPartitions(*key, "piece").drop("piece").mapInArrow(fold, "depth long, h1 long, h2 long, ends_sha256 string")


def prefixes(turns: DataFrame, seqs: DataFrame) -> DataFrame:
    """rep, n, length, total, depth, h1, h2, p1, p2, upto, words: every prefix of every sequence, the empty one too. h and p are
    the hashes of the prefix and of the one before it, upto its words, words those of its last turn."""
    facts = ["rep", "n", "length", "total"]
    rows = turns.join(seqs.select(F.col("rep").alias("conv_id"), *facts), "conv_id")
    rows = rows.withColumn("block", F.expr(f"pos div {BLOCK}"))
    running = Window.partitionBy("rep", "block").orderBy("pos")
    xor = lambda c: F.call_function("bit_xor", F.col(c))
    rows = rows.select(*facts, "block", "pos", "g1", "g2", "words", *(xor(f"g{k}").over(running).alias(f"h{k}") for k in (1, 2)), F.sum("words").over(running).alias("upto"))
    blocks = turns.withColumn("block", F.expr(f"pos div {BLOCK}")).groupBy(F.col("conv_id").alias("rep"), "block").agg(xor("g1").alias("b1"), xor("g2").alias("b2"), F.sum("words").alias("bw"))
    before = Window.partitionBy("rep").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    blocks = blocks.select("rep", "block", *(F.coalesce(f(c).over(before), F.lit(0)).alias(c) for c, f in (("b1", xor), ("b2", xor), ("bw", F.sum))))
    rows = rows.join(blocks, ["rep", "block"]).select(*facts, (F.col("pos") + 1).alias("depth"), *(F.col(f"h{k}").bitwiseXOR(F.col(f"b{k}")).alias(f"h{k}") for k in (1, 2)), "g1", "g2", (F.col("upto") + F.col("bw")).alias("upto"), "words")
    rows = rows.select(*facts, "depth", "h1", "h2", *(F.col(f"h{k}").bitwiseXOR(F.col(f"g{k}")).alias(f"p{k}") for k in (1, 2)), "upto", "words")
    none = F.lit(0).cast("long")
    return rows.union(seqs.select(*facts, none, none, none, none, none, none, none))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of turns (as `ordered_turns` has them); convs has all conv_id, those without turns, too."""
    turns = staged(turns.select("conv_id", "pos", F.xxhash64("pos", "one").alias("g1"), F.xxhash64("pos", "two").alias("g2"), "words"))
    whole = turns.groupBy("conv_id").agg(F.count("*").alias("depth"), F.expr("bit_xor(g1)").alias("h1"), F.expr("bit_xor(g2)").alias("h2"), F.sum("words").alias("total"))
    whole = staged(convs.distinct().join(whole, "conv_id", "left").fillna(0))
    seqs = staged(whole.groupBy(F.col("depth").alias("length"), "h1", "h2").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"), F.first("total").alias("total")))
    ends = staged(digests(whole))

    key = ["depth", "h1", "h2"]
    rows = staged(prefixes(turns, seqs))
    found = staged(rows.groupBy(*key).agg(F.min("rep").alias("owner"), F.max(F.col("depth") < F.col("length")).alias("inner"), F.first("words").alias("words")))
    proper = found.where("inner").select(F.col("depth").alias("length"), "h1", "h2")
    leaves = seqs.join(proper, ["length", "h1", "h2"], "left_anti").select("rep", F.lit(1).cast("long").alias("leaf"))
    owned = found.groupBy(F.col("owner").alias("rep")).agg(F.min("depth").alias("top"), F.sum("words").alias("below"))
    facts = staged(seqs.select("rep").join(leaves, "rep", "left").join(owned, "rep", "left").fillna({"leaf": 0, "below": 0}))

    rest = F.col("total") - F.col("upto") + F.col("words")
    once = F.when(F.col("depth") > F.col("top"), rest).otherwise(F.col("below"))
    nodes = rows.join(facts, "rep").groupBy(*key, "p1", "p2").agg(
        F.min("rep").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("leaf").alias("n_leaves"), (F.sum(F.col("n") * rest) - F.sum(once)).alias("saved_tokens"))
    nodes = staged(nodes)
    below = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2"))
    children = staged(below.groupBy(*key).agg(F.count("*").alias("n_children")))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(children, key, "left").join(ends, key, "left").join(parents, ["depth", "p1", "p2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each distinct
    sequence of first turns, with the smallest id that starts with it, from the empty one (depth 0, without a parent) down.

    Turns are ordered by turn, null first; those of one turn by a hash of role and text, and repeated rows are turns of their
    own. Null roles and texts count as empty. Rows without a conv_id belong to no conversation and are left out. Other columns are
    ignored; an empty table has no node at all. saved_tokens is what a subtree saves by holding every turn's words once.
    """
    turns = staged(ordered_turns(conversations, conv_col, turn_col, role_col, text_col))
    return trie(turns, turns.select("conv_id"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(staged(ordered_turns(table(spark, sf_dir, "conversations")))))


#: A CRC-32 by eight steps a digit, then prefixes as joined strings; for the sizes that SQL is run on.
OP12_SQL = r"""
WITH RECURSIVE own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM own
), crc AS (
  SELECT conv_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT)), lambda a, b:
    list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS c
  FROM ids
), heads AS (SELECT conv_id, xor(c, 4294967295) % 4 AS h, conv_id - conv_id % 20 AS base FROM crc
), built AS (
  SELECT heads.conv_id, 0 AS side, o.pos, o.role, o.text FROM heads JOIN own o ON o.conv_id = base AND o.pos < h
  UNION ALL SELECT heads.conv_id, 1, o.pos, o.role, o.text FROM heads JOIN own o ON o.conv_id = heads.conv_id AND o.pos >= h
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY side, pos) AS depth, sha256(role || chr(1) || text) AS t,
    len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS words FROM built
), prefix AS (
  SELECT conv_id, 0::BIGINT AS depth, '' AS k, NULL::VARCHAR AS parent, 0::BIGINT AS words FROM heads
  UNION ALL SELECT p.conv_id, t.depth, sha256(p.k || t.t), p.k, t.words FROM prefix p JOIN turns t ON t.conv_id = p.conv_id AND t.depth = p.depth + 1
), size AS (SELECT conv_id, max(depth) AS depth FROM prefix GROUP BY conv_id
), nodes AS (SELECT depth, k, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM prefix GROUP BY depth, k
), pieces AS (SELECT depth, k, conv_id AS least, (n_convs - 1) * words AS saved, NOT EXISTS (FROM nodes c WHERE c.parent = n.k AND c.depth = n.depth + 1) AS leaf FROM nodes n
), up AS (SELECT p.depth, p.k, sum(x.saved) AS saved, sum(x.leaf::INT) AS leaves
  FROM pieces x JOIN prefix member ON member.conv_id = x.least AND member.depth = x.depth AND member.k = x.k
  JOIN prefix p ON p.conv_id = x.least AND p.depth <= x.depth GROUP BY ALL
), ended AS (SELECT depth, k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM prefix JOIN size USING (conv_id, depth) GROUP BY depth, k)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, (SELECT count(*) FROM nodes c WHERE c.parent = n.k AND c.depth = n.depth + 1) AS n_children,
  up.leaves::BIGINT AS n_leaves, up.saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n JOIN up USING (depth, k) LEFT JOIN nodes p ON p.k = n.parent AND p.depth = n.depth - 1 LEFT JOIN ended e ON e.depth = n.depth AND e.k = n.k
"""

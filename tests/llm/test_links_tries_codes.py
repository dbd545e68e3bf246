"""Fingerprint links, conversation tries and vector codes against plain versions."""

import itertools
import random

import duckdb
import numpy as np
import pytest

from panelkit.llm import op11_simhash as sim
from panelkit.llm import op12_prefix_trie as tri
from panelkit.llm import op13_vector_codes as vec
from panelkit.llm.common import staged
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def signed(x):
    return x - 2**64 if x >> 63 else x


def near(x, y):
    return bin(x ^ y).count("1") <= 2


# --- fingerprints


def test_masks_cover_every_pair_of_positions():
    masks = sim.masks()
    assert len(masks) == 7 and {bin(m).count("1") for m in masks} <= {36, 37}
    for i, j in itertools.product(range(64), repeat=2):
        assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_fingerprints_and_components_of_given_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: brute.simhash(t) for i, t in docs}
    found = sim.op11_simhash_near_dedup(spark, SF).collect()
    assert len(found) == len(docs) and {r.doc_id: int(r.fingerprint, 16) for r in found} == want
    assert {r.doc_id: r.component_id for r in found} == brute.least_reached(list(want), lambda a, b: near(want[a], want[b]))


@pytest.mark.parametrize("few", [2, 64])
def test_links_in_crowded_buckets(spark, monkeypatch, few):
    monkeypatch.setattr(sim, "FEW", few)
    r, found = random.Random(few), set()
    base = r.getrandbits(64)
    for _ in range(300):
        x = base
        for _ in range(r.randint(0, 8)):
            x ^= 1 << r.randrange(64)
        found |= {x, r.getrandbits(64)}
    links = [(a % 2**64, b % 2**64) for a, b in sim.links(spark.createDataFrame([(signed(x),) for x in found], "fp long")).collect()]
    assert all(near(a, b) for a, b in links)
    tied = {frozenset(x) for x in links}
    assert brute.least_reached(sorted(found), lambda a, b: frozenset((a, b)) in tied) == brute.least_reached(sorted(found), near)


def test_simhash_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(sim, "CHUNK", 64)
    long = " ".join(f"Word{i % 977}" + "\t\n" * (i % 3 == 0) for i in range(5000)) + "x" * 300
    rows = [(1, None, 5), (2, "", 5), (None, " \n", 6), (4, "one", 7), (5, "ONE  ", 7), (6, "one two", 7), (7, long, 8), (7, long, 8), (None, "alone here now", 9), (9, "É é x y", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int").withColumn("component_id", df_one())
    found = sim.simhash_groups(df).collect()
    assert len(found) == len(rows)
    by_text = {i: r for i, r in zip([r.doc_id for r in found], found)}
    for i, t, _ in rows:
        if i is not None:
            assert int(by_text[i].fingerprint, 16) == brute.simhash(t)
    assert {i: by_text[i].component_id for i in (1, 2, 4, 5, 6, 7, 9)} == {1: 1, 2: 1, 4: 4, 5: 4, 6: 6, 7: 7, 9: 9}
    assert {r.component_id for r in found if r.doc_id is None} == {1, None}
    assert sim.simhash_groups(df.limit(0)).count() == 0


def df_one():
    from pyspark.sql import functions as F

    return F.lit("clash")


# --- conversations


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


def test_trie_of_given_conversations(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = rows_of(tri.op12_prefix_trie(spark, SF))
    assert found == brute.prefix_trie(turns)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert sorted((tuple(r) for r in duck.sql(tri.OP12_SQL).fetchall()), key=lambda r: r[:2]) == found


@pytest.mark.parametrize("shuffled", [1, 2])
def test_trie_of_few_different_turns(spark, monkeypatch, shuffled):
    monkeypatch.setattr(tri, "BLOCK", 2)
    monkeypatch.setattr(tri, "PIECE", 1)
    r = random.Random(shuffled)
    turns = [(c, t - 1 if t else None, r.choice(["user", "assistant", None]), r.choice(["a b", "a b", "c", "", None])) for c in [*range(60), -3, -21, 100, 10**12] for t in range(r.randint(1, 6))]
    r.shuffle(turns)
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    assert rows_of(tri.trie(*tri.rebuilt(staged(tri.ordered_turns(df))))) == brute.prefix_trie(turns)
    assert rows_of(tri.prefix_trie(df)) == brute.prefix_trie(turns, heads=1)


def test_trie_edge_cases(spark):
    long = "word " * 300_000
    turns = [(1, 0, "user", long, 0), (2, 0, "user", long, 0), (None, 0, "user", "x", 0), (3, 5, None, None, 0), (4, None, "", "", 0), (4, None, "", "", 0)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, depth int")
    assert rows_of(tri.prefix_trie(df)) == brute.prefix_trie([t[:4] for t in turns], heads=1)
    assert tri.prefix_trie(df.limit(0)).count() == 0


def test_trie_of_one_conversation_over_many_ranges(spark):
    turns = [(c, t, "user", f"w{t}") for c, n in ((1, 3000), (2, 2990)) for t in range(n)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(8, "turn")
    found = rows_of(tri.prefix_trie(df))
    assert len(found) == 3001 and [r for r in found if r[1] == 2990][0][:7] == (1, 2990, 1, 2, 1, 1, 1)
    assert found[0][3:7] == (2, 1, 1, 2990)


# --- vector codes


def test_assignment_is_that_of_a_full_search():
    rng = np.random.default_rng(5)
    for _ in range(200):
        k = rng.integers(1, 17)
        book, part = rng.integers(-6, 6, (k, 3)), rng.integers(-8, 8, (rng.integers(1, 60), 3))
        own, dist = vec.assign(part, rng.integers(0, k, len(part)), book)
        every = ((part[:, None] - book) ** 2).sum(-1)
        assert (own == every.argmin(1)).all() and (dist == every.min(1)).all()


def test_rings_and_cores_spare_comparisons():
    rng = np.random.default_rng(6)
    book = rng.integers(-1000, 1000, (16, 8))
    part = book[rng.integers(0, 16, 500)] + rng.integers(-20, 20, (500, 8))
    best = ((part[:, None] - book) ** 2).sum(-1).argmin(1)
    order, apart = vec.neighbours(book)
    dist = ((part - book[best]) ** 2).sum(1)
    assert ((apart[best] <= 4 * dist[:, None]).sum(1) == 1).mean() > 0.9  # stable cores
    assert (vec.assign(part, best, book)[0] == best).all()


def test_codes_of_given_vectors(spark):
    found = sorted(tuple(r) for r in vec.op13_vector_codes(spark, SF).collect())
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(duck.sql(vec.OP13_SQL).fetchall()) == found
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert found == brute.vector_codes(rows)


def test_codes_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, [1.0] * 8, None), (1, [0.5] * 7 + [None], 1), (2, None, 2), (3, [nan] * 8, 1), (4, [-inf] * 8, 1), (5, [-0.1] * 8, None), (5, [-0.2] * 8, 7), (6, [1e30] * 8, 7), (7, [0.0] * 16, 7), (8, [0.1] * 9, 7), (9, [], 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = vec.vector_codes(df).collect()
    assert sorted((r.vec_id or -1, r.code) for r in found) == [(-1, "02" * 8), (5, "00" * 8), (5, "00" * 8), (6, "01" * 8)]
    assert [(r.error, r.label_error) for r in found if r.vec_id == 5] == [(8 * 205**2, 8 * 205**2)] * 2  # floor((-410 - 820) / 2) is -615
    assert vec.vector_codes(df.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [0.25] * 8, "a") for i in range(40)], "vec_id long, embedding array<float>, label string").withColumn("code", df_one())
    assert {(r.code, r.error, r.label_error) for r in vec.vector_codes(same).collect()} == {("00" * 8, 0, 0)}

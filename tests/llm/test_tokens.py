"""The token store: exact against the tokenizer, rebuilt from its files, and damage shows."""

import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelkit.llm.op2_token_store import _Encoder, merkle_root, read_digests, read_ids, write_store
from tests.llm import brute
from tests.llm.test_text_operators import make_docs

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aBé '.,!\n\t<|>")), max_size=30), max_size=5))
def test_words_give_the_ids_of_whole_texts(texts):
    encoder = _Encoder.of(PATH)
    ids, at = encoder.encode([t.encode() for t in texts], 1)
    assert [list(ids[a:b]) for a, b in zip(at[:-1], at[1:])] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_few_kept_words_give_the_same_ids_in_bounded_memory():
    encoder, rng = _Encoder(PATH), random.Random(2)
    for k in range(40):
        texts = [" ".join(rng.choice(["the", "Straße", "onwhingin,", f"w{k}x{rng.random()}"]) for _ in range(60)) for _ in range(3)]
        ids, at = encoder.encode([t.encode() for t in texts], 1, kept_words=100)
        assert [list(ids[a:b]) for a, b in zip(at[:-1], at[1:])] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]
        assert len(encoder.code) == len(encoder.lens) == len(encoder.again) <= 100 + 180
    assert b"the" in encoder.code


def rows():
    rng = random.Random(1)
    long = " ".join(rng.choice(["onwhingin", "the", "Straße", "a,", "x!!", "<|endoftext|>"]) + rng.choice("abcdef") for _ in range(9_000))
    return [(5, "The quick, brown fox."), (2, None), (9, ""), (9, "two rows of one id"), (9, "two rows of one id"), (None, "no id"), (7, long), (8, "x" + long), (3, "same"), (4, "same")]


def test_store_round_trip(spark, tmp_path):
    write_store(make_docs(spark, rows()), f"{tmp_path}/s", PATH)
    encoder = _Encoder.of(PATH)
    plain = {i: encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows() if i != 9}
    rebuilt = read_ids(spark, f"{tmp_path}/s", PATH).collect()
    assert {r.doc_id: r.ids for r in rebuilt if r.doc_id != 9} == plain and len(rebuilt) == len(rows())
    found = sorted(read_digests(spark, f"{tmp_path}/s", PATH).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, 2, 3, 4, 5, 7, 8, 9, 9, 9] and all(r.verified for r in found)
    start = 0
    for r in found:
        assert r.start == start
        start += r.n_tokens
        if r.doc_id != 9:
            assert (r.n_tokens, r.ids_crc32) == (len(plain[r.doc_id]), brute.crc_of_ids(plain[r.doc_id]))
    chunks = spark.read.parquet(f"{tmp_path}/s/parts/kind=chunk")
    used = spark.read.parquet(f"{tmp_path}/s/recipes").selectExpr("explode(keys) AS key")
    assert chunks.count() == used.distinct().count() < used.count()  # each once, and some are used again


def copied(spark, a, b, without=None, **changes):
    """A copy of store a at b; changes are SQL for a column of a table, as table__column."""
    for name in ("parts/kind=chunk", "recipes", "manifest", "seal"):
        df = spark.read.parquet(f"{a}/{name}")
        for key, sql in changes.items():
            table, column = key.split("__")
            if table == name.split("/")[0]:
                df = df.selectExpr(*(f"{sql} AS {c}" if c == column else c for c in df.columns))
        if without and without[0] == name:
            df = df.where(without[1])
        df.write.parquet(f"{b}/{name}")
    return read_digests(spark, b, PATH).collect()


def test_damage_is_found(spark, tmp_path):
    a = f"{tmp_path}/a"
    write_store(make_docs(spark, rows()), a, PATH)
    n = len(rows())
    assert all(r.verified for r in copied(spark, a, f"{tmp_path}/same"))
    key = spark.read.parquet(f"{a}/parts/kind=chunk").selectExpr("hex(min(key)) AS k").first().k
    part = spark.read.parquet(f"{a}/recipes").selectExpr("max(part) AS p").first().p
    altered = {
        "payload": {"parts__payload": f"CASE WHEN hex(key) = '{key}' THEN cast('zz' AS binary) ELSE payload END"},
        "count": {"recipes__n_tokens": "CASE WHEN doc_id = 5 THEN n_tokens + 1 ELSE n_tokens END"},
        "id": {"recipes__doc_id": "CASE WHEN doc_id = 5 THEN 6 ELSE doc_id END"},
        "keys": {"recipes__keys": "CASE WHEN doc_id = 7 THEN slice(keys, 1, size(keys) - 1) ELSE keys END"},
        "start": {"manifest__start": "start + 1"},
        "seal": {"seal__seal": "reverse(seal)"},
    }
    for name, changes in altered.items():
        found = copied(spark, a, f"{tmp_path}/{name}", **changes)
        assert len(found) == n and not all(r.verified for r in found), name
    for name, cut in {"recipe": ("recipes", f"part <> {part}"), "manifest": ("manifest", f"part <> {part}"), "chunk": ("parts/kind=chunk", f"hex(key) <> '{key}'")}.items():
        found = copied(spark, a, f"{tmp_path}/lost-{name}", without=cut)
        assert found and not all(r.verified for r in found), name
        if name != "chunk":
            assert not any(r.verified for r in found), "an incomplete store proves nothing"


def test_reading_ids_from_a_damaged_store_is_an_error(spark, tmp_path):
    a = f"{tmp_path}/a"
    write_store(make_docs(spark, rows()), a, PATH)
    key = spark.read.parquet(f"{a}/parts/kind=chunk").selectExpr("hex(min(key)) AS k").first().k
    part = spark.read.parquet(f"{a}/recipes").selectExpr("max(part) AS p").first().p
    damage = {
        "chunk": {"without": ("parts/kind=chunk", f"hex(key) <> '{key}'")},
        "recipe": {"without": ("recipes", f"part <> {part}")},
        "payload": {"parts__payload": f"CASE WHEN hex(key) = '{key}' THEN cast('zz' AS binary) ELSE payload END"},
    }
    for name, how in damage.items():
        copied(spark, a, f"{tmp_path}/{name}", **how)
        with pytest.raises(Exception, match="lost|altered"):
            read_ids(spark, f"{tmp_path}/{name}", PATH).collect()


def test_empty_table(spark, tmp_path):
    write_store(make_docs(spark, []), f"{tmp_path}/s", PATH)
    assert read_digests(spark, f"{tmp_path}/s", PATH).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7])
def test_merkle_root_depends_on_every_leaf(n):
    leaves = [bytes([k]) * 16 for k in range(n)]
    for k in range(n):
        assert merkle_root(leaves) != merkle_root(leaves[:k] + [b"other"] + leaves[k + 1 :])

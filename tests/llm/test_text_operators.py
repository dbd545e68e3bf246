"""Operators on documents against plain Python, on tables with nulls, ties, repeats, long texts and clashing columns."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.llm import kernels as K
from panelkit.llm.op1_substring_dedup import dedup_substrings
from panelkit.llm.op7_jaccard_join import OPTIONS, band_of, bands_of, drop_near_duplicates, near_duplicates, signatures, too_short
from tests.llm import brute

#: Columns named as the operators name theirs inside.
CLASH = "doc_id long, text string, row long, part int, key string, block int, words string, marks int, size double, node long, root string, seeds int, source string"


def make_docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "k", 3, "w", 4, 0.5, 5, "r", 6, "s") for i, t in rows], CLASH)


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)] + ["Ünï", "THE", "the", "a b"]
    base = [[rng.choice(vocab) for _ in range(n)] for n in (260, 180, 90, 70, 55, 50, 49, 12, 6, 5, 4, 1)]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows = []
    for k in range(90):
        w = list(base[k % len(base)])
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if k % 7 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage
        rows.append((k * 3 % 97, rng.choice([" ", "\n", "\t "]).join(w)))
    long = " ".join(rng.choice(vocab) for _ in range(30_000))
    return [*rows, (500, None), (501, ""), (502, " \n\t"), (None, rows[0][1]), (None, None), rows[3], rows[3], (503, long), (504, "x " + long), (505, "la la " * 200), (506, "la la " * 150)]


def test_words_split_on_ascii_white_space_only():
    raw = "a b\x1cc \x0bd\te".encode()
    codes, starts, ends, first = K.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert [raw[s:e] for s, e in zip(starts, ends)] == raw.split() and list(first) == [0, 3] and len(set(codes.tolist())) == 3


def test_substring_dedup_equals_brute_force(spark):
    rows = corpus()
    out = dedup_substrings(make_docs(spark, rows)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, out.collect()), key=key) == sorted(brute.substring_dedup(rows), key=key)


def test_substring_dedup_of_nothing(spark):
    assert dedup_substrings(make_docs(spark, [])).collect() == []


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard_join_equals_brute_force(spark, seed):
    rows = corpus(seed)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, near_duplicates(make_docs(spark, rows)).collect()), key=key) == sorted(brute.jaccard_components(rows), key=key)


def test_jaccard_join_on_the_edge_of_the_threshold(spark):
    """Chains of sets that share exactly three quarters, or just less, of their shingles."""
    rows, k = [], 0
    for n in (8, 9, 12, 16, 24, 40, 64, 100, 257):
        w = [f"{n}-{i}" for i in range(2 * n)]
        for cut in range(0, n, max(1, n // 8)):
            rows.append((k, " ".join(w[cut : cut + n])))
            k += 1
    assert sorted(map(tuple, near_duplicates(make_docs(spark, rows)).collect())) == sorted(brute.jaccard_components(rows))


def test_drop_near_duplicates_keeps_columns_and_smallest_ids(spark):
    rows = corpus()
    docs = make_docs(spark, rows)
    kept = drop_near_duplicates(docs)
    first = {}
    for i, n, c, _ in brute.jaccard_components(rows):
        if n:
            first[c] = min(first.get(c, i), i, key=lambda x: (x is None, x))
    blank = [i for i, n, _, _ in brute.jaccard_components(rows) if not n]
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [*first.values(), *blank]))
    assert near_duplicates(make_docs(spark, [])).collect() == [] and drop_near_duplicates(make_docs(spark, [])).collect() == []


def test_one_row_stays_of_a_group_without_ids(spark):
    words = [" ".join(f"{g}{k}" for k in range(30)) for g in "ab"]
    rows = [(None, words[0]), (None, words[0]), (None, words[0] + " z"), (7, words[1]), (7, words[1]), (7, words[1] + " y"), (None, ""), (None, None), (8, "once")]
    kept = [(r.doc_id, r.text) for r in drop_near_duplicates(make_docs(spark, rows)).collect()]
    assert sorted(str(i) for i, _ in kept) == ["7", "8", "None", "None", "None"]
    assert sum((t or "").startswith("a0") for _, t in kept) == 1


@pytest.mark.parametrize("option", [1, 2, 3])
@pytest.mark.parametrize("mask", [2**64 - 1, 63])
def test_jaccard_join_by_every_kind_of_index(spark, monkeypatch, option, mask):
    """Exact contents, single elements and one-deletion neighbourhoods; with 63, most sets share their first hash with others."""
    from panelkit.llm import op7_jaccard_join as op7

    monkeypatch.setattr(op7, "NODE_MASK", mask)
    rng = random.Random(option)
    rows = []
    for k in range(12):
        base = [f"b{k}-{j}" for j in range(rng.choice([30, 90, 300, 700]))]
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randrange(len(w) // 18)):
                w[rng.randrange(len(w))] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(w)))
    docs = make_docs(spark, rows).select("doc_id", F.lit(1).cast("long").alias("tie"), "text")
    found = op7._classes(docs, index_by=option)
    expected = brute.jaccard_components(rows)
    assert sorted((r.doc_id, r.n_shingles, r.n_links) for r in found.collect()) == sorted((i, n, links) for i, n, _, links in expected)
    assert found.select("root").distinct().count() == len({c for _, _, c, _ in expected})


def test_linked_sets_always_share_a_signature():
    rng = np.random.default_rng(5)
    classes = rng.integers(0, 3, 1 << 18).astype(np.uint8)
    seen = set()
    for _ in range(400):
        n = int(rng.integers(3, 900))
        a = np.unique(rng.integers(1, 2**63, n).astype(np.uint64) * np.uint64(2))
        drop = int(rng.integers(0, len(a) // 4 + 1))
        add = int(rng.integers(0, max(1, (len(a) - drop) - len(a) * 3 // 4 + 1)))
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(1, 2**63, add).astype(np.uint64)]))
        if 100 * len(np.intersect1d(a, b)) < 75 * len(np.union1d(a, b)):
            continue
        band = band_of(max(len(a), len(b)))
        assert band in bands_of(len(a)) and band in bands_of(len(b))
        for option in range(len(OPTIONS)):
            if not too_short(a, band, option) and not too_short(b, band, option):
                seen.add(option)
                assert len(np.intersect1d(signatures(a, band, option, classes), signatures(b, band, option, classes)))
    assert seen == set(range(len(OPTIONS)))


def test_crc_is_that_of_the_ids():
    assert brute.crc_of_ids([1, 2]) == zlib.crc32(b"\x01\0\0\0\x02\0\0\0")


@pytest.mark.parametrize(("few", "block"), [(1, 3), (2, 1000), (10**6, 5)])
def test_families_compared_in_blocks_lose_no_link(spark, monkeypatch, few, block):
    """Copies of one text, some linked and most too far apart, by blocks, by joins and by both."""
    from panelkit.llm import op7_jaccard_join as op7

    monkeypatch.setattr(op7, "FEW", few)
    monkeypatch.setattr(op7, "BLOCK", block)
    rng = random.Random(11)
    base = [f"b{k}" for k in range(140)]
    rows = []
    for k in range(40):
        w = list(base)
        for _ in range(rng.choice([1, 4, 8, 12])):
            w[rng.randrange(len(w))] = f"x{k}-{rng.random()}"
        rows.append((k, " ".join(w)))
    assert sorted(map(tuple, near_duplicates(make_docs(spark, rows)).collect())) == sorted(brute.jaccard_components(rows))


def test_sets_that_share_only_a_passage_leave_their_family(spark, monkeypatch):
    """Texts tied together by one passage aren't sent to the blocks of their family; near copies among them are, and stay linked."""
    from panelkit.llm import op7_jaccard_join as op7

    monkeypatch.setattr(op7, "FEW", 2)
    sent, links = [], op7.family_links
    monkeypatch.setattr(op7, "family_links", lambda nodes, sets: sent.append(nodes.where("kind = 'family'").select("node").distinct().count()) or links(nodes, sets))
    rng, passage = random.Random(4), [f"p{k}" for k in range(130)]
    own = [[f"x{k}-{j}" for j in range(50)] for k in range(30)]
    rows = [(k, " ".join(passage + w)) for k, w in enumerate(own)]
    for k in range(3):
        w = passage + own[k]
        w[rng.randrange(20, 120)] = f"y{k}"
        rows.append((100 + k, " ".join(w)))
    assert sorted(map(tuple, near_duplicates(make_docs(spark, rows)).collect())) == sorted(brute.jaccard_components(rows))
    assert 0 < sent[0] < 12


def test_sets_of_a_slice_are_hashed_and_indexed_together(monkeypatch):
    """Many short texts take no more calls than one: what a set costs is its elements, and each has what it has on its own."""
    from types import SimpleNamespace

    import pyarrow as pa

    from panelkit.llm import op7_jaccard_join as op7

    rng, shared = random.Random(6), SimpleNamespace
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(n)) for n in [1, 4, *rng.choices([5, 40, 70, 200], k=298)]]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "text": texts})
    classes, wanted = np.random.default_rng(6).integers(0, 4, 1 << 18).astype(np.uint8), np.full(1 << 20, 2**64 - 1, np.uint64)
    alone = [(np.unique(values), op7.set_hashes(values, bounds, op7.NODE_MASK)[0][0]) for text in texts for _, values, bounds in op7._sets(pa.RecordBatch.from_pydict({"doc_id": [0], "text": [text]}))]
    calls, mix = [], K.mix
    monkeypatch.setattr(K, "mix", lambda x: calls.append(len(x)) or mix(x))
    for option in range(len(OPTIONS)):
        calls.clear()
        found = list(op7._entries(iter([batch]), dict.fromkeys(range(op7.BANDS), option), shared(value=classes), shared(value=wanted), lambda values, bounds: op7.set_hashes(values, bounds, op7.NODE_MASK)[0]))
        assert len(calls) < 50
        expected = {(int(sig), int(node)) for values, node in alone for band in bands_of(len(values)) for sig in signatures(values, band, option, classes)}
        assert {(int(s), int(n)) for sig, node in found for s, n in zip(sig, node)} == expected


@pytest.mark.parametrize(("most", "held"), [(1 << 22, 1 << 20), (50, 30)])
def test_entries_of_one_node_are_written_nowhere(spark, monkeypatch, most, held):
    """With a bitmap that rules nothing out, as on a large input, only what two nodes have is kept; ranges and wide entries in parts."""
    from collections import defaultdict

    import pyarrow as pa

    from panelkit.llm import op7_jaccard_join as op7

    monkeypatch.setattr(op7, "MOST", most)
    monkeypatch.setattr(op7, "HELD_ENTRIES", held)
    monkeypatch.setattr(op7, "FEW", 4)
    rng, share = random.Random(3), spark.sparkContext.broadcast
    passage, other = [f"p{k}" for k in range(30)], [f"q{k}" for k in range(30)]
    rows = [(k, " ".join([f"x{k}-{j}" for j in range(60)] + (passage if k < 20 else other if k < 23 else []))) for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(5)]
    rng.shuffle(rows)
    classes, full = np.zeros(1 << 18, np.uint8), np.full(1 << 20, 2**64 - 1, np.uint64)
    options, node_of = dict.fromkeys(range(op7.BANDS), 2), lambda values, bounds: op7.set_hashes(values, bounds, 2**64 - 1)[0]
    docs = make_docs(spark, rows).select("doc_id", "text").repartition(5)
    expected = defaultdict(set)
    for sig, node in op7._entries(iter([pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in rows])]), options, share(classes), share(full), node_of):
        for s, n in zip(sig.view(np.int64).tolist(), node.tolist()):
            expected[s].add(n)
    expected = {s: n for s, n in expected.items() if len(n) > 1}
    found, tied = defaultdict(set), defaultdict(set)
    rows_out = op7.indexed(docs, options, share(classes), share(full), node_of, share(full), 26, 2).collect()
    for r in rows_out:
        found[r.sig].add(r.node)
        tied[r.sig].add(frozenset((r.node, r["head"])))
        assert r["head"] in expected[r.sig] and (r.width == len(expected[r.sig]) if len(expected[r.sig]) <= 4 else r.width > 4)
    widths = {len(n) for n in expected.values()}
    assert found == expected and min(widths) < 4 and max(widths) == 20
    for s, links in tied.items():  # heads of several parts are tied to each other
        reached = {min(expected[s])}
        while len(more := reached.union(*(x for x in links if x & reached))) > len(reached):
            reached = more
        assert reached == expected[s]
    assert most > 50 or len(rows_out) > sum(map(len, expected.values()))


@pytest.mark.parametrize("rows_a_batch", [1, 2, 3, 7, 1000])
def test_groups_are_compared_from_one_stream(rows_a_batch):
    """Groups of any size, cut by batches anywhere, next to groups that differ in one part of the key only."""
    import pyarrow as pa

    from panelkit.llm.op7_jaccard_join import compare_groups

    rng, rows, expected_n, expected_tied = random.Random(8), [], {}, set()
    for key in [("family", 1, 0, 0), ("group", 1, 0, 0), ("group", 2, 0, 0), ("group", 2, 0, 1), ("group", 2, 1, 1), ("group", 3, 0, 0), ("group", 4, 0, 1)]:
        base, members = rng.sample(range(10**9), 60), []
        for _ in range(rng.choice([2, 3, 9])):
            own = sorted({*rng.sample(base, 60 - rng.choice([0, 3, 7, 20])), *rng.sample(range(10**9), rng.choice([0, 2]))})
            members.append((len(rows) + len(members), rng.randrange(1, 4), own, 0 if key[2] == key[3] else rng.randrange(2)))
        rows += [(*key, side, node, docs, False, 0, 0, False, False, own) for node, docs, own, side in members]
        for node, _, own, side in members:
            near = [(m, d) for m, d, o, s in members if m != node and (key[2] == key[3] or s != side) and 100 * len({*o} & {*own}) >= 75 * len({*o} | {*own})]
            if near:
                expected_n[node] = sum(d for _, d in near)
            expected_tied |= {frozenset((node, m)) for m, _ in near}
    names = ["kind", "family", "p", "q", "side", "node", "docs", "guest", "own", "above", "has_own", "has_above", "set"]
    table = pa.table(dict(zip(names, map(list, zip(*rows)))))
    found = [r for out in compare_groups(iter(table.to_batches(rows_a_batch))) for r in out.to_pylist()]
    assert {r["a"]: r["n"] for r in found if r["b"] is None} == expected_n
    forest = {frozenset((r["a"], r["b"])) for r in found if r["b"] is not None}

    def components(edges):
        root = {node: node for edge in expected_tied for node in edge}
        for _ in root:
            for edge in edges:
                least = min(root[x] for x in edge)
                root.update(dict.fromkeys(edge, least))
        return root

    assert components(forest) == components(expected_tied) and list(compare_groups(iter([]))) == []

"""Shards, fingerprints, mixing, URL filters, private data, toxicity, decontamination."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.llm.op3_shards import assign_shards, level, pack, write_shards
from panelkit.llm import op4_fingerprints as op4
from panelkit.llm import op5_mixing as op5
from panelkit.llm.op4_fingerprints import containment, fingerprint, range_of
from panelkit.llm.op5_mixing import mix_plan, mix_sources, realise
from panelkit.llm.op6_url_filters import RULES, judge_urls, rules_table
from panelkit.llm.op8_private_data import KINDS, find_all, find_base, find_private
from panelkit.llm.op9_toxicity import automaton, drop_toxic, features, fit_curve, fold, learn_exceptions, learn_lexicon, score_toxicity, training_rows, weigh
from panelkit.llm.op10_decontaminate import align, drop_leaks, find_leaks, least_score
from tests.llm import brute
from tests.llm.test_text_operators import corpus, make_docs


def test_shards_balance_everything_and_number_rows(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["a", "bcd", "efghij"]) for _ in range(int(rng.paretovariate(1.2) * 12) % 900))) for k in range(2000)]
    rows += [(2000 + k, "one text that a third of all rows have " * 4) for k in range(1000)] + [(None, None), (None, ""), rows[5], rows[5]]
    out = assign_shards(make_docs(spark, rows), 24).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in out) == sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    assert sorted(by) == list(range(24))
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    for value, most in ((lambda r: r.size, 1.02), (lambda r: r.tokens, 1.05), (lambda r: 1, 1.05)):
        sums = [sum(map(value, rs)) for rs in by.values()]
        assert max(sums) <= most * sum(sums) / 24
    shards = defaultdict(set)
    for r in out:
        shards[r.text_crc32, r.size].add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) == 1  # only the group that no shard holds
    assert assign_shards(make_docs(spark, [])).collect() == []


def test_shards_written_hold_whole_rows(spark, tmp_path):
    docs = make_docs(spark, corpus())
    write_shards(docs, f"{tmp_path}/s", 4)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.schema["doc"].dataType.fieldNames() == docs.columns and back.count() == docs.count()


def test_packing_equals_one_item_and_shard_at_a_time():
    rng = np.random.default_rng(4)
    for _ in range(20):
        demand = rng.pareto(1.5, (int(rng.integers(1, 90)), 3))
        demand = demand / demand.sum(0)
        assert list(pack(demand, 7)) == brute.pack(demand.tolist(), 7)


def test_exchanges_even_out_every_dimension():
    rng = np.random.default_rng(7)
    demand = rng.pareto(2.5, (400, 3))
    demand = demand / demand.sum(0)
    spread = lambda shard: max(np.ptp(np.bincount(shard, d, 8)) for d in demand.T)
    before = rng.integers(0, 8, 400).astype(np.int32)
    after = level(demand, before, 8)
    assert spread(after) < 0.01 < spread(before) and len(after) == 400


def test_equal_texts_stay_together_unless_no_shard_holds_them(spark):
    rng = random.Random(3)
    rows = [(k, f"t{k} " + "w " * rng.randrange(60)) for k in range(900)]
    groups = {"large " * 30: 300, "middle one " * 9: 60, "small " * 5: 30, "x": 25, None: 20}
    rows += [(1000 * (j + 1) + k, t) for j, (t, n) in enumerate(groups.items()) for k in range(n)]
    out = assign_shards(make_docs(spark, rows), 12).collect()
    total, shards = defaultdict(int), defaultdict(set)
    for r in out:
        total[r.text_crc32] += np.array([r.size, r.tokens, 1])
        shards[r.text_crc32].add(r.shard)
    whole = sum(total.values())
    for t, found in shards.items():
        assert len(found) <= max(1, math.ceil((total[t] / whole).max() * 12 / 0.9)), "as few parts as hold it"
    assert [t for t, s in shards.items() if len(s) > 1] == [zlib.crc32(b"large " * 30)]
    sums = [sum(r.size for r in out if r.shard == s) for s in range(12)]
    assert max(sums) < 1.02 * sum(sums) / 12


def test_a_very_long_text_is_one_row_of_a_shard(spark):
    out = assign_shards(make_docs(spark, [(1, "word " * 400_000), *((k, f"t{k}") for k in range(2, 60))]), 4).collect()
    assert sorted(r.shard for r in out if r.doc_id == 1) == [next(r.shard for r in out if r.size > 10**6)] and len(out) == 59


def test_packing_prefers_the_highest_dot_product():
    assert list(pack(np.array([[0.5, 0.0], [0.0, 0.5], [0.5, 0.0], [0.0, 0.5]]), 2)) == [0, 0, 1, 1]


def fingerprints(spark, rows):
    out = fingerprint(make_docs(spark, rows))
    return out.withColumns({"near_edited": containment("sketch", "edited_sketch"), "near_next": containment("sketch", "next_sketch")}).collect()


def test_fingerprints_edit_and_order(spark):
    rows = [(i, t) for i, t in corpus() if i is not None]
    rows = list({i: (i, t) for i, t in rows}.values())
    found = {r.doc_id: r for r in fingerprints(spark, rows)}
    ids = sorted((i for i, _ in rows), reverse=True)
    text = {i: t or "" for i, t in rows}
    for i, following in zip(ids, [*ids[1:], ids[0]]):
        n, r = len(text[i]), found[i]
        assert r.n_chars == n and r.edited_text == text[i][: n - n // 3] + text[following][: n // 3]
        assert r.next_sketch == found[following].sketch and r.sketch == brute.sketch(text[i])
        assert r.edited_sketch == brute.sketch(r.edited_text)
        both = len(set(r.sketch) & set(r.edited_sketch))
        assert r.near_edited == (both / min(len(r.sketch), len(r.edited_sketch)) if r.sketch and r.edited_sketch else 0)


@pytest.mark.parametrize("step_rows", [1, 7])
def test_order_runs_through_ranges_and_steps(spark, monkeypatch, step_rows):
    """Clustered ids, ties and null ids: every row is followed by the next by descending id, then by descending hash."""
    monkeypatch.setattr(op4, "STEP_ROWS", step_rows)
    monkeypatch.setattr(op4, "RANGES", 5)
    rng = random.Random(6)
    ids = [*range(40), *(rng.randrange(-(2**62), 2**62) for _ in range(40)), *[7] * 5, *[None] * 9]
    rows = [(i, f"text {k} of {rng.random()}") for k, i in enumerate(ids)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, brute.xxhash_chain([("str", r[1])])), reverse=True)
    expected = sorted((str(i), t[: len(t) - len(t) // 3] + u[: len(t) // 3]) for (i, t), (_, u) in zip(order, [*order[1:], order[0]]))
    assert sorted((str(r.doc_id), r.edited_text) for r in fingerprint(make_docs(spark, rows)).collect()) == expected


def test_sketch_of_joined_texts_is_the_union(spark):
    texts = [" ".join(f"{g}{k}" for k in range(n)) for g, n in (("a", 5), ("b", 9), ("c", 400), ("d", 3000))]
    found = {r.doc_id: set(r.sketch) for r in fingerprint(make_docs(spark, [*enumerate(texts), (9, " ".join(texts))])).collect()}
    inside = set().union(*(found[k] for k in range(4)))
    assert inside <= found[9] and len(found[9] - inside) <= 3 * 4  # and the runs across the joints

def test_fingerprints_estimate_containment(spark):
    rng = random.Random(8)
    page = [f"p{rng.random()}" for _ in range(600)]
    book = [f"b{rng.random()}" for _ in range(6000)] + page
    found = {r.doc_id: r for r in fingerprints(spark, [(3, " ".join(page)), (2, " ".join(book)), (1, " ".join(f"o{k}" for k in range(9000)))])}
    assert found[3].near_next == 1.0 and abs(found[2].near_edited - 2 / 3) < 0.05 and found[2].near_next == 0.0


def test_fingerprints_of_ties_nulls_and_nothing(spark):
    assert len(fingerprints(spark, corpus())) == len(corpus())
    one = fingerprints(spark, [(1, "ein Text für sich")])
    assert one[0].edited_text == "ein Text für sich"[:12] + "ein T" and one[0].near_next in (0.0, 1.0)
    long = fingerprints(spark, [(1, "ein langer Text " * 100_000 + "und noch ein anderer dazu, der viele Wörter hat")])
    assert long[0].near_next == 1.0 and long[0].n_chars > 10**6
    assert fingerprints(spark, []) == []


def test_ranges_count_bounds(spark):
    bounds = np.unique(np.random.default_rng(1).integers(-50, 5000, 300))
    for b in (bounds[:0], bounds[:5], bounds):
        out = spark.range(-60, 5100, 7).select("id", range_of("id", b).alias("r")).collect()
        assert all(r.r == (b <= r.id).sum() for r in out)


def sources(spark):
    rng = random.Random(4)
    rows = [(k, f"w{k} " * rng.randrange(1, 60), rng.choices(["a", "b", "c", None], [60, 25, 10, 5])[0]) for k in range(3000)]
    return spark.createDataFrame([(i, t, s, 1, "k", 2) for i, t, s in [*rows, (None, None, "b"), (7, "", "c"), rows[0]]], "doc_id long, text string, source string, epoch int, key string, weight int"), rows


def test_mixing_meets_entropy_and_budget(spark):
    docs, _ = sources(spark)
    budget = 60_000
    plan = mix_plan(docs, target_entropy=0.9, budget=budget)
    weights = {r.source: r.weight for r in plan.collect()}
    entropy = -sum(w * math.log(w) for w in weights.values()) / math.log(len(weights))
    assert abs(sum(weights.values()) - 1) < 1e-9 and abs(entropy - 0.9) < 1e-4
    sums = Counter()
    for r in realise(docs, plan).selectExpr("source", "regexp_count(coalesce(doc.text, ''), '[^ ]+') + 1 AS n", "position").collect():
        sums[r.source] += r.n
        assert 0 <= r.position <= 1
    assert all(abs(sums[s] - w * budget) <= 120 for s, w in weights.items())


@pytest.mark.parametrize("row", [1, 2, 4096])
def test_mixing_takes_what_the_definition_says(spark, monkeypatch, row):
    """Weights, budgets and every document taken, against a plain version; many blocks, nulls, ties, one long text."""
    monkeypatch.setattr(op5, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(op5, "ROW", row)
    docs, _ = sources(spark)
    docs = docs.union(spark.createDataFrame([(9000, "long " * 3000, "a", 1, "k", 2)], docs.schema))
    budget = 60_000
    plan = mix_plan(docs, target_entropy=0.9, budget=budget, seed=5)
    rows = [(r.doc_id, r.text, r.source or "\0") for r in docs.collect()]
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split()) + 1
    share = {s: n / sum(size.values()) for s, n in size.items()}

    def weights(x):
        z = sum(p**x for p in share.values())
        return {s: p**x / z for s, p in share.items()}

    low, high = 0.0, 4.0
    for _ in range(60):
        mid = (low + high) / 2
        entropy = -sum(w * math.log(w) for w in weights(mid).values()) / math.log(len(share))
        low, high = (low, mid) if entropy <= 0.9 else (mid, high)
    found = {r.source: r for r in plan.collect()}
    expected = []
    for s, w in weights(high).items():
        r = found[s]
        assert abs(r.weight - w) < 1e-4 and r.met and abs(r.entropy - 0.9) < 1e-4 and abs(r.exponent - high) < 1e-4
        assert r.epochs == int(r.repeats + 1e-9) and r.rest == round((r.repeats - r.epochs) * size[s])
        own = [(i, t) for i, t, x in rows if x == s]
        keyed = []
        for i, t in own:
            text = None if t is None else brute.xxhash_chain([("str", t)])
            key = brute.xxhash_chain([("int", 5), ("int", r.epochs), ("long", i), ("long", 42 if t is None else text)])
            keyed.append((key % r.blocks, key, i, len((t or "").split()) + 1))
        sums, taken = 0, []
        by_block = Counter()
        for b, _, _, n in keyed:
            by_block[b] += n
        for b in sorted(by_block):
            inside = sorted(k for k in keyed if k[0] == b)
            if sums + by_block[b] < r.rest:
                taken += inside
            elif sums < r.rest:
                upto = sums
                for k in sorted({k[1] for k in inside}):
                    tied = [x for x in inside if x[1] == k]
                    upto += sum(x[3] for x in tied)
                    if upto - tied[0][3] / 2 <= r.rest:
                        taken += tied
            sums += by_block[b]
        expected += [(str(i), r.epochs) for _, _, i, _ in taken] + [(str(i), e) for i, _ in own for e in range(r.epochs)]
    assert sorted((str(r.doc_id), r.epoch) for r in realise(docs, plan, seed=5).select("doc.doc_id", "epoch").collect()) == sorted(expected)


def test_a_target_out_of_reach_is_told(spark):
    docs = spark.createDataFrame([(k, "a b c", "xyz"[k % 3]) for k in range(30)], "doc_id long, text string, source string")
    with pytest.warns(UserWarning, match="no exponent meets"):
        plan = mix_plan(docs, target_entropy=0.5).collect()
    assert not any(r.met for r in plan) and all(abs(r.entropy - 1) < 1e-9 for r in plan)
    with pytest.warns(UserWarning, match="no exponent meets"):
        assert not any(r.met for r in mix_plan(docs, max_repeats=0.5).collect())
    uneven = docs.union(spark.createDataFrame([(99, "d", "x")], docs.schema))
    plan = mix_plan(uneven, target_entropy=0.2).collect()  # needs an exponent far over 4
    assert all(r.met and abs(r.entropy - 0.2) < 1e-2 and r.exponent > 4 for r in plan)


def test_mixing_keeps_within_repetitions(spark):
    docs, rows = sources(spark)
    plan = {r.source: r for r in mix_plan(docs, max_repeats=1.5).collect()}
    assert abs(max(r.repeats for r in plan.values()) - 1.5) < 1e-3 and abs(min(r.repeats for r in plan.values()) - 1) < 1e-9
    mixed = mix_sources(docs, max_repeats=1.5)
    assert mixed.columns == docs.columns
    n = Counter(r.doc_id for r in mixed.where("doc_id is not null").collect())
    assert set(n) == {i for i, _, _ in rows} and max(n.values()) <= 4  # ids 0 and 7 have two rows
    assert mix_sources(docs.limit(0), max_repeats=1.5).collect() == []
    with pytest.raises(ValueError):
        mix_sources(docs)


def test_url_filters_equal_brute_force(spark):
    rng = random.Random(6)
    hosts = ["a.net", "net", "x.a.net", "A.NET", "org", "b.org", "", "example.net", "deep.x.example.net", "com", ".net", "net."]
    paths = ["", "/", "/en", "/en/", "/en/a/b", "/fr/x", "/de/", "/EN/", "/en/a", "/é/ü"]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#x://y', '?'])}" for _ in range(900)] + [None, "", "no scheme/net/", "a://b://net/", "http://net\n/en/"]
    urls += ["http://hot.net/en/a/b/c"] * 700
    rules = (*RULES, ("allow", "net", "/en/"), ("block", "net", "/en/a/"), ("allow", "net", "/en/a/b/"), ("block", "a.net", "/"), ("allow", "x.a.net", "/e"), ("block", "example.net", "/é"), ("block", "b.org", ""))
    pages = spark.createDataFrame([(k % 1500 if k % 90 else None, u, "h", "r", 1) for k, u in enumerate(urls)], "page_id long, url string, host string, rule string, depth int")
    out = judge_urls(pages, rules_table(spark, rules)).collect()
    expected = [(k % 1500 if k % 90 else None, *brute.judge(u, rules)) for k, u in enumerate(urls)]
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, expected))
    assert judge_urls(pages.limit(0), rules_table(spark)).collect() == []
    long = f"http://{'a.' * 60}net/" + "en/" * 100_000
    assert [tuple(r) for r in judge_urls(spark.createDataFrame([(1, long)], "page_id long, url string"), rules_table(spark, rules)).collect()] == [(1, *brute.judge(long, rules))]
    assert {r.verdict for r in judge_urls(pages, rules_table(spark).limit(0), "block").collect()} == {"block"}


BASE_TEXTS = [
    "mail a.b+c@ex-ample.co.uk, x@y and @z.com or a@b@c.de.", "ip 1.2.3.4 and 256.1.1.1, 1.2.3.4.5.6.7.8 999999999999.1.1.1 00001.2.3.0255",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112, 4111  1111 1111 1111; 378282246310005 12345678901234567890", "call +1 (771) 555-1655 or +49.30.1234567, +1 2, + 1 771 555 1655, +123456789012345678",
    "é@é.fr ü.a@b.c 🙂 +33 1 23 45 67 89", "", None, "no data", "a" * 5000, "1" * 5000, "@" * 3000, "+1" + " " * 3000, "a.b" * 2000 + "@x.y",
]


def test_base_spans_equal_plain_patterns(spark):
    out = find_private(make_docs(spark, list(enumerate(BASE_TEXTS)))).collect()
    for r in out:
        assert [(s["kind"], s["start"], s["end"]) for s in r.spans if s["base"]] == brute.base_spans(BASE_TEXTS[r.doc_id])
    assert len(out) == len(BASE_TEXTS) and find_private(make_docs(spark, [])).collect() == []


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("write to john.doe [at] example [dot] com today", "email", "john.doe [at] example [dot] com"),
        ("write to john(at)example.org today", "email", "john(at)example.org"),
        ("write to john at example dot com today", "email", "john at example dot com"),
        ("write to jоhn@exаmple.com today", "email", "jоhn@exаmple.com"),
        ("write to ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ today", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("é write to jo\u200bhn@exam\u200bple.com today", "email", "jo\u200bhn@exam\u200bple.com"),
        ("ring plus four nine three zero one two three four five six seven now", "phone", "plus four nine three zero one two three four five six seven"),
        ("ring ＋４９ ３０ １２３４５６７ now", "phone", "＋４９ ３０ １２３４５６７"),
        ("at one nine two dot one six eight dot one dot one now", "ip", "one nine two dot one six eight dot one dot one"),
        ("card four one one one one one one one one one one one one one one one ends", "card", "four one one one one one one one one one one one one one one one"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, part):
    start = text.index(part)
    assert (KINDS.index(kind), start, start + len(part), False) in find_all(text)


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("write to john.smith at example.com now", "email", "john.smith at example.com"),
        ("write to anna@example punkt de now", "email", "anna@example punkt de"),
        ("write to john dot smith@example.com now", "email", "john dot smith@example.com"),
        ("host 192 dot 168 dot 10 dot 12 now", "ip", "192 dot 168 dot 10 dot 12"),
        ("host 192 punto 168 punto 10 punto 12 now", "ip", "192 punto 168 punto 10 punto 12"),
        ("host 192[.]168[.]10[.]12 now", "ip", "192[.]168[.]10[.]12"),
        ("host 192 (dot) 168 (dot) 10 (dot) 12 now", "ip", "192 (dot) 168 (dot) 10 (dot) 12"),
        ("card 4111 1111 one one 11 1111 now", "card", "4111 1111 one one 11 1111"),
        ("ring plus 49 one 7 two 3 four 5 six 7 now", "phone", "plus 49 one 7 two 3 four 5 six 7"),
        ("escribe a john arroba ejemplo punto com hoy", "email", "john arroba ejemplo punto com"),
        ("merci a john (arobase) exemple point fr hier", "email", "john (arobase) exemple point fr"),
    ],
)
def test_no_disguise_needs_another_beside_it(text, kind, part):
    start = text.index(part)
    assert (KINDS.index(kind), start, start + len(part), False) in find_all(text)
    assert {s[:3] for s in find_all(text) if not s[3]} == {s[:3] for s in find_all(f"{text} \u200b") if not s[3]}


GLYPHS = {"a": "а", "e": "е", "o": "о", "p": "р", "c": "с", "x": "х", "i": "і"}
DIGITS = "zero one two three four five six seven eight nine".split()


def disguised(rng, kind):
    """An identifier of the kind and a form of it in which every character or sign may be disguised."""
    word = lambda: "".join(rng.choice("abcdeopxik") for _ in range(rng.randrange(3, 9)))
    if kind == "email":
        glyph = lambda w: "".join(GLYPHS.get(c, c) if rng.random() < 0.3 else c + "\u200b" * (rng.random() < 0.1 and k < len(w) - 1) for k, c in enumerate(w))
        at, dot = rng.choice([" [at] ", "(at)", " at ", "@", " {at} "]), rng.choice([" dot ", "[dot]", " (dot) ", "."])
        return glyph(word()) + at + glyph(word()) + dot + "com"
    if kind == "phone":
        digits = "49" + "".join(str(rng.randrange(10)) for _ in range(9))
        spelled = " ".join(DIGITS[int(d)] if rng.random() < 0.6 or k == 3 else d for k, d in enumerate(digits))
        return rng.choice(["plus ", "+"]) + spelled
    parts = [str(rng.randrange(10, 256)) for _ in range(4)]
    return rng.choice([" dot ", "[.]", " (dot) ", " punto "]).join(parts)


@pytest.mark.parametrize("seed", range(6))
def test_added_spans_equal_what_was_planted(spark, seed):
    """Disguised identifiers among clean words of the alphabet: found are these spans, whole, and nothing else; also in a very
    long text."""
    rng = random.Random(seed)
    rows, expected = [], {}
    for k in range(25):
        text, spans = "", []
        for _ in range(rng.randrange(1, 5)):
            text += " ".join("".join(rng.choice("qwrtzüñ") for _ in range(4)) for _ in range(3 + 20_000 * (k == 7))) + "; "
            kind = rng.choice(["email", "phone", "ip"])
            form = disguised(rng, kind)
            spans.append((kind, len(text), len(text) + len(form)))
            text += form + "; "
        rows.append((k, text))
        expected[k] = sorted(spans)
    for r in find_private(make_docs(spark, rows)).collect():
        assert sorted((KINDS[s["kind"]], s["start"], s["end"]) for s in r.spans) == expected[r.doc_id]


def test_long_runs_of_signs_are_read_in_linear_time():
    for text in ("1" + "(.)" * 400 + "x", "one " + "( dot ) " * 400 + "x", "dot " * 2000, "a at b " * 2000, "1" + " " * 3000 + "one"):
        assert find_all(text) == []


@pytest.mark.parametrize("text", ["we met at noon dot dot dot", "heat at the dot of nine", "one two three four", "она пришла домой", "look at this. dot com was a boom", "seven eight at nine", "we met (at) 3.30 pm", "score [at] 2.1 of 3"])
def test_clean_texts_stay_clean(text):
    assert find_all(text) == []


def test_base_spans_stay_beside_added_ones():
    text = "a@b.com and c [at] d [dot] com"
    assert {s[:3] for s in find_all(text)} >= set(find_base(text)) and len(find_all(text)) == 2


def test_lexicon_folds_disguises_and_spares_phrases():
    words = automaton({" idiot": 5.0, f"{fold(' stupid ')}": 4.0, fold(" trash "): 3.0}, ("trash can",))
    assert weigh("an IDIOT, idiotic; stupidly stupid.", words)[0] == 14.0
    assert weigh("1d10t іdіоt ｓｔｕｐｉｄ $tupid", words)[0] == 18.0
    assert weigh("a trash  can and trash", words)[0] == 3.0 and weigh("", words) == (0, 0)
    assert weigh("trash can " * 200_000, words) == (0.0, 400_000)  # in linear time


def test_exceptions_are_learned(spark):
    rng = random.Random(5)
    plain = lambda n: [f"p{rng.randrange(500)}" for _ in range(n)]
    rows = [(k, " ".join([*plain(6), "blorg", f"t{rng.randrange(99)}", *plain(6)]), 1) for k in range(60)]
    rows += [(100 + k, " ".join(plain(20) + ["blorg", "fish"] * (k < 2) + plain(3)), 0) for k in range(300)]
    lexicon = {fold(" blorg "): 4.0}
    training = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert learn_exceptions(training, lexicon, least_docs=3) == []
    more = training.union(spark.createDataFrame([(900 + k, f"a{k} blorg fish b{k}", 0) for k in range(9)], training.schema))
    assert learn_exceptions(more, lexicon) == [fold("blorg fish")] and learn_exceptions(more, {}) == []


def test_toxicity_equals_its_definition(spark):
    """Scores of the operator against lexicon, exceptions and curve applied text by text; ties and long texts among them."""
    rows = toxic_rows()
    docs = make_docs(spark, [(i, t) for i, t, _ in rows] + [(None, None), (9000, "blorgface " + "so long " * 60_000), rows[0][:2], (rows[1][0] + 5000, rows[1][1])])
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    training = training_rows(docs, labels, 10**6)
    lexicon = learn_lexicon(training)
    seen = {(t, x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    assert {(r.text, r.toxic) for r in training.collect()} == seen
    counts = {f: [sum(f in features(t) for t, x in seen if x == c) for c in (0, 1)] for f in lexicon}
    n = [sum(x == c for _, x in seen) for c in (0, 1)]
    for f, w in lexicon.items():
        odds = (counts[f][1] + 0.5) / (n[1] + 1) * (n[0] + 1) / (counts[f][0] + 0.5)
        assert abs(w - math.log(odds)) < 1e-9 and odds >= 20
    words = automaton(lexicon, learn_exceptions(training, lexicon))
    facts = np.array([(*weigh(t, words), x) for t, x in seen], float)
    curve = fit_curve(*facts.T)
    for r, text in zip(sorted(score_toxicity(docs, labels).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0)), [t or "" for _, t in sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0))]):
        w, size = weigh(text, words)
        z = curve[0] + curve[1] * math.log1p(w) + curve[2] * math.log1p(100 * w / (size + 20))
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-6
    kept = drop_toxic(docs, labels)
    scored = score_toxicity(docs, labels)
    assert kept.columns == docs.columns and kept.count() == scored.where("predicted = 0").count() < docs.count()


def toxic_rows():
    rng = random.Random(9)
    vocab = [f"wo{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for k in range(900):
        w = [rng.choice(vocab) for _ in range(rng.randrange(5, 200))]
        toxic = int(k % 5 == 0)
        for _ in range(toxic * rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = rng.choice(["blorgface", "zilchbrain", f"mumpf{rng.choice(vocab)}"])
        rows.append((k, " ".join(w), toxic))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows()
    docs = make_docs(spark, [(i, t) for i, t, _ in rows] + [(None, None), (9000, ""), (9001, None), rows[0][:2]])
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(None, 1), (3, None), (5, 0), (8888, 1)], "doc_id long, toxic int")
    out = score_toxicity(docs, labels).collect()
    assert len(out) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    label = {i: x for i, _, x in rows}
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert sum(r.predicted == label.get(r.doc_id, 0) for r in held) / len(held) > 0.98


def test_toxicity_without_rows_or_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert score_toxicity(make_docs(spark, []), labels).collect() == []
    assert {r.score for r in score_toxicity(make_docs(spark, [(1, "a"), (2, None)]), labels).collect()} == {0.5}


def test_alignment_equals_the_cell_by_cell_version():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 15)), rng.integers(0, 5, rng.integers(0, 30))
        assert align(a, b)[0] == brute.local_score(a.tolist(), b.tolist())


def leak_rows():
    rng = random.Random(12)
    vocab = ["the", "of", "and", "to"] * 60 + [f"v{k}" for k in range(900)]
    items = [[rng.choice(vocab) for _ in range(rng.randrange(15, 60))] for _ in range(20)]
    rows, expected = [], set()
    for k in range(300):
        w = [rng.choice(vocab) for _ in range(rng.randrange(30, 300))]
        if k % 6 == 0:
            j = rng.randrange(20)
            copy = [x for x in items[j] if rng.random() > 0.04 * (k % 12 == 0)]
            if k % 18 == 0:
                copy[len(copy) // 2 : len(copy) // 2] = ["inserted", "words"]
            w[5:5] = [c.upper() + "," for c in copy] if k % 24 == 0 else copy
            expected.add((k, j))
        rows.append((k, " ".join(w)))
    return rows, items, expected


def test_leaks_are_found_and_nothing_else(spark):
    rows, items, expected = leak_rows()
    docs = make_docs(spark, [*rows, (None, " ".join(items[3])), (900, None), (901, ""), rows[0]])
    benchmark = spark.createDataFrame([(j, " ".join(w), 1) for j, w in enumerate(items)] + [(50, None, 1), (51, "", 1), (52, "too short", 1)], "item_id long, text string, doc_id int")
    out = find_leaks(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in out} == expected | {(None, 3)}
    text = dict(rows)
    for r in out:
        if r.doc_id is not None:
            words = [w.strip(",").lower() for w in text[r.doc_id].split()]
            assert r.score == brute.local_score(items[r.item_id], words) >= least_score(len(items[r.item_id]))
    kept = drop_leaks(docs, benchmark)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in expected} | {900, 901}  # the copy without an id goes, too
    assert find_leaks(docs.limit(0), benchmark).collect() == [] and find_leaks(docs, benchmark.limit(0)).collect() == []


def test_short_items_are_found(spark):
    """Items of four words and more wherever they stand, shorter ones only as whole documents."""
    items = ["one", "two words", "three word item", "an item of four", "this item has five words", "and this one has all six"]
    rows = [(10 * k + j, t) for k, item in enumerate(items) for j, t in enumerate((item.upper() + "!", f"before it {item} and after", item.rsplit(" ", 1)[0] + " other"))]
    docs = make_docs(spark, [*rows, (None, "two, words"), (None, None)])
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.score) for r in find_leaks(docs, benchmark).collect()}
    assert found == {(10 * k, k, len(i.split())) for k, i in enumerate(items)} | {(10 * k + 1, k, len(i.split())) for k, i in enumerate(items) if k > 2} | {(None, 1, 2)}
    assert sorted(str(r.doc_id) for r in drop_leaks(docs, benchmark).collect()) == sorted([*(str(i) for i, _ in rows if i not in {x[0] for x in found}), "None"])


def test_leaks_equal_the_cell_by_cell_alignment_of_every_pair(spark):
    """Small vocabularies, so that chance matches, ties and gaps abound; long texts and rows that repeat."""
    rng = random.Random(31)
    items = [[f"w{rng.randrange(60)}" for _ in range(n)] for n in (4, 5, 7, 9, 14, 26, 40)]
    rows = []
    for k in range(60):
        w = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 80))]
        item = list(rng.choice(items))
        for _ in range(rng.randrange(3)):
            item[rng.randrange(len(item))] = f"w{rng.randrange(60)}"
        w[len(w) // 2 : len(w) // 2] = item
        rows.append((k, " ".join(w)))
    rows += [(70, " ".join(f"x{k}" for k in range(60_000)) + " " + " ".join(items[-1])), rows[0]]
    docs, benchmark = make_docs(spark, rows), spark.createDataFrame([(j, " ".join(i)) for j, i in enumerate(items)], "item_id long, text string")
    seeds = {j: {tuple(i[k : k + 4]) for k in range(len(i) - 3)} for j, i in enumerate(items)}
    expected = []
    for i, text in rows:
        w = text.split()[-200:]
        runs = {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
        for j, item in enumerate(items):
            if runs & seeds[j] and (score := brute.local_score(item, w)) >= least_score(len(item)):
                expected.append((i, j, score))
    assert sorted((r.doc_id, r.item_id, r.score) for r in find_leaks(docs, benchmark).collect()) == sorted(expected)


@pytest.mark.parametrize("around", [0, 1])
def test_leaks_of_frequent_seeds_are_found(spark, around):
    """One intact copy and many edited ones, equal or each in its own text: the seeds of the edited ones are far more frequent than the item's others."""
    rng = random.Random(21)
    item = [f"i{k}" for k in range(36)]
    edited = [f"e{k}" if k % 6 == 5 else w for k, w in enumerate(item)]
    rows = [(0, " ".join(item)), *((k, " ".join([f"o{rng.random()}" for _ in range(50 * around)] + edited)) for k in range(1, 21)), (30, " ".join(f"n{k}" for k in range(60)))]
    docs, benchmark = make_docs(spark, rows), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert {(r.doc_id, r.score) for r in find_leaks(docs, benchmark).collect()} == {(0, 36), *((k, brute.local_score(item, rows[k][1].split())) for k in range(1, 21))}
    assert {r.doc_id for r in drop_leaks(docs, benchmark).collect()} == {30}


def test_edited_hash_is_of_utf8(spark):
    (r,) = spark.createDataFrame([("é",)], "t string").select(F.sha2("t", 256)).collect()
    assert r[0] == hashlib.sha256("é".encode()).hexdigest()


def test_private_data_query_counts_every_kind(spark):
    from panelkit.llm.op8_private_data import op8_private_data

    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    seen = Counter()
    for r in op8_private_data(spark, sf).collect():
        base = brute.base_spans(text[r.doc_id])
        counts = [sum(k == kind for k, _, _ in base) for kind in range(4)]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert r.base_sha256 == hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        seen.update({k: max(seen[k], n) - seen[k] for k, n in enumerate(counts)})
    assert max(seen.values()) > 1

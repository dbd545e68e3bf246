"""Plain Python versions of what the queries return, for small tables."""

import hashlib
import itertools
import re
import zlib

import xxhash

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return SPACE.findall((text or "").encode())


def substring_dedup(rows, window=50):
    rows = [(i, words(t)) for i, t in rows]
    first = {}
    for i, w in rows:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    gone_by_id = {}
    for i, w in rows:
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone_by_id.setdefault(i, set()).update(range(k, k + window))
    out = []
    for i, w in rows:
        gone = gone_by_id.get(i, set())
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), sum(k < len(w) for k in gone), hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text):
    w = [x.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) for x in words(text)]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(sets)
    for (a, (_, x)), (b, (_, y)) in itertools.combinations(enumerate(sets), 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            parent[find(a)] = find(b)
            links[a] += 1
            links[b] += 1
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s), least.get(find(k)) if s else i, links[k]) for k, (i, s) in enumerate(sets)]


def crc_of_ids(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


LUHN_TABLE = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def base_spans(text):
    text = text or ""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(LUHN_TABLE[x] if k % 2 else x for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def judge(url, rules, otherwise="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        rest = rest[end:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else otherwise


def local_score(item, text):
    """Smith-Waterman, cell by cell."""
    best, above = 0, [0] * (len(text) + 1)
    for w in item:
        here = [0]
        for j, x in enumerate(text):
            here.append(max(0, above[j] + (1 if w == x else -1), above[j + 1] - 1, here[j] - 1))
        best, above = max(best, *here), here
    return best


def pack(demand, shards):
    """Vector bin packing, one item and one shard at a time."""
    left = [[1 / shards] * len(demand[0]) for _ in range(shards)]
    out = [None] * len(demand)
    for i in sorted(range(len(demand)), key=lambda i: (-max(demand[i]), i)):
        fits = [s for s in range(shards) if all(x >= d for x, d in zip(left[s], demand[i]))]
        if fits:
            best = max(fits, key=lambda s: (sum(x * d for x, d in zip(left[s], demand[i])), -s))
        else:
            best = max(range(shards), key=lambda s: (min(x - d for x, d in zip(left[s], demand[i])), -s))
        out[i] = best
        left[best] = [x - d for x, d in zip(left[best], demand[i])]
    return out


def xxhash_chain(values, seed=42):
    """What hashing columns one after the other gives: integers of 4 (int) or 8 (long) bytes, strings; nulls are passed over."""
    for kind, v in values:
        if v is not None:
            data = v.encode() if kind == "str" else v.to_bytes(4 if kind == "int" else 8, "little", signed=True)
            seed = xxhash.xxh64_intdigest(data, seed)
    return seed - 2**64 if seed >= 2**63 else seed


def sketch(text, bits=2, size=5):
    """Hashes under the threshold of the runs of five words, of the whole sequence if it has fewer."""
    w = [xxhash_chain([("str", x.decode())]) for x in words(text)]
    runs = [w[k : k + size] for k in range(len(w) - size + 1)] if len(w) >= size else [w] if w else []
    found = {xxhash_chain([("long", v) for v in run]) for run in runs}
    return sorted(h for h in found if h % 2**64 < 2 ** (64 - bits))


def simhash(text):
    w = [x.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) for x in words(text)]
    runs = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def least_reached(ids, linked):
    """The smallest id that each reaches, all pairs compared."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if linked(a, b):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def prefix_trie(turns, heads=4, shared=20):
    """All prefixes of all conversations, one by one."""
    own = {}
    for c, t, role, text in turns:
        if c is not None:
            own.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % shared) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + own[c][h:]
    members = {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    saved, leaves, children = (dict.fromkeys(members, 0) for _ in range(3))
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * (len(words(p[-1][1])) if p else 0)
            leaves[p[:d]] += children[p] == 0
    ends = {p: ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)) for p, m in members.items()}
    out = [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items()]
    return sorted(out, key=lambda r: r[:2])


def vector_codes(rows, parts=8, entries=16, rounds=6):
    """Whole numbers of any size, all distances; rows of one length with unique ids."""
    rows = sorted((i, [int(x * 4096 // 1) for x in v], label) for i, v, label in rows)
    width = len(rows[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda: [[min((far(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        found = best()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    found, by_label = best(), {}
    errors = [sum(d for d, _ in f) for f in found]
    for (_, _, label), e in zip(rows, errors):
        by_label[label] = by_label.get(label, 0) + e
    seal = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in f), e, by_label[label], seal) for (i, _, label), f, e in zip(rows, found, errors)]

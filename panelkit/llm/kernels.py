"""Vectorised text kernels used inside Spark tasks.

Everything here works on one slice of an Arrow batch (about a quarter of a megabyte of text), so the memory of a task doesn't depend
on how many rows its partition has. Words are maximal runs of bytes other than the six ASCII white-space characters;
they are hashed straight from the Arrow buffer, without making Python strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256).astype(np.uint64)
_FOLDED = _BYTE[LOWER]
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_STEP2 = 0xAF251AF3B0F025B5
SLICE_BYTES = 1 << 18
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= SLICE_BYTES + 1:
            _powers[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(text: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row bounds in those bytes) of consecutive rows with about limit bytes of text."""
    text = text.cast(pa.large_string())
    if text.null_count:
        text = text.fill_null("")
    n = len(text)
    if not n:
        return
    _, offsets, data = text.buffers()
    bounds = np.frombuffer(offsets, np.int64, n + 1, text.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        end = min(end, n)
        yield at, end, raw[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at]
        at = end


def words(raw: np.ndarray, bounds: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of every word, and each row's bounds in them. fold: A-Z count as a-z."""
    n = len(raw)
    if not n:
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, np.zeros(len(bounds), np.int64)
    inside = ~SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = bounds[:-1][bounds[:-1] < n]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = bounds[1:][bounds[1:] > 0] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    value = (_FOLDED if fold else _BYTE)[raw]
    value *= powers(_BASE, n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(value, out=total[1:])
    code = (total[ends] - total[starts]) * powers(inverse(_BASE), n)[starts]
    return mix(code), starts, ends, np.searchsorted(starts, bounds)


def runs(code: np.ndarray, size: int, second: bool = False) -> np.ndarray:
    """Hash of each run of size consecutive values, by its first position; len(code) - size + 1 of them."""
    if len(code) < size:
        return np.zeros(0, np.uint64)
    step = _STEP2 if second else _STEP
    total = np.empty(len(code) + 1, np.uint64)
    total[0] = 0
    np.cumsum((mix(code + np.uint64(_STEP2)) if second else code) * powers(step, len(code)), out=total[1:])
    return mix((total[size:] - total[:-size]) * powers(inverse(step), len(code) - size + 1))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def shingles(code: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of size words; with fewer words, of the whole sequence; without words, none."""
    return distinct(runs(code, size)) if len(code) >= size else runs(code, len(code)) if len(code) else np.zeros(0, np.uint64)


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows that have words, their shingles (A-Z as a-z) one row after another, and each such row's bounds in them."""
    codes, _, _, first = words(raw, bounds, fold=True)
    every = runs(codes, size)
    n_words = np.diff(first)
    rows = np.flatnonzero(n_words)
    n = np.maximum(1, n_words[rows] - size + 1)
    ends = np.cumsum(n)
    starts = ends - n
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    for at, end, a, b in zip(starts.tolist(), ends.tolist(), first[rows].tolist(), first[rows + 1].tolist()):
        own = out[at:end]
        own[:] = every[a : b - size + 1] if b - a >= size else runs(codes[a:b], b - a)
        own.sort()
    return rows, *distinct_by_row(out, starts)


def distinct_by_row(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value once a row, and the rows' bounds, of values sorted in each row; no row is empty."""
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    new[starts] = True
    n = np.add.reduceat(new, starts, dtype=np.int64) if len(starts) else starts
    return values[new], np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())

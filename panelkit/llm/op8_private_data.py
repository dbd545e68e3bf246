"""Personal data, also in disguise, as spans of the original text.

Base spans come from four patterns on the text as it is. A transducer then rewrites every text without its disguises -
letters and digits of other scripts or widths, invisible characters, spelled digits, "at" and "dot" in words or brackets -
and keeps, for each character it writes, which source characters it stands for. The same patterns run on the rewritten
text, and what they find maps back to source spans. Base spans always stay; a mapped span is added unless a base one of its kind
holds it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm.common import clean_text, table
from panelkit.llm.op9_toxicity import LOOKALIKES

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]")

# Digits spelled in the languages of the documents.
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
# The last labels with which an address in words may end; none is a word of the documents' languages.
ENDINGS = frozenset("com org net edu gov mil info biz io co ai app dev tv uk de fr es eu nl ch pl cz se fi dk ie pt br mx ca au nz jp cn ru".split())
_NUM = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + r"|[0-9])"
_IN = r"[A-Za-z0-9%+\-]"
_DOT = r"(?:\s*[\[({<]\s*(?:dot|punkt|punto|point|\.)\s*[\])}>]\s*|\s+(?:dot|punkt|punto|point)\s+|\.)"
_AT = r"(?:\s*[\[({<]\s*(?:at|arroba|arobase|@)\s*[\])}>]\s*|\s+(?:at|arroba|arobase)\s+|@)"
#: An address with some part in words or brackets: at least one domain dot in any form.
_ADDRESS = re.compile(rf"(?<!{_IN}){_IN}{{1,64}}(?:{_DOT}{_IN}{{1,64}}){{0,4}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,5}}(?!{_IN})", re.I)
_AT_TOKEN, _DOT_TOKEN = re.compile(_AT, re.I), re.compile(_DOT, re.I)
_BRACKET_DOT = r"[\[({<]\s*(?:dot|punkt|punto|point|\.)\s*[\])}>]"
#: What numbers have between them: a dot in words or brackets, signs. None begins a number, so its run is never cut short.
_SIGN = rf"(?:\s(?:dot|punkt|punto|point)\s|{_BRACKET_DOT}|[\s.,()\-])"
#: Five digits or more, some of them spelled, with such signs between them.
_NUMBER = re.compile(rf"(?<![^\W_])(?:\+|plus\s+)?{_NUM}(?:{_SIGN}*+(?<![^\W\d_])(?:{_NUM})(?![^\W\d_])){{4,40}}", re.I)
_NUM_TOKEN = re.compile(rf"(?P<plus>plus\s+)|(?P<dot>\s*(?:\b(?:dot|punkt|punto|point)\b|{_BRACKET_DOT})\s*)|(?P<num>{_NUM})(?:[\s,]+(?={_NUM}(?![^\W\d_])))?", re.I)
_NUMBER_DISGUISE = re.compile(rf"[^\W\d_]|{_BRACKET_DOT}")


def _plain(c: str) -> str:
    """What a character stands for: one ASCII character, nothing if it is invisible, or itself."""
    if c < "Ͱ" and c != "­":
        return c
    if low := LOOKALIKES.get(c.lower()):
        return low if c == c.lower() else low.upper()
    if unicodedata.category(c) == "Cf":
        return ""
    if (d := unicodedata.decimal(c, None)) is not None:
        return str(d)
    flat = unicodedata.normalize("NFKC", c)
    return flat if len(flat) == 1 and flat < "\x7f" else c


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def find_base(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), leftmost and non-overlapping within a kind. Linear in the text, whatever it holds."""
    out, done = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((0, start, m.end()))
                done = m.end()
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _DIGITS.sub("", m[0])) <= 19 and _luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m[0])) <= 15]
    return out


class _Tape:
    """Text written so far, and for each of its characters the source span it stands for."""

    def __init__(self, text: str, start: np.ndarray, end: np.ndarray):
        self.text, self.start, self.end = text, start, end
        self.parts, self.starts, self.ends, self.at = [], [], [], 0

    def put(self, a: int, b: int, new: str) -> None:
        """new stands for characters a to b; what lies before them is kept."""
        self.keep(a)
        if new:
            self.parts.append(new)
            self.starts.append(np.full(len(new), self.start[a]))
            self.ends.append(np.full(len(new), self.end[b - 1]))
        self.at = max(self.at, b)

    def keep(self, to: int) -> None:
        if to > self.at:
            self.parts.append(self.text[self.at : to])
            self.starts.append(self.start[self.at : to])
            self.ends.append(self.end[self.at : to])
            self.at = to

    def close(self) -> tuple[str, np.ndarray, np.ndarray]:
        self.keep(len(self.text))
        return "".join(self.parts), np.concatenate([np.zeros(0, np.int64), *self.starts]), np.concatenate([np.zeros(0, np.int64), *self.ends])


def rewrite(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The text without disguises, and the source span of each of its characters."""
    n = len(text)
    tape = _Tape(text, np.arange(n), np.arange(1, n + 1))
    for m in re.finditer(r"[^\x00-ͯ]|­", text):
        if (c := _plain(m[0])) != m[0]:
            tape.put(m.start(), m.end(), c)
    text, start, end = tape.close()
    tape = _Tape(text, start, end)
    for m in _ADDRESS.finditer(text):
        at = _AT_TOKEN.search(text, m.start(), m.end())
        tokens = [(at.span(), "@"), *((d.span(), ".") for a, b in ((m.start(), at.start()), (at.end(), m.end())) for d in _DOT_TOKEN.finditer(text, a, b))]
        bare = at[0].strip().lower() in ("at", "arroba", "arobase")
        last = text[tokens[-1][0][1] : m.end()].lower()
        if (bare and last not in ENDINGS) or (last.isdigit() and at[0] != "@"):
            continue  # "at" in words is a word of the language, too: the address has to end as addresses do, not with a number
        for (a, b), new in sorted(tokens):
            tape.put(a, b, new)
    text, start, end = tape.close()
    tape = _Tape(text, start, end)
    for m in _NUMBER.finditer(text):
        if not _NUMBER_DISGUISE.search(m[0]):
            continue
        for t in _NUM_TOKEN.finditer(text, m.start(), m.end()):
            if t["num"]:
                tape.put(*t.span("num"), SPELLED.get(t["num"].lower(), t["num"]))
                tape.put(t.end("num"), t.end(), "") if t.end() > t.end("num") else None
            else:
                tape.put(*t.span(), "+" if t["plus"] else ".")
    return tape.close()


def find_all(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, is base), in that order."""
    base = find_base(text)
    found = {(*s, True) for s in base}
    new, start, end = rewrite(text)
    if new != text:
        for kind, a, b in find_base(new):
            s, e = int(start[a]), int(end[b - 1])
            if not any(k == kind and x <= s and e <= y for k, x, y in base):
                found.add((kind, s, e, False))
    return sorted(found)


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: array of (kind, start, end, base) in code points, end exclusive, sorted; kind counts in KINDS.

    One row for each input row, repeated ones too. Null and empty texts have no spans; null ids stay. Whole texts are
    searched, however long. Other columns are ignored.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b, "base": x} for k, a, b, x in find_all(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), clean_text(text_col).alias("text"))
    return docs.mapInArrow(find, "doc_id long, spans array<struct<kind int, start long, end long, base boolean>>")


def op8_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, KINDS))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter(base, of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added")
    return find_private(table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), added)

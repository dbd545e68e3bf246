"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text and normalised by length.

The lexicon is learned from labels: word beginnings and whole words that toxic documents have far more often than others,
weighted by their log odds. Exception phrases are learned, too: pairs of neighbouring words, one of them listed, that clean
labelled texts have and toxic ones hardly. Texts are folded first (look-alike letters of other scripts, digits and signs that
stand for letters, case), so a disguised word meets the same entry. A logistic curve, fitted on the same labelled rows, turns
the sum of weights and its share of the text's length into a score.

Only the text goes to Python, about a megabyte at a time; the row it stands in stays in the JVM, so scoring and filtering
are one pass over the corpus without a shuffle.
"""

from __future__ import annotations

import itertools
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import kernels as K
from panelkit.llm.common import clean_text, staged, table

# Look-alikes of Latin letters in the Cyrillic and Greek scripts, in lower case.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "х": "x", "ӏ": "l", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
# Digits and signs that stand for letters; i and l fold together, as 1 stands for both.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}

_OTHER_SCRIPT = re.compile("[Ͱ-ԯ！-～]")
_LETTERS = str.maketrans(LOOKALIKES | {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)})
_ASCII = bytes(ord(STANDS_FOR.get(chr(b), chr(b))) if b > 127 or chr(b).isalnum() or chr(b) in STANDS_FOR else 32 for b in range(256))
LONGEST = 12
REJECTED = 0.7
COUNTED = 200_000  # counts that a task holds before it sends them on


def fold(text: str) -> str:
    """Lower-case, without disguises; every ASCII character that can't be part of a word is a space."""
    text = text.lower()
    if _OTHER_SCRIPT.search(text):
        text = text.translate(_LETTERS).lower()
    # a sign at a word's end is punctuation, not a letter
    return re.sub(r"[!|$@]+(?=\s|$)", " ", text).encode().translate(_ASCII).decode() if re.search(r"[!|$@]", text) else text.encode().translate(_ASCII).decode()


def features(text: str) -> set[str]:
    """Beginnings (' abcd') of four letters and more, and whole words (' abcd ')."""
    out = set()
    for w in set(fold(text).split()):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in range(4, min(len(w), LONGEST) + 1))
    return out


def training_rows(docs: DataFrame, labels: DataFrame, most_rows: int) -> DataFrame:
    """text, toxic of at most about most_rows labelled documents, chosen by a hash of their ids, none of the held-out fold."""
    labels = labels.where("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 3 != 1").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, most_rows / max(1, labels.count()))
    sample = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * share))
    # copies of one text are one piece of evidence
    return staged(docs.join(F.broadcast(sample), "doc_id").select("text", "toxic").dropDuplicates())  # bounded by most_rows


def texts(column: pa.Array) -> Iterator[str]:
    """The column's texts one by one, decoded when they are asked for."""
    for _, _, raw, bounds in K.slices(column):
        for a, b in itertools.pairwise(bounds.tolist()):
            yield raw[a:b].tobytes().decode()


def _counts(rows: DataFrame, found_in: Callable[[], Callable[[str], set[str]]]) -> DataFrame:
    """found, clean, toxic: in how many rows of each class found_in()(text) has it. Tasks send their counts in parts of bounded size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, seen = found_in(), (Counter(), Counter())

        def out() -> pa.RecordBatch:
            keys = list(seen[0].keys() | seen[1].keys())
            done = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in seen)], ["found", "clean", "toxic"])
            for c in seen:
                c.clear()
            return done

        for batch in batches:
            for text, toxic in zip(texts(batch.column("text")), batch.column("toxic").to_numpy()):
                seen[int(toxic > 0)].update(of(text))
                if len(seen[0]) + len(seen[1]) > COUNTED:
                    yield out()
        yield out()

    return rows.mapInArrow(count, "found string, clean long, toxic long").groupBy("found").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def learn_lexicon(rows: DataFrame, least_docs: int = 4, least_odds: float = 20.0) -> dict[str, float]:
    """Entry -> weight. Features of least_docs toxic rows or more whose smoothed odds ratio is least_odds or more.

    Of a word's beginnings the shortest that qualifies stays, made as long as its toxic rows allow.
    """
    n_toxic, n = rows.agg(F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0)), F.count("*")).first()
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1) * (n - n_toxic + 1) / (F.col("clean") + 0.5))
    found = _counts(rows, lambda: features).where(F.col("toxic") >= max(least_docs, n_toxic // 500)).withColumn("weight", odds).where(F.col("weight") >= math.log(least_odds)).collect()  # what a bounded sample has
    weight, toxic = {r["found"]: r["weight"] for r in found}, {r["found"]: r["toxic"] for r in found}
    longer: dict[str, list[str]] = {}
    for f in weight:
        longer.setdefault(f[:-1], []).append(f)
    lexicon = {}
    for f in sorted(weight, key=lambda f: (len(f), f)):
        if any(f[:k] in weight for k in range(5, len(f))):
            continue
        while more := [x for x in longer.get(f, ()) if toxic[x] >= 0.95 * toxic[f]]:
            f = max(more, key=lambda x: (toxic[x], x))
        lexicon[f] = weight[f]
    return lexicon


def automaton(lexicon: dict[str, float], exceptions: Iterable[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for entry, w in lexicon.items():
        found.add_word(entry, (len(entry), w))
    for phrase in exceptions:
        found.add_word(key := f" {' '.join(fold(phrase).split())} ", (len(key), 0.0))
    found.make_automaton()
    return found


def _hits(text: str, words: ahocorasick.Automaton) -> tuple[str, list[tuple[int, int, float]]]:
    """The folded text with single spaces between, before and after its words, and what the automaton finds in it."""
    text = f" {' '.join(fold(text).split())} "
    return text, [(end + 1 - size, end + 1, w) for end, (size, w) in words.iter(text)] if len(words) else []


def neighbours(text: str, words: ahocorasick.Automaton) -> set[str]:
    """Each word that a listed entry begins, with the word before it and with the one after it."""
    text, hits = _hits(text, words)
    out = set()
    for a, _, _ in hits:
        end = text.index(" ", a + 1)
        if a:
            out.add(text[text.rindex(" ", 0, a) + 1 : end])
        if end + 1 < len(text):
            out.add(text[a + 1 : text.index(" ", end + 1)])
    return out


def learn_exceptions(rows: DataFrame, lexicon: dict[str, float], least_docs: int = 3, least_odds: float = 20.0) -> list[str]:
    """Pairs of words around an entry that least_docs clean rows or more have, and toxic rows a least_odds-th as often at most."""
    if not lexicon:
        return []

    def found_in() -> Callable[[str], set[str]]:
        words = automaton(lexicon, ())
        return lambda text: neighbours(text, words)

    n_toxic, n = rows.agg(F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0)), F.count("*")).first()
    often = F.col("clean") * (n_toxic + 1) >= F.col("toxic") * (n - n_toxic + 1) * least_odds
    return sorted(r["found"] for r in _counts(rows, found_in).where((F.col("clean") >= least_docs) & often).collect())  # what a bounded sample has


def weigh(text: str, words: ahocorasick.Automaton) -> tuple[float, int]:
    """Sum of the weights that the text has outside exception phrases, and its number of words."""
    text, hits = _hits(text, words)
    spared = sorted((a, b) for a, b, w in hits if not w)
    starts, reach = [a for a, _ in spared], list(itertools.accumulate((b for _, b in spared), max))
    free = (w for a, b, w in hits if w and not (spared and (k := bisect_right(starts, a)) and reach[k - 1] >= b))
    return math.fsum(free), text.count(" ") - 1 if len(text) > 2 else 0


def _columns(weight: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(weight)), np.log1p(weight), np.log1p(100 * weight / (size + 20))], 1)


def fit_curve(weight: np.ndarray, size: np.ndarray, toxic: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps; ridge keeps it finite where the classes part cleanly."""
    x, y, b = _columns(weight, size), (toxic > 0).astype(float), np.zeros(3)
    penalty = ridge * np.eye(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def toxicity_score(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, exceptions: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> Callable[[Column], Column]:
    """Fits lexicon, exceptions and curve; returns what turns a column of texts into one of scores."""
    rows = training_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), clean_text(text_col).alias("text")), labels, most_rows)
    lexicon = learn_lexicon(rows)
    spared = [*exceptions, *learn_exceptions(rows, lexicon)]
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, spared))
    facts = pa.struct([("weight", pa.float64()), ("size", pa.int64())])

    def measure(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = automaton(*shared.value)
        for column in columns:
            found = [weigh(t, words) for t in texts(column)]
            yield pa.StructArray.from_arrays([pa.array([w for w, _ in found], facts[0].type), pa.array([n for _, n in found], facts[1].type)], fields=list(facts))

    # not deterministic to the optimiser, so that it is never evaluated a second time in a filter
    measured = F.arrow_udf(measure, "weight double, size long").asNondeterministic()
    train = rows.select("toxic", measured("text").alias("m")).select("toxic", "m.weight", "m.size").toArrow()  # bounded by most_rows
    curve = fit_curve(*(train[c].to_numpy().astype(float) for c in ("weight", "size", "toxic"))) if len(train) else np.zeros(3)

    def score(text: Column) -> Column:
        def of(m: Column) -> Column:
            x = [F.lit(1.0), F.log1p(m["weight"]), F.log1p(100 * m["weight"] / (m["size"] + 20))]
            return 1 / (1 + F.exp(-sum((float(b) * c for b, c in zip(curve, x)), F.lit(0.0))))

        return F.get(F.transform(F.array(measured(clean_text(text))), of), F.lit(0))

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, exceptions: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each document; score is the probability of label 1.

    Lexicon, exceptions and curve are fitted on at most about most_rows labelled rows whose crc32(doc_id as text) mod 3 is
    not 1; all documents are scored whole. labels: doc_id, toxic; rows without either are skipped, of several the highest
    counts. exceptions adds phrases to the learned ones. Without labels every score is 0.5. Null texts count as empty and get
    the score of a text without hits; a null id is never held out. Equal texts, repeated rows among them, get equal scores.
    Other columns are ignored.
    """
    score = toxicity_score(docs, labels, most_rows, exceptions, id_col, text_col)
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), score(F.col(text_col)).alias("score"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= REJECTED).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, as they are, whose text scores under 0.7.

    Every row is judged by its own text, whatever its id: null and repeated ids make no difference, repeated rows go or stay
    together, null and empty texts stay as they have no hits.
    """
    score = toxicity_score(docs, labels, text_col=text_col)
    return docs.where(score(F.col(text_col)) < REJECTED)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

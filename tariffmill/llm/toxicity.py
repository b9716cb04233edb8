"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lowers case, splits off accents, and maps homoglyphs of other scripts and digits or signs set for letters to the
letters they stand for; all else becomes a blank. Terms are word starts (a blank and some letters) and whole words. Their
weights are learned from labelled rows: the log of how much more often toxic documents hold the term, less one standard
error. An exception phrase is a term's word with a neighbour that together are no likelier in toxic documents than in
others; a hit inside it does not count, and callers may give phrases of their own. The sum of weights, alone and
normalised by length, goes through a logistic function fitted on labelled rows that the lexicon has not seen.

Only rows whose CRC-32 of the id leaves other than 2 by 4 are learned from, and at most ``train_rows`` of them, those of
the least id hash: the bound that keeps training on one machine's scale while scoring reads everything. Scores depend on
the text alone.

Defined cases: null and empty texts have no hits and get the score of a text without hits; without labels, or with labels
of one kind only, all scores are equal; a repeated label counts as toxic if any is. Other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffmill.llm.common import Workspace

TRAIN_ROWS = 20_000
MAX_TERMS = 5_000
MIN_DOCS = 4
MIN_WEIGHT = 2.0
STEMS = range(3, 9)
THRESHOLD = 0.3
# Letters of other scripts that look like Latin ones, and digits and signs written for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "и": "u", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e",
    "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o",
    "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}


class Fold(dict):
    """Table for ``str.translate``; characters are looked at once."""

    def __missing__(self, code: int) -> str:
        letter = chr(code)
        if unicodedata.combining(letter):
            out = ""
        elif letter in HOMOGLYPHS:
            out = HOMOGLYPHS[letter]
        else:
            out = letter if letter.isalpha() or letter in SUBSTITUTES else " "
        self[code] = out
        return out


def folder():
    """A function that folds a text to words between single or more blanks, a blank at either end."""
    import re

    table = Fold()
    # A digit or sign stands for a letter only inside a word: next to a letter that follows it.
    inside = re.compile("[" + "".join(SUBSTITUTES) + "]+(?=[^\\W\\d_])|[" + "".join(c for c in SUBSTITUTES if c.isdigit()) + "]+(?<=[^\\W\\d_].)")
    other = re.compile("[" + "".join(SUBSTITUTES) + "]")

    def swap(found) -> str:
        return "".join(SUBSTITUTES[c] for c in found[0])

    def fold(text: str | None) -> str:
        plain = unicodedata.normalize("NFKD", (text or "").lower()).translate(table)
        if other.search(plain):
            plain = other.sub(" ", inside.sub(swap, plain))
        return f" {plain} "

    return fold


def word_terms(word: str) -> set[str]:
    return {f" {word} "} | {f" {word[:k]}" for k in STEMS if k < len(word)}


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fold = folder()
    for batch in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            counts[toxic].update(set().union(*map(word_terms, set(fold(text).split()))))
        for toxic in (0, 1):
            found = counts[toxic]
            yield pa.RecordBatch.from_arrays([
                pa.array(list(found), pa.string()), pa.array([n * toxic for n in found.values()], pa.int64()),
                pa.array([n * (1 - toxic) for n in found.values()], pa.int64()),
            ], ["term", "toxic_docs", "other_docs"])


class Matcher:
    """Aho-Corasick automaton over terms and exception phrases."""

    def __init__(self, weights: dict[str, float], phrases: Sequence[str]):
        import ahocorasick

        self.fold = folder()
        self.machine = ahocorasick.Automaton()
        for term, weight in weights.items():
            self.machine.add_word(term, (len(term), weight))
        for phrase in phrases:
            if phrase.strip():
                self.machine.add_word(f" {' '.join(phrase.split())} ", (len(" ".join(phrase.split())) + 2, 0.0))
        self.empty = not len(self.machine)
        if not self.empty:
            self.machine.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(start, stop, weight) outside of exception phrases."""
        if self.empty:
            return []
        found = [(end + 1 - size, end + 1, weight) for end, (size, weight) in self.machine.iter(text)]
        excepted = [(a, b) for a, b, w in found if not w]
        return [(a, b, w) for a, b, w in found if w and not any(x <= a and b <= y for x, y in excepted)]

    def features(self, text: str | None) -> tuple[float, float]:
        """Sum of the weights, and that sum a hundred words, both as logarithms. A word counts with its heaviest term."""
        plain = self.fold(text)
        best: dict[int, float] = {}
        for start, _, weight in self.hits(plain):
            best[start] = max(weight, best.get(start, 0.0))
        if not best:
            return 0.0, 0.0
        total = sum(best.values())
        return float(np.log1p(total)), float(np.log1p(100 * total / max(1, len(plain.split()))))


def _matcher(shared) -> Matcher:
    state = shared.value
    if "matcher" not in state:
        state["matcher"] = Matcher(state["weights"], state["phrases"])
    return state["matcher"]


def _neighbours(shared):
    """Documents by phrase: each hit's word with the word before and the word after."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared)
        for batch in batches:
            counts = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                plain, phrases = matcher.fold(text), set()
                for start, _, _ in matcher.hits(plain):
                    after = plain[start:start + 200].split()[:2]
                    before = plain[max(0, start - 100):start].split()[-1:]
                    phrases |= {" ".join(after)} if len(after) == 2 else set()
                    phrases |= {f"{before[0]} {after[0]}"} if before and after else set()
                counts[toxic].update(phrases)
            for toxic in (0, 1):
                found = counts[toxic]
                yield pa.RecordBatch.from_arrays([
                    pa.array(list(found), pa.string()), pa.array([n * toxic for n in found.values()], pa.int64()),
                    pa.array([n * (1 - toxic) for n in found.values()], pa.int64()),
                ], ["term", "toxic_docs", "other_docs"])

    return run


def _features(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared)
        for batch in batches:
            pairs = [matcher.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), *(pa.array([p[k] for p in pairs], pa.float64()) for k in (0, 1))], ["toxic", "total", "share"]
            )

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Weights, the constant first, by Newton's method with a small ridge."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 10)
        return np.array([np.log(rate / (1 - rate)), *np.zeros(x.shape[1])])
    full = np.column_stack([np.ones(len(y)), x])
    weights = np.zeros(full.shape[1])
    penalty = np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ weights, -30, 30)))
        step = np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + penalty, full.T @ (y - p) - penalty @ weights)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def _log_odds(toxic_total: int, other_total: int) -> Column:
    a, b = F.col("toxic_docs") + 0.5, F.col("other_docs") + 0.5
    return F.log(a / (toxic_total + 1)) - F.log(b / (other_total + 1)) - F.sqrt(1 / a + 1 / b)


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, exceptions: Sequence[str] = (), max_terms: int = MAX_TERMS) -> dict:
    """weights (term -> weight), phrases, and the logistic weights.

    Half of the sample (remainders 0 and 3) gives the lexicon, the rest the logistic function. The sample is bounded by
    ``train_rows``, which is why it may be broadcast; terms and phrases are counted in Spark and at most ``max_terms``
    of each reach the driver.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "toxicity")
    usable = labels.where(~held_out()).where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = work.save(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows), "sample")
    rows = work.save(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(
        "text", "toxic", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 1).alias("fitting")
    ), "rows")
    lexical = rows.where("NOT fitting").select("text", "toxic")
    totals = {r["toxic"]: r["n"] for r in lexical.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    odds = _log_odds(totals.get(1, 0), totals.get(0, 0))

    def counted(run) -> DataFrame:
        return lexical.mapInArrow(run, "term string, toxic_docs long, other_docs long").groupBy("term").agg(
            F.sum("toxic_docs").alias("toxic_docs"), F.sum("other_docs").alias("other_docs")
        )

    terms = counted(_count_terms).where(F.col("toxic_docs") >= MIN_DOCS).select("term", odds.alias("weight"), "toxic_docs")
    top = terms.where(F.col("weight") >= MIN_WEIGHT).orderBy(F.desc("weight"), F.desc("toxic_docs"), "term").limit(max_terms).collect()
    weights: dict[str, float] = {}
    for row in sorted(top, key=lambda r: (len(r["term"]), r["term"])):
        stems = [row["term"][:k] for k in range(2, len(row["term"]))]
        if not any(weights.get(s, -1.0) >= row["weight"] - 0.3 for s in stems):  # a stem that says as much covers the term
            weights[row["term"]] = float(row["weight"])
    shared = spark.sparkContext.broadcast({"weights": weights, "phrases": []})
    phrases = counted(_neighbours(shared)).where(F.col("other_docs") >= MIN_DOCS).where(
        (F.col("other_docs") + 0.5) / (totals.get(0, 0) + 1) >= (F.col("toxic_docs") + 0.5) / (totals.get(1, 0) + 1)
    ).orderBy(F.desc("other_docs"), "term").limit(max_terms).collect()
    fold = folder()
    model = {"weights": weights, "phrases": [*(r["term"] for r in phrases), *(" ".join(fold(p).split()) for p in exceptions)]}
    shared = spark.sparkContext.broadcast(dict(model))
    fitted = rows.where("fitting").select("text", "toxic").mapInArrow(_features(shared), "toxic int, total double, share double").collect()
    data = np.array([(r["toxic"], r["total"], r["share"]) for r in fitted], float).reshape(-1, 3)
    # On separable labels an unbounded slope would only sharpen; hits never lower a score.
    model["logistic"] = [float(w) for w in np.maximum(fit_logistic(data[:, 1:], data[:, 0]), [-np.inf, 0, 0])]
    work.drop("sample", "rows")
    return model


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, weights = _matcher(shared), np.array(shared.value["logistic"])
        for batch in batches:
            x = np.array([matcher.features(t) for t in batch.column("text").to_pylist()], float).reshape(-1, 2)
            score = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row: one scan, no exchange."""
    shared = docs.sparkSession.sparkContext.broadcast(dict(model))
    texts = docs.select("doc_id", "text")
    found = texts.mapInArrow(_scored(shared), f"doc_id {texts.schema[0].dataType.simpleString()}, score double")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

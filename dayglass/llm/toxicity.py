"""Toxicity by a weighted lexicon.

Texts are folded (lower case, look-alike letters of other scripts, digits and signs that
stand for letters, invisible characters dropped) and searched by an Aho-Corasick
automaton for terms at word starts; a term inside an exception phrase doesn't count. The
sum of weights and its share of the text's words go through a logistic curve.

The lexicon is learned: whole words and word beginnings that far more toxic than other
documents of a bounded sample of labelled rows contain, weighted by that log ratio;
longer words and word pairs around a term that only the others contain are exceptions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayglass.llm.common import slices, stored, texts, use_memo

#: Letters of other scripts that look like a Latin one.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k",
    "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "ԁ": "d", "ѵ": "v", "α": "a", "ο": "o", "ρ": "p", "ν": "v",
    "ι": "i", "κ": "k", "τ": "t", "υ": "u", "ε": "e", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l", "ℓ": "l",
}

#: Digits and signs that stand for letters. One, l and i fold together.
SUBSTITUTES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
    "|": "i", "l": "i", "+": "t", "€": "e",
}

_SEPARATORS = "\t\n\r\f\v\"#%&()*,-./:;<=>?[\\]^_`{}~'“”‘’«»„–—…·• "
_INVISIBLE = "­​‌‍⁠﻿"
_FOLD = {
    **{ord(c): " " for c in _SEPARATORS},
    **{ord(c): None for c in _INVISIBLE},
    **{c: chr(c - 0xFEE0) for c in range(0xFF41, 0xFF5B)},
    **{c: SUBSTITUTES.get(chr(c - 0xFEE0), chr(c - 0xFEE0)) for c in range(0xFF10, 0xFF1A)},
    0xFF4C: "i",
    **{ord(c): SUBSTITUTES.get(v, v) for c, v in {**HOMOGLYPHS, **SUBSTITUTES}.items()},
}


def fold(text: str) -> str:
    """Folded words with a space on either side of each."""
    return f" {' '.join(text.lower().translate(_FOLD).split())} "


@dataclass(frozen=True)
class Learning:
    """Bounds and thresholds of the lexicon's training."""

    rows: int = 6000  # labelled documents that are read at most
    shortest: int = 4  # characters of a word beginning
    longest: int = 8
    share: float = 0.02  # of the toxic documents that hold a term, and `least` of them
    least: int = 4
    weight: float = 2.5  # log ratio from which a term counts
    terms: int = 2000


@dataclass
class Lexicon:
    """Terms start with a space; one that ends with a space is a whole word."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-4.0, 2.0, 0.5)  # base, of ln(1 + sum), of ln(1 + sum per 100 words)

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for phrase in self.exceptions:
            out.add_word(phrase, (len(phrase), None))
        for term, weight in self.weights.items():
            if term not in self.exceptions:
                out.add_word(term, (len(term), weight))
        out.make_automaton()
        return out


def total_weight(folded: str, automaton: ahocorasick.Automaton) -> float:
    """Sum of the weights of all terms outside exception phrases."""
    if not len(automaton):
        return 0.0
    terms, safe = [], []
    for end, (length, weight) in automaton.iter(folded):
        (safe if weight is None else terms).append((end + 1 - length, end + 1, weight))
    if safe:
        terms = [t for t in terms if not any(s[0] <= t[0] and t[1] <= s[1] for s in safe)]
    return sum(t[2] for t in terms)


def features(folded: str, automaton: ahocorasick.Automaton) -> tuple[float, float]:
    total = total_weight(folded, automaton)
    return np.log1p(total), np.log1p(100 * total / max(1, folded.count(" ") - 1))


def probability(f: np.ndarray, curve: tuple[float, float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-(curve[0] + f @ np.array(curve[1:]))))


def _terms(folded: str, learning: Learning) -> set[str]:
    out = set()
    for word in set(folded.split()):
        out.add(f" {word} ")
        out.update(f" {word[:k]}" for k in range(learning.shortest, min(len(word), learning.longest) + 1))
    return out


def _contexts(folded: str, terms: tuple[str, ...]) -> set[str]:
    """Words that go on where a term ends, and words with a term and their successor."""
    out = set()
    words = folded.split()
    for word, after in zip(words, [*words[1:], ""]):
        whole = f" {word} "
        held = [t for t in terms if whole.startswith(t)]
        if held:
            if whole not in held:
                out.add(whole)
            if after:
                out.add(f" {word} {after} ")
    return out


def _count(sample: DataFrame, of) -> DataFrame:
    """term, toxic, other: documents of each kind that hold a term; `of` maps folded text to terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for part in slices(batches):
            for text, toxic in zip(texts(part.column(0)), part.column(1).to_pylist()):
                found[toxic].update(of(fold(text)))
        terms = list(found[0] | found[1])
        for at in range(0, len(terms), 20_000):
            some = terms[at : at + 20_000]
            columns = [some, [found[1][t] for t in some], [found[0][t] for t in some]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["term", "toxic", "other"])

    counted = sample.select("text", "toxic").mapInArrow(run, "term string, toxic bigint, other bigint")
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no lexicon learns from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, learning: Learning) -> DataFrame:
    """text, toxic of at most `rows` labelled documents outside the held-out ones, by hash of
    their id. Equal texts count once; a document with both labels is toxic."""
    chosen = (
        labels.where("doc_id is not null and toxic in (0, 1)")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(learning.rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `rows` rows
    return stored(rows.groupBy("text").agg(F.max("toxic").alias("toxic")), "labelled")


def learn(docs: DataFrame, labels: DataFrame, learning: Learning = Learning()) -> Lexicon:
    """Lexicon and curve from labelled documents; without toxic ones nothing is toxic."""
    sample = labelled_sample(docs, labels, learning)
    sizes = dict(sample.groupBy("toxic").count().collect())
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return Lexicon({})
    least = max(learning.least, int(learning.share * toxic))
    own = _count(sample.where("toxic = 1"), lambda t: _terms(t, learning)).where(F.col("toxic") >= least)
    # a document holds a bounded share of all terms, so terms in every 50th are few
    candidates = frozenset(r[0] for r in own.select("term").collect())
    rows = _count(sample, lambda t: _terms(t, learning) & candidates).collect()
    ratio = {
        r["term"]: float(np.log((r["toxic"] + 0.5) / (toxic + 1)) - np.log((r["other"] + 0.5) / (other + 1))) for r in rows
    }
    support = {r["term"]: r["toxic"] for r in rows}
    weights: dict[str, float] = {}
    # the most frequent of the strong terms first; one that a chosen term covers as well adds nothing
    for term in sorted((t for t in ratio if ratio[t] >= learning.weight), key=lambda t: (-support[t], len(t), t)):
        if len(weights) < learning.terms and not any(term.startswith(w) or w.startswith(term) for w in weights):
            weights[term] = round(ratio[term], 6)
    terms = tuple(weights)
    safe = _count(sample, lambda t: _contexts(t, terms)).where("toxic = 0 and other >= 3").orderBy(F.desc("other"), "term")
    lexicon = Lexicon(weights, [r[0] for r in safe.limit(learning.terms).collect()])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for part in slices(batches):
            found = [features(fold(t), automaton) for t in texts(part.column(0))]
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), part.column(1)], ["a", "b", "toxic"])

    # at most `rows` rows of three numbers
    table = sample.select("text", "toxic").mapInArrow(measure, "a double, b double, toxic int").toPandas()
    lexicon.curve = fit_curve(table[["a", "b"]].to_numpy("f8"), table["toxic"].to_numpy("f8"))
    return lexicon


def fit_curve(f: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> tuple[float, float, float]:
    """Logistic regression by Newton steps, slopes held to be positive."""
    x = np.column_stack([np.ones(len(f)), f])
    w = np.zeros(3)
    penalty = np.diag([1e-3, ridge, ridge])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(round(float(v), 9) for v in w)


def score(lexicon: Lexicon) -> Column:
    """Toxicity of column `text`, 0 to 1; null and empty texts get the score of no match."""

    def run(column: pa.Array) -> pa.Array:
        use_memo(None)
        automaton = lexicon.automaton()
        found = [features(fold(t.as_py() or ""), automaton) for t in column]
        return pa.array(probability(np.array(found, "f8").reshape(-1, 2), lexicon.curve))

    return F.arrow_udf(run, "double")(F.col("text"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, learning: Learning = Learning()) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; repeated rows stay repeated."""
    lexicon = learn(docs, labels, learning)
    return docs.select("doc_id", held_out().alias("held_out"), score(lexicon).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, learning: Learning = Learning()) -> DataFrame:
    """The rows of `docs` that score below the threshold, all columns as they were."""
    return docs.where(score(learn(docs, labels, learning)) < threshold)

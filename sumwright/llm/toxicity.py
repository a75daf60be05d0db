"""Toxicity by a weighted lexicon.

Texts are folded first, so that look-alike letters, accents and digits put for letters make no
difference. An Aho-Corasick automaton finds the lexicon's terms and the exception phrases in one
pass; a term inside an exception phrase does not count. The summed weights are divided by the
logarithm of the text's length and a logistic curve turns them into a score.

Terms and weights are learned from labelled texts, apart from words given beforehand.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Callable, Collection, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import lru_cache, partial

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumwright.llm.shared import col, materialize

#: Most labelled rows of either label that the lexicon is learned from.
MOST_ROWS = 10_000
#: A term's log odds, and the log of how improbable its counts are by chance, at least.
LEAST_ODDS = 1.5
LEAST_SURPRISE = math.log(1e4)

#: Terms that are harmless inside these phrases, apart from those learned.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "circus clown", "scum line", "pond scum")

# Look-alikes outside Latin, by the letter they look like.
HOMOGLYPHS = {
    "a": "аα", "b": "вβЬ", "c": "сϲ", "e": "еєε", "h": "һн", "i": "іιıӏ", "j": "ј", "k": "кκ",
    "m": "м", "n": "пη", "o": "оοσ", "p": "рρ", "s": "ѕ", "t": "тτ", "u": "υս", "v": "ν",
    "w": "ԝω", "x": "хχ", "y": "уүγ",
}
# Digits by the letter they are put for; l and i, which 1 both stands for, become one letter.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "l": "i"}
# Signs put for letters, only where a letter stands on either side.
SIGNS = {"@": "a", "$": "s", "!": "i"}
SIGN_IN_WORD = re.compile(r"(?<=[^\W\d_])[@$!](?=[^\W\d_])")
WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=1)
def folding() -> dict[int, str]:
    """Code points to what they fold to: bases of decomposed letters, look-alikes, digits."""
    table = {}
    for code in range(0xA0, 0x20000):  # compatibility forms and letters with marks, whatever block they are in
        bases = [c for c in unicodedata.normalize("NFKD", chr(code)).lower() if c.isascii() and c.isalnum()]
        if bases:
            table[code] = "".join(DIGITS.get(c, c) for c in bases)
    for code in range(0x300, 0x370):  # combining marks
        table[code] = ""
    for letter, alike in HOMOGLYPHS.items():
        for a in alike:
            table[ord(a)] = DIGITS.get(letter, letter)
    return table | {ord(a): b for a, b in DIGITS.items()}


def fold(text: str) -> str:
    text = text.lower()
    if SIGN_IN_WORD.search(text):
        text = SIGN_IN_WORD.sub(lambda m: SIGNS[m[0]], text)
    return text.translate(folding())


@dataclass(frozen=True)
class Lexicon:
    """Weights of folded terms, exception phrases, and the curve from density to score."""

    weights: Mapping[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 1.0
    middle: float = 0.0
    _built: list = field(default_factory=list, compare=False, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_built": []}

    def automaton(self):
        if not self._built:
            found = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                found.add_word(term, (len(term), weight))
            for phrase in map(fold, self.exceptions):
                found.add_word(phrase, (len(phrase), None))
            found.make_automaton()
            self._built.append(found)
        return self._built[0]

    def density(self, text: str | None) -> float:
        """Summed weights of whole-word matches outside exceptions, by the log of the length."""
        if not text or not (self.weights or self.exceptions):
            return 0.0
        folded, hits, excused = fold(text), [], []
        for end, (length, weight) in self.automaton().iter(folded):
            start = end + 1 - length
            before = folded[start - 1] if start else " "
            after = folded[end + 1] if end + 1 < len(folded) else " "
            if not before.isalnum() and not after.isalnum():
                (excused if weight is None else hits).append((start, end, weight))
        if excused:
            hits = outside(hits, excused)
        return sum(h[2] for h in hits) / math.log2(2 + len(text) / 6)

    def score(self, text: str | None) -> float:
        z = self.slope * (self.density(text) - self.middle)
        return 1 / (1 + math.exp(-max(min(z, 500), -500)))


def outside(hits: list[tuple], excused: list[tuple]) -> list[tuple]:
    """The hits ``start, end, weight`` that lie in none of the excused spans, whose ends are in order.

    Of the spans that end at a hit's end or later the one that starts first decides; going from the
    right, it is known at each hit.
    """
    kept, first, at = [], math.inf, len(excused) - 1
    for hit in reversed(hits):
        while at >= 0 and excused[at][1] >= hit[1]:
            first = min(first, excused[at][0])
            at -= 1
        if hit[0] < first:
            kept.append(hit)
    return kept[::-1]


def densities(lexicon: Lexicon, text: Column) -> Column:
    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([lexicon.density(t) for t in texts], dtype=float)

    return of(text)


def scored(lexicon: Lexicon, text: Column) -> Column:
    """Score from 0 to 1; null and empty texts hold no term and score as any text without."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([lexicon.score(t) for t in texts], dtype=float)

    return of(text)


# Learning


def sample(labels: DataFrame, most: int = MOST_ROWS, by: str = "doc_id") -> DataFrame:
    """The rows with label 0 or 1, of either about ``most`` at most, chosen by a hash of column ``by``."""
    labels = labels.where("label in (0, 1)")
    sizes = {r.label: r["count"] for r in labels.groupBy("label").count().collect()}
    place = F.pmod(F.xxhash64(F.lit(5), col(by)), F.lit(2**20))
    share = F.lit(0.0)
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, most / n) * 2**20)).otherwise(share)
    return labels.where(place < share)


def unit_counts(rows: DataFrame, units: Callable[[str], Iterable[str]]) -> DataFrame:
    """``term, toxic, clean``: different texts of either label that hold a unit of their folded text.

    Texts that share their least shingle hash count once, shorter ones if all words agree, so copies of one text do not make its
    words look toxic.
    """

    def found_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, sketches, labels = [], [], []
            for text, label in zip(*(batch.column(c).to_pylist() for c in ("text", "label")), strict=True):
                folded = fold(text or "")
                words = WORD.findall(folded)
                threes = zip(words, words[1:], words[2:], strict=False) if len(words) > 2 else [words]
                sketch = min(xxhash.xxh64_intdigest(" ".join(t)) for t in threes) >> 1
                own = list(set(units(folded)))
                terms += own
                sketches += [sketch] * len(own)
                labels += [label] * len(own)
                if len(terms) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(sketches, pa.int64()), pa.array(labels, pa.int32())], ["term", "sketch", "label"])
                    terms, sketches, labels = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(sketches, pa.int64()), pa.array(labels, pa.int32())], ["term", "sketch", "label"])

    rows = rows.select("text", F.col("label").cast("int").alias("label")).mapInArrow(found_in, "term string, sketch long, label int")
    once = rows.groupBy("term", "sketch").agg(F.max("label").alias("label"))
    return once.groupBy("term").agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("clean"))


def term_counts(rows: DataFrame) -> DataFrame:
    """``term, toxic, clean`` of folded words."""
    return unit_counts(rows, WORD.findall)


def phrases_with(terms: Collection[str], folded: str) -> Iterator[str]:
    """A term and the word before or behind it, a blank apart."""
    last, end = None, 0
    for match in WORD.finditer(folded):
        if last is not None and folded[end : match.start()] == " " and (last in terms or match[0] in terms):
            yield f"{last} {match[0]}"
        last, end = match[0], match.end()


def surprise(toxic: Column, clean: Column, rate: Column) -> Column:
    """Chernoff's bound on as many toxic texts among so many, drawn at ``rate``."""
    n = toxic + clean
    few = F.when(clean > 0, clean * F.log(clean / (n * (1 - rate)))).otherwise(0.0)
    return F.when(toxic > 0, toxic * F.log(toxic / (n * rate))).otherwise(0.0) + few


def harmless(rows: DataFrame, terms: Mapping[str, tuple[int, int]], odds: Column) -> tuple[str, ...]:
    """Phrases that hold a term, given with its toxic and clean texts, and are no more frequent in
    toxic texts than elsewhere, which chance would not make of the term's own rate."""
    known = {t: (toxic + 0.5) / (toxic + clean + 1) for t, (toxic, clean) in terms.items() if clean}
    if not known:
        return ()
    phrases = unit_counts(rows, partial(phrases_with, frozenset(known)))
    # Of a phrase of two terms the one seldomer in toxic texts counts.
    table, rate = F.from_json(F.lit(json.dumps(known)), "map<string,double>"), F.lit(1.0)
    for word in (F.substring_index("term", " ", 1), F.substring_index("term", " ", -1)):
        rate = F.least(rate, F.coalesce(F.try_element_at(table, word), F.lit(1.0)))
    found = phrases.withColumn("rate", rate)
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    found = found.where((odds <= 0) & (share < F.col("rate")))
    found = found.where(surprise(F.col("toxic"), F.col("clean"), F.col("rate")) > LEAST_SURPRISE)
    return tuple(r.term for r in found.select("term").orderBy("term").collect())


def learn(labelled: DataFrame, most: int = MOST_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon from rows ``text, label`` (1 toxic, 0 not; others and nulls are left out).

    A term's weight is its log odds, smoothed by half a text, against those of all texts. Terms
    whose counts chance could explain are left out, so that one takes several texts and their number
    is bounded by the words of the sample: at most about ``most`` rows of either label. Without toxic
    rows nothing is toxic. Phrases that make a term harmless are learned from the clean rows that hold it
    (see :func:`harmless`) and added to ``exceptions``.
    """
    rows = labelled.where("text is not null").select("text", "label")
    rows = materialize(sample(rows, most, "text"), "toxic-sample")
    counts = term_counts(rows)
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return Lexicon({}, exceptions, 1.0, 10.0)
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / (toxic + 1)) - F.log(b / (clean + 1))
    terms = counts.where("toxic > 0").select("term", "toxic", "clean", odds.alias("odds"))
    terms = terms.where(F.col("odds") > LEAST_ODDS)
    rate = toxic / (toxic + clean) if clean else 1.0
    terms = terms.where(surprise(F.col("toxic"), F.col("clean"), F.lit(rate)) > LEAST_SURPRISE)
    found = terms.orderBy("term").collect()
    learned = harmless(rows, {r.term: (r.toxic, r.clean) for r in found}, odds)
    lexicon = Lexicon({r.term: float(r.odds) for r in found}, (*exceptions, *learned))
    return fitted(lexicon, rows)


def fitted(lexicon: Lexicon, rows: DataFrame) -> Lexicon:
    """The lexicon with the logistic curve fitted to the densities of the sample's rows."""
    seen = rows.select(F.col("label").cast("double").alias("y"), densities(lexicon, F.col("text")).alias("x"))
    pairs = seen.groupBy("y", F.round("x", 2).alias("x")).count().collect()
    y, x, n = (np.array([r[i] for r in pairs], float) for i in range(3))
    slope, middle = 1.0, 0.0
    w = np.zeros(2)
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):  # Newton steps with a small ridge, since the labels may be separable
        p = 1 / (1 + np.exp(-design @ w))
        gradient = design.T @ (n * (y - p)) - 0.01 * w
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w += step * min(1, 5 / max(np.abs(step).max(), 1e-9))
    slope = max(float(w[1]), 1e-6)
    middle = float(-w[0] / slope)
    return Lexicon(lexicon.weights, lexicon.exceptions, slope, middle)


def score_documents(docs: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` of every row."""
    return docs.select(col(doc_id).alias("doc_id"), scored(lexicon, col(text)).alias("score"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows that score below ``threshold``, with the columns of ``docs``."""
    return docs.where(scored(lexicon, col(text)) < threshold)

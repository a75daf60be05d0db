"""Quality scores of question-answer pairs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sumwright.functions.stem import stem
from sumwright.functions.text import words

# Weights of the reading-ease formula.
READING_BASE, READING_SENTENCE, READING_SYLLABLE = 206.835, 1.015, 84.6


def reading_ease(text: Column) -> Column:
    """Flesch reading ease; 0 for a text without words.

    Words are whitespace separated, sentences are runs of ``.``, ``!`` or ``?``, syllables are
    vowel groups, each at least one.
    """
    low = F.lower(text)
    word_count = F.regexp_count(low, F.lit(r"\S+"))
    sentences = F.greatest(F.regexp_count(low, F.lit(r"[.!?]+")), F.lit(1))
    syllables = F.greatest(F.regexp_count(low, F.lit(r"[aeiouy]+")), word_count)
    score = (
        READING_BASE
        - READING_SENTENCE * (word_count / sentences)
        - READING_SYLLABLE * F.try_divide(syllables, word_count)
    )
    return F.when(word_count > 0, score).otherwise(F.lit(0.0))


def clarity(question: Column, answer: Column) -> Column:
    """Mean reading ease of question and answer."""
    return (reading_ease(question) + reading_ease(answer)) / 2


def _lcs(a: list[str], b: list[str]) -> int:
    """LCS length, one bit of a whole number per token of ``b``.

    The bit-parallel recurrence V' = (V + (V & M)) | (V & ~M): the zero bits of V count the
    common subsequence so far (Crochemore et al. 2001, Hyyro 2004).
    """
    masks: dict[str, int] = {}
    for i, token in enumerate(b):
        masks[token] = masks.get(token, 0) | 1 << i
    full = (1 << len(b)) - 1
    v = full
    for token in a:
        mask = masks.get(token)
        if mask:
            hit = v & mask
            v = ((v + hit) | (v - hit)) & full
    return len(b) - v.bit_count()


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two token arrays of any length.

    Whole numbers of any size do the work of a row of the table at once; column functions would
    need a step for every cell or every 62 tokens.
    """

    @F.pandas_udf("int")
    def of(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([_lcs(list(x), list(y)) for x, y in zip(left, right, strict=True)], dtype="int32")

    return of(a, b)


ROUGE_TOKEN = re.compile("[a-z0-9]+")


def rouge_l(target: Column, prediction: Column, stemmed: bool = False) -> Column:
    """ROUGE-L F-measure of two whole texts; 0 when nothing is shared or a text is null.

    ``stemmed`` compares Porter stems of tokens of more than three letters.
    """

    def tokens(text: str | None) -> list[str]:
        found = ROUGE_TOKEN.findall((text or "").lower())
        return [stem(t) if len(t) > 3 else t for t in found] if stemmed else found

    @F.pandas_udf("double")
    def of(left: pd.Series, right: pd.Series) -> pd.Series:
        scores = []
        for x, y in zip(left, right, strict=True):
            a, b = tokens(x), tokens(y)
            scores.append(2.0 * _lcs(a, b) / (len(a) + len(b)) if a or b else 0.0)
        return pd.Series(scores, dtype=float)

    return of(target, prediction)


def terms(*texts: Column) -> Column:
    """Lowercase whitespace-separated words of all texts, in order."""
    return F.flatten(F.array(*[words(t, lower=True) for t in texts]))

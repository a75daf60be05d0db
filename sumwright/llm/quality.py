"""Quality classifier by a sparse rule ensemble.

Boosted trees on statistics of the text give conjunctive rules, one for the way to every node. A
logistic regression with an L1 penalty weighs the rules, and those left with a weight are compiled
to column expressions over the statistics.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumwright.llm import trees
from sumwright.llm.shared import col, materialize

#: Most labelled rows that trees and weights are fitted to.
MOST_ROWS = 20_000

UPPER, DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
STOPS, SYMBOLS, SPACES = b".,;:?", b"#$%&*@^~=<>{}[]\\/+_", b" \t\r\n\x0b\x0c"

STATISTICS = (
    "log_bytes", "log_words", "word_length", "longest_word", "upper_share", "digit_share", "symbol_share",
    "bar_share", "bang_share", "stop_share", "space_share", "non_ascii_share", "distinct_words",
    "top_word", "short_words", "capital_words", "line_words", "distinct_lines",
)


def statistics(text: str | None) -> tuple[float, ...]:
    """:data:`STATISTICS` of a whole text; null counts as empty, shares of nothing are 0."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)

    def share(of: bytes) -> float:
        return (len(raw) - len(raw.translate(None, of))) / n

    words = text.split()
    m = max(len(words), 1)
    counts = Counter(words)
    lengths = list(map(len, words))
    lines = [line for line in text.split("\n") if line.strip()]
    return (
        math.log1p(len(raw)),
        math.log1p(len(words)),
        sum(lengths) / m,
        float(max(lengths, default=0)),
        share(UPPER),
        share(DIGIT),
        share(SYMBOLS),
        share(b"|"),
        share(b"!"),
        share(STOPS),
        share(SPACES),
        (len(raw) - len(text)) / n,
        len(counts) / m,
        max(counts.values(), default=0) / m,
        sum(k < 4 for k in lengths) / m,
        sum(map(str.istitle, words)) / m,
        len(words) / max(len(lines), 1),
        len(set(lines)) / max(len(lines), 1),
    )


def described(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, stats``, the statistics as an array, of every row; repeated rows give repeated rows,
    an empty table none."""

    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts], dtype=object)

    return docs.select(col(doc_id).alias("doc_id"), of(col(text)).alias("stats"))


@dataclass(frozen=True)
class Rules:
    """Weighted conjunctions over the statistics."""

    weighted: tuple[tuple[trees.Rule, float], ...]
    intercept: float

    def score(self, stats: Column) -> Column:
        """The probability of label 1."""
        features = [stats[i] for i in range(len(STATISTICS))]
        # Rules in batches, each summed on its own, keep compiled methods small.
        total = F.lit(self.intercept)
        for rule, weight in self.weighted:
            total += F.when(trees.holds(rule, features), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def text(self) -> list[str]:
        """The rules in words, heaviest first."""
        order = sorted(self.weighted, key=lambda r: -abs(r[1]))
        return [
            f"{weight:+.3f} if " + " and ".join(f"{STATISTICS[f]} {'<=' if low else '>'} {t:.4g}" for f, low, t in rule)
            for rule, weight in order
        ]


def learn(
    labelled: DataFrame, most: int = MOST_ROWS, depth: int = 3, rounds: int = 20, penalty: float = 0.0005
) -> Rules:
    """Rules from rows ``stats, label``; rows with a label other than 0 and 1 are left out.

    About ``most`` rows at most are used, chosen by a hash of the statistics. With labels of one
    kind only the score is 1 or 0 throughout, without any it is a half.
    """
    rows = labelled.where("label in (0, 1)").select("stats", F.col("label").cast("double").alias("label"))
    n = rows.count()
    share = min(1.0, most / max(n, 1)) * 2**20
    rows = materialize(rows.where(F.pmod(F.xxhash64("stats"), F.lit(2**20)) < share), "quality-sample")
    kinds = [r.label for r in rows.select("label").distinct().collect()]
    if len(kinds) < 2:
        return Rules((), 500.0 * (2 * kinds[0] - 1) if kinds else 0.0)
    vectors = rows.select("label", array_to_vector("stats").alias("features"))
    model = GBTClassifier(maxDepth=depth, maxIter=rounds, seed=7, subsamplingRate=0.7).fit(vectors)
    found = {trees.narrowed(p) for _, root in trees.read(model.toDebugString) for p in trees.paths(root)}
    rules: Sequence[trees.Rule] = sorted(found)
    stats = [F.col("stats")[i] for i in range(len(STATISTICS))]
    held = F.array(*[trees.holds(r, stats).cast("double") for r in rules])
    design = materialize(rows.select("label", held.alias("held")), "quality-rules")
    design = design.select("label", array_to_vector("held").alias("features"))
    lasso = LogisticRegression(regParam=penalty, elasticNetParam=1.0, standardization=False, maxIter=100).fit(design)
    weights = [float(w) for w in lasso.coefficients.toArray()]
    kept = tuple((r, w) for r, w in zip(rules, weights, strict=True) if w != 0.0)
    return Rules(kept, float(lasso.intercept))


def score_documents(described: DataFrame, rules: Rules) -> DataFrame:
    """``doc_id, score`` of rows ``doc_id, stats``, of each on its own."""
    return described.select("doc_id", rules.score(F.col("stats")).alias("score"))

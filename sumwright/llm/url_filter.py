"""URL filters: an allow and block list first, gradient-boosted trees for the rest.

The trees are trained on lexical features of labelled URLs and compiled to column expressions.
DataFrame functions and Spark's own learner only.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumwright.llm import trees
from sumwright.llm.shared import col, materialize, packed, unpacked

#: Most labelled rows that the trees are trained on.
MOST_ROWS = 20_000
#: Labelled URLs of the prior share that a suffix's rate is drawn towards it by.
PRIOR = 20
#: Parts of the labelled URLs; the rates that one is trained with come from the others.
FOLDS = 5

BLOCK, ALLOW = "block", "allow"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """The longest of ``rules``, as ``host/path``, that fits, else null.

    A rule fits its host and all subdomains, if the path starts with the rule's.
    """
    found = F.lit(None).cast("string")
    for rule in sorted(set(rules), key=lambda r: (len(r), len(r.split("/")[0]), r)):
        of, slash, start = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


# Features


def entropy(text: Column) -> Column:
    """Bits a character; 0 for the empty text."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")

    def add(done: Column, letter: Column) -> Column:
        share = F.size(F.filter(letters, lambda c: c == letter)) / F.size(letters)
        return done - share * F.log2(share)

    return F.aggregate(F.array_distinct(letters), F.lit(0.0), add)


def occurrences(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark)))


def suffixes(host: Column) -> list[Column]:
    """The last label of a host and the last two."""
    labels = F.split(host, r"\.")
    return [F.element_at(labels, -1), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")]


class Model(NamedTuple):
    """Trees, statistics of suffixes, and the blocked share of all labelled URLs."""

    trees: list
    statistics: DataFrame
    prior: float


def by_suffix(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(F.explode(F.array_distinct(F.array(*suffixes(F.col("host"))))).alias("suffix"), *more)


def suffix_statistics(urls: DataFrame, labelled: DataFrame) -> DataFrame:
    """``suffix, pages, bad, m`` of columns ``host`` and, in ``labelled``, ``label``.

    ``pages`` is the log of the number of URLs with the suffix, ``bad`` of ``m`` labelled ones are
    blocked. One row for each suffix, counted partially before it shuffles.
    """
    pages = by_suffix(urls).groupBy("suffix").agg(F.count("*").alias("n"))
    rates = by_suffix(labelled, "label").groupBy("suffix").agg(F.count("*").alias("m"), F.sum("label").alias("bad"))
    both = pages.join(rates, "suffix", "left")
    return both.select("suffix", F.log1p("n").alias("pages"), F.coalesce("bad", F.lit(0.0)).alias("bad"), F.coalesce("m", F.lit(0)).alias("m"))


def fold_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), url), F.lit(FOLDS)).cast("int")


def rate(bad: Column, m: Column, prior: float) -> Column:
    return (bad + PRIOR * prior) / (m + PRIOR)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features; null URLs count as empty."""
    url = F.coalesce(url, F.lit(""))
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return {
        "length": F.length(url),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": occurrences(path, "/"),
        "labels": F.when(host == "", 0).otherwise(occurrences(host, ".") + 1),
        "hyphens": occurrences(host, "-"),
        "digit_ratio": digits / F.greatest(F.length(url), F.lit(1)),
        "host_digits": F.length(F.regexp_replace(host, "[^0-9]", "")),
        "parameters": F.when(query == "", 0).otherwise(occurrences(query, "&") + 1),
        "entropy": entropy(host),
        "path_entropy": entropy(path),
        "secure": F.when(url.startswith("https:"), 1).otherwise(0),
    }


def featured(rows: DataFrame, model: Model, *keep: str, own: DataFrame | None = None) -> tuple[DataFrame, int]:
    """``keep`` and an array ``features`` of rows ``url, host, path``; the number of features.

    Statistics meet the rows by suffix: by broadcast where they are small, else by a shuffle in which
    Spark splits frequent suffixes. ``own`` are counts ``suffix, fold, bad, m`` of the rows' folds, which
    are taken from the rates, so that no row is described by its own label.
    """
    found = lexical(F.col("url"), F.col("host"), F.col("path"))
    parts = rows.select(
        *keep,
        F.array(*[f.cast("double") for f in found.values()]).alias("lexical"),
        fold_of(F.col("url")).alias("fold"),
        *[s.alias(f"s{i}") for i, s in enumerate(suffixes(F.col("host")))],
    )
    numbers = []
    for i in range(2):
        counts = model.statistics.select(F.col("suffix").alias(f"s{i}"), F.struct("pages", "bad", "m").alias(f"of{i}"))
        parts = parts.join(counts, f"s{i}", "left")
        bad, m = F.coalesce(f"of{i}.bad", F.lit(0.0)), F.coalesce(f"of{i}.m", F.lit(0))
        if own is not None:
            other = own.select(F.col("suffix").alias(f"s{i}"), "fold", F.struct("bad", "m").alias(f"own{i}"))
            parts = parts.join(other, [f"s{i}", "fold"], "left")
            bad, m = bad - F.coalesce(f"own{i}.bad", F.lit(0.0)), m - F.coalesce(f"own{i}.m", F.lit(0))
        numbers += [F.coalesce(f"of{i}.pages", F.lit(0.0)), rate(bad, m, model.prior)]
    return parts.select(*keep, F.concat("lexical", F.array(*numbers)).alias("features")), len(found) + 4


# The filter


def train(urls: DataFrame, labelled: DataFrame, most: int = MOST_ROWS, depth: int = 3, rounds: int = 20) -> Model:
    """Trees and suffix statistics from all ``urls`` (``url``) and ``labelled`` ones (``url, label``).

    Label 1 stands for block, 0 for allow; rows with another or a null label are left out. About
    ``most`` labelled rows at most are used, chosen by a hash of the URL. With labels of one kind
    only, or none, there are no trees.
    """
    parsed = [F.col("url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")]
    marked = labelled.where("label in (0, 1)").select(*parsed, F.col("label").cast("double").alias("label"))
    n = marked.count()
    marked = materialize(marked.where(F.pmod(F.xxhash64("url"), F.lit(2**20)) < min(1.0, most / max(n, 1)) * 2**20), "labelled-urls")
    statistics = materialize(suffix_statistics(urls.select(*parsed), marked), "suffixes")
    kinds = {r.label: r["count"] for r in marked.groupBy("label").count().collect()}
    model = Model([], statistics, kinds.get(1.0, 0) / max(sum(kinds.values()), 1))
    if len(kinds) < 2:
        return model
    own = by_suffix(marked, "label", fold_of(F.col("url")).alias("fold")).groupBy("suffix", "fold")
    own = own.agg(F.count("*").alias("m"), F.sum("label").alias("bad"))
    rows, _ = featured(marked, model, "label", own=own)
    # Written, since the learner reads it for every tree.
    rows = materialize(rows, "url-features").select("label", array_to_vector("features").alias("features"))
    fitted = GBTClassifier(maxDepth=depth, maxIter=rounds, seed=7).fit(rows)
    return model._replace(trees=trees.read(fitted.toDebugString))


def judge(
    urls: DataFrame,
    model: Model,
    rules: dict[str, str] | None = None,
    threshold: float = 0.5,
    url: str = "url",
) -> DataFrame:
    """All rows with ``host, path, rule, verdict, score``; these replace columns of that name.

    ``rules`` maps rules to ``allow`` or ``block``; the longest that fits decides, else the score
    does: the trees' probability that the URL is to be blocked, 0 without trees. A null URL and one
    without ``://`` have an empty host and path; they fit no rule and are scored like any other.
    """
    forest = model.trees
    rows = packed(urls, url=col(url))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    found, n = featured(rows, model, "row", "host", "path")
    features = [F.col("features")[i] for i in range(n)]
    total = sum((F.lit(w) * trees.value(root, features) for w, root in forest), F.lit(0.0))
    score = 1 / (1 + F.exp(-2 * total)) if forest else F.lit(0.0)
    found = found.withColumns({"score": score, "rule": rule_of(F.col("host"), F.col("path"), list(rules or ()))})
    ruled = F.lit(None).cast("string")
    for rule, verdict in (rules or {}).items():
        ruled = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(ruled)
    verdict = F.coalesce(ruled, F.when(F.col("score") >= threshold, BLOCK).otherwise(ALLOW))
    made = {c: F.col(c) for c in ("host", "path", "rule")}
    return unpacked(found, urls, **made, verdict=verdict, score=F.col("score"))

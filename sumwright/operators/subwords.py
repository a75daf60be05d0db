"""Subword vocabulary: merges learned from word counts, and words cut by them.

Words are sequences of characters. The most frequent pair of neighbouring symbols becomes one symbol,
again and again. Pair counts are kept in a table and changed only by the words that a merge changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumwright.session import checkpointed

#: Most frequent pairs that a round looks at, and most merges of a round.
LOOK = 1024
#: Words that a task keeps cut.
KEPT_WORDS = 2**16


def merged(symbols: list[str], left: str, right: str) -> list[str]:
    """The symbols with each pair of the two as one, from the left."""
    made, i = [], 0
    while i < len(symbols):
        if symbols[i] == left and i + 1 < len(symbols) and symbols[i + 1] == right:
            made.append(left + right)
            i += 2
        else:
            made.append(symbols[i])
            i += 1
    return made


def settled_merges(top: list, wanted: int, all_pairs: bool) -> list[tuple[str, str]]:
    """The next merges, as far as the most frequent pairs decide them.

    ``top`` are pairs in order. A merge changes the counts of pairs that its symbols are in, and what
    it makes is no more frequent than those. So further pairs follow as long as they share no symbol
    with merges before and are more frequent than all that these can make.
    """
    chosen: list[tuple[str, str]] = []
    used: set[str] = set()
    made_most = 0
    floor = 0 if all_pairs else top[-1].n
    for pair in top:
        if len(chosen) == wanted or pair.left in used or pair.right in used or (chosen and pair.n <= made_most):
            break
        chosen.append((pair.left, pair.right))
        used |= {pair.left, pair.right}
        # (x, left) and (right, y) become (x, left right) and (left right, y).
        near = [p.n for p in top if p is not pair and (p.right == pair.left or p.left == pair.right)]
        again = pair.n if pair.left == pair.right else 0
        made_most = max(made_most, min(pair.n, max([*near, floor, again])))
    return chosen


def applied(merges: list[tuple[str, str]]):
    """A function of an array column: the symbols after some merges, null where nothing changes."""

    @F.pandas_udf("array<string>")
    def cut(rows: pd.Series) -> pd.Series:
        def one(symbols) -> list[str] | None:
            own = list(symbols)
            for left, right in merges:
                if left in own:
                    own = merged(own, left, right)
            return own if len(own) < len(symbols) else None

        return pd.Series([one(s) for s in rows], dtype=object)

    return cut


def learn_merges(counts: DataFrame, merges: int, least: int = 2, look: int = LOOK) -> list[tuple[str, str]]:
    """The merges of word counts ``term, n``, in order, as one by one would give them.

    The pair that occurs most often in all words, each as often as its word, is merged, of equally
    frequent ones the first by left and then right symbol; none that occurs fewer than ``least`` times.
    Symbols are ordered by their UTF-8 bytes. Null and empty words have no pairs. A round merges as many
    pairs as cannot bear on each other; words with none of them stay as they are.
    """
    letters = F.filter(F.split("term", ""), lambda c: c != "")
    words = counts.where("term is not null and n > 0").groupBy("term").agg(F.sum("n").alias("n"))
    words = checkpointed(words.select(letters.alias("symbols"), "n"), "words")

    def pairs_of(symbols: str, sign: int, rows: DataFrame) -> DataFrame:
        last = F.greatest(F.size(symbols) - 1, F.lit(0))
        both = F.arrays_zip(F.slice(symbols, 1, last).alias("left"), F.slice(symbols, 2, last).alias("right"))
        exploded = rows.select(F.explode(both).alias("p"), (F.col("n") * sign).alias("n"))
        return exploded.select(F.col("p")["left"].alias("left"), F.col("p")["right"].alias("right"), "n")

    def summed(rows: DataFrame) -> DataFrame:
        found = rows.groupBy("left", "right").agg(F.sum("n").alias("n")).where("n > 0")
        return checkpointed(found, "pairs")

    pairs = summed(pairs_of("symbols", 1, words))
    found: list[tuple[str, str]] = []
    while len(found) < merges:
        top = pairs.where(F.col("n") >= least).orderBy(F.desc("n"), "left", "right").limit(look).collect()
        if not top:
            break
        new = settled_merges(top, merges - len(found), len(top) < look)
        found += new

        holds = F.lit(False)
        for left, right in new:
            holds = holds | (F.array_contains("symbols", left) & F.array_contains("symbols", right))
        rows = words.withColumn("after", F.when(holds, applied(new)("symbols")))
        rows = checkpointed(rows, "words")
        changed = rows.where("after is not null")
        delta = pairs_of("symbols", -1, changed).union(pairs_of("after", 1, changed))
        pairs = summed(pairs.union(delta))
        words = rows.select(F.coalesce("after", "symbols").alias("symbols"), "n")
    return found


def pieces(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """A word cut as the merges, in their order, would leave it."""
    symbols = list(word)
    while len(symbols) > 1:
        rank, left, right = min((ranks.get(p, len(ranks)), *p) for p in zip(symbols, symbols[1:], strict=False))
        if rank == len(ranks):
            break
        symbols = merged(symbols, left, right)
    return symbols


def cut_words(df: DataFrame, tokens: str, merges: list[tuple[str, str]], out: str = "pieces") -> DataFrame:
    """Adds ``out``, the pieces of all words of an array column one after the other.

    Null stays null. The merges are as many as the vocabulary is to have, so they go to all tasks.
    """
    held = df.sparkSession.sparkContext.broadcast({pair: i for i, pair in enumerate(merges)})

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = lru_cache(maxsize=KEPT_WORDS)(lambda word: pieces(word, held.value))
        for rows in batches:
            yield pd.Series([None if words is None else [p for w in words if w for p in one(w)] for words in rows], dtype=object)

    return df.withColumn(out, cut(tokens))


def piece_vocabulary(counts: DataFrame, merges: list[tuple[str, str]], reserved: int = 2) -> DataFrame:
    """``piece, piece_id``: the letters of the words in order, then what merges make, in theirs."""
    spark = counts.sparkSession
    letters = counts.select(F.explode(F.split("term", "")).alias("piece")).where("piece != ''").distinct()
    # As many letters as there are characters.
    first = sorted((r.piece for r in letters.collect()), key=lambda p: p.encode())
    known = dict.fromkeys([*first, *(a + b for a, b in merges)])
    return spark.createDataFrame([(p, i + reserved) for i, p in enumerate(known)], "piece string, piece_id long")

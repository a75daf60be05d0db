"""Subword merges against a trainer that counts everything anew for every merge."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sumwright.operators import subwords


def trained(counts, merges, least=2):
    words = {w: list(w) for w in counts}
    found = []
    for _ in range(merges):
        pairs = Counter()
        for w, symbols in words.items():
            for pair in zip(symbols, symbols[1:]):
                pairs[pair] += counts[w]
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p[0].encode(), p[1].encode()))
        if pairs[best] < least:
            break
        found.append(best)
        words = {w: subwords.merged(s, *best) for w, s in words.items()}
    return found, words


@pytest.mark.parametrize("seed, look", [(1, 1024), (2, 5), (3, 2)])
def test_merges_equal_those_of_a_plain_trainer(spark, seed, look):
    rng = random.Random(seed)
    parts = ["ab", "ba", "é", "aa", "abc", "x", "😀b", "cab", "."]
    counts = Counter("".join(rng.choices(parts, k=rng.randint(1, 5))) for _ in range(120))
    rows = [(w, n) for w, n in counts.items()] + [(None, 5), ("", 7), ("abab", 2), ("abab", 3), ("unused", 0)]
    counts["abab"] += 5
    df = spark.createDataFrame(rows, "term string, n long").repartition(3)
    want, words = trained(counts, 25)
    got = subwords.learn_merges(df, 25, look=look)
    assert got == want
    ranks = {p: i for i, p in enumerate(got)}
    assert all(subwords.pieces(w, ranks) == s for w, s in words.items())
    texts = spark.createDataFrame([(1, list(counts)), (2, None), (3, []), (4, ["new 😀 word", "", "abab"])], "id int, words array<string>")
    cut = {r.id: r.pieces for r in subwords.cut_words(texts, "words", got).collect()}
    assert cut[1] == [p for w in counts for p in words[w]] and cut[2] is None and cut[3] == [] and "".join(cut[4]) == "new 😀 wordabab"
    vocabulary = {r.piece: r.piece_id for r in subwords.piece_vocabulary(df, got).collect()}
    assert set(cut[1]) <= set(vocabulary) and sorted(vocabulary.values()) == list(range(2, 2 + len(vocabulary)))


def test_nothing_to_merge(spark):
    df = spark.createDataFrame([("a", 9), ("bc", 1)], "term string, n long")
    assert subwords.learn_merges(df, 5) == [] and subwords.learn_merges(df.limit(0), 5) == []
    assert subwords.learn_merges(df, 5, least=1) == [("b", "c")]
    assert df.select(F.lit(1)).count() == 2

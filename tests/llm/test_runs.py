import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sumwright.llm import queries, runs


def lyndon_brute(s):
    """The longest Lyndon word from each place on: up to the next smaller suffix."""
    ends = []
    for i in range(len(s)):
        ends.append(next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s)) - i)
    return ends


def brute(words, min_words=24, times=3):
    found, n = [], len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j - i + q
            if j > i and length >= max(min_words, times * q):
                part = words[start : start + length]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    found.append((start, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_lyndon_arrays_of_both_orders(codes):
    s = np.unique(codes, return_inverse=True)[1].tolist()
    assert runs.lyndon_lengths(s) == lyndon_brute(s)
    back = [max(s, default=0) - x for x in s]
    back = np.unique(back, return_inverse=True)[1].tolist()
    assert runs.lyndon_lengths(back) == lyndon_brute(back)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 9)), max_size=5), st.integers(3, 4))
def test_runs_against_brute_force(parts, times):
    codes = [c for part, k in parts for c in part * k]
    got = runs.runs_of(np.array(codes, np.int64), 6, times)
    assert [(s, n, p) for s, n, p in got] == sorted(brute(codes, 6, times))


def texts():
    rng = random.Random(3)
    words = [a + b for a in "bdfgk" for b in "aeiou"]
    rows = [(None, "own"), ("", "own"), (" \t\n", "own"), ("a " * 24, "own"), ("a " * 23, "own"), (" x" + " a b c" * 8 + " y ", "own")]
    for _ in range(150):
        text = []
        for _ in range(rng.randint(1, 6)):
            part = rng.choices(words, k=rng.choice([1, 2, 5, 9, 30]))
            text += part * rng.choice([1, 1, 2, 3, 5, 20])
        rows.append((rng.choice([" ", "\n", "   "]).join(text), "own"))
    part = rng.choices(words, k=4_000)
    rows += [(" ".join(part * 7), "own"), (" ".join(["w"] * 200_000), "own")]
    return rows + rows[3:5]


@pytest.mark.parametrize("min_words, times", [(24, 3), (12, 4), (40, 3)])
def test_rows(spark, min_words, times):
    rows = texts()
    docs = spark.createDataFrame(rows, "text string, runs string").repartition(3)
    got = runs.find_runs(docs, min_words=min_words, times=times)
    assert got.columns == ["text", "runs", "n_words", "collapsed"]
    found = got.collect()
    assert len(found) == len(rows)
    short = [r for r in found if len(r.text or "") < 20_000]
    assert len(short) == len(rows) - 2 and sum(bool(r.runs) for r in short) > 50
    for r in short:
        words = (r.text or "").encode().split()
        want = brute(words, min_words, times)
        assert [tuple(x) for x in r.runs] == want and r.n_words == len(words)
        dropped = {i for s, n, p in want for i in range(s + p, s + n)}
        assert r.collapsed.encode() == b" ".join(w for i, w in enumerate(words) if i not in dropped)
    long = {r.n_words: [tuple(x) for x in r.runs] for r in found if len(r.text or "") >= 20_000}
    assert long == {28_000: [(0, 28_000, 4_000)], 200_000: [(0, 200_000, 1)]}
    assert runs.find_runs(docs.limit(0)).count() == 0


def test_strongest_is_exact(spark):
    rows = [([(5, 100, 33), (0, 97, 32), (9, 97, 32)],), ([],), ([(7, 30, 10), (7, 60, 20), (2, 30, 10)],)]
    docs = spark.createDataFrame(rows, f"runs {runs.RUNS}").coalesce(1)
    got = docs.select(runs.strongest(F.col("runs")).alias("r")).collect()
    assert [r.r and tuple(r.r) for r in got] == [(0, 97, 32), None, (7, 30, 10)]


def test_query_against_brute_force(spark, tmp_path):
    rows = [(i, t) for i, (t, _) in enumerate(texts()) if len(t or "") < 20_000]
    rows += [(1000 + i, " ".join(f"w{j}" for j in range(i))) for i in range(1, 120)] + [(7, "a " * 24), (None, "x y")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_word_runs"](spark, str(tmp_path))
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got.columns == ["doc_id", *names]

    def want(doc, text):
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc).encode()) if doc is not None else 1, len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        found = brute(words)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        dropped = {i for s, k, p in found for i in range(s + p, s + k)}
        made = "".join(f"{s},{k},{p}\n" for s, k, p in found)
        kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
        numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        return (doc, len(found), *numbers, hashlib.sha256(made.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())

    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str(want(*r)) for r in rows)

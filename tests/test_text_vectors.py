"""Text vectors against numpy's decomposition of the whole matrix."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sumwright.operators import text_vectors


def matrix_of(texts):
    words = [Counter((t or "").lower().split()) for t in texts]
    vocabulary = sorted({w for c in words for w in c})
    idf = {w: math.log((1 + len(texts)) / (1 + sum(w in c for c in words))) + 1 for w in vocabulary}
    return vocabulary, np.array([[c[w] * idf[w] for w in vocabulary] for c in words])


def corpus(topics, n, seed=1):
    rng = random.Random(seed)
    words = [[f"{t}{i}" for i in range(12)] for t in "pqrstuvw"[:topics]]
    return [" ".join(rng.choices(rng.choice(words), k=30)) for _ in range(n)]


def test_few_texts_are_decomposed_exactly(spark):
    texts = [*corpus(3, 12), None, "", "A a b", "A a b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(3)
    space = text_vectors.fit(df, dimensions=20)
    vocabulary, a = matrix_of(texts)
    u, s, vt = np.linalg.svd(a)
    rank = int((s > 1e-9).sum())
    assert space.values == pytest.approx(s[:rank])
    found = {r.term: (r.idf, r.vector) for r in space.terms.collect()}
    v = np.array([found[w][1] for w in vocabulary])
    assert np.allclose(v.T @ v, np.eye(rank), atol=1e-8)
    rows = {r.row: r.vector for r in text_vectors.embed(space, df, "id").collect()}
    made = np.array([rows[i] for i in range(len(texts))])
    assert np.allclose(made, a @ v) and np.allclose(made @ v.T, a, atol=1e-7)
    unknown = spark.createDataFrame([(1, "never seen"), (2, None)], "id int, text string")
    assert {tuple(r.vector) for r in text_vectors.embed(space, unknown, "id").collect()} == {(0.0,) * rank}


def test_leading_directions_of_more_texts_and_the_same_again(spark):
    texts = corpus(6, 150)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    space = text_vectors.fit(df, dimensions=6)
    _, a = matrix_of(texts)
    s = np.linalg.svd(a, compute_uv=False)
    assert space.values == pytest.approx(s[:6], rel=1e-2)
    best = math.sqrt((s[6:] ** 2).sum())
    vocabulary = matrix_of(texts)[0]
    vectors = {r.term: r.vector for r in space.terms.collect()}
    v = np.array([vectors[w] for w in vocabulary])
    assert np.linalg.norm(a - a @ v @ v.T) < 1.02 * best
    again = text_vectors.fit(df.repartition(5), dimensions=6)
    assert np.allclose(np.abs(np.array([{r.term: r.vector for r in again.terms.collect()}[w] for w in vocabulary])), np.abs(v), atol=1e-6)
    rows = [r.vector for r in text_vectors.embed(space, df, "id").orderBy("row").collect()]
    units = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
    same = np.array([[x[0] == y[0] for y in texts] for x in texts])
    assert (units @ units.T)[same].mean() > 0.9 > 0.1 > abs((units @ units.T)[~same].mean())


def test_no_terms_at_all(spark):
    df = spark.createDataFrame([(1, None), (2, " ")], "id int, text string")
    for rows in (df, df.limit(0)):
        space = text_vectors.fit(rows)
        assert len(space.values) == 0 and text_vectors.embed(space, rows, "id").where(F.size("vector") > 0).count() == 0

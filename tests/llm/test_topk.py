import math
import random

import pytest

from sumwright.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string, tile string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "own", "own") for r in rows], SCHEMA)


def brute(queries, rows, k):
    import numpy as np

    def whole(v):
        ok = v is not None and all(x is not None and math.isfinite(x) for x in v)
        return [math.floor(256 * float(np.float32(x))) for x in v] if ok else None

    usable = [(i, w) for i, v in rows if i is not None and (w := whole(v)) is not None]
    found = []
    for q, v in queries:
        if q is not None and (w := whole(v)) is not None:
            scores = sorted((-sum(a * b for a, b in zip(w, c)), i) for i, c in usable if i != q)[:k]
            found += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(found)


@pytest.mark.parametrize(("tile", "shard", "fan"), [(1024, 8192, 16), (5, 11, 2)])
def test_against_brute_force(spark, monkeypatch, tile, shard, fan):
    monkeypatch.setattr(topk, "QUERY_TILE", tile)
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "FAN_IN", fan)
    rng = random.Random(tile)
    rows = [(i, [rng.choice([0.0, 0.5, -0.25, rng.gauss(0, 1)]) for _ in range(4)]) for i in range(150)]
    rows += [(200 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(60)]  # ties
    rows += [(300, None), (301, [None, 1.0, 1.0, 1.0]), (302, [float("nan")] * 4), (303, [float("inf")] * 4), (None, [1.0] * 4)]
    rows += [(304, []), (305, [3.0]), (10, [9.0, 9.0, 9.0, 9.0]), (10, [9.0, 9.0, 9.0, 9.0])]
    df = vectors(spark, rows)
    got = topk.top_k(df.where("vec_id % 10 = 0 or vec_id is null"), df, 5).collect()
    want = brute([r for r in rows if r[0] is None or r[0] % 10 == 0], rows, 5)
    assert sorted(map(tuple, got)) == want


def test_large_components_stay_exact(spark):
    rows = [(0, [1e6, 1.0]), (1, [1e6, 1.0]), (2, [1e6, 1.0078125]), (3, [-1e6, 0.0])]
    got = topk.top_k(vectors(spark, rows[:1]), vectors(spark, rows), 2).collect()
    assert sorted(map(tuple, got)) == brute(rows[:1], rows, 2)


def test_few_or_no_candidates(spark):
    one = vectors(spark, [(0, [1.0]), (1, [1.0])])
    assert [tuple(r) for r in topk.top_k(one.where("vec_id = 0"), one, 5).collect()] == [(0, 1, 1, 65536)]
    assert topk.top_k(one, one.limit(0)).count() == 0 and topk.top_k(one.limit(0), one).count() == 0

import random

import numpy as np
import pytest

from sumwright.llm import simhash
from tests.llm import brute

SCHEMA = "doc_id long, text string, fp string, node string, `x.y` string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "own", "own", "own") for r in rows], SCHEMA)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "Of", "é", "x1", "word", "other", "thing", "longer-one", " b"] + [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 5, 40, 300])))) for i in range(n)]
    for i in range(n, 2 * n):  # near copies: one word of many changed
        w = rng.choice(rows[:n])[1].split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    return rows


def test_fingerprint_and_components_against_brute_force(spark):
    rows = texts(1, 150) + [(900, None), (901, ""), (902, " \n"), (5, "the"), (5, "the"), (None, "alone here now"), (None, "the")]
    rows += [(903, "a b c " * 60_000)]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    prints = [(i, brute.simhash(t)) for i, t in rows]
    want = [(i, f"{f:016x}", c) for (i, f), c in zip(prints, brute.components(prints), strict=True)]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert {r.fingerprint for r in got if r.doc_id in (900, 901, 902)} == {"0" * 16}


@pytest.mark.parametrize("leaves", [1, 2, 40])
def test_tree_finds_every_close_pair(leaves):
    rng = np.random.default_rng(leaves)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    dense = base[0] ^ (np.uint64(1) << np.arange(40, dtype=np.uint64))  # all within two bits of each other
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    points = np.unique(np.concatenate([base, near, near ^ (near << np.uint64(1) & np.uint64(2)), dense]))
    tree = simhash.Tree.build(points[::3], leaves, 2)
    met, homes = set(), np.zeros(len(points), int)
    for _, rows, home in tree.route(points, 2):
        homes[rows[home]] += 1
        d = np.bitwise_count(points[rows[home]][:, None] ^ points[rows][None, :])
        for a, b in zip(*np.nonzero(d <= 2), strict=True):
            met.add(frozenset((int(rows[home][a]), int(rows[b]))))
    assert (homes == 1).all()
    close = np.argwhere(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2)
    assert {frozenset((int(a), int(b))) for a, b in close} <= met


def test_leaves_in_cells_give_the_same_components(spark, monkeypatch):
    rows = texts(2, 120)
    monkeypatch.setattr(simhash, "CELL", 16)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    want = brute.components([(i, brute.simhash(t)) for i, t in rows])
    assert got == {i: c for (i, _), c in zip(rows, want, strict=True)}


def test_long_chains_are_one_component(spark):
    order = random.Random(3).sample(range(500), 500)
    edges = [(a, b) if a % 2 else (b, a) for a, b in zip(order, order[1:])] + [(1000, 1001), (7, 7)]
    got = {r.node: r.root for r in simhash.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(500)} | {1000: 1000, 1001: 1000}


def test_one_of_each_group_stays(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(3, long), (2, long), (2, long), (None, long), (9, "quite another text of a few words"), (9, "short"), (None, "no id at all here")]
    source = docs(spark, rows)
    kept = simhash.keep_one(source)
    assert kept.columns == source.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(2, long), (9, "quite another text of a few words"), (9, "short"), (None, "no id at all here")], key=str)


def test_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.keep_one(docs(spark, [])).count() == 0


def test_one_row_stays_whatever_the_columns_types_are(spark):
    docs = spark.sql(
        """SELECT doc_id, text, map('a', doc_id) AS m, array(map('b', n)) AS name, named_struct('x', n) AS row, n AS stays
        FROM VALUES (1L, 'a b c d', 1), (1L, 'a b c d', 2), (2L, 'a b c d', 3), (3L, 'one two three four', 4) AS t(doc_id, text, n)"""
    ).repartition(3)
    got = simhash.keep_one(docs).collect()
    assert sorted(r.doc_id for r in got) == [1, 3] and all(r.m == {"a": r.doc_id} and r.row.x == r.stays for r in got)
    assert {tuple(map(str, r)) for r in got} == {tuple(map(str, r)) for r in simhash.keep_one(docs.repartition(1)).collect()}

import pytest

from sumwright.llm import mixing

SCHEMA = "doc_id long, source string, text string, size string, copy string, `a.b` string"


def docs(spark, rows):
    return spark.createDataFrame([(i, s, t, "own", "own", "x") for i, s, t in rows], SCHEMA)


def targets(sizes, weights=(5, 2, 1), most=3):
    """Excess shared again and again, as the contract words it."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    order += [None] if None in sizes else []
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return capped | share
        capped |= {s: most * sizes[s] for s in above}


def test_targets_share_the_whole_by_weight_and_stop_at_the_cap(spark):
    sizes = {"a": 1, "b": 1000, "c": 10, "d": 300, "B": 2, "é": 77, None: 500, "z": 0}
    rows = [(s, n) for s, n in sizes.items()] + [("b", 0)]
    found = mixing.source_targets(spark.createDataFrame(rows, "source string, size long"))
    found = {r.source: (r.source_size, r.target) for r in found.collect()}
    want = targets(sizes)
    assert {s: n for s, (n, _) in found.items()} == sizes
    for s, (_, target) in found.items():
        assert target == pytest.approx(want[s])
    assert sum(t for _, t in found.values()) == pytest.approx(sum(sizes.values()))


def test_many_sources_are_ranked_by_code_point(spark):
    names = [f"s{i:03d}" for i in range(300)] + ["S", "ß", "\U0001f600", "￮", None, ""]
    totals = spark.createDataFrame([(n, 1) for n in names], "source string, source_size long")
    found = {r.source: r.place for r in mixing.ranked(totals.repartition(7)).collect()}
    order = sorted((n for n in names if n is not None), key=lambda n: n.encode()) + [None]
    assert found == {n: i for i, n in enumerate(order)}


def test_copies_follow_rate_and_draw(spark):
    rows = [(i, "a" if i % 3 else "b", "w " * (i % 7)) for i in range(900)] + [(None, None, None), (5, "a", "x"), (5, "a", "x")]
    source = docs(spark, rows)
    plan = mixing.plan(source).collect()
    assert len(plan) == len(rows)
    for r in plan:
        rate = r.target / r.source_size if r.source_size else 0.0
        assert int(rate) <= r.copies <= int(rate) + 1 and r.copies <= 3
    for of in ("a", "b"):
        own = [r for r in plan if r.source == of]
        assert sum(r["size"] * r.copies for r in own) == pytest.approx(own[0].target, rel=0.1)
    assert [r for r in plan if r.source is None][0].copies == 0
    mixed = mixing.mix(source)
    assert mixed.columns == [*source.columns] and mixed.schema["copy"].dataType.simpleString() == "int"
    again = mixing.mix(source.repartition(5))
    assert sorted(map(str, mixed.collect())) == sorted(map(str, again.collect()))
    assert mixed.count() == sum(r.copies for r in plan)
    assert mixed.first()["a.b"] == "x" and mixed.first()["size"] == "own"


def test_words_are_runs_between_blanks(spark, one):
    rows = [None, "", " \t\n", "a", "a b c", " x  y\x0bz ", "w " * 50_000]
    assert one(mixing.word_count(mixing.F.col("v")), *rows) == [0, 0, 0, 1, 2, 3, 50_000]


def test_empty_table(spark):
    empty = docs(spark, [])
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert mixing.plan(docs(spark, [(1, "a", None)])).first().copies == 0

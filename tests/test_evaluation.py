"""Joins, accuracy, decoding and candidate choice."""

import pytest
from pyspark.sql import functions as F

from sumwright.operators import decode, evaluate
from sumwright.plans import workflows
from sumwright.sources import examples as ex

GOLD = [
    ("a", "subtract(5, 3), divide(#0, 3)", "0.66667", None),
    ("b", "add(1, 2)", "3", None),
    ("c", "greater(2, 1)", "yes", None),
    ("d", "table_max(rev, none)", "7.0", [["rev", "7", "2"]]),
    ("e", "add(2, 2)", "5", None),
]
PRED = [
    ("a", ["divide(", "5", "3", ")", "divide(", "3", "3", ")", "subtract(", "#0", "#1", ")", "EOF"]),
    ("b", ["add(", "2", "1", ")", "EOF"]),
    ("c", ["greater(", "2", "1", ")", "EOF"]),
    ("d", ["table_max(", "rev", "none", ")", "EOF"]),
    ("e", ["add(", "2", "2", ")", "EOF"]),
    ("b", ["EOF"]),
    ("z", ["add(", "1", "2", ")", "EOF"]),
]


@pytest.fixture()
def gold(spark):
    return spark.createDataFrame(
        GOLD, "id string, program string, exe_ans string, table array<array<string>>"
    )


@pytest.fixture()
def predictions(spark):
    return spark.createDataFrame(PRED, "id string, predicted array<string>")


def test_accuracy(gold, predictions):
    report, errors = workflows.evaluate(predictions, gold)
    row = report.first()
    assert (row.total, row.exe_correct, row.prog_correct) == (7, 4, 5)
    assert row.exe_acc == pytest.approx(4 / 7) and row.prog_acc == pytest.approx(5 / 7)
    assert row.equal_but_mismatch == 1 and row.missing_gold == 1
    assert row.equal_but_different_text == 2
    assert sorted(r.id for r in errors.collect()) == ["b", "e", "z"]


def test_empty_predictions(gold, predictions):
    row = evaluate.accuracy(evaluate.score(predictions.where("false"), gold)).first()
    assert row.total == 0 and row.exe_acc is None


def test_tolerance(spark, gold):
    pred = spark.createDataFrame([("b", ["add(", "1", "2.001", ")", "EOF"])], "id string, predicted array<string>")
    assert not evaluate.score(pred, gold).first().exe_ok
    assert evaluate.score(pred, gold, tolerance=0.01).first().exe_ok


def test_duplicates(predictions):
    assert [tuple(r) for r in evaluate.duplicate_ids(predictions, "id").collect()] == [("b", 2)]


def test_candidates(spark):
    rows = [
        ("one", 0, "Program: divide(1, 0)"),
        ("one", 1, "Program: add(1, 2)"),
        ("one", 2, "Program: add(3, 4)"),
        ("none", 0, "Program: add(1, x)"),
        ("none", 1, "Program: add(1, x) add(2, y)"),
        ("none", 2, "Program: add(3, x) add(4, y)"),
        ("empty", 0, "no idea"),
    ]
    raw = spark.createDataFrame(rows, "id string, sample_no int, raw_text string")
    chosen, stats = workflows.predict(raw, "sample_no")
    got = {r.id: r.predicted for r in chosen.collect()}
    assert got == {
        "one": ["add(", "1", "2", ")", "EOF"],
        "none": ["add(", "1", "x", ")", "add(", "2", "y", ")", "EOF"],
        "empty": ["EOF"],
    }
    row = stats.first()
    assert (row.total, row.valid, row.has_ops, row.empty, row.has_ops_pct) == (3, 3, 2, 1, 66.7)


def test_decoding_accepts_a_stream(spark, tmp_path):
    raw = [("a", "Program: add(1, 2)")]
    spark.createDataFrame(raw, "id string, raw_text string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, raw_text string").json(str(tmp_path / "in"))
    query = (
        decode.decode(stream).writeStream.format("memory").queryName("decoded")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    assert spark.table("decoded").first().predicted == ["add(", "1", "2", ")", "EOF"]


def test_attach_prediction(spark, predictions):
    nested = spark.createDataFrame([("b", ("q",))], "id string, qa struct<question string>")
    rows = evaluate.attach_prediction(nested, predictions).collect()
    assert sorted(len(r.qa.predicted) for r in rows if r.qa.question) == [1, 5]
    assert len(rows) == len(PRED)  # predictions without an example stay


def test_repeated_gold_counts_once(spark, gold, predictions):
    twice = gold.union(gold).union(gold.where("id = 'b'").withColumn("program", F.lit("add(9, 9)")))
    row = evaluate.accuracy(evaluate.score(predictions, twice)).first()
    assert (row.total, row.exe_correct, row.prog_correct) == (7, 4, 5)
    assert (row.missing_gold, row.duplicate_gold) == (1, 6)


def test_answers_are_compared_by_kind(spark):
    pred = spark.createDataFrame([(i, ["divide(", "1", "2", ")", "EOF"]) for i in "nt"], "id string, predicted array<string>")
    rows = [("n", "divide(1, 2)", "0.5", "number"), ("t", "divide(1, 2)", "0.5", "string")]
    gold = spark.createDataFrame(rows, "id string, program string, exe_ans string, exe_ans_kind string")
    assert {r.id: r.exe_ok for r in evaluate.score(pred, gold).collect()} == {"n": True, "t": False}
    assert all(r.exe_ok for r in evaluate.score(pred, gold.drop("exe_ans_kind")).collect())


def test_predictions_on_disk(spark, predictions, tmp_path):
    path = str(tmp_path / "pred")
    ex.write_json(predictions, path)
    back = ex.read_predictions(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted((i, p) for i, p in PRED)


def test_bucketed_gold_stays_where_it_is(spark, tmp_path):
    from sumwright.operators import evaluate
    from sumwright.sources import examples

    gold = [(f"g{i}", f"add({i}, 1)", str(i + 1)) for i in range(50)]
    gold = spark.createDataFrame(gold, "id string, program string, exe_ans string")
    examples.write_buckets(gold, "gold_in_buckets", 8, str(tmp_path / "gold"))
    try:
        stored = spark.table("gold_in_buckets")
        rows = [(f"g{i % 50}", ["add(", str(i), "1", ")", "EOF"]) for i in range(70)]
        predictions = spark.createDataFrame(rows, "id string, predicted array<string>")
        old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        scored = evaluate.score(predictions, stored, equality=False)
        plan = scored._jdf.queryExecution().executedPlan().toString()
        plain = evaluate.score(predictions, gold, equality=False)._jdf.queryExecution().executedPlan().toString()
        assert (plan.count("Exchange"), plain.count("Exchange")) == (1, 2)
        assert scored.where("exe_ok").count() == 50 and scored.count() == 70 and "equal" not in scored.columns
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE gold_in_buckets")

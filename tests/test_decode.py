"""Decoding, screening and choosing of candidates, compiled and folded."""

import random

from pyspark.sql import functions as F

from sumwright.functions import program_text as pt
from sumwright.functions.execute import screen_steps
from sumwright.functions.text import WHITESPACE, squeeze
from sumwright.operators.decode import decode, select_candidate
from sumwright.operators.run_programs import UNROLLED_RUN, with_usable

RAW = [
    "add(1, 2)", "Program: add(1,2) EOF\n\nQuestion: add(3, 4)", "xadd(1, 2) 9add(3, 4) add_(1, 2)", "", None,
    "foo(add(1, 2) add(foo(1, 2)", "add( , ) add(  a b ,\tc\x0bd ) add(, 1)", "add (1, 2) ADD\n(1 , 2)",
    "table_(a, b) Table_Sum( net  sales , none ) table_é(1, 2)", "add(\x011, $1) add(\\1, 2\x00)", "add(1, 2, 3) add(1)",
    "add(1, 2)add(#0, 3)exp(2, 3)", "no Program: Program: Add(1, 2) Explanation: add(2, 3)", "İ add(é, \U0001f600)",
]
ARGS = [
    "1", "-2.5", " 7 ", "ten", "#0", "#1", "# 0 ", "#-1", "#+1", "#x", "#9999999999", "const_3", "const_m1", "5%", "1e308",
    "nan", "1d", "", "(", None, "0",
]
OPS = [*(f"{op}(" for op in pt.ARITHMETIC_OPS), "Add(", "DIVIDE(", "table_max(", "add", "add((", "mod(", "(", None]


def test_decode_is_steps_to_tokens_of_parsed_text(spark):
    rng = random.Random(1)
    parts = ["add", "Table_x", "foo", "(", "(", ",", ",", ")", " ", "\n", "1", "#0", "a b", "　", "EOF", "exp(1, 2)"]
    texts = RAW + ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(3000)]
    decoded = decode(spark.createDataFrame([(t,) for t in texts], "raw_text string"))
    folded = pt.steps_to_tokens(pt.parse_raw_to_steps(F.col("raw_text")))
    rows = decoded.withColumn("folded", folded).collect()
    assert [r for r in rows if r["predicted"] != r["folded"]] == []
    assert sum(len(r["predicted"]) > 1 for r in rows) > 500


def test_decode_compiles(spark):
    """A fold over the calls was interpreted."""
    decoded = decode(spark.createDataFrame([("add(1, 2)",)], "raw_text string"))
    assert "lambdafunction" not in decoded._jdf.queryExecution().optimizedPlan().toString()


def test_usable_is_verified_and_screened(spark):
    rng = random.Random(2)
    programs = [None, [], ["EOF"], [None], ["x"], ["add(", "1", "2", ")"], ["add(", "1", "2", None, None]]
    for _ in range(4000):
        program = []
        plain = rng.random() < 0.6
        for _ in range(rng.randint(1, UNROLLED_RUN + 2)):
            op = rng.choice(OPS[:6] if plain else OPS)
            args = rng.choices(ARGS[:3] + ["#0", "const_3"] if plain else ARGS, k=2)
            program += [op, *args, rng.choices([")", None, "x"], [50, 1, 1])[0]]
        program += rng.choices([["EOF"], [None], ["eof"], [")", "EOF"], []], [50, 1, 1, 1, 1])[0]
        programs.append(program)
    df = spark.createDataFrame([(p,) for p in programs], "predicted array<string>")
    value = screen_steps(pt.tokens_to_steps(F.col("predicted")))
    folded = F.when(pt.verify_tokens(F.col("predicted")), value).isNotNull()
    rows = with_usable(df).withColumn("folded", folded).collect()
    assert [r for r in rows if r["usable"] is None or r["usable"] != r["folded"]] == []
    for long in (False, True):
        some = [r for r in rows if r["predicted"] and (len(r["predicted"]) > 4 * UNROLLED_RUN + 1) == long]
        assert 20 < sum(r["usable"] for r in some) < len(some)


def test_selection(spark):
    good, better = ["add(", "1", "2", ")", "EOF"], ["add(", "3", "4", ")", "EOF"]
    long = ["add(", "ten", "2", ")", "add(", "#0", "1", ")", "EOF"]
    groups = {
        "first usable": ([long, good, better], good),
        "longest": ([["EOF"], good[:4] + ["x"], long, long[::-1]], long),
        "empty": ([["EOF"], ["x"]], ["EOF"]),
        "null": ([None, long], ["EOF"]),
        "null and usable": ([None, long, better], better),
        None: ([["EOF"], good], good),
    }
    rows = [(i, k, p) for i, (ps, _) in groups.items() for k, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "id string, sample_no int, predicted array<string>").repartition(4)
    chosen = select_candidate(df)
    assert {r["id"]: r["predicted"] for r in chosen.collect()} == {i: want for i, (_, want) in groups.items()}
    # One buffer of tokens a group: two were sorted and shuffled before.
    assert chosen._jdf.queryExecution().optimizedPlan().toString().count("min_by(") == 1


def test_squeeze_is_python_split(one):
    rng = random.Random(3)
    alphabet = WHITESPACE + "   ab!~\x7f\x84\x86​\U0001f600"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 12))) for _ in range(3000)]
    assert one(squeeze(F.col("v")), *texts) == [" ".join(t.split()) for t in texts]

"""Program text, numbers, execution and equivalence."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sumwright.functions import points
from sumwright.functions import program_text as pt
from sumwright.functions.equivalence import equal_program
from sumwright.functions.execute import eval_program, screen_steps
from sumwright.functions.numbers import const_value, round_exact, row_to_nums, str_to_num
from sumwright.operators.run_programs import round_compiled, with_equality, with_result

V = "v"
TABLE = [
    ["", "2011", "2010"],
    ["revenue", "1", "2"],
    ["revenue", "$ 1,153.7 (a)", "139.9"],
    ["share", "5%", "const_2"],
    ["notes", "(123)", "4"],
    ["lonely"],
]
SCHEMA = "t array<string>, g array<array<string>>"


def tokens(program):
    """Gold text → tokens, by hand."""
    out = []
    for call in program.split("), "):
        if call:
            op, rest = call.rstrip(")").split("(", 1)
            out += [op + "(", *rest.split(", "), ")"]
    return out + ["EOF"]


def results(spark, programs, table=TABLE):
    """Every program through the compiled operator and through the fold; they must agree."""
    rows = [(p if isinstance(p, list) else tokens(p), table) for p in programs]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + SCHEMA)
    done = with_result(df, "t", "g").withColumn("fold", eval_program(F.col("t"), F.col("g")))
    found = done.orderBy("i").collect()
    for r in found:
        assert repr(r["result"]) == repr(r["fold"]), r
    return [tuple(r["result"]) for r in found]


def test_str_to_num(one):
    texts = ["1,153.7", " 5 ", "12%", "5 %", "const_100", "const_m1", "-.5", "1e3", "5."]
    assert one(str_to_num(F.col(V)), *texts) == [1153.7, 5, 0.12, 0.05, 100, -1, -0.5, 1000, 5]
    bad = ["", "1d", "0x1p3", "nan", "inf", "1_000", "ceiling", "const_x", "x%", "1 2", None]
    assert one(str_to_num(F.col(V)), *bad) == [None] * len(bad)


def test_row_to_nums(one):
    rows = [(["$ 1,153.7 (a)", "5%"],), (["(123)", "4"],), (["4", "x"],), ([],)]
    assert one(row_to_nums(F.col(V)), *rows, schema="v array<string>") == [
        [1153.7, 0.05],
        None,
        None,
        [],
    ]


def test_const_value(one):
    assert one(const_value(F.col(V)), "const_3", "const_m1", "3") == [3.0, None, None]


def test_rounding_is_exact(spark):
    rng = random.Random(5)
    xs = [rng.uniform(-1e6, 1e6) for _ in range(3000)] + [k / 2**20 for k in range(-800, 800)]
    xs += [k / 1600 for k in range(3000)] + [2.675, 1.000005, 1e17, 5e9 + 0.000005]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    both = df.select("x", round_exact(F.col("x")).alias("a"), round_compiled(F.col("x")).alias("b"))
    for r in both.collect():
        assert r.a == r.b == round(r.x, 5), r


def test_linearize(one):
    texts = [
        "subtract(153.7, 139.9), divide(#0, 139.9)",
        " ADD ( 1 ,\n2 ),  table_Max(net sales, none)",
        "divide(1,000, 50)",
        "xadd(1, 2)",
        "modulo(1, 2)",
        "",
        None,
    ]
    assert one(pt.linearize_program(F.col(V)), *texts) == [
        "subtract(153.7, 139.9) divide(#0, 139.9)",
        "add(1, 2) table_max(net sales, none)",
        "",
        "add(1, 2)",
        "",
        "",
        "",
    ]
    listed = [(["divide", "(", "100", ",", "50", ")"],), (["divide(", "100", "50", ")"],)]
    assert one(pt.linearize_tokens(F.col(V)), *listed, schema="v array<string>") == [
        "divide(100, 50)",
        "",
    ]


def test_tokenize(one):
    got = one(pt.tokenize_program(F.col(V)), "add(1, 2), divide(#0, 3)", "add(1, 2) x", "")
    assert got == [
        ["add(", "1", "2", ")", "divide(", "#0", "3", ")", "EOF"],
        ["add(", "1", "2", ")", " x", "EOF"],
        ["EOF"],
    ]


def test_parse_raw(one):
    texts = [
        "add(9, 9) Program: add(1, 2) foo(3, 4) Table_x( a , b )\n\nQuestion: add(5, 6)",
        "subtract(1, 2) Explanation: add(1, 2)",
        "add(divide(1, 2), 3)",
        "a\n\nContext: add(1, 2)",
        "a\n\nAnswer: add(1, 2)",
        "a\n\nFinal add(1, 2)",
        "",
        None,
    ]
    steps = F.transform(pt.parse_raw_to_steps(F.col(V)), lambda s: F.concat_ws("~", s["op"], s["a"], s["b"]))
    assert one(steps, *texts) == [
        ["add~1~2", "Table_x~a~b"],
        ["subtract~1~2"],
        ["add~divide(1~2"],
        [],
        [],
        [],
        [],
        [],
    ]


def test_verify_and_structure(one):
    rows = [
        tokens("add(1, 2)"),
        ["EOF"],
        ["add(", "1", "2", ")"],
        ["add(", "1", "2", "EOF"],
        ["Add(", "1", "2", ")", "EOF"],
        ["table_foo(", "1", "2", ")", "EOF"],
        ["foo(", "1", "2", ")", "EOF"],
        [],
    ]
    rows = [(r,) for r in rows]
    schema = "v array<string>"
    assert one(pt.verify_tokens(F.col(V)), *rows, schema=schema) == [
        True, True, False, False, True, True, False, False,
    ]
    assert one(pt.structure_ok(F.col(V)), *rows, schema=schema) == [
        True, True, True, True, False, False, False, True,
    ]


def test_execution_cases(spark):
    cases = {
        "subtract(153.7, 139.9), divide(#0, 139.9)": (0, 0.09864, None),
        "divide(1, 0)": (1, None, None),
        "exp(0, -1)": (1, None, None),
        "exp(10, 400)": (1, None, None),
        "exp(-8, 0.5)": (1, None, None),
        "exp(-8, 0.5), add(1, 2)": (0, 3.0, None),
        "exp(-8, 0.5), greater(#0, 2), add(1, 1)": (1, None, None),
        "add(12%, const_m1)": (0, -0.88, None),
        "greater(2, 1)": (0, None, "yes"),
        "greater(1, 1)": (0, None, "no"),
        "greater(2, 1), greater(1, 2), greater(#0, #1)": (0, None, "yes"),
        "greater(2, 1), add(#0, 1)": (1, None, None),
        "greater(2, 1), add(#0, #0)": (1, None, None),
        "add(#1, 1), add(1, 1)": (1, None, None),
        "add(#x, 1)": (1, None, None),
        "add(1, ceiling)": (1, None, None),
        "Add(1, 2)": (1, None, None),
        "table_foo(revenue, none)": (1, None, None),
        "table_max(revenue, none)": (0, 1153.7, None),
        "table_min(revenue, none), multiply(#0, 2)": (0, 279.8, None),
        "table_sum(revenue, none)": (0, 1293.6, None),
        "table_average(share, none)": (0, 1.025, None),
        "table_sum(notes, none)": (1, None, None),
        "table_sum(lonely, none)": (0, 0.0, None),
        "table_max(lonely, none)": (1, None, None),
        "table_average(lonely, none)": (1, None, None),
        "table_max(nowhere, none)": (1, None, None),
        "add(1, 2), table_max(#0, none)": (1, None, None),
        "add(1, 2), add(#0, 3), add(#1, 4), add(#2, 5), multiply(#3, #0)": (0, 45.0, None),
        "": (0, None, None),
    }
    assert results(spark, list(cases)) == list(cases.values())
    odd = [
        (["add", "1", "2", ")", "EOF"], (1, None, None)),
        (["add(", "1", "2", "EOF"], (0, None, None)),
        (["add(", "1", "2", ")", "add(", "1", "EOF"], (0, 3.0, None)),
        (["add(", "(1", "2", ")", "EOF"], (1, None, None)),
    ]
    assert results(spark, [o[0] for o in odd]) == [o[1] for o in odd]
    assert results(spark, ["table_max(revenue, none)", "add(1, 2)"], None) == [
        (1, None, None),
        (0, 3.0, None),
    ]


def direct(program):
    """The same steps with Python's own operators; any exception makes the program invalid."""
    operators = {
        "add": lambda x, y: x + y,
        "subtract": lambda x, y: x - y,
        "multiply": lambda x, y: x * y,
        "divide": lambda x, y: x / y,
        "exp": lambda x, y: x**y,
        "greater": lambda x, y: "yes" if x > y else "no",
    }
    values = []
    try:
        for op, a, b in program:
            x, y = (values[v] if isinstance(v, int) else v for v in (a, b))
            values.append(operators[op](x, y))
        last = values[-1]
        return (0, None, last) if last in ("yes", "no") else (0, round(last, 5), None)
    except (ZeroDivisionError, OverflowError, TypeError):
        return 1, None, None


def test_random_programs_match_direct_arithmetic(spark):
    rng = random.Random(11)
    programs, texts = [], []
    while len(programs) < 400:
        steps = []
        for i in range(rng.randint(1, 6)):
            args = [
                rng.randrange(i) if i and rng.random() < 0.5 else rng.choice([0.0, 2.5, -3.0, 17.25])
                for _ in range(2)
            ]
            op = rng.choice(["add", "subtract", "multiply", "divide", "exp", "greater"])
            steps.append((op, *args))
        programs.append(steps)
        shown = [
            f"{op}({', '.join(f'#{v}' if isinstance(v, int) else str(v) for v in (a, b))})"
            for op, a, b in steps
        ]
        texts.append(", ".join(shown))
    for steps, text, got in zip(programs, texts, results(spark, texts)):
        want = direct(steps)
        if want[1] is not None and math.isnan(want[1]):
            assert got[0] == 0 and math.isnan(got[1])
        elif want[1] is not None:
            assert got[0] == 0 and got[1] == pytest.approx(want[1], rel=1e-12), (text, got, want)
        else:
            assert got == want, (text, got, want)


def test_screening(one):
    programs = [
        "add(1, 2)", "greater(2, 1)", "divide(1, 0)", "add(1, const_m1)", "add(1, 5%)",
        "table_max(revenue, none)", "add(1, 2), multiply(#0, const_3)", "add(#1, 1)", "exp(-1, 0.5)",
    ]
    rows = [(tokens(p),) for p in programs]
    value = screen_steps(pt.tokens_to_steps(F.col(V)))
    assert one(value, *rows, (["EOF"],), schema="v array<string>") == [
        3.0, 1.0, None, None, None, None, 9.0, None, None, None,
    ]


EQUAL = [
    ("subtract(a, b), divide(#0, b)", "divide(a, b), divide(b, b), subtract(#0, #1)", True),
    ("add(a, b)", "add(b, a)", True),
    ("add(a, b)", "add(a, b)", True),
    ("subtract(a, b)", "subtract(b, a)", False),
    ("divide(a, b)", "divide(b, a)", False),
    ("add(a, b), exp(#0, c)", "add(b, a), exp(#0, c)", True),
    ("add(a, b), exp(#0, c)", "subtract(a, b), exp(#0, c)", False),
    ("add(a, b)", "add(a, c)", False),
    ("add(100, b)", "add(100.0, b)", False),
    ("greater(a, b)", "greater(a, b)", True),
    ("greater(a, b)", "greater(b, a)", False),
    ("add(a, b), greater(#0, c)", "add(b, a), greater(#0, c)", True),
    ("greater(a, b), add(#0, a)", "greater(a, b), add(#0, a)", False),
    ("table_max(r, none)", "table_max(r, none)", True),
    ("table_max(r, none)", "table_min(r, none)", False),
    ("table_max(r, none), add(#0, a)", "table_max(r, none), add(a, #0)", True),
    ("add(a, b), table_max(r, none)", "table_max(r, none)", True),
    ("add(a, b)", "", False),
    ("add(a, b)", "Add(a, b)", False),
    ("add(a, b), multiply(#0, c)", "multiply(a, c), multiply(b, c), add(#0, #1)", True),
    ("add(a, b)", "add(#0, b)", False),
    ("add(a, b)", "add(a, b), add(#2, a)", False),
    ("add(a, b), add(#0, c), add(#1, d), add(#2, e)", "add(e, d), add(#0, c), add(#1, b), add(#2, a)", True),
]


def test_equivalence(spark):
    rows = [(i, tokens(g), tokens(p)) for i, (g, p, _) in enumerate(EQUAL)]
    df = spark.createDataFrame(rows, "i int, gold array<string>, predicted array<string>")
    both = with_equality(df).withColumn("fold", equal_program(F.col("gold"), F.col("predicted")))
    for r in both.orderBy("i").collect():
        assert r["equal"] == r["fold"] == EQUAL[r["i"]][2], (EQUAL[r["i"]], r)
    strict = equal_program(F.col("gold"), F.col("predicted"), positional_tables=True)
    moved = df.where("i = 16").select(strict).first()[0]
    assert moved is False


POWERS = [
    ("exp(a, c), exp(a, d), multiply(#0, #1)", "add(c, d), exp(a, #0)", True),
    ("exp(a, c), exp(a, d), divide(#0, #1)", "subtract(c, d), exp(a, #0)", True),
    ("exp(a, c), exp(a, c), multiply(#0, #1)", "add(c, c), exp(a, #0)", True),
    ("add(a, b), exp(#0, c), exp(#0, d), multiply(#1, #2)", "add(d, c), add(b, a), exp(#1, #0)", True),
    ("divide(c, d), exp(a, #0), exp(a, #0), multiply(#1, #2)", "add(c, c), divide(#0, d), exp(a, #1)", True),
    ("exp(a, c), divide(#0, #0)", "divide(c, c), subtract(a, a), exp(#0, #1)", True),
    ("exp(a, c), exp(b, c), multiply(#0, #1)", "multiply(a, b), exp(#0, c)", False),  # for positive bases alone
    ("exp(a, c), exp(#0, d)", "multiply(c, d), exp(a, #0)", False),  # likewise
    ("exp(a, c), exp(a, d), add(#0, #1)", "add(c, d), exp(a, #0)", False),
    ("exp(a, c), exp(a, d), multiply(#0, #1)", "multiply(c, d), exp(a, #0)", False),
    ("exp(a, c), exp(b, d), multiply(#0, #1)", "exp(a, d), exp(b, c), multiply(#0, #1)", False),
    ("exp(a, c)", "exp(c, a)", False),
]


def random_powers(rng):
    """A product of powers of two bases, and another that is equal if the exponents add up alike."""

    def product(terms):
        steps, parts = [], []
        for base, exponents in terms:
            last = exponents[0]
            for e in exponents[1:]:
                steps.append(f"add({last}, {e})")
                last = f"#{len(steps) - 1}"
            steps.append(f"exp({base}, {last})")
            parts.append(f"#{len(steps) - 1}")
        last = parts[0]
        for part in parts[1:]:
            steps.append(f"multiply({last}, {part})")
            last = f"#{len(steps) - 1}"
        return ", ".join(steps)

    def dealt(exponents):
        terms = []
        for base, own in exponents.items():
            own = rng.sample(own, len(own))
            while own:
                k = rng.randint(1, len(own))
                terms.append((base, own[:k]))
                own = own[k:]
        return product(rng.sample(terms, len(terms)))

    exponents = {base: [*"cde", *rng.choices("cde", k=rng.randint(0, 2))] for base in "ab"}
    other = {base: list(own) for base, own in exponents.items()}
    equal = rng.random() < 0.5
    if not equal:
        base = rng.choice("ab")
        i = rng.randrange(len(other[base]))
        other[base][i] = rng.choice([x for x in "cde" if x != other[base][i]])
    return dealt(exponents), dealt(other), equal


def test_powers_of_one_base_add_their_exponents(spark):
    rng = random.Random(7)
    cases = POWERS + [random_powers(rng) for _ in range(60)]
    df = spark.createDataFrame([(i, tokens(g), tokens(p)) for i, (g, p, _) in enumerate(cases)], "i int, gold array<string>, predicted array<string>")
    found = {r.i: r.equal for r in with_equality(df).collect()}
    assert [c for i, c in enumerate(cases) if found[i] != c[2]] == []


def test_filter_on_results_is_cheap_to_plan(spark):
    df = spark.createDataFrame([(tokens("add(1, 2)"), tokens("add(2, 1)"))], "gold array<string>, predicted array<string>")
    both = with_equality(with_result(df)).where("result.num = 3 AND equal")
    assert both.count() == 1


def test_plain_programs_of_six_steps_are_laid_out(spark):
    """Every plain program of up to six steps has its value without the fold."""
    from sumwright.operators import run_programs

    text = "subtract(7, 3), divide(#0, 3), multiply(#1, 2), add(#2, 1), subtract(#3, 7), divide(#4, 3)"
    df = spark.createDataFrame([(text,)], "program string").select(pt.tokenize_program(F.col("program")).alias("predicted"))
    assert df.select(run_programs._matches("predicted", run_programs._PLAIN_PROGRAM)).first()[0] == 6
    assert run_programs.with_result(df).first().result.num == round(((4 / 3 * 2 + 1) - 7) / 3, 5)


def test_rational_programs_need_no_fold(spark, monkeypatch):
    """Equal by algebra and not by text: the random points of the compiled form settle it."""
    from sumwright.operators import run_programs

    monkeypatch.setattr(run_programs, "equal_program", lambda *_: F.lit(None).cast("boolean"))
    pairs = [
        ("add(5, 3), divide(#0, 2)", "divide(5, 2), divide(3, 2), add(#1, #0)", True),
        ("add(5, 3), divide(#0, 2)", "add(5, 3), divide(2, #0)", False),
        ("subtract(5, 3), subtract(#0, 3)", "add(3, 3), subtract(5, #0)", True),
        ("subtract(5, 5), divide(3, #0)", "subtract(3, 3), divide(5, #0)", None),
    ]
    df = spark.createDataFrame(pairs, "g string, p string, wanted boolean")
    df = df.select(pt.tokenize_program(F.col("g")).alias("gold"), pt.tokenize_program(F.col("p")).alias("predicted"), "wanted")
    assert [r.equal for r in run_programs.with_equality(df).collect()] == [p[2] for p in pairs]


def test_plain_programs_of_any_operation_need_no_fold(spark, monkeypatch):
    """Powers, comparisons, table steps and programs of any length are settled a batch at a time."""
    from sumwright.operators import run_programs

    monkeypatch.setattr(run_programs, "equal_program", lambda *_: F.lit(None).cast("boolean"))
    terms = [f"add(#{i}, {i})" for i in range(40)]
    cases = POWERS + [
        ("exp(7, 2), greater(#0, 3)", "exp(7, 2), greater(#0, 3)", True),
        ("add(7, 3), exp(#0, 2)", "add(3, 7), exp(#0, 2)", True),
        ("add(7, 3), exp(#0, 2)", "add(3, 7), exp(#0, 3)", False),
        ("exp(7, 2), greater(#0, 3)", "greater(7, 3)", False),
        ("greater(7, 3)", "greater(3, 7)", False),
        ("greater(7, 3)", "subtract(7, 3)", False),
        ("add(7, 3), subtract(#0, 3), greater(7, #1)", "subtract(3, 7), subtract(3, 3), add(#0, 7), greater(#2, 3)", True),
        ("table_max(rev, none), add(#0, 7)", "table_max(rev, none), add(7, #0)", True),
        ("table_max(rev, none), add(#0, 7)", "table_min(rev, none), add(#0, 7)", False),
        ("table_max(rev, none), add(#0, 7)", "table_max(net sales, none), add(#0, 7)", False),
        ("add(7, 3)", "add(7, 3), add(#2, 7)", False),
        ("add(7, 3)", "add(7, 4)", False),
        ("add(12, 3), add(1, 23)", "add(1, 23), add(12, 3)", False),
        (", ".join(["add(0, 0)", *terms]), ", ".join(["add(0, 0)", *(t.replace("add(#", "subtract(#") for t in terms)]), False),
        (", ".join(["add(x, x)", *terms]), ", ".join(["add(39, 0)", *(f"add({38 - i}, #{i})" for i in range(38)), "add(x, #38), add(#39, x)"]), True),
        ("subtract(5, 5), divide(3, #0), exp(#1, 3)", "subtract(3, 3), divide(5, #0), exp(#1, 3)", None),  # no value
        ("greater(7, 3), add(#0, 7)", "greater(7, 3), add(#0, 7)", None),  # arithmetic on a comparison
        ("modulo(7, 3)", "modulo(7, 3)", None),
    ]
    df = spark.createDataFrame([(i, tokens(g), tokens(p)) for i, (g, p, _) in enumerate(cases)], "i int, gold array<string>, predicted array<string>")
    found = {r.i: r.equal for r in run_programs.with_equality(df).collect()}
    assert [(c, found[i]) for i, c in enumerate(cases) if found[i] is not c[2]] == []


def random_pair(rng):
    """A program and one that is often the same by another order of operands; at times of no plain form."""
    odd = ["", " a", "a ", "1|2", "a(", "\x85a", "#", "##0", "#+0", "# 0", "#-1", "#9", "a#0", None, "EOF"]
    ops = rng.choice(([*pt.ALL_OPS, "modulo", "Add"], pt.ALL_OPS[:4], pt.ALL_OPS[:5], ["exp", "multiply", "divide"], ["table_max", "greater", "add"]))

    def argument(i):
        if rng.random() < 0.03:
            return rng.choice(odd)
        return f"#{rng.randrange(i)}" if i and rng.random() < 0.55 else rng.choice(["a", "b", "c", "a b"])

    def program():
        made = []
        for i in range(rng.randint(0, 5)):
            op = rng.choice(ops)
            a, b = (rng.choice("rs"), "none") if op.startswith("table_") else (argument(i), argument(i))
            made += [f"{op}(", a, b, ")"]
        if rng.random() < 0.03 and made:
            made[rng.randrange(len(made))] = None
        return [*made, "EOF"] if rng.random() < 0.97 else made or None

    gold = program()
    other = list(gold or [])
    for k in range(0, len(other) - 4, 4):
        if other[k] in ("add(", "multiply(") and rng.random() < 0.5:
            other[k + 1], other[k + 2] = other[k + 2], other[k + 1]
        if rng.random() < 0.08:
            other[k] = f"{rng.choice(ops)}("
    return gold, other if rng.random() < 0.8 else program()


@pytest.mark.parametrize("positional", [False, True])
def test_batches_settle_what_the_fold_says(spark, positional):
    rng = random.Random(5)
    pairs = [random_pair(rng) for _ in range(600)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, gold array<string>, predicted array<string>").coalesce(1)
    fold = {r.i: r.equal for r in df.select("i", equal_program(F.col("gold"), F.col("predicted"), positional).alias("equal")).collect()}
    got = {r.i: r.equal for r in with_equality(df, positional_tables=positional).collect()}
    assert [(p, fold[i], got[i]) for i, p in enumerate(pairs) if fold[i] is not got[i]] == []

    kind = pa.list_(pa.string())
    gold, predicted = (pa.array([p[side] for p in pairs], kind) for side in (0, 1))
    batch = points.equal_pairs(gold, predicted, positional).to_pylist()
    assert [(p, fold[i], batch[i]) for i, p in enumerate(pairs) if batch[i] not in (None, fold[i])] == []
    assert points.equal_pairs(gold[100:], predicted[100:], positional).to_pylist() == batch[100:]
    assert points.equal_pairs(gold[:0], predicted[:0], positional).to_pylist() == []
    assert batch.count(None) < 300 and batch.count(True) > 50 and batch.count(False) > 50


def test_tokens_of_any_bytes_are_compared():
    """Strings of Spark may hold what is no UTF-8."""
    flat = [b"add(", b"\xff", b"\xc3\xa9", b")", b"EOF", b"add(", b"\xc3\xa9", b"\xff", b")", b"EOF", b"add(", b"\xc3\xa9", b"\xfe", b")", b"EOF"]
    offsets, sizes = [0], b""
    for token in flat:
        sizes += token
        offsets.append(len(sizes))
    text = pa.StringArray.from_buffers(len(flat), pa.py_buffer(np.array(offsets, np.int32)), pa.py_buffer(sizes))
    lists = pa.ListArray.from_arrays([0, 5, 10, 15], text)
    assert points.equal_pairs(lists[:2], lists[1:]).to_pylist() == [True, False]


def test_numpy_powers_and_inverses_are_those_of_integers():
    from sumwright.functions import equivalence as e

    numbers = np.array([1, 2, 15, 16, 255, 256, 12345678, e.ORDER - 1], np.uint64)
    assert points.generated(numbers).tolist() == [pow(e.GENERATOR, n, e.PRIME) for n in numbers.tolist()]
    assert points.inverses(numbers).tolist() == [pow(n, -1, e.PRIME) for n in numbers.tolist()]
    assert points.inverses(numbers, e.ORDER).tolist() == [pow(n, -1, e.ORDER) for n in numbers.tolist()]
    assert points.inverses(np.array([0], np.uint64)).tolist() == [0]


def test_powers_and_inverses_are_those_of_integers(spark):
    from sumwright.functions import equivalence as e

    numbers = [1, 2, 15, 16, 255, 12345678, e.ORDER - 1]
    df = spark.createDataFrame([(n,) for n in numbers], "n bigint")
    got = df.select(e._generated(F.col("n")).alias("g"), e._inverse(F.col("n")).alias("i")).collect()
    assert [r.g for r in got] == [pow(e.GENERATOR, n, e.PRIME) for n in numbers]
    assert [r.i for r in got] == [pow(n, -1, e.PRIME) for n in numbers]


def test_tokens_are_computed_once_for_all_steps(spark):
    """Steps of an expression: what is not a variable would be computed anew in every one."""
    df = spark.range(1).select(F.lit("add(1, 2), add(#0, 3)").alias("program"))
    steps = pt.raw_token_steps(pt.tokenize_program(F.col("program")))
    calls = str(steps).count("regexp_extract_all")
    assert calls == 1 and len(df.select(steps.alias("s")).first().s) == 2


def test_kind_of_a_value_is_asked_once(spark):
    from sumwright.functions import shapes

    df = spark.createDataFrame([('[1, "a", null, true, [2], {"b": 3}]',)], "t string")
    assert str(shapes.kind_of(F.col("v"))).count("schema_of_variant") == 1
    assert [i.kind for i in df.select(shapes.items(F.col("t")).alias("i")).first().i] == [
        "number", "string", "null", "boolean", "list", "object"
    ]

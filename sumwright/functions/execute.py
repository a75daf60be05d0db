"""Program execution as a fold over the steps of one row; no shuffle and no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sumwright.functions.numbers import (
    NUMBER,
    const_value,
    parse_float,
    round_exact,
    row_to_nums,
    str_to_num,
)
from sumwright.functions.program_text import TABLE_PREFIX, raw_token_steps, structure_ok
from sumwright.functions.text import bind, strip

RESULT_TYPE = "struct<invalid:int,num:double,txt:string>"

# One executed step. Both fields null: a value Python keeps as a complex number, which may only
# flow into further arithmetic. A null element: the step failed, so the program is invalid.
VALUE_TYPE = "struct<num:double,txt:string>"

_REFERENCE = r"\A\s*[+-]?\d+\s*\z"


def table_lookup(table: Column, key: Column) -> Column:
    """Cells after the header of the last row whose header is ``key``; null when there is none."""
    row = F.try_element_at(F.filter(table, lambda r: F.get(r, F.lit(0)) == key), F.lit(-1))
    return bind(row, lambda r: F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))))


def table_value(op: Column, key: Column, table: Column) -> Column:
    """Maximum, minimum, sum or average of a table row; null when there is no such row of numbers."""

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)

    headless = F.exists(table, lambda r: F.coalesce(F.size(r), F.lit(0)) < 1)
    value = bind(
        row_to_nums(table_lookup(table, key)),
        lambda xs: F.when(op == "table_max", F.array_max(xs))
        .when(op == "table_min", F.array_min(xs))
        .when(op == "table_sum", total(xs))
        .when((op == "table_average") & (F.size(xs) > 0), total(xs) / F.size(xs)),
    )
    return F.when(~headless, value)


def _reference(arg: Column) -> Column:
    """Step number in ``#k``; null when it is no integer."""
    bare = F.replace(arg, F.lit("#"), F.lit(""))
    return F.when(bare.rlike(_REFERENCE), strip(bare).try_cast("int"))


def _operand(arg: Column) -> Column:
    """Argument → ``struct<num, ref>``; both null when it is neither a number nor a reference."""

    def pair(num: Column, ref: Column) -> Column:
        return F.struct(num.cast("double").alias("num"), ref.cast("int").alias("ref"))

    nothing = F.lit(None)
    return (
        F.when(arg.rlike(NUMBER), pair(arg.try_cast("double"), nothing))
        .when(arg.contains("#"), pair(nothing, _reference(arg)))
        .otherwise(pair(str_to_num(strip(arg)), nothing))
    )


def _parse(step: Column, index: Column, table: Column | None) -> Column:
    """Resolve everything in a step that does not depend on earlier steps."""

    def fields(op: Column, is_table: bool, a: Column, b: Column, ok: Column) -> Column:
        return F.struct(
            op.alias("op"),
            F.lit(is_table).alias("is_table"),
            a["num"].cast("double").alias("a_num"),
            a["ref"].cast("int").alias("a_ref"),
            b["num"].cast("double").alias("b_num"),
            b["ref"].cast("int").alias("b_ref"),
            F.coalesce(ok, F.lit(False)).alias("ok"),
        )

    def resolved(x: Column) -> Column:
        return x["num"].isNotNull() | ((x["ref"] >= 0) & (x["ref"] < index))

    def arithmetic(op: Column) -> Column:
        return bind(
            F.struct(_operand(step["a"]).alias("a"), _operand(step["b"]).alias("b")),
            lambda v: fields(
                op,
                False,
                v["a"],
                v["b"],
                (step["op"] == F.concat(op, F.lit("("))) & resolved(v["a"]) & resolved(v["b"]),
            ),
        )

    def table_step(op: Column) -> Column:
        usable = (
            (step["op"] == F.concat(op, F.lit("(")))
            & (step["b"] != "")
            & ~F.concat(step["a"], step["b"]).rlike(r"[()|]")
            & ~step["a"].contains("#")
        )
        value = F.lit(None) if table is None else table_value(op, strip(step["a"]), table)
        return bind(
            F.struct(
                F.when(usable, value).cast("double").alias("num"),
                F.lit(None).cast("int").alias("ref"),
            ),
            lambda v: fields(op, True, v, v, v["num"].isNotNull()),
        )

    return bind(
        F.btrim(step["op"], F.lit("(")),
        lambda op: F.when(op.startswith(TABLE_PREFIX), table_step(op)).otherwise(arithmetic(op)),
    )


def _number(value: Column) -> Column:
    return F.struct(value.alias("num"), F.lit(None).cast("string").alias("txt")).cast(VALUE_TYPE)


def _text(value: Column) -> Column:
    return F.struct(F.lit(None).cast("double").alias("num"), value.alias("txt")).cast(VALUE_TYPE)


def _yes_no(condition: Column) -> Column:
    return _text(F.when(condition, F.lit("yes")).otherwise(F.lit("no")))


def _power(x: Column, y: Column) -> Column:
    """Power with Python's failures: 0 to a negative power and overflow fail the step; a negative
    base with a fractional exponent is complex."""
    infinity = F.lit(float("inf"))
    value = F.pow(x, y)
    overflow = (
        (F.abs(value) == infinity) & (F.abs(x) != infinity) & (F.abs(y) != infinity)
    )
    complex_value = F.isnan(value) & ~F.isnan(x) & ~F.isnan(y)
    return F.when(((x != 0) | (y >= 0)) & ~overflow, _number(F.when(~complex_value, value)))


def _run_step(acc: Column, step: Column) -> Column:
    def apply(v: Column) -> Column:
        op, x, y, xt, yt = step["op"], v["x"], v["y"], v["xt"], v["yt"]
        both_real = x.isNotNull() & y.isNotNull()
        on_text = F.when(op == "greater", _yes_no(xt > yt)).when(
            op == "add", _text(F.concat(xt, yt))
        )
        on_numbers = (
            F.when(op == "add", _number(x + y))
            .when(op == "subtract", _number(x - y))
            .when(op == "multiply", _number(x * y))
            .when(op == "divide", F.when((y != 0) | y.isNull(), _number(F.try_divide(x, y))))
            .when(op == "exp", F.when(both_real, _power(x, y)).otherwise(_number(x + y)))
            .when(both_real, _yes_no((x > y) & ~F.isnan(x) & ~F.isnan(y)))
        )
        return F.when(xt.isNull() & yt.isNull(), on_numbers).when(
            xt.isNotNull() & yt.isNotNull(), on_text
        )

    def look_up(num: Column, ref: Column) -> Column:
        return F.when(ref.isNull(), _number(num)).otherwise(F.get(acc, ref))

    def operands(v: Column) -> Column:
        return F.struct(
            v["a"]["num"].alias("x"),
            v["a"]["txt"].alias("xt"),
            v["b"]["num"].alias("y"),
            v["b"]["txt"].alias("yt"),
        )

    found = F.struct(
        look_up(step["a_num"], step["a_ref"]).alias("a"),
        look_up(step["b_num"], step["b_ref"]).alias("b"),
    )
    return F.when(step["is_table"], _number(step["a_num"])).otherwise(
        bind(found, lambda v: bind(operands(v), apply))
    )


def _outcome(invalid: Column, num: Column, txt: Column) -> Column:
    return F.struct(
        invalid.cast("int").alias("invalid"),
        num.cast("double").alias("num"),
        txt.cast("string").alias("txt"),
    )


def eval_program(tokens: Column, table: Column | None = None) -> Column:
    """Run a token program → ``struct<invalid, num, txt>``.

    ``num`` is rounded to 5 decimals, ``txt`` is ``yes`` or ``no``. Both are null when invalid is 1
    and when there is no step at all, which is valid. Without ``table`` a table operation is
    invalid.
    """
    nothing = F.lit(None)
    invalid = _outcome(F.lit(1), nothing, nothing)

    def run(parsed: Column) -> Column:
        values = F.aggregate(
            parsed,
            F.array().cast(f"array<{VALUE_TYPE}>"),
            lambda acc, step: F.concat(acc, F.array(_run_step(acc, step))),
        )
        return F.when(F.exists(parsed, lambda s: ~s["ok"]), invalid).otherwise(
            bind(values, finish)
        )

    def finish(values: Column) -> Column:
        last = F.element_at(values, -1)
        return (
            F.when(F.exists(values, F.isnull), invalid)
            .when(last["txt"].isin("yes", "no"), _outcome(F.lit(0), nothing, last["txt"]))
            .when(last["num"].isNotNull(), _outcome(F.lit(0), round_exact(last["num"]), nothing))
            .otherwise(invalid)
        )

    steps = F.transform(raw_token_steps(tokens), lambda s, i: _parse(s, i, table))
    return (
        F.when(~structure_ok(tokens), invalid)
        .when(F.size(tokens) < 5, _outcome(F.lit(0), nothing, nothing))
        .otherwise(bind(steps, run))
    )


def screen_reference(arg: Column) -> Column:
    """Step number in ``#k`` by the screening rule; null when it is no integer."""
    ref = F.substring(arg, 2, 2147483647)
    return F.when(ref.rlike(_REFERENCE), strip(ref).try_cast("int"))


def screen_number(arg: Column) -> Column:
    """Plain number or ``const_N`` → double, else null."""
    return F.coalesce(const_value(arg), parse_float(arg))


def screen_value(op: Column, x: Column, y: Column, suffix: str = "") -> Column:
    """One screened step; null when an operand is missing. ``suffix`` ends the names of operations."""
    return (
        F.when(op == "add" + suffix, x + y)
        .when(op == "subtract" + suffix, x - y)
        .when(op == "multiply" + suffix, x * y)
        .when(op == "divide" + suffix, F.try_divide(x, y))
        .when(op == "exp" + suffix, F.pow(x, y))
        .when(
            (op == "greater" + suffix) & x.isNotNull() & y.isNotNull(),
            F.when(x > y, 1.0).otherwise(0.0),
        )
    )


def screen_steps(steps: Column) -> Column:
    """Lenient run used to screen candidates → double, null when any step has no finite value.

    Arguments are plain numbers, ``const_N`` or ``#k``; ``greater`` gives 1 or 0; table
    operations, percentages and ``const_m1`` have no value here.
    """
    infinity = F.lit(float("inf"))

    def argument(arg: Column, acc: Column) -> Column:
        return F.when(arg.startswith("#"), F.get(acc, screen_reference(arg))).otherwise(screen_number(arg))

    def run(acc: Column, step: Column) -> Column:
        value = bind(
            F.struct(
                argument(step["a"], acc).alias("x"), argument(step["b"], acc).alias("y")
            ),
            lambda v: screen_value(step["op"], v["x"], v["y"]),
        )
        finite = bind(value, lambda z: F.when(~F.isnan(z) & (F.abs(z) != infinity), z))
        return F.concat(acc, F.array(finite))

    values = F.aggregate(steps, F.array().cast("array<double>"), run)
    return bind(
        values,
        lambda vs: F.when(
            (F.size(vs) > 0) & ~F.exists(vs, F.isnull), F.try_element_at(vs, F.lit(-1))
        ),
    )

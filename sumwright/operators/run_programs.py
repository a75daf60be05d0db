"""Program execution and comparison over a whole DataFrame.

The column functions of ``functions.execute`` and ``functions.equivalence`` handle every program,
but a fold over an array is interpreted. Nearly all real programs are a few plain
arithmetic or table steps. To run, such programs are laid out as ordinary columns, one projection per
step, which Spark compiles; to compare, they are evaluated a batch at a time by numpy
(``functions.points``). Every other program takes the fold. Both are maps: nothing shuffles.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumwright.functions.equivalence import equal_program
from sumwright.functions.execute import (
    eval_program,
    screen_number,
    screen_reference,
    screen_steps,
    screen_value,
    table_value,
)
from sumwright.functions.numbers import round_exact
from sumwright.functions.points import equal_pairs
from sumwright.functions.program_text import (
    ARITHMETIC_OPS,
    EOF,
    TABLE_PREFIX,
    tokens_to_steps,
    verify_tokens,
)
from sumwright.functions.text import strip

#: Steps laid out for running a program.
UNROLLED_RUN = 6

_ARG = r"(?:-?\d+(?:\.\d+)?|const_\d+|#\d)"
_CALC = r"(?:add|subtract|multiply|divide|exp)"
# Joined with '|': up to UNROLLED_RUN calls with plain arguments; only the last may compare.
_TABLE_CALL = r"table_(?:max|min|sum|average)\(\|[^|()#]+\|[^|()#]+"
_PLAIN_PROGRAM = (
    rf"\A(?:(?:{_CALC}\(\|{_ARG}\|{_ARG}|{_TABLE_CALL})\|\)\|){{0,{UNROLLED_RUN - 1}}}"
    rf"(?:(?:{_CALC}|greater)\(\|{_ARG}\|{_ARG}|{_TABLE_CALL})\|\)\|{EOF}\z"
)

_RUN = range(UNROLLED_RUN)
_TEMP = "__sw_"


def _project(df: DataFrame, **columns: str) -> DataFrame:
    """Add columns given as SQL text."""
    return df.selectExpr("*", *[f"{sql} AS {_TEMP}{name}" for name, sql in columns.items()])


def _matches(tokens: str, pattern: str) -> Column:
    """Step count of a program that has the given form, else 0."""
    count = F.expr(f"CAST((size(`{tokens}`) - 1) DIV 4 AS INT)")
    return F.when(F.array_join(F.col(tokens), "|").rlike(pattern), count).otherwise(0)


def _token(tokens: str, step: int, place: int) -> str:
    return f"get(`{tokens}`, {4 * step + place})"


def _settle(df: DataFrame, out: str, value: Column) -> DataFrame:
    """Put ``value`` behind a generator of one row and drop the temporary columns.

    A filter on the result would otherwise be rewritten in terms of the first input columns, and
    its size multiplies with every step on the way down. Through a generator it does not pass.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if not c.startswith(_TEMP)]
    return df.select(*kept, F.explode_outer(F.array(value)).alias(out))


def round_compiled(value: Column) -> Column:
    """``round_exact`` to 5 decimals for ordinary magnitudes, as one compiled expression.

    A product whose fraction is well away from one half needs no error term. Zero has no sign.
    """
    product = value * 100000.0
    nearest = F.rint(product)
    clear = (F.abs(product) < 2.0**40) & (F.abs(F.abs(product - nearest) - 0.5) > 1e-3)
    return F.when(clear, nearest / 100000.0 + 0.0).otherwise(round_exact(value))


def with_result(
    df: DataFrame, tokens: str = "predicted", table: str | None = None, out: str = "result"
) -> DataFrame:
    """Add ``out``: ``struct<invalid, num, txt>`` of running ``tokens`` over ``table``."""
    run = df.withColumn(f"{_TEMP}n", _matches(tokens, _PLAIN_PROGRAM))

    def argument(step: int, place: int) -> str:
        token = _token(tokens, step, place)
        earlier = " ".join(f"WHEN '#{k}' THEN {_TEMP}v{k}" for k in range(step))
        reference = f"CASE {token} {earlier} END" if step else "CAST(NULL AS DOUBLE)"
        # A table step has no numbers: a failing cast is slow.
        return f"""CASE WHEN {_TEMP}n <= {step} OR startswith({_token(tokens, step, 0)}, '{TABLE_PREFIX}') THEN NULL
            WHEN startswith({token}, '#') THEN {reference}
            WHEN startswith({token}, 'const_') THEN try_cast(substring({token}, 7) AS DOUBLE)
            ELSE try_cast({token} AS DOUBLE) END"""

    for step in _RUN:
        x, y = f"{_TEMP}x{step}", f"{_TEMP}y{step}"
        op, key = F.expr(_token(tokens, step, 0)), F.expr(_token(tokens, step, 1))
        looked_up = F.lit(None).cast("double")
        if table is not None:
            name = F.substring_index(op, "(", 1)
            looked_up = F.when(
                (F.col(f"{_TEMP}n") > step) & op.startswith(TABLE_PREFIX),
                table_value(name, strip(key), F.col(table)),
            )
        run = run.withColumn(f"{_TEMP}t{step}", looked_up)
        run = _project(run, **{f"x{step}": argument(step, 1), f"y{step}": argument(step, 2)})
        run = _project(
            run,
            **{
                f"v{step}": f"""CASE {_token(tokens, step, 0)}
                    WHEN 'add(' THEN {x} + {y} WHEN 'subtract(' THEN {x} - {y}
                    WHEN 'multiply(' THEN {x} * {y} WHEN 'divide(' THEN try_divide({x}, {y})
                    WHEN 'exp(' THEN power({x}, {y})
                    WHEN 'greater(' THEN CASE WHEN {x} > {y} THEN 1D WHEN {x} <= {y} THEN 0D END
                    ELSE {_TEMP}t{step} END"""
            },
        )
    # Any missing or infinite value (bad reference, zero divisor, overflow) is left to the fold.
    sound = " AND ".join(f"({_TEMP}n <= {k} OR abs({_TEMP}v{k}) <= 1.7e308D)" for k in _RUN)
    last = ", ".join(f"{_TEMP}v{k}" for k in reversed(_RUN))
    run = _project(
        run,
        last=f"CASE WHEN {_TEMP}n > 0 AND {sound} THEN coalesce({last}) END",
        compares=f"{_TEMP}n > 0 AND try_element_at(`{tokens}`, -5) = 'greater('",
    )
    final, compares = F.col(f"{_TEMP}last"), F.col(f"{_TEMP}compares")
    plain = F.struct(
        F.lit(0).alias("invalid"),
        F.when(~compares, round_compiled(final)).alias("num"),
        F.when(compares, F.when(final == 1.0, "yes").otherwise("no")).alias("txt"),
    )
    folded = eval_program(F.col(tokens), None if table is None else F.col(table))
    return _settle(run, out, F.when(final.isNotNull(), plain).otherwise(folded))


def with_usable(df: DataFrame, tokens: str = "predicted", out: str = "usable") -> DataFrame:
    """Add ``out``: whether ``tokens`` are verified and every step has a value when screened.

    A step's numbers and references are read in one projection, its value is one more. Programs of
    more than ``UNROLLED_RUN`` steps take the fold.
    """
    size, last = F.size(tokens), F.try_element_at(F.col(tokens), F.lit(-1))
    shaped = (size >= 5) & ((size - 1) % 4 == 0) & F.coalesce(last == EOF, F.lit(True))
    n = F.col(f"{_TEMP}n")
    run = df.withColumn(f"{_TEMP}n", F.when(shaped, F.floor((size - 1) / 4).cast("int")).otherwise(0))

    def token(step: int, place: int) -> Column:
        return F.expr(_token(tokens, step, place))

    def read(step: int) -> dict[str, Column]:
        # A missing closing token passes, as it does in ``verify_tokens``.
        here = (n > step) & (n <= UNROLLED_RUN) & F.coalesce(token(step, 3) == ")", F.lit(True))
        op = token(step, 0)
        plain = F.when(op.isin([f"{known}(" for known in ARITHMETIC_OPS]), op).otherwise(F.lower(op))
        columns = {f"{_TEMP}o{step}": F.when(here, plain)}
        for name, place in (("x", 1), ("y", 2)):
            marked = token(step, place).startswith("#")
            columns[f"{_TEMP}{name}{step}"] = F.when(here & ~marked, screen_number(token(step, place)))
            if step:
                columns[f"{_TEMP}{name}r{step}"] = F.when(here & marked, screen_reference(token(step, place)))
        return columns

    run = run.withColumns({name: column for step in _RUN for name, column in read(step).items()})
    for step in _RUN:
        earlier = [F.col(f"{_TEMP}v{k}") for k in range(step)]

        def operand(name: str) -> Column:
            number = F.col(f"{_TEMP}{name}{step}")
            if not earlier:
                return number
            return F.coalesce(number, F.get(F.array(*earlier), F.col(f"{_TEMP}{name}r{step}")))

        value = screen_value(F.col(f"{_TEMP}o{step}"), operand("x"), operand("y"), "(")
        run = run.withColumn(f"{_TEMP}v{step}", value)
    sound = n > 0
    for step in _RUN:
        sound &= (n <= step) | F.coalesce(F.abs(f"{_TEMP}v{step}") < float("inf"), F.lit(False))
    folded = F.when(verify_tokens(F.col(tokens)), screen_steps(tokens_to_steps(F.col(tokens))))
    usable = F.when(n > UNROLLED_RUN, folded.isNotNull()).otherwise(sound)
    return run.withColumn(out, usable).drop(*[c for c in run.columns if c.startswith(_TEMP)])


def with_equality(
    df: DataFrame,
    gold: str = "gold",
    pred: str = "predicted",
    out: str = "equal",
    positional_tables: bool = False,
) -> DataFrame:
    """Add ``out``: whether the ``pred`` program is the same expression as the ``gold`` program.

    Programs of plain form, of any operations and any number of steps, are evaluated a batch at a time
    (``functions.points``). What has no value at a point, and programs of other forms, take the fold.
    """

    @F.arrow_udf("boolean")
    def settled(ours: pa.Array, theirs: pa.Array) -> pa.Array:
        return equal_pairs(ours, theirs, positional_tables)

    verdict = settled(F.col(gold), F.col(pred))
    folded = equal_program(F.col(gold), F.col(pred), positional_tables)
    return _settle(df.withColumn(f"{_TEMP}verdict", verdict), out, F.coalesce(F.col(f"{_TEMP}verdict"), folded))

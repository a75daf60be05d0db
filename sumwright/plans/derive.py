"""Programs, tables and predictions derived from ordinary tables, one per row.

The same rows are described in Spark here and in SQL in ``catalog``; every derivation is a map over
``lineitem`` and grows with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumwright.functions.numbers import round_exact
from sumwright.functions.program_text import tokenize_program
from sumwright.operators.partition import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fixed(column: str) -> Column:
    """A number as text with two decimals."""
    return F.col(column).cast("decimal(15,2)").cast("string")


def price() -> Column:
    return fixed("l_extendedprice")


def quantity() -> Column:
    return fixed("l_quantity")


def discount() -> Column:
    return fixed("l_discount")


def tax() -> Column:
    return fixed("l_tax")


def fill(template: str) -> Column:
    """Template text with ``{P}``, ``{Q}``, ``{D}`` and ``{X}`` replaced by the row's numbers."""
    slots = {"P": price(), "Q": quantity(), "D": discount(), "X": tax()}
    parts: list[Column] = []
    for i, piece in enumerate(template.split("{")):
        if i:
            parts.append(slots[piece[0]])
            piece = piece[2:]
        parts.append(F.lit(piece))
    return F.concat(*parts)


def choose(index: Column, *options: Column) -> Column:
    """``options[index]``; the last one for any other index."""
    chosen = options[-1]
    for i, option in reversed(list(enumerate(options[:-1]))):
        chosen = F.when(index == i, option).otherwise(chosen)
    return chosen


def row_id() -> Column:
    """(l_orderkey, l_linenumber) repeats; with these five columns a row is identified."""
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", price())


PRED_VARIANTS = (
    "subtract({P}, {Q}), divide(#0, {Q})",
    "subtract({P}, {Q}), divide(#0, {Q})",
    "divide({P}, {Q}), divide({Q}, {Q}), subtract(#0, #1)",
    "subtract({Q}, {P}), divide(#0, {Q})",
    "subtract({P}, 1), divide(#0, {Q})",
    "modulo({P}, {Q})",
    "",
    "divide({P}, {Q}), subtract(#0, const_1)",
)
EQUAL_VARIANTS = (
    "add({P}, {Q}), divide(#0, {D})",
    "add({Q}, {P}), divide(#0, {D})",
    "divide({P}, {D}), divide({Q}, {D}), add(#1, #0)",
    "add({P}, {Q}), divide({D}, #0)",
    "add({P}, 7), divide(#0, {D})",
    "subtract({P}, {Q}), divide(#0, {D})",
)
BROKEN_VARIANTS = (
    "divide({P}, {X})",
    "modulo({P}, {Q})",
    "add(#1, {Q}), add({P}, {Q})",
    "add({P}, ceiling)",
    "exp(-{Q}, 0.5)",
    "Add({P}, {Q})",
    "add({P}, {Q})",
)


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "lineitem"))


def variant(count: int) -> Column:
    return (F.col("l_orderkey") + F.col("l_linenumber")) % count


def gold_examples(spark: SparkSession, folder: str) -> DataFrame:
    """``id, program, exe_ans``: the relative excess of price over quantity."""
    ratio = (F.col("l_extendedprice") - F.col("l_quantity")) / F.col("l_quantity")
    return lines(spark, folder).select(
        row_id().alias("id"),
        fill(PRED_VARIANTS[0]).alias("program"),
        round_exact(ratio).cast("string").alias("exe_ans"),
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """``id, predicted``: right, equivalent, wrong, invalid and empty programs."""
    program = choose(variant(len(PRED_VARIANTS)), *map(fill, PRED_VARIANTS))
    return lines(spark, folder).select(
        row_id().alias("id"), tokenize_program(program).alias("predicted")
    )


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Generated texts of an order's lines as candidates for one answer."""
    text = choose(
        F.col("l_linenumber") % 4,
        fill("Program: divide({P}, {X})"),
        fill("no idea"),
        fill("so Program: divide({P}, {X}) add(#0, {Q}) EOF\n\nQuestion: add(1, 2)"),
        fill("Program: multiply({P}, ten) add(#0, {Q}) divide(#1, {Q})"),
    )
    return lines(spark, folder).select(
        F.col("l_orderkey").cast("string").alias("id"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        text.alias("raw_text"),
    )


CANDIDATE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def price_table() -> Column:
    """A table in the row's own example; the header 'amounts' occurs twice and the last counts."""
    money = F.concat(F.lit("$ "), F.format_number("l_extendedprice", 2), F.lit(" (a)"))
    percent = F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%"))
    return F.array(
        F.array(F.lit(""), F.lit("gross"), F.lit("units"), F.lit("rate")),
        F.array(F.lit("amounts"), F.lit("1"), F.lit("2"), F.lit("3")),
        F.array(F.lit("amounts"), money, quantity(), percent),
        F.array(F.lit("notes"), F.lit("(none)"), quantity(), percent),
    )

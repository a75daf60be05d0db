"""Predictions against gold: join, execution and program accuracy, error rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumwright.functions.numbers import parse_float
from sumwright.functions.program_text import same_tokens, tokenize_program
from sumwright.functions.shapes import NUMBER, STRING
from sumwright.operators.run_programs import with_equality, with_result


def duplicate_ids(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count; gold data must have none."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def join_gold(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Every prediction with its gold example; ``missing_gold`` marks ids without one."""
    marked = gold.withColumn("missing_gold", F.lit(False))
    return predictions.join(marked, "id", "left").withColumn(
        "missing_gold", F.coalesce("missing_gold", F.lit(True))
    )


def unique_gold(gold: DataFrame) -> DataFrame:
    """One row per id, the one whose program and answer come first, with ``gold_copies``."""
    others = F.struct(*[c for c in gold.columns if c != "id"])
    first = F.min_by(others, F.struct("program", "exe_ans")).alias("g")
    return gold.groupBy("id").agg(first, F.count("*").alias("gold_copies")).select("id", "g.*", "gold_copies")


def _matches(result: Column, exe_ans: Column, kind: Column | None, tolerance: float | None) -> Column:
    gold = parse_float(exe_ans)
    text = result["txt"] == exe_ans
    if kind is not None:
        gold, text = F.when(kind == NUMBER, gold), text & (kind == STRING)
    if tolerance is None:
        close = result["num"] == gold
    else:
        close = F.abs(result["num"] - gold) <= tolerance
    return F.coalesce(
        F.when(result["num"].isNotNull(), close).otherwise(text), F.lit(False)
    )


def score(
    predictions: DataFrame,
    gold: DataFrame,
    tolerance: float | None = None,
    positional_tables: bool = False,
    equality: bool = True,
) -> DataFrame:
    """One row per prediction with ``result``, ``exe_match``, ``exe_ok``, ``equal`` and ``exact``.

    ``predictions``: ``id, predicted``. ``gold``: ``id, program, exe_ans`` and, where programs use
    the table, ``table``. The rounded result must equal the gold answer exactly unless a
    ``tolerance`` is given; where ``exe_ans_kind`` tells the kind of the answer, a number only equals
    a number and a text only a text. Of gold rows that repeat an id one counts, and ``gold_copies``
    says how many there were, so every prediction stays one row. ``equality=False`` leaves out
    ``equal``, which costs as much as all the rest.

    Gold that is stored in buckets of its id (see ``examples.write_buckets``) stays where it is.
    """
    table = "table" if "table" in gold.columns else None
    kind = F.col("exe_ans_kind") if "exe_ans_kind" in gold.columns else None
    joined = join_gold(predictions, unique_gold(gold)).withColumn("gold", tokenize_program(F.col("program")))
    run = with_result(joined, "predicted", table)
    if equality:
        run = with_equality(run, positional_tables=positional_tables)
    match = _matches(F.col("result"), F.col("exe_ans"), kind, tolerance)
    return run.withColumns(
        {
            "exe_match": match,
            "exe_ok": (F.col("result.invalid") == 0) & match,
            "exact": F.coalesce(same_tokens(F.col("gold"), F.col("predicted")), F.lit(False)),
        }
    )


def accuracy(scored: DataFrame) -> DataFrame:
    """One-row report; both accuracies are shares of the predictions, null when there are none.

    ``missing_gold`` and ``duplicate_gold`` count predictions whose id has no gold row or several.
    """

    def count_if(condition: Column) -> Column:
        return F.count_if(condition).cast("bigint")

    total = F.count("*")
    return scored.agg(
        total.alias("total"),
        count_if(F.col("exe_ok")).alias("exe_correct"),
        count_if(F.col("equal")).alias("prog_correct"),
        F.try_divide(count_if(F.col("exe_ok")), total).alias("exe_acc"),
        F.try_divide(count_if(F.col("equal")), total).alias("prog_acc"),
        count_if(F.col("equal") & ~F.col("exe_match")).alias("equal_but_mismatch"),
        count_if(F.col("equal") & ~F.col("exact")).alias("equal_but_different_text"),
        count_if(F.col("missing_gold")).alias("missing_gold"),
        count_if(F.col("gold_copies") > 1).alias("duplicate_gold"),
    )


def error_rows(scored: DataFrame) -> DataFrame:
    """Predictions whose result differs from the gold answer; an invalid one always does."""
    return scored.where(~F.col("exe_match"))


def attach_prediction(examples: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every prediction's gold example with ``qa.predicted`` filled in, as written to a result file.

    A prediction without an example keeps its id and tokens; the rest is null.
    """
    kind = examples.schema["qa"].dataType
    empty = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields])
    qa = F.coalesce("qa", empty).withField("predicted", F.col("predicted"))
    return predictions.join(examples, "id", "left").withColumn("qa", qa).drop("predicted")

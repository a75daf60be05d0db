"""Generated text to prediction tokens, candidate selection and format statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumwright.functions.program_text import EOF, parse_raw_to_tokens, verify_tokens
from sumwright.operators.run_programs import with_usable


def decode(raw: DataFrame, text: str = "raw_text") -> DataFrame:
    """Add ``predicted``: the token program found in the generated text."""
    return raw.withColumn("predicted", parse_raw_to_tokens(F.col(text)))


def select_candidate(candidates: DataFrame, id_col: str = "id", *order: str) -> DataFrame:
    """One prediction per id out of several generated texts, taken in ``order``.

    The first candidate that is well formed and has a value wins; otherwise the longest one, the
    earliest of these; otherwise the empty program. The group is aggregated partially on the map
    side, so an id with very many candidates is no problem.
    """
    order = order or ("sample_no",)
    ready = with_usable(candidates, "predicted", "__usable")
    # All usable ones come first, in order; then the others by length.
    length = F.when(F.col("__usable"), F.lit(0)).otherwise(-F.size("predicted"))
    best = F.struct((~F.col("__usable")).alias("unusable"), length.alias("length"), *order)
    picked = ready.groupBy(id_col).agg(F.min_by("predicted", best).alias("predicted"))
    return picked.select(
        id_col,
        F.coalesce(
            F.when(F.size("predicted") > 1, F.col("predicted")), F.array(F.lit(EOF))
        ).alias("predicted"),
    )


def format_stats(predictions: DataFrame, tokens: str = "predicted") -> DataFrame:
    """One-row report: valid, non-empty and empty predictions, with percentages."""
    valid = verify_tokens(F.col(tokens))
    total = F.count("*")
    counts = {
        "valid": F.count_if(valid),
        "has_ops": F.count_if(valid & (F.size(tokens) > 1)),
        "empty": F.count_if((F.size(tokens) == 1) & (F.get(tokens, F.lit(0)) == EOF)),
    }
    return predictions.agg(
        total.alias("total"),
        *[c.cast("bigint").alias(name) for name, c in counts.items()],
        *[
            F.round(F.try_divide(c * 100.0, total), 1).alias(f"{name}_pct")
            for name, c in counts.items()
        ],
    )

"""Token id arrays: packing, padding, truncation and range checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sumwright.functions.text import strip

# Fixed values.
IGNORE_LABEL = -100
INPUT_MAX_LEN = 2048
PAD_LEN = 256


def target_text(program: Column) -> Column:
    """The text the model learns: the program, then the stop word."""
    return strip(F.concat(strip(program), F.lit(" EOF")))


def pack(prompt_ids: Column, target_ids: Column) -> Column:
    """``struct<input_ids, attention_mask, labels>``; prompt positions carry no label."""
    ids = F.concat(prompt_ids, target_ids)
    return F.struct(
        ids.cast("array<int>").alias("input_ids"),
        F.transform(ids, lambda _: F.lit(1)).cast("array<tinyint>").alias("attention_mask"),
        F.concat(F.array_repeat(F.lit(IGNORE_LABEL), F.size(prompt_ids)), target_ids)
        .cast("array<bigint>")
        .alias("labels"),
    )


def truncate(ids: Column, length: int = INPUT_MAX_LEN) -> Column:
    """The first ``length`` ids."""
    return F.slice(ids, 1, length)


def pad_ids(ids: Column, length: Column | int, pad: int) -> Column:
    """Truncate to ``length``, then fill up with ``pad``."""
    n = F.lit(length) if isinstance(length, int) else length
    short = F.array_repeat(F.lit(pad), F.greatest(n - F.size(ids), F.lit(0)))
    return F.concat(F.slice(ids, F.lit(1), n), short.cast("array<int>"))


def pad(ids: Column, length: Column | int = PAD_LEN, pad_id: int = 0) -> Column:
    """``struct<input_ids, attention_mask>`` of exactly ``length``."""
    ids = ids.cast("array<int>")
    return F.struct(
        pad_ids(ids, length, pad_id).alias("input_ids"),
        pad_ids(F.transform(ids, lambda _: F.lit(1)), length, 0)
        .cast("array<tinyint>")
        .alias("attention_mask"),
    )


def bad_input_ids(ids: Column, vocab_size: int | Column) -> Column:
    """Input ids outside ``[0, vocab_size)``."""
    return F.filter(ids, lambda x: (x < 0) | (x >= vocab_size))


def bad_labels(labels: Column, vocab_size: int | Column, strict: bool = False) -> Column:
    """Labels at or above ``vocab_size``; ``strict`` adds negative ones other than -100."""

    def bad(x: Column) -> Column:
        high = (x >= vocab_size) & (x != IGNORE_LABEL)
        return high | ((x < 0) & (x != IGNORE_LABEL)) if strict else high

    return F.filter(labels, bad)

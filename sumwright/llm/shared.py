"""What the corpus operators have in common: shared folders, row packing, label folds."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumwright.session import checkpointed, shared_folder

#: Rows whose ``crc32`` of the id leaves this remainder are held out from every fit.
FOLDS = 5


def col(name: str) -> Column:
    """The column of that very name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


materialize = checkpointed


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as struct ``row`` next to the operator's own columns.

    Columns of the input can have any name then without clashing with those of the operator.
    """
    return df.select(
        F.struct(*[col(c).alias(c) for c in df.columns]).alias("row"),
        *[value.alias(name) for name, value in columns.items()],
    )


def unpacked(df: DataFrame, source: DataFrame, **columns: Column) -> DataFrame:
    """The columns of ``source`` out of ``row``, those in ``columns`` replaced or added."""
    names = [*source.columns, *[c for c in columns if c not in source.columns]]
    return df.select(
        *[(columns[c] if c in columns else F.col("row").getField(c)).alias(c) for c in names]
    )


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept away from fitting; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def mixed(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """64-bit identifiers of ordered pairs of identifiers."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def row_blocks(texts: pa.Array, most: int = 2**21) -> Iterator[tuple[int, int]]:
    """``(first, number)`` of consecutive rows that hold about ``most`` bytes, or one longer text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes, dtype=np.int64) // most
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else block
    yield from zip(first.tolist(), np.diff(np.concatenate([first, [len(texts)]])).tolist(), strict=True)

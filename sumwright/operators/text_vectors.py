"""Text vectors: the leading singular directions of a corpus' weighted term matrix.

A randomised decomposition by distributed products. Rows of the matrix are texts, columns terms, and
only its entries that are not zero are ever stored. Random signs of a term come from a hash of it,
so no task has to hold the vocabulary; the driver holds matrices of a few hundred numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumwright.functions.quality import terms
from sumwright.session import checkpointed

#: Directions of a space, further ones that make the leading ones exact, and times that the products
#: are repeated, which sharpens them where singular values fall slowly.
DIMENSIONS, MORE, PASSES = 16, 8, 1


@dataclass(frozen=True)
class TextSpace:
    """``terms``: ``term, idf, vector`` (a column of orthonormal directions); singular values, largest first."""

    terms: DataFrame
    values: np.ndarray


def entries(texts: DataFrame, text: str | Column, row: str = "row") -> DataFrame:
    """``row, term, tf`` of lower-case words between blanks, counted within each row."""
    words = terms(F.col(text) if isinstance(text, str) else text)
    exploded = texts.select(F.col(row).alias("row"), F.explode(words).alias("term"))
    return exploded.groupBy("row", "term").agg(F.count("*").cast("double").alias("tf"))


def _signs(term: Column, seed: int, width: int) -> list[Column]:
    made = []
    for at in range(0, width, 63):
        bits = F.xxhash64(F.lit(seed + at), term)
        made += [F.when(F.getbit(bits, F.lit(i)) == 1, 1.0).otherwise(-1.0) for i in range(min(63, width - at))]
    return made


def _sums(rows: DataFrame, key: str, weight: Column, factors: list[Column]) -> DataFrame:
    """``key, v``: for each key the sums of weight times factors."""
    names = [f"s{i}" for i in range(len(factors))]
    found = rows.groupBy(key).agg(*[F.sum(weight * f).alias(n) for f, n in zip(factors, names, strict=True)])
    return found.select(key, F.array(*names).alias("v"))


def _gram(rows: DataFrame, width: int) -> np.ndarray:
    """The products of the columns of ``v``, summed in each task and then over the tasks."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            own = batch.column(0).flatten().to_numpy().reshape(-1, width)
            total += own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], ["g"])

    parts = rows.select("v").mapInArrow(products, "g array<double>").collect()
    return sum((np.array(r.g).reshape(width, width) for r in parts), np.zeros((width, width)))


def _turned(rows: DataFrame, key: str, matrix: np.ndarray) -> DataFrame:
    """``v`` times a small matrix."""

    @F.arrow_udf("array<double>")
    def turn(vectors: pa.Array) -> pa.Array:
        own = vectors.flatten().to_numpy().reshape(-1, matrix.shape[0]) @ matrix
        offsets = np.arange(len(own) + 1, dtype=np.int32) * matrix.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(own.ravel()))

    return rows.select(key, turn("v").alias("v"))


def _whitener(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What makes columns of this Gram matrix orthonormal, without those of no length, and their lengths."""
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    real = values > max(values.max(initial=0), 1e-300) * 1e-12
    # A sign for each direction that does not depend on the solver.
    vectors = vectors[:, real] * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))] < 0, -1, 1)[real]
    lengths = np.sqrt(values[real])
    return vectors / lengths, lengths


def fit(texts: DataFrame, text: str = "text", dimensions: int = DIMENSIONS, seed: int = 42, passes: int = PASSES) -> TextSpace:
    """The space of the texts. A term weighs its count times ``ln((1 + n) / (1 + texts with it)) + 1``.

    Null and blank texts count as texts without terms. The same texts and seed give the same space,
    up to rounding. There are at most as many directions as the matrix has ranks.
    """
    numbered = checkpointed(texts.select(F.monotonically_increasing_id().alias("row"), F.col(text).alias("text")), "texts")
    counts = checkpointed(entries(numbered, "text"), "terms")
    n = numbered.count()
    idf = F.log((1.0 + n) / (1.0 + F.count("*"))) + 1
    weights = checkpointed(counts.groupBy("term").agg(idf.alias("idf")), "idf")
    matrix = counts.join(weights, "term").select("row", "term", (F.col("tf") * F.col("idf")).alias("w"))
    matrix = checkpointed(matrix, "matrix")
    width = dimensions + MORE
    parts = [F.col("v")[i] for i in range(width)]
    rows = checkpointed(_sums(matrix, "row", F.col("w"), _signs(F.col("term"), seed, width)), "rows")
    for again in range(passes + 1):
        basis, _ = _whitener(_gram(rows, width))
        parts = [F.col("v")[i] for i in range(basis.shape[1])]
        width = basis.shape[1]
        if not width:
            break
        by_term = matrix.join(_turned(rows, "row", basis), "row")
        columns = checkpointed(_sums(by_term, "term", F.col("w"), parts), "columns")
        if again < passes:
            by_row = matrix.join(columns, "term")
            rows = checkpointed(_sums(by_row, "row", F.col("w"), parts), "rows")
    if not width:
        return TextSpace(weights.withColumn("vector", F.array().cast("array<double>")), np.zeros(0))
    turn, lengths = _whitener(_gram(columns, width))
    vectors = _turned(columns, "term", turn[:, :dimensions]).withColumnRenamed("v", "vector")
    return TextSpace(checkpointed(weights.join(vectors, "term"), "space"), lengths[:dimensions])


def embed(space: TextSpace, texts: DataFrame, row: str, text: str = "text") -> DataFrame:
    """``row, vector`` of the texts: their weighted terms along the space's directions.

    ``row`` tells texts apart. Terms that the space does not know are left out; a text without any
    has the zero vector.
    """
    width = len(space.values)
    known = entries(texts, text, row).join(space.terms, "term")
    sums = _sums(known, "row", F.col("tf") * F.col("idf"), [F.col("vector")[i] for i in range(width)]) if width else None
    rows = texts.select(F.col(row).alias("row"))
    zero = F.array(*[F.lit(0.0)] * width).cast("array<double>")
    if sums is None:
        return rows.select("row", zero.alias("vector"))
    return rows.join(sums, "row", "left").select("row", F.coalesce("v", zero).alias("vector"))

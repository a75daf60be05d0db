"""Exact nearest-neighbour retrieval by cosine similarity over cells of the corpus.

Vectors are put into the cell of their nearest centroid, with their distance to it. On the unit
sphere distances are a metric, so a vector can only be as near to a query as the difference of
their distances to a centroid: a query skips cells, and in a cell all vectors outside of a ring,
that cannot hold a better neighbour than those of its own cell. What is found does not depend on the
centroids; how much is skipped does.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sumwright.session import checkpointed

#: Vectors of a cell, roughly, most cells, and most bytes of the centroids that all tasks hold.
PER_CELL, MOST_CELLS, MOST_BYTES = 2048, 4096, 2**26
#: Sampled vectors for each centroid, and rounds of moving centroids to the mean of their sample.
PER_CENTROID, ROUNDS = 16, 4
#: Corpus vectors and queries that meet in one task at most; larger cells are cut by a hash.
CORPUS_BLOCK, QUERY_BLOCK = 16_384, 16_384

# Scores are ranked at this precision so that the order of summation cannot decide a tie.
SCORE_DIGITS = 9
# Bounds give way by this much, more than rounding can move a distance.
MARGIN = 1e-6

CANDIDATE = "query_id {0}, neighbour_id {0}, score double, sort_key double, compared long"


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack(vectors.to_numpy()).astype(np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, np.nan, norms)


def _distances(units: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (units @ centroids.T), 0))


def _units(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``id, vector`` of length 1; rows without a direction (null, zero, not finite) are left out."""

    @F.pandas_udf("array<double>")
    def scaled(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        units = _unit_rows(vectors)
        return pd.Series([u if np.isfinite(u).all() else None for u in units], dtype=object)

    own = F.col(vector).cast("array<double>")
    rows = df.where(own.isNotNull() & ~F.exists(own, lambda x: x.isNull() | F.isnan(x)))
    rows = rows.select(F.col(id_col).alias("id"), scaled(own).alias("vector"))
    return rows.where("vector is not null")


@dataclass(frozen=True)
class CellIndex:
    """``vectors`` (``id, vector, cell, far``), centroids, and of each cell its size and its least and
    greatest distance ``far`` to the centroid."""

    vectors: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray
    near: np.ndarray
    far: np.ndarray


def cell_index(corpus: DataFrame, id_col: str = "vec_id", vector: str = "embedding", per_cell: int = PER_CELL) -> CellIndex:
    """The vectors in cells around centroids, which come from a bounded sample by hash."""
    units = checkpointed(_units(corpus, id_col, vector), "units")
    first = units.select(F.size("vector").alias("n")).first()
    width = first.n if first else 1
    most = max(min(MOST_CELLS, MOST_BYTES // (8 * width * PER_CENTROID)), 1)
    cells = min(max(-(-units.count() // per_cell), 1), most)
    picked = units.orderBy(F.xxhash64("id"), "id").limit(cells * PER_CENTROID).select("vector").collect()
    sample = np.array([r.vector for r in picked]).reshape(-1, width)
    centroids = sample[:cells]
    for _ in range(ROUNDS if cells > 1 else 0):
        own = _distances(sample, centroids).argmin(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
    held = units.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("cell int, far double")
    def place(vectors: pd.Series) -> pd.DataFrame:
        if not len(vectors):
            return pd.DataFrame({"cell": [], "far": []})
        d = _distances(np.stack(vectors.to_numpy()), held.value)
        return pd.DataFrame({"cell": d.argmin(axis=1), "far": d.min(axis=1)})

    placed = units.select("id", "vector", place("vector").alias("at"))
    placed = checkpointed(placed.select("id", "vector", "at.cell", "at.far"), "cells")
    sizes, near, far = np.zeros(len(centroids), np.int64), np.full(len(centroids), np.inf), np.full(len(centroids), -np.inf)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("near"), F.max("far").alias("far")).collect():
        sizes[r.cell], near[r.cell], far[r.cell] = r.n, r.near, r.far
    return CellIndex(placed, centroids, sizes, near, far)


def search(
    index: CellIndex, queries: DataFrame, k: int = 3, id_col: str = "vec_id", vector: str = "embedding",
    skip_self: bool = False, corpus_block: int = CORPUS_BLOCK, query_block: int = QUERY_BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """``query_id, neighbour_id, score, rank`` of the ``k`` most similar vectors per query, and
    ``pairs``, how many pairs were compared for it.

    First a query meets the nearest cells that hold enough vectors. Its ``k``-th score there bounds
    how far a better neighbour can be, and only cells and rings within that bound come second. Every
    result is exact. Cells and queries are cut so that a task meets bounded numbers of either.
    """
    spark = queries.sparkSession
    asked = checkpointed(_units(queries, id_col, vector), "queries")
    parts = max(1, -(-asked.count() // query_block))
    id_type = index.vectors.schema["id"].dataType.simpleString()
    cuts = np.maximum(-(-index.sizes // corpus_block), 1)
    held = spark.sparkContext.broadcast((index.centroids, index.sizes, index.near, index.far, cuts))
    enough = k + (1 if skip_self else 0)

    def visits(pdf: pd.DataFrame, second: bool) -> pd.DataFrame:
        centroids, sizes, near, far, cuts = held.value
        d = _distances(np.stack(pdf["vector"].to_numpy()), centroids)
        order = np.argsort(d, axis=1, kind="stable")
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        first = np.zeros(d.shape, bool)
        np.put_along_axis(first, order, (before < enough) & (sizes[order] > 0), axis=1)
        reach = np.full((len(pdf), 1), np.inf)
        if second:
            score = pdf["bound"].to_numpy(float)[:, None]  # null where there are too few
            reach = np.where(np.isnan(score), np.inf, np.sqrt(np.maximum(2 - 2 * np.nan_to_num(score), 0)) + MARGIN)
            chosen = ~first & (sizes > 0) & (d - far <= reach) & (near - d <= reach)
        else:
            chosen = first
        rows, cells = np.nonzero(chosen)
        times = cuts[cells]
        rows, cells = np.repeat(rows, times), np.repeat(cells, times)
        blocks = np.arange(len(cells)) - np.repeat(np.cumsum(times) - times, times)
        own, limit = d[rows, cells], np.broadcast_to(reach, d.shape)[rows, cells]
        return pd.DataFrame(
            {"id": pdf["id"].to_numpy()[rows], "vector": pdf["vector"].to_numpy()[rows], "cell": cells, "block": blocks, "low": own - limit, "high": own + limit}
        )

    def visiting(batches, second: bool):
        for pdf in batches:
            if len(pdf) and len(held.value[0]):
                yield visits(pdf, second)

    # The number of blocks goes by cell, of which there are MOST_CELLS at most.
    blocks = F.broadcast(spark.createDataFrame(list(enumerate(cuts.tolist())), "of int, cuts int"))
    block = F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")
    stored = index.vectors.join(blocks, F.col("cell") == F.col("of")).withColumn("block", block)
    stored = stored.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def meet(asked: pd.DataFrame, cell: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "neighbour_id", "score", "sort_key", "compared"]
        if asked.empty or cell.empty:
            return pd.DataFrame({c: [] for c in names})
        cell = cell.sort_values(["far", "id"])
        ids, far, matrix = cell["id"].to_numpy(), cell["far"].to_numpy(), np.stack(cell["vector"].to_numpy())
        begins = np.searchsorted(far, asked["low"].to_numpy(), "left")
        ends = np.searchsorted(far, asked["high"].to_numpy(), "right")
        found, compared = [], 0
        for own, unit, begin, end in zip(asked["id"], asked["vector"], begins, ends, strict=True):
            scores, others = matrix[begin:end] @ unit, ids[begin:end]
            if skip_self:
                keep = others != own
                scores, others = scores[keep], others[keep]
            compared += len(scores)
            keys = np.round(scores, SCORE_DIGITS)
            best = np.lexsort((others, -keys))[:k]
            found.append(pd.DataFrame(dict(zip(names, (own, others[best], scores[best], keys[best], 0), strict=True))))
        found.append(pd.DataFrame({"query_id": [None], "neighbour_id": [None], "score": [None], "sort_key": [None], "compared": [compared]}))
        return pd.concat(found)

    def round_of(rows: DataFrame, second: bool) -> DataFrame:
        schema = f"id {id_type}, vector array<double>, cell int, block int, low double, high double"
        visit = rows.mapInPandas(lambda batches: visiting(batches, second), schema)
        visit = visit.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
        key = ("cell", "block", "part")
        met = visit.groupBy(*key).cogroup(stored.groupBy(*key)).applyInPandas(meet, CANDIDATE.format(id_type))
        return checkpointed(met, "candidates")

    by_query = Window.partitionBy("query_id").orderBy(F.desc("sort_key"), "neighbour_id")
    home = round_of(asked, False)
    ranked = home.where("neighbour_id is not null").withColumn("rank", F.row_number().over(by_query))
    bound = ranked.where(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("sort_key").alias("bound"))
    away = round_of(asked.join(bound, F.col("id") == F.col("of"), "left").drop("of"), True)
    both = home.union(away)
    ranked = both.where("neighbour_id is not null").withColumn("rank", F.row_number().over(by_query))
    result = ranked.where(F.col("rank") <= k).select("query_id", "neighbour_id", "score", "rank")
    return result, both.agg(F.coalesce(F.sum("compared"), F.lit(0)).alias("pairs"))


def nearest(
    queries: DataFrame, corpus: DataFrame, k: int = 3, id_col: str = "vec_id", vector: str = "embedding",
    skip_self: bool = False, per_cell: int = PER_CELL,
) -> DataFrame:
    """``query_id, neighbour_id, score, rank`` of the ``k`` most similar corpus vectors per query.

    An index is built for the one search; to ask it again, keep it and use :func:`search`.
    """
    index = cell_index(corpus, id_col, vector, per_cell)
    return search(index, queries, k, id_col, vector, skip_self)[0]

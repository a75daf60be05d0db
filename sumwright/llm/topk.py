"""Exact top-k search by inner product.

Queries and candidates are cut into tiles, each pair of tiles is one matrix product with a partial
selection, and the tiles' lists of a query are merged as a tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumwright.llm.shared import col, materialize

#: Rows of a query tile and of a shard of candidates, and lists merged at a time.
QUERY_TILE = 16384
SHARD = 8192
FAN_IN = 16


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def quantized(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of whole numbers; shorter vectors end in zeros."""
    lists = vectors.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    full = np.zeros((len(sizes), width), np.int64)
    full[np.arange(width)[None, :] < sizes[:, None]] = flat
    return full


def width(vectors: pa.ChunkedArray) -> int:
    sizes = np.diff(vectors.combine_chunks().offsets.to_numpy())
    return int(sizes.max()) if len(sizes) else 0


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's ``k`` highest allowed scores; ties go to the first columns."""
    scores = np.where(allowed, scores, -np.inf if scores.dtype.kind == "f" else np.iinfo(np.int64).min)
    if scores.shape[1] > k:
        edge = np.partition(scores, -k, axis=1)[:, -k][:, None]
        above, level = scores > edge, scores == edge
        room = k - above.sum(axis=1, keepdims=True)
        taken = above | (level & (np.cumsum(level, axis=1) <= room))
    else:
        taken = np.ones(scores.shape, bool)
    return np.nonzero(taken & allowed)


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products, by floating point where all sums stay whole numbers below 2^53."""
    most = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(candidates.astype(float)).max(initial=0))
    if most * queries.shape[1] < 2**53:
        return queries.astype(np.float64) @ candidates.astype(np.float64).T
    return queries @ candidates.T


def top_k(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = 5,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest inner products.

    Components are ``floor(scale * x)``; ties go to the smaller id. A candidate with the query's id
    is its own. Vectors that are null or hold null or non-finite components, and rows without id,
    take no part. Vectors of other lengths end in zeros. A query that repeats is answered each
    time, repeated candidates count each; products beyond 64 bits wrap around. Without candidates
    a query has no rows.
    """

    def rows(df: DataFrame) -> DataFrame:
        df = df.select(col(vec_id).cast("long").alias("id"), col(vector).alias("v"))
        df = df.where(F.col("id").isNotNull() & usable(F.col("v")))
        return df.select("id", quantized(F.col("v"), scale).alias("v"), F.monotonically_increasing_id().alias("row"))

    # Written, since two shuffles go by the row's number.
    queries, candidates = materialize(rows(queries), "queries"), rows(candidates)
    tiles = -(-queries.count() // QUERY_TILE) or 1
    shards = -(-candidates.count() // SHARD) or 1
    # Each query meets each shard and each candidate each tile, once.
    left = queries.withColumn("tile", F.pmod(F.xxhash64("row"), F.lit(tiles)).cast("int"))
    left = left.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = candidates.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"))
    right = right.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).drop("row")

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("id")
        n = max(width(left.column("v")), width(right.column("v")))
        q, c = matrix(left.column("v"), n), matrix(right.column("v"), n)
        own, ids = left.column("id").to_numpy(), right.column("id").to_numpy()
        found = [(np.zeros(0, np.int64),) * 3]
        for at in range(0, len(q), 256):
            part = slice(at, at + 256)
            scores = products(q[part], c)
            r, j = best(scores, own[part][:, None] != ids[None, :], k)
            found.append((r + at, j, scores[r, j].astype(np.int64)))
        r, j, score = (np.concatenate(x) for x in zip(*found, strict=True))
        names = ["row", "query_id", "vec_id", "score", "shard"]
        columns = [left.column("row").to_numpy()[r], own[r], ids[j], score, np.full(len(r), key[1].as_py(), np.int32)]
        return pa.table([pa.array(x) for x in columns], names=names)

    pairs = left.groupBy("tile", "shard").cogroup(right.groupBy("tile", "shard"))
    lists = pairs.applyInArrow(meet, "row long, query_id long, vec_id long, score long, shard int")
    while True:
        shards = -(-shards // FAN_IN)
        lists = lists.withColumn("shard", (F.col("shard") / FAN_IN).cast("int"))
        order = Window.partitionBy("row", "shard").orderBy(F.col("score").desc(), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if shards == 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists = lists.drop("rank")

"""Reproducible subsets: first rows by key, exact-size split, shuffled positions.

Positions come from hash buckets: rows are counted per bucket of the hashed id, at most 65,536
counts, and only these are accumulated in one task. No sort of the whole data, no sampling, and the
same result for every partitioning. Positions need unique ids, or a row key beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumwright.session import checkpointed

_BUCKET_DIGITS = 4


def first_rows(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first ``n`` rows in ``order``; tables have no order of their own."""
    return df.orderBy(*order).limit(n)


def shuffle_key(id_col: str | Column, seed: int) -> Column:
    """Uniform order of the ids for a seed; a null id counts as empty."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(col.cast("string"), F.lit(""))))


def _bucket_counts(keyed: DataFrame) -> DataFrame:
    """``__bucket, n, below, total`` with at most 16^4 rows: a proven bound for the broadcast."""
    counts = keyed.groupBy("__bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.withColumns(
        {
            "below": F.coalesce(F.sum("n").over(before), F.lit(0)),
            "total": F.sum("n").over(everything),
        }
    )


def _keyed(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    key = shuffle_key(id_col, seed)
    return df.withColumns({"__key": key, "__bucket": F.substring(key, 1, _BUCKET_DIGITS)})


def with_split(
    df: DataFrame, id_col: str, test_fraction: float = 0.1, seed: int = 42
) -> DataFrame:
    """Add ``split``: exactly ceil(fraction * rows) rows are ``test``, the others ``train``.

    The bucket that holds the border is the only one sorted, by distinct id; every row is then
    compared with the border, so the data itself is not shuffled. Rows with the same id stay on one
    side: where ids repeat, the test side ends with the group that reaches its size.
    """
    keyed = _keyed(df, id_col, seed)
    narrow = keyed.select("__bucket", "__key", F.col(id_col).alias("__id"))
    wanted = F.ceil(F.col("total") * F.lit(test_fraction))
    buckets = _bucket_counts(narrow).withColumn("need", wanted - F.col("below"))
    border = buckets.where((F.col("need") > 0) & (F.col("need") <= F.col("n")))
    up_to_id = Window.partitionBy("__bucket").orderBy("__key", "__id")
    last_test = (
        narrow.join(F.broadcast(border.select("__bucket", "need")), "__bucket")
        .groupBy("__bucket", "need", "__key", "__id")
        .agg(F.count("*").alias("copies"))
        .withColumn("reached", F.sum("copies").over(up_to_id))
        .where((F.col("reached") >= F.col("need")) & (F.col("reached") - F.col("copies") < F.col("need")))
        .select("__bucket", F.struct("__key", "__id").alias("last"))
    )
    plan = buckets.join(last_test, "__bucket", "left").select("__bucket", "n", "need", "last")
    is_test = (F.col("need") > F.col("n")) | F.coalesce(
        F.struct(F.col("__key"), F.col(id_col).alias("__id")) <= F.col("last"), F.lit(False)
    )
    return (
        keyed.join(F.broadcast(plan), "__bucket")
        .withColumn("split", F.when(is_test, "test").otherwise("train"))
        .select(*df.columns, "split")
    )


def with_position(df: DataFrame, id_col: str, seed: int = 42, row: str | None = None) -> DataFrame:
    """Add ``position``: 0, 1, 2, … in the seeded shuffle order.

    Where ids repeat, ``row`` names a column that tells rows apart. Rows are then dealt out by ranges
    of the whole order and counted by range, so that one id, or a missing one, spreads over many
    tasks.
    """
    if row is not None:
        order = ["__key", id_col, row]
        ranges = df.withColumn("__key", shuffle_key(id_col, seed)).repartitionByRange(*order)
        ranges = checkpointed(ranges.withColumn("__part", F.spark_partition_id()), "ranges")
        # One row for each range.
        before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        starts = ranges.groupBy("__part").agg(F.count("*").alias("n"))
        starts = starts.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        inside = Window.partitionBy("__part").orderBy(*order)
        placed = ranges.withColumn("nth", F.row_number().over(inside) - 1).join(F.broadcast(starts), "__part")
        return placed.withColumn("position", F.col("start") + F.col("nth")).select(*df.columns, "position")
    keyed = _keyed(df, id_col, seed)
    in_bucket = Window.partitionBy("__bucket").orderBy("__key", id_col)
    offsets = _bucket_counts(keyed.select("__bucket")).select("__bucket", "below")
    return (
        keyed.join(F.broadcast(offsets), "__bucket")
        .withColumn("position", F.col("below") + F.row_number().over(in_bucket) - 1)
        .select(*df.columns, "position")
    )

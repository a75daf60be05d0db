"""Mixing sources to target weights.

Tokens are summed per source, every source gets a target, and a document is emitted
``floor(rate)`` times plus one more time with the probability of the remaining fraction, decided by
a hash of seed and id. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumwright.llm.shared import col, materialize, packed, unpacked

WEIGHTS = (5, 2, 1)
MAX_RATE = 3
SEED = 17


def word_count(text: Column) -> Column:
    """Number of runs free of blank, tab and line ends; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(seed: int, doc_id: Column) -> Column:
    """A number in [0, 1) fixed by seed and id; all null ids draw the same."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def ranked(totals: DataFrame) -> DataFrame:
    """Adds ``place``, the 0-based position of ``source`` by code point with null last.

    Sources are dealt out by range and counted per partition, so no task sees them all.
    """
    ranges = totals.repartitionByRange(F.col("source").asc_nulls_last())
    ranges = materialize(ranges.withColumn("part", F.spark_partition_id()), "mix-ranges")
    # One row for each partition, whatever the number of sources.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("part").agg(F.count("*").alias("n"))
    starts = starts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    placed = ranges.withColumn("nth", F.row_number().over(inside) - 1).join(starts, "part")
    return placed.select("source", "source_size", (F.col("start") + F.col("nth")).alias("place"))


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_rate: int = MAX_RATE
) -> DataFrame:
    """``source, source_size, target`` of rows ``source, size``.

    Sources in the order of their code points take the weights in turn and share the sum of all
    sizes. A target ends at ``max_rate`` times its source's size and the excess is shared by weight
    among the others until none is above. An empty input has no targets.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(
        F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")
    )
    table = materialize(ranked(totals).withColumn("weight", weight), "mix-sources")
    limit = F.col("source_size") * max_rate
    whole = table.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    level, capped = (whole.t or 0) / whole.w if whole.w else 0.0, -1
    while True:
        above = limit.cast("double") <= F.lit(level) * F.col("weight")
        now = table.agg(
            F.count_if(above).alias("n"),
            F.sum(F.when(above, limit).otherwise(0)).alias("taken"),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("w"),
        ).first()
        if now.n == capped or not now.w:
            break
        level, capped = (whole.t - now.taken) / now.w, now.n
    target = F.least(limit.cast("double"), F.lit(level) * F.col("weight"))
    return table.select("source", "source_size", target.alias("target"))


def _planned(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_rate: int = MAX_RATE,
    seed: int = SEED,
    size: Column | None = None,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """Packed rows with ``size, source_size, target, copies``."""
    size = word_count(col(text)) if size is None else size
    targets = source_targets(docs.select(col(source).alias("source"), size.alias("size")), weights, max_rate)
    targets = materialize(targets, "mix-targets").withColumnRenamed("source", "key")
    rows = packed(docs, id=col(doc_id), source=col(source), size=size)
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("key")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("rate", rate)
    extra = draw(seed, F.col("id")) < F.col("rate") - F.floor("rate")
    return rows.withColumn("copies", F.floor("rate") + extra.cast("long"))


def plan(docs: DataFrame, **options) -> DataFrame:
    """All rows with ``size, source_size, target, copies``; these replace columns of that name.

    Options are ``weights``, ``max_rate``, ``seed``, the columns ``doc_id``, ``source`` and
    ``text``, and ``size``, an expression that is the number of words if not given. Null texts have
    size 0, null sources are one source, rows of a source without words get no copy, and repeated
    ids decide alike. The table of sources is written first, so the planner broadcasts it only
    when it knows it to be small; else the join shuffles and adaptive execution splits a hot
    source.
    """
    made = ("size", "source_size", "target", "copies")
    return unpacked(_planned(docs, **options), docs, **{c: F.col(c) for c in made})


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows: every row as often as :func:`plan` says, with ``copy`` from 1."""
    taken = _planned(docs, **options).where("copies > 0")
    taken = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return unpacked(taken, docs, copy=F.col("copy"))

"""Corpus preparation, stage by stage, each over all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumwright.llm import decontaminate, line_dedup, mixing, queries, simhash, toxicity
from sumwright.llm.shared import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the lexicon learned from the labels scores 0.5 or more."""
    return toxicity.drop_toxic(docs, queries.toxic_lexicon(docs, spark, sf_dir), 0.5)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that are frequent in their source; the text and its length change."""
    clean = line_dedup.drop_boilerplate(docs, ratio=0.05, min_pages=2)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of documents whose fingerprints link within 2 bits."""
    return simhash.keep_one(docs, words=3, radius=2)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits documents so that sources meet their targets; ``copy`` counts from 1."""
    return mixing.mix(docs, weights=(5, 2, 1), max_rate=3)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_copies),
    ("decontaminate", drop_benchmark),
    ("mix_sources", mix_sources),
]

#: Near-duplicate groups and the learned lexicon have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs

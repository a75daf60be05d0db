"""Example, prediction and token tables on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumwright.functions.program_text import linearize_program, linearize_tokens
from sumwright.functions.prompts import join_sentences
from sumwright.functions.shapes import LIST, STRING, kind_at
from sumwright.sources.json_lists import read_any, read_lists

# Fields whose JSON shape varies arrive as text; ``typed_examples`` reads their kind as well.
RAW_EXAMPLE = (
    "id string, pre_text string, post_text string, table string, table_ori string, "
    "qa struct<question: string, program: string, exe_ans: string>"
)
PREDICTION = "id string, predicted array<string>"

LAYOUTS = ("auto", "list", "wrapped", "lines")


def read_records(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """``record``, the JSON text of every record.

    Every layout is read in as many tasks as files have splits: ``lines``, which skips blank ones, one
    ``list`` per file, a ``wrapped`` ``{"data": [...]}``, or whichever a file has (``auto``). A file that
    is one JSON list or one JSON object is read as such, anything else holds one record a line.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {LAYOUTS}")
    if layout == "lines":
        lines = spark.read.text(path).select(F.col("value").alias("record"))
        return lines.where(F.trim("record") != "")
    return read_any(spark, path) if layout == "auto" else read_lists(spark, path, layout)


def read_json(spark: SparkSession, path: str, schema: str, layout: str = "lines") -> DataFrame:
    """The fields of ``schema`` of every record; see ``read_records``."""
    records = read_records(spark, path, layout)
    return records.select(F.from_json("record", schema).alias("r")).select("r.*")


def read_examples(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """Examples as ``record``; see ``typed_examples``."""
    return read_records(spark, path, layout)


def sentences(text: Column, kind: Column) -> Column:
    """A JSON list of sentences joined by a space, or a JSON string as it is; null gives ``''``."""
    joined = join_sentences(F.from_json(text, "array<string>"))
    return F.coalesce(F.when(kind == LIST, joined), text, F.lit(""))


def program_text(text: Column, kind: Column) -> Column:
    """Program text, that of a JSON token list with its tokens joined by a space."""
    return F.when(kind == LIST, F.array_join(F.from_json(text, "array<string>"), " ")).otherwise(text)


def linear_program(text: Column, kind: Column) -> Column:
    """Linearized program from program text or a JSON token list."""
    tokens = linearize_tokens(F.from_json(text, "array<string>"))
    return F.when(kind == LIST, tokens).otherwise(linearize_program(text))


def typed_examples(records: DataFrame) -> DataFrame:
    """``id, pre, post, table_json, table_kind, table, question, program, program_kind, exe_ans,
    exe_ans_kind`` of ``record`` rows; missing text and ids are empty.

    What a field holds is read from its JSON kind, never guessed from its first character. A table
    that is null falls back to ``table_ori`` just like a missing one.
    """
    parsed = records.select(
        F.from_json("record", RAW_EXAMPLE).alias("r"), F.try_parse_json("record").alias("v")
    )
    own = F.col("r.table").isNotNull()
    table = F.when(own, F.col("r.table")).otherwise(F.col("r.table_ori"))
    kind = F.when(own, kind_at(F.col("v"), "$.table")).otherwise(kind_at(F.col("v"), "$.table_ori"))
    return parsed.select(
        F.coalesce("r.id", F.lit("")).alias("id"),
        sentences(F.col("r.pre_text"), kind_at(F.col("v"), "$.pre_text")).alias("pre"),
        sentences(F.col("r.post_text"), kind_at(F.col("v"), "$.post_text")).alias("post"),
        table.alias("table_json"),
        kind.alias("table_kind"),
        F.when(kind != STRING, F.from_json(table, "array<array<string>>")).alias("table"),
        F.coalesce("r.qa.question", F.lit("")).alias("question"),
        F.coalesce("r.qa.program", F.lit("")).alias("program"),
        kind_at(F.col("v"), "$.qa.program").alias("program_kind"),
        F.col("r.qa.exe_ans").alias("exe_ans"),
        kind_at(F.col("v"), "$.qa.exe_ans").alias("exe_ans_kind"),
    )


def read_predictions(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """``id, predicted``."""
    return read_json(spark, path, PREDICTION, layout)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Predictions or result rows as JSON lines."""
    df.write.mode(mode).json(path)


def write_splits(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Token rows, one folder per ``split``."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def write_buckets(df: DataFrame, name: str, buckets: int, path: str | None = None, id_col: str = "id") -> None:
    """A table in buckets of its id, for gold that is evaluated against again and again.

    Joins and aggregates by id read it without a shuffle, and only predictions move. Take as many
    buckets as ``spark.sql.shuffle.partitions`` or more; with fewer, Spark shuffles both sides.
    """
    writer = df.write.bucketBy(buckets, id_col).sortBy(id_col)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split; the other folders are not opened."""
    return spark.read.parquet(path).where(F.col("split") == split)


def tensor_columns(df: DataFrame) -> DataFrame:
    """Only the columns a training loop reads."""
    return df.select("input_ids", "attention_mask", "labels")

"""Text folders, the chunk collection and run metrics."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = "run_id string, metric string, value double"
#: Characters of a record's id that name its part of the collection.
PART_DIGITS = 2


def read_texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """``file_name, text``: every matching file as one row."""
    files = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))


def write_texts(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Texts keyed by their file name."""
    df.select("file_name", "text").write.mode(mode).parquet(path)


def upsert_records(records: DataFrame, path: str) -> None:
    """Append the chunk records whose id the collection at ``path`` does not hold yet.

    The collection is stored in parts by the first characters of the id, at most 16 to the power of
    :data:`PART_DIGITS` for ids in hexadecimal digits. Only parts that the records touch are read.
    """
    spark = records.sparkSession
    records = records.withColumn("part", F.substring("id", 1, PART_DIGITS))
    try:
        held = spark.read.schema("id string, part string").parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        fresh = records
    else:
        touched = [r.part for r in records.select("part").distinct().collect()]
        fresh = records.join(held.where(F.col("part").isin(touched)).select("part", "id"), ["part", "id"], "left_anti")
    # One file for each part that gets records.
    fresh.select(*records.columns).repartition("part").write.mode("append").partitionBy("part").parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The collection that :func:`upsert_records` has written."""
    return spark.read.parquet(path).drop("part")


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Append ``run_id, metric, value`` rows."""
    metrics.select("run_id", "metric", F.col("value").cast("double")).write.mode("append").parquet(
        path
    )


def read_run_summaries(spark: SparkSession, path: str, run_pattern: str) -> DataFrame:
    """One-object JSON files → ``run_id, metric, value``; values that are no number are left out.

    ``run_pattern`` is a regular expression whose first group finds the run in the file path.
    """
    text = spark.read.text(path, wholetext=True)
    entries = text.select(
        F.regexp_extract("_metadata.file_path", run_pattern, 1).alias("run_id"),
        F.explode(F.from_json("value", "map<string,string>")).alias("metric", "raw"),
    )
    numbers = entries.select("run_id", "metric", F.col("raw").try_cast("double").alias("value"))
    return numbers.where(F.col("value").isNotNull())


def best_run(metrics: DataFrame, *metric: str, smaller_is_better: bool = True) -> DataFrame:
    """``metric, run_id, value`` of the best run per metric, ties by run id."""
    rows = metrics.where(F.col("metric").isin(*metric)) if metric else metrics
    rank = F.col("value") if smaller_is_better else -F.col("value")
    best = F.min_by(F.struct("run_id", "value"), F.struct(rank, F.col("run_id")))
    return rows.groupBy("metric").agg(best.alias("best")).select("metric", "best.*")


def refresh_best(spark: SparkSession, path: str, state: str, smaller_is_better: bool = True) -> DataFrame:
    """:func:`best_run` of all metrics appended at ``path``, of which only new files are read.

    ``state`` keeps which files have been read and the best rows so far, a version for each time that
    there were new ones. A refresh that breaks off is done again by the next one.
    """
    best = f"{state}/best"

    def merge(rows: DataFrame, version: int) -> None:
        if version:
            before = spark.read.schema(METRICS).parquet(f"{best}/version={version - 1}")
            rows = rows.unionByName(before)
        found = best_run(rows, smaller_is_better=smaller_is_better)
        found.write.mode("overwrite").parquet(f"{best}/version={version}")

    new = spark.readStream.schema(METRICS).parquet(path)
    stream = new.writeStream.foreachBatch(merge).option("checkpointLocation", f"{state}/files")
    stream.trigger(availableNow=True).start().awaitTermination()
    versions = spark.read.schema("metric string, run_id string, value double, version long").parquet(best)
    last = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == last).drop("version")

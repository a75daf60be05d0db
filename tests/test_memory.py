"""What tasks hold at a time, whatever the input's size."""

import glob

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sumwright import session
from sumwright.llm import decontaminate
from sumwright.operators import long_texts


def batch_bytes(df):
    """Bytes of each batch that reaches Python."""

    def measure(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.nbytes], pa.int64())})

    return [r.n for r in df.mapInArrow(measure, "n long").collect()]


def test_batches_are_of_few_megabytes(spark):
    rows = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 50_000).alias("text"))
    found = batch_bytes(rows)
    assert sum(found) > 400 * 50_000
    assert max(found) < 2 * session.BATCH_BYTES


def test_wide_rows_are_written_in_small_row_groups(spark):
    docs = spark.range(0, 12, 1, 1).select(
        F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(" word"), 240_000)).alias("text")
    )
    index = decontaminate.build_index(docs)
    assert index.count() == 12
    groups = [
        meta.row_group(i).num_rows
        for path in index.inputFiles()
        for meta in [pq.ParquetFile(path.removeprefix("file://")).metadata]
        for i in range(meta.num_row_groups)
    ]
    assert sum(groups) == 12 and max(groups) <= decontaminate.SHARDS


def test_blocks_are_written_in_small_row_groups(spark):
    parts = spark.range(0, 40, 1, 1).select(F.lit("a").alias("doc_id"), F.col("id").alias("part_no"), F.repeat(F.lit("so "), 40).alias("text"))
    before = set(session._written)
    assert long_texts.chunk_parts(parts, size=20, overlap=5, block=64).count() > 0
    written = [p for p in set(session._written) - before if "/blocks-" in p]
    files = [f for p in written for f in glob.glob(f"{p.removeprefix('file://')}/*.parquet")]
    sizes = [m.row_group(i).num_rows for f in files for m in [pq.ParquetFile(f).metadata] for i in range(m.num_row_groups)]
    assert sum(sizes) > long_texts.ROWS and max(sizes) <= long_texts.ROWS

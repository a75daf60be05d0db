"""Session and checkpoint settings."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a batch that goes to a Python task; one longer row is a batch of its own.
BATCH_BYTES = 2 * 1024 * 1024


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators are written for; nothing here depends on the data.

    Compiled methods above 8,000 bytes are never JIT-compiled, so such stages are better split
    into one method per expression. Python batches are limited by size, since one document may be
    large, and to a few megabytes, since a task holds a batch several times over as Python objects,
    whatever the input's size.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    return spark


def local_session(cpus: int | str = 8, name: str = "sumwright") -> SparkSession:
    """A local session for tests and the benchmark; on a cluster, bring your own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        # Call sites are recorded at several JVM round trips per column otherwise.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    A folder of this machine is used only in a local session where nothing is set, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="sumwright-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_written: list[str] = []


def checkpointed(df: DataFrame, label: str = "table", group: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back.

    This cuts lineage, outlives lost executors and tells the planner the real size, so that small
    tables are broadcast and others not. Results may read the files until :func:`delete_written`.
    Files are read in batches of up to 4,096 rows of a row group. Where rows are of a megabyte,
    ``group`` limits the rows of a row group, and so what writers and readers hold.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    limits = {} if group is None else {"parquet.block.row.count.limit": str(group)}
    df.write.options(**limits).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_written(spark: SparkSession) -> int:
    """Deletes what :func:`checkpointed` has written in this process; results that are still to be
    computed from it are lost. Returns the number of tables."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    gone = len(_written)
    while _written:
        path = paths(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, for clusters where it is not installed."""
    root = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="sumwright-ship-")) / "sumwright.zip"
    with zipfile.ZipFile(archive, "w") as file:
        for module in sorted(root.rglob("*.py")):
            file.write(module, module.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    return spark

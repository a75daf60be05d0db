"""Partition counts of scans."""

from __future__ import annotations

from pyspark.sql import DataFrame

SETTING = "sumwright.scan.partitions"


def spread(scan: DataFrame) -> DataFrame:
    """The scan as it is, or dealt out over as many partitions as the session asks for.

    A file with one large row group is one task. Who knows the inputs to be such files sets
    ``sumwright.scan.partitions``; nothing here looks at the data or the machine.
    """
    wanted = scan.sparkSession.conf.get(SETTING, None)
    return scan.repartition(int(wanted)) if wanted else scan

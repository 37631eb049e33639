"""A session with the settings that the plans here are written for."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are broadcast at most where a table is counted for it.
BROADCAST_ROWS = 1_000_000


def session(master: str | None = None, **settings: str) -> SparkSession:
    """Adaptive execution, UTC, and small files packed into few scan partitions."""
    builder = SparkSession.builder.appName("lexigrid")
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.files.openCostInBytes": "65536",
        "spark.ui.enabled": "false",
    }
    return builder.config(map={**defaults, **settings}).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors of a cluster, whose Python workers would not find it. Not needed where it is installed, or on
    their PYTHONPATH."""
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lexigrid-")) / "lexigrid.zip"  # read by the driver alone, which serves it
    with zipfile.ZipFile(archive, "w") as f:
        for path in sorted(package.rglob("*.py")):
            f.write(path, path.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor and the driver see. Where it is unset, a session whose executors are on
    this machine gets a temporary one; on a cluster, whose executors would not see it, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lexigrid-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def spread(table: DataFrame) -> DataFrame:
    """A table of one file dealt over all cores: such a file is often one row group, which one task reads, and that task would then do
    all the work that needs no shuffle. A table of several files stays as it is."""
    if len(table.inputFiles()) > 1:
        return table
    return table.repartition(table.sparkSession.sparkContext.defaultParallelism)


def kept(table: DataFrame) -> DataFrame:
    """The table, computed now and kept on the executors (in memory, else on their disks) for what reads it several times; a lost executor's
    share is computed again. The planner knows its size from then on, so joins broadcast it only if it is small."""
    table = table.persist(StorageLevel.MEMORY_AND_DISK)
    table.count()
    return table


def small(table: DataFrame) -> DataFrame:
    """To be broadcast, if it has no more than BROADCAST_ROWS rows; else as it is, and joins shuffle."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table

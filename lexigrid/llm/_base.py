"""What the operators of this subpackage share: scratch tables in the shared folder, column helpers, input checks."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, spread

#: Rows of an Arrow batch. Texts may be very long; a batch also ends at BATCH_BYTES.
BATCH_ROWS = 500
BATCH_BYTES = 4 << 20


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lexigrid/{name}-{uuid.uuid4().hex}"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """Works for whatever store the shared folder is in (file:, hdfs:, viewfs:, s3:, gs:)."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def stored(df: DataFrame, name: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, a lost executor costs no more than its tasks,
    and the planner knows the table's true size (so a later broadcast is size-checked)."""
    path = scratch_path(df.sparkSession, name)
    bounded_batches(df.sparkSession)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches end at BATCH_ROWS rows or BATCH_BYTES bytes, so that long texts do not pile up in a worker. This sets the session's
    limits and leaves them, as results are lazy: they have to hold when a result is read."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of df has, whatever the letters' case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        k, new = 0, f"_lx_{name}"
        while new.lower() in taken:
            k += 1
            new = f"_lx_{name}_{k}"
        taken.add(new.lower())
        out.append(new)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def sheltered(df: DataFrame, *taken: str) -> tuple[DataFrame, list[Column]]:
    """df with the columns that have one of these names (whatever the letters' case) renamed, and what selects all of df's columns
    again, under their own names, from what is made of it."""
    clash = [c for c in df.columns if c.lower() in taken]
    new = dict(zip(clash, fresh(df, *(f"kept_{k}" for k in range(len(clash)))), strict=True))
    return df.withColumnsRenamed(new), [col(new.get(c, c)).alias(c) for c in df.columns]


def giving_back(function: Callable) -> Callable:
    """A function for mapInArrow whose worker, which stays for other stages, gives free memory back to the machine when a task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # a C library without it
                ctypes.CDLL(None).malloc_trim(0)

    return run

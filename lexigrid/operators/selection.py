"""Preparing labelled sets: splits, seeded shuffles, slices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept, small


def split_of(data: DataFrame, split: str, split_col: str = "split") -> DataFrame:
    """One split; where the data are partitioned by it, only its files are read."""
    return data.where(F.col(split_col) == split)


def shuffle_key(id_col: str, seed: int = 42) -> Column:
    """A number that depends on seed and id alone, so the order is the same however rows are partitioned."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def shuffled(data: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    return data.orderBy(shuffle_key(id_col, seed), id_col)


def shuffled_take(data: DataFrame, id_col: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """The first n rows in shuffled order, with their position (from 0). Each task keeps n rows at most; what is done to the rows comes
    after this, so no more than n rows pay for it."""
    picked = data.withColumn("_key", shuffle_key(id_col, seed)).orderBy("_key", id_col).limit(n)
    return picked.withColumn("position", F.row_number().over(Window.orderBy("_key", id_col)) - 1).drop("_key")


def numbered(data: DataFrame, id_col: str, name: str) -> DataFrame:
    """data with each row's place (from 0) in the order of id. A range shuffle deals rows over partitions, which number their own; what is
    before a partition is a sum over partitions. Ids must be different; a null is the first."""
    dealt = data.repartitionByRange(F.col(id_col)).withColumn("_part", F.spark_partition_id())
    dealt = kept(dealt)  # else partitions could be cut differently the second time
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    bases = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_base"))
    own = dealt.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy(id_col)))
    return own.join(bases, "_part").withColumn(name, F.col("_base") + F.col("_nth") - 1).drop("_part", "_nth", "_base")


def permutation_take(data: DataFrame, id_col: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """The same with numpy's permutation of row numbers (rows in order of id), for sets small enough that this order is wanted: the driver
    holds a number for each row."""
    rows = numbered(data, id_col, "_row")
    order = np.random.default_rng(seed).permutation(rows.count())[:n]
    places = data.sparkSession.createDataFrame([(int(row), at) for at, row in enumerate(order)], "_row long, position int")  # at most n rows
    return rows.join(small(places), "_row").drop("_row")

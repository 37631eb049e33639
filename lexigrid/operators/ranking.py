"""Ranking, and joining runs with judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank(run: DataFrame, depth: int | None = None, score: str = "score") -> DataFrame:
    """run with rank (from 1) within its topic: by score, ties by docno, both descending; a rank column in run is ignored. With depth,
    only so many of each topic, which each task already cuts down to before the shuffle."""
    order = Window.partitionBy("qid").orderBy(F.desc(score), F.desc("docno"))
    ranked = run.drop("rank").withColumn("rank", F.row_number().over(order))
    return ranked if depth is None else ranked.where(F.col("rank") <= depth)


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """run with rel; 0 where a document is not judged for its topic."""
    known = qrels.groupBy("qid", "docno").agg(F.max("rel").alias("rel"))
    return run.join(known, ["qid", "docno"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))

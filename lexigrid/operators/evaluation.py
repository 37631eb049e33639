"""Measures of ranked retrieval, as trec_eval defines them. A document is relevant if rel > 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import judged, rank

METRICS = ("map", "Rprec", "recip_rank", "P_5", "P_10", "P_20")


def _measures(cutoffs: tuple[int, ...] = (5, 10, 20)) -> dict[str, Column]:
    hit, at, n = F.col("hit"), F.col("rank"), F.col("n_rel")
    first = F.min(F.when(hit == 1, at))
    return {
        "map": F.sum(F.when(hit == 1, F.col("hits") / at).otherwise(0.0)) / F.max(n),
        "Rprec": F.sum(F.when(at <= n, hit).otherwise(0)) / F.max(n),
        "recip_rank": F.coalesce(1 / first, F.lit(0.0)),
        **{f"P_{k}": F.sum(F.when(at <= k, hit).otherwise(0)) / F.lit(float(k)) for k in cutoffs},
    }


def per_query(run: DataFrame, qrels: DataFrame, complete: bool = False) -> DataFrame:
    """qid and a column for each measure. Topics are those in the run that have a relevant document in qrels; with complete all topics
    that have one, with zeros where the run has none of theirs. run: qid, docno, score; its rank column is ignored."""
    relevant = qrels.where(F.col("rel") > 0).groupBy("qid").agg(F.countDistinct("docno").alias("n_rel"))
    marked = judged(rank(run.select("qid", "docno", "score")), qrels).withColumn("hit", (F.col("rel") > 0).cast("int"))
    so_far = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    counted = marked.withColumn("hits", F.sum("hit").over(so_far)).join(relevant, "qid")
    found = counted.groupBy("qid").agg(*[value.alias(name) for name, value in _measures().items()])
    if complete:
        found = relevant.select("qid").join(found, "qid", "left").fillna(0.0, list(METRICS))
    return found


def long_form(measures: DataFrame) -> DataFrame:
    """(metric, qid, value) from a column for each measure."""
    return measures.unpivot("qid", list(METRICS), "metric", "value").select("metric", "qid", "value")


def evaluate(run: DataFrame, qrels: DataFrame, by_query: bool = False, complete: bool = False) -> DataFrame:
    """(metric, qid, value): the mean over topics has qid 'all'; with by_query each topic's value is there too."""
    each = long_form(per_query(run, qrels, complete)).withColumn("qid", F.col("qid").cast("string"))
    mean = each.groupBy("metric").agg(F.avg("value").alias("value")).select("metric", F.lit("all").alias("qid"), "value")
    return each.unionByName(mean) if by_query else mean


def report(measures: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """The means as lines, 'map: 0.1234', in the order of metrics (column nth)."""
    order = F.array_position(F.array(*map(F.lit, metrics)), F.col("metric"))
    rows = measures.where((F.col("qid") == "all") & F.col("metric").isin(*metrics))
    return rows.select(order.alias("nth"), "metric", F.format_string("%s: %.4f", "metric", "value").alias("line"))

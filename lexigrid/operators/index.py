"""Inverted index. Tables keyed by document: docno, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..session import small


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unicode: bool = False) -> DataFrame:
    return docs.select(F.col(id_col).alias("docno"), tokenize(F.col(text_col), unicode).alias("tokens"))


def postings(tokens: DataFrame) -> DataFrame:
    """(term, docno, tf). Counts are summed on the map side, so a word that is everywhere moves once a task and document."""
    return tokens.select("docno", F.explode("tokens").alias("term")).groupBy("term", "docno").agg(F.count("*").alias("tf"))


def postings_by_document(tokens: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(doc, term, tf), doc a struct of docno and the document's length. A document's rows are in one partition, so later sums by document
    need no other shuffle. With terms (term), only theirs: then words are thrown away before the one shuffle there is."""
    doc = F.struct("docno", F.size("tokens").cast("bigint").alias("length")).alias("doc")
    rows = tokens.select(doc, F.explode("tokens").alias("term"))
    if terms is not None:
        rows = rows.join(small(terms.select("term").distinct()), "term", "left_semi")
    return rows.repartition("doc").groupBy("doc", "term").agg(F.count("*").alias("tf"))


def term_statistics(index: DataFrame) -> DataFrame:
    """(term, df, cf): documents with the term, occurrences of it."""
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def document_lengths(tokens: DataFrame) -> DataFrame:
    """(docno, length), without a shuffle."""
    return tokens.select("docno", F.size("tokens").cast("bigint").alias("length"))


def collection_statistics(tokens: DataFrame) -> DataFrame:
    """One row: documents, average length."""
    return tokens.agg(F.count("*").alias("n_docs"), F.avg(F.size("tokens")).alias("avg_length"))

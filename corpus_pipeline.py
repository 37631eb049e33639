"""A corpus from raw documents to packed token sequences, in stages that each end as a table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm._base import bounded_batches, fresh, sheltered, stored, table
from lexigrid.llm.langid import UNKNOWN, fit, held_out, identify
from lexigrid.llm.line_dedup import dedup_lines
from lexigrid.llm.mixing import mix, mixed_rows, words
from lexigrid.llm.packing import pack, token_pieces
from lexigrid.llm.simhash import drop_near_duplicates

#: A document whose language is less likely than this is rejected, as is one whose language cannot be told.
LEAST_SCORE = 0.5
#: Encoded stretches that a worker keeps: workers stay from stage to stage, beside what the other stages need.
REMEMBERED = 20_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, as they are; the others go.

    Rejected are null and empty texts, texts without a letter, and those whose likeliest language has a calibrated probability below
    LEAST_SCORE. The model learns from the rows of documents with an id and a language that are not held out; a null language teaches
    nothing and is predicted like any other. Repeated rows are judged alike and all stay or go. Whole texts are read, however long.
    Columns of docs named as those that the operator adds are kept as they are. No rows: no rows.
    """
    bounded_batches(spark)
    model = fit(docs.where(F.col("doc_id").isNotNull()), ~held_out())
    docs, own = sheltered(docs, "lang_pred", "score")
    told = identify(docs, model)
    return told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*own)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others keep; n_chars follows the text.

    No row goes, even if all its lines do: its text is then empty, as is a null one. Of documents that hold a line the one with the
    largest id keeps it; rows that repeat this id all do; rows without an id lose it. Columns named n_lines and n_dropped are kept as they
    are. No rows: no rows.
    """
    bounded_batches(spark)
    docs, own = sheltered(docs, "n_lines", "n_dropped")
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*own)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, as it is: that with the smallest id.

    Empty texts are one group. Of rows that repeat the id, the text with the smallest hash stays, and of equal ones one; rows without an
    id all stay. Columns of any name are carried along. No rows: no rows.
    """
    bounded_batches(spark)
    return drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, shard after shard, shuffled within each.

    A null source is a source, the last one. Empty texts have no words and are taken or left with their block. Rows that repeat are
    documents of their own. Columns named as those that the operator adds are kept as they are. No rows: no rows.
    """
    bounded_batches(spark)
    docs, own = sheltered(docs, "source_size", "target", "draws", "shard", "place")
    (size,) = fresh(docs, "words")
    drawn = mixed_rows(mix(docs.withColumn(size, words()), size))
    return drawn.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place").select(*own)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids (ids: two bytes each, little-endian) with their sequence and offset.

    An empty or null text is its end id alone. Very long texts are cut into pieces of 4,096 ids and a rest. Rows that repeat are documents
    of their own. Of the columns of docs only doc_id comes back. No rows: no pieces.
    """
    bounded_batches(spark)
    return pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, remembered=REMEMBERED, narrow=True))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: Hashing, learning and tokenizing are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Readers and writers of retrieval collections: documents, topics, judgments, runs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types are stated, never inferred: ids such as 04 stay as they are.
QRELS = "qid string, iter string, docno string, rel int"
RUN = "qid string, q0 string, docno string, rank int, score double, tag string"


def parse_corpus(files: DataFrame) -> DataFrame:
    """From (value, path), a row a file: the first line is the URL, the text follows after empty lines; the folder is the shard, the
    file's name the document's: docno, shard, url, body. A file without a line end has an empty body."""
    body = F.ltrim(F.substring(F.col("value"), F.instr("value", "\n") + 1, F.lit(2**31 - 1)), F.lit("\n"))
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("docno"),
        F.element_at(F.split("path", "/"), -2).alias("shard"),
        F.substring_index("value", "\n", 1).alias("url"),
        F.when(F.instr("value", "\n") > 0, body).otherwise(F.lit("")).alias("body"),
    )


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One file a document, in folders that are the shards. Many small files go to few scan partitions where
    spark.sql.files.openCostInBytes is small. Read once, write Parquet, query that."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return parse_corpus(files.select("value", F.col("_metadata.file_path").alias("path")))


def write_corpus(docs: DataFrame, folder: str) -> DataFrame:
    """Write documents (docno, shard, url, body) as files in the layout that read_corpus reads; overwrites. Returns (docno), which has to
    be consumed. A file is written under another name, outside the folder, and then renamed, so a task that is run again leaves whole
    files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri("/" + folder[5:].lstrip("/") if folder.startswith("file:") else folder)
        for batch in batches:
            for docno, shard, url, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = f"{root}.new/{uuid.uuid4().hex}"
                store.create_dir(f"{root}.new", recursive=True)
                store.create_dir(f"{root}/{shard}", recursive=True)
                with store.open_output_stream(new) as f:
                    f.write(f"{url}\n\n{body}".encode())
                store.move(new, f"{root}/{shard}/{docno}")
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["docno"])

    return docs.select("docno", "shard", "url", "body").mapInArrow(write, "docno string")


def parse_topics(lines: DataFrame, line: str = "value", unescape: bool = False) -> DataFrame:
    """'<qid> <title>' a line, cut at the first space only. unescape turns \\/ into /. Empty lines are left out."""
    at = F.instr(line, " ")
    title = F.when(at > 0, F.substring(F.col(line), at + 1, F.lit(2**31 - 1))).otherwise(F.lit(""))
    title = F.regexp_replace(title, r"\\/", "/") if unescape else title
    return lines.where(F.trim(F.col(line)) != "").select(F.substring_index(line, " ", 1).alias("qid"), F.trim(title).alias("title"))


def read_topics(spark: SparkSession, path: str, unescape: bool = False) -> DataFrame:
    return parse_topics(spark.read.text(path), unescape=unescape)


def _fields(lines: DataFrame, line: str, schema: str) -> DataFrame:
    parts = F.split(F.trim(F.col(line)), r"\s+")
    names = [field.split() for field in schema.split(", ")]
    return lines.where(F.trim(F.col(line)) != "").select(*[F.try_element_at(parts, F.lit(k + 1)).try_cast(kind).alias(name) for k, (name, kind) in enumerate(names)])


def parse_qrels(lines: DataFrame, line: str = "value") -> DataFrame:
    """'qid iter docno rel', white space between; see QRELS. A field that is missing or no number is null."""
    return _fields(lines, line, QRELS)


def parse_run(lines: DataFrame, line: str = "value") -> DataFrame:
    """'qid Q0 docno rank score tag', white space between; see RUN. A field that is missing or no number is null."""
    return _fields(lines, line, RUN)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    return parse_qrels(spark.read.text(path))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    return parse_run(spark.read.text(path))


def run_lines(run: DataFrame, tag: str = "lexigrid") -> DataFrame:
    """A ranking (qid, docno, rank, score) as the lines of a run file."""
    fields: list[Column] = [F.col("qid").cast("string"), F.lit("Q0"), F.col("docno").cast("string"), F.col("rank").cast("string"), F.col("score").cast("string"), F.lit(tag)]
    return run.select(F.concat_ws(" ", *fields).alias("value"))


def write_run(run: DataFrame, path: str, tag: str = "lexigrid") -> None:
    """Sorted by topic and rank, in as many files as there are partitions."""
    run_lines(run.repartitionByRange("qid", "rank").sortWithinPartitions("qid", "rank"), tag).write.mode("overwrite").text(path)


def read_labelled(spark: SparkSession, docs_path: str, labels_path: str, label: str = "quality") -> DataFrame:
    """Labelled texts (doc_id, split, text, label): a tenth of the ids, by remainder, is the split test."""
    docs = spark.read.parquet(docs_path).select("doc_id", "text")
    labels = spark.read.parquet(labels_path).select("doc_id", F.col(label).alias("label"))
    split = F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train")
    return docs.join(labels, "doc_id").select("doc_id", split.alias("split"), "text", "label")

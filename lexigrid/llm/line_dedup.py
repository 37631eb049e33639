"""Line dedup: lines that several documents hold stay only in the document with the largest id.

Three passes, none of which gathers a line's holders in one place: the distinct line keys of each row are hashed to 128 bits, made
distinct by document and counted with map-side partial sums; keys over the threshold are joined back to the rows that hold them (a
sort-merge join, which adaptive execution splits where one line is in a third of all documents); each row gets the list of its own
lines to drop. A row is known by its id and a hash of its text, so that an id, or none, that many rows have is no group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import col, fresh, giving_back, stored

#: A line's key must have so many code points, and so many documents must hold it.
MIN_CHARS = 20
MIN_DOCS = 3


def line_keys(text: bytes) -> list[bytes]:
    """The key of each line: stripped of [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased. On bytes, strip() and lower() do just that."""
    return [line.strip().lower() for line in text.split(b"\n")]


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _emitter(min_chars: int, names: list[str]):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, digests = [], []
            for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                if text:
                    own = {xxhash.xxh3_128_digest(k) for k in line_keys(text) if _long_enough(k, min_chars)}
                    owners.append(np.full(len(own), i, "i8"))
                    digests.extend(own)
            if digests:
                halves = np.frombuffer(b"".join(digests), ">i8").astype("i8").reshape(-1, 2)
                rows = pa.array(np.concatenate(owners))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(2).take(rows), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=names)

    return emit


def shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The (id, text_hash, h1, h2) of every line key that a row has to give up: at least min_docs documents hold it, and the row is not of
    the one with the largest id."""
    plain = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    longs = [T.StructField(c, T.LongType()) for c in ("text_hash", "h1", "h2")]
    schema = T.StructType([T.StructField("id", plain.schema["id"].dataType), *longs])
    held = plain.mapInArrow(giving_back(_emitter(min_chars, schema.names)), schema)
    often = held.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs).drop("n")
    often = stored(often, "often")  # else its partitioning would bind the join's, and a hot line could not be split
    return held.join(often, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper"))).select("id", "text_hash", "h1", "h2")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of docs, with the text of the lines that stay, and n_lines (before dropping) and n_dropped after them.

    A null or empty text is one empty line and comes back as an empty text. Rows with the same id are one document, which holds a line
    once however many of them do; lines stay in every row that has the largest id. Rows without an id are no document that counts, and
    lose the lines that others lose. Line ends other than \\n belong to the line. Input columns named n_lines or n_dropped are replaced.
    An empty table gives an empty table.
    """
    drops, lines, texts_hash, out = fresh(docs, "drops", "lines", "text_hash", "out")
    shared = shared_lines(docs, id_col, text_col, min_chars, min_docs)
    gone = shared.groupBy(F.col("id").alias(lines), F.col("text_hash").alias(texts_hash)).agg(F.collect_set(F.struct("h1", "h2")).alias(drops))
    joined = docs.join(gone, col(id_col).eqNullSafe(F.col(lines)) & (F.xxhash64(col(text_col).cast("string")) == F.col(texts_hash)), "left")

    @F.arrow_udf("struct<text: string, n_lines: bigint, n_dropped: bigint>")
    def keep(texts: pa.Array, dropped: pa.Array) -> pa.Array:
        kept, n, less = [], [], []
        hashes = dropped.values.field(0).to_numpy(zero_copy_only=False), dropped.values.field(1).to_numpy(zero_copy_only=False)
        packed = np.stack(hashes, 1).astype(">i8").tobytes() if len(hashes[0]) else b""
        at = dropped.offsets.to_numpy()
        for i, text in enumerate(texts.cast(pa.binary()).to_pylist()):
            text = text or b""
            if at[i] == at[i + 1]:
                kept.append(text)
                n.append(text.count(b"\n") + 1)
                less.append(0)
                continue
            own = {packed[16 * k : 16 * k + 16] for k in range(at[i], at[i + 1])}
            whole = text.split(b"\n")
            stay = [line for line, key in zip(whole, line_keys(text), strict=True) if not (_long_enough(key, min_chars) and xxhash.xxh3_128_digest(key) in own)]
            kept.append(b"\n".join(stay))
            n.append(len(whole))
            less.append(len(whole) - len(stay))
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(less, pa.int64())], names=["text", "n_lines", "n_dropped"])

    done = joined.withColumn(out, keep(col(text_col).cast("string"), F.coalesce(F.col(drops), F.array().cast("array<struct<h1: bigint, h2: bigint>>"))))
    rest = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return done.select(*[F.col(out)["text"].alias(c) if c == text_col else col(c) for c in rest], F.col(out)["n_lines"].alias("n_lines"), F.col(out)["n_dropped"].alias("n_dropped"))

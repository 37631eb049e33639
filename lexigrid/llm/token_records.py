"""Token-id output: length-delimited binary records with masked checksums, and an offset index beside each file.

A record: length of the payload (unsigned 64-bit), masked CRC-32 of those 8 bytes, payload, masked CRC-32 of the payload; all
little-endian. The payload: 1 byte (1 if the document has an id), the id (signed 64-bit), 1 byte (bytes of a token id: 2 if the whole vocabulary and
the end id fit, else 4), then the token ids (unsigned).
The index file has, per record, its offset and the number of ids in the records before it in the file (unsigned 64-bit each), then
the file's size and all its ids: any record is found with one seek, in whatever order a reader shuffles them.

Files are in ascending order of id, then of a hash of the text, so that an id, or none, that many rows have is many files: a range
shuffle, one data file and one index file a partition. Their names are new for each
attempt; only files in the manifest belong to the data set, so retried and speculative tasks do no harm.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import col, filesystem, scratch_path, stored
from ._tokens import encoder

_HEAD = "<QI"
_ID = "<BqB"
_CRC = "<I"
#: Records that a reading task takes at once, and bytes for a task, about.
CHUNK, TASK_BYTES = 4096, 16 << 20
MANIFEST = "shard bigint, path string, n_records bigint, n_ids bigint, n_bytes bigint"


def masked(crc: int) -> int:
    """A checksum turned and shifted, so that checksums of data that hold checksums stay telling."""
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack(_CRC, masked(zlib.crc32(size))), payload, struct.pack(_CRC, masked(zlib.crc32(payload)))))


def unframed(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The payload of the record at this offset, and the offset after it; ValueError if a checksum is wrong."""
    size, crc = struct.unpack_from(_HEAD, data, at)
    if masked(zlib.crc32(data[at : at + 8])) != crc:
        raise ValueError(f"record at {at}: the length is damaged")
    begin = at + struct.calcsize(_HEAD)
    payload = data[begin : begin + size]
    if len(payload) != size or masked(zlib.crc32(payload)) != struct.unpack_from(_CRC, data, begin + size)[0]:
        raise ValueError(f"record at {at}: the payload is damaged")
    return payload, begin + size + 4


def _writer(out_dir: str, tokenizer: str, end_id: int | None):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        store, root = filesystem(out_dir)
        name = f"{root}/part-{shard:06d}-{uuid.uuid4().hex}"
        tokens = encoder(tokenizer)
        encode, end = tokens.encode, b"" if end_id is None else struct.pack("<I", end_id)
        width = 2 if max(tokens.tokenizer.get_vocab_size() - 1, end_id or 0) < 1 << 16 else 4
        at = n = 0
        index: list[int] = []
        sink = None
        for batch in batches:
            if sink is None:
                store.create_dir(root, recursive=True)
                sink = store.open_output_stream(f"{name}.rec")
            texts = batch.column(1).to_pylist()
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode([t or "" for t in texts]), strict=True):
                own = np.frombuffer(ids + end, "<u4")
                record = framed(struct.pack(_ID, doc_id is not None, doc_id or 0, width) + own.astype(f"<u{width}").tobytes())
                index += (at, n)
                at += len(record)
                n += len(own)
                sink.write(record)
        if sink is not None:
            sink.close()
            with store.open_output_stream(f"{name}.idx") as f:
                f.write(np.array([*index, at, n], "<u8").tobytes())
            uri = f"{out_dir}/{name.rpartition('/')[2]}.rec"
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [uri], "n_records": [len(index) // 2], "n_ids": [n], "n_bytes": [at]})

    return write


def write_records(docs: DataFrame, tokenizer: str, end_id: int | None, out_dir: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append end_id, write files in ascending id order (nulls first, ties by a hash of the text, then the text);
    returns the manifest.

    A null text is an empty one. An empty table writes nothing. tokenizer: a file of the tokenizers library, at the same path on every
    machine. A control string of the tokenizer that stands in a text is ordinary text there, so that no text can end its document. The
    ids of documents must be integers.
    """
    out_dir = out_dir or scratch_path(docs.sparkSession, "records")
    plain = docs.select(col(id_col).cast("bigint").alias("id"), col(text_col).cast("string").alias("text"))
    ranged = plain.withColumn("h", F.xxhash64("text")).repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text")
    manifest = ranged.select("id", "text").mapInArrow(_writer(out_dir, tokenizer, end_id), MANIFEST)
    return stored(manifest, "manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, first, base in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            store, name = filesystem(path)
            with store.open_input_file(f"{name.removesuffix('.rec')}.idx") as f:
                entries = f.size() // 16
                f.seek(16 * first)
                index = np.frombuffer(f.read(16 * (min(CHUNK, entries - 1 - first) + 1)), "<u8").reshape(-1, 2).astype("i8")
            with store.open_input_file(name) as f:
                bounds = index[:, 0]
                k = 0
                while k < len(index) - 1:
                    upto = max(k + 1, int(np.searchsorted(bounds, bounds[k] + (8 << 20), "right")) - 1)
                    f.seek(int(bounds[k]))
                    data, at, ids, tokens = f.read(int(bounds[upto] - bounds[k])), 0, [], []
                    while at < len(data):
                        payload, at = unframed(data, at)
                        has, doc_id, width = struct.unpack_from(_ID, payload)
                        ids.append(doc_id if has else None)
                        tokens.append(np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(_ID)).astype("<u4").tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(index[k:upto, 1] + base), pa.array(tokens, pa.binary())], names=["doc_id", "start", "ids"])
                    k = upto


def read_records(manifest: DataFrame) -> DataFrame:
    """The records of the files in the manifest: doc_id, start (ids of all records before it), ids (little-endian unsigned 32-bit)."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a file
    based = stored(manifest.where(F.col("n_records") > 0).withColumn("base", before), "bases")
    chunks = based.select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_records") - 1, F.lit(CHUNK).cast("bigint"))).alias("first"), "base")
    size, n = based.agg(F.sum("n_bytes"), F.sum(F.ceil(F.col("n_records") / CHUNK))).first()
    tasks = max(1, min(n or 1, -(-(size or 0) // TASK_BYTES)))  # stated, as adaptive execution would see paths, not what they hold
    return chunks.repartition(tasks, "path", "first").mapInArrow(_reader, "doc_id bigint, start bigint, ids binary")

"""Packing: shortest-pack-first over the length histogram (Krell et al., 2021).

Only the histogram, at most max_tokens counts, comes to the driver. Lengths are placed longest first into the shortest pack that has
room, whole groups of equal packs at a time; a group is a count and a list of (length, copies). Each (group, length) owns a range of
ranks among the pieces of that length, so a piece finds its sequence and offset from its length and rank. There are at most two new
groups a length, and at most about sqrt(2 * max_tokens) lengths a group, so what executors get is bounded whatever the corpus.

Ranks come from one range shuffle by (length, hash, id, start): a hot length is dealt over many partitions, each of which numbers its
own rows; the bases are sums over (partition, length), at most partitions + max_tokens rows.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import col, fresh, giving_back, stored
from ._tokens import REMEMBERED, encoder

MAX_TOKENS = 4096
#: The columns that pack() adds.
ADDED = ("sequence_id", "offset", "sequence_length", "padded_length")


def shortest_pack_first(histogram: dict[int, int], capacity: int = MAX_TOKENS) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of equal packs: (number of packs, [(length, copies), ...])."""
    by_free: dict[int, list] = defaultdict(list)
    widest = 0
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        left = histogram[length]
        while left:
            while widest and not by_free[widest]:
                widest -= 1
            if widest < length:
                copies = capacity // length
                for packs, each in ((left // copies, copies), (1, left % copies)):
                    if packs and each:
                        by_free[capacity - each * length].append((packs, [(length, each)]))
                        widest = max(widest, capacity - each * length)
                left = 0
                continue
            packs, runs = by_free[widest].pop()
            if packs > left:
                by_free[widest].append((packs - left, runs))
                packs, copies = left, 1
            else:
                lower = next((f for f in range(widest, 0, -1) if by_free[f]), 0)
                copies = min(left // packs, widest // length, (widest - lower) // length + 1)
            by_free[widest - copies * length].append((packs, [*runs, (length, copies)]))
            left -= packs * copies
    return [group for groups in by_free.values() for group in groups]


class Layout:
    """Where the piece of a length and rank goes."""

    def __init__(self, groups: list[tuple[int, list[tuple[int, int]]]]):
        used: dict[int, int] = defaultdict(int)
        rows, base = [], 0
        for packs, runs in sorted(groups, key=lambda g: g[1]):
            offset = 0
            for length, copies in runs:
                rows.append((length, used[length], base, offset, copies, sum(n * c for n, c in runs)))
                used[length] += packs * copies
                offset += length * copies
            base += packs
        self.sequences = base
        table = np.array(sorted(rows), "i8").reshape(-1, 6)
        self.length, self.first, self.base, self.offset, self.copies, self.total = table.T.copy()
        self.lengths, self.begin = np.unique(self.length, return_index=True)
        self.shift = np.cumsum([0, *[used[int(n)] for n in self.lengths]])  # ranks of all lengths on one line
        self.line = self.first + self.shift[np.searchsorted(self.lengths, self.length)]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence, offset in it, and the sequence's length."""
        at = np.searchsorted(self.line, rank + self.shift[np.searchsorted(self.lengths, length)], "right") - 1
        nth = rank - self.first[at]
        return self.base[at] + nth // self.copies[at], self.offset[at] + nth % self.copies[at] * length, self.total[at]


def _numberer(names: list[str]):
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by their last column (length) get the partition and their number within the partition's rows of that length."""
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column(batch.num_columns - 1).to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(length[1:] != length[:-1]) + 1])
            nth = np.arange(len(length)) - np.repeat(starts, np.diff([*starts, len(length)]))
            if length[0] == last:
                nth[: starts[1] if len(starts) > 1 else len(length)] += n
            last, n = length[-1], nth[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part, "i8")), pa.array(nth)], names=names)

    return number


def pack(pieces: DataFrame, length_col: str = "length", order_by: tuple[str, ...] = ("doc_id", "start"), capacity: int = MAX_TOKENS) -> DataFrame:
    """pieces with sequence_id, offset (from 0, gapless within a sequence), sequence_length (its ids) and padded_length (with padding:
    capacity, except that a sequence whose length is a power of two is not padded).

    Rows that agree in order_by, nulls among them, are interchangeable. Lengths must be in 1..capacity; a null or other length raises. An
    empty table gives an empty table. Input columns of the names added are replaced; other columns are carried along, whatever their names.

    pieces are stored once, with a number for each row. Only a row's number, length and order are ranked; the rows themselves move once, to
    meet their places, or not at all where the places are few enough to broadcast.
    """
    pieces = pieces.select(*[col(c) for c in pieces.columns if c.lower() not in ADDED])
    row, size, out = fresh(pieces, "row", "size", "place")
    pieces = stored(pieces.withColumn(row, F.monotonically_increasing_id()), "pieces")
    counts = pieces.groupBy(col(length_col).cast("bigint").alias("length")).count().limit(capacity + 2).collect()
    if any(r["length"] is None or not 0 < r["length"] <= capacity for r in counts):
        raise ValueError(f"a piece's length must be in 1..{capacity}")
    layout = Layout(shortest_pack_first({r["length"]: r["count"] for r in counts}, capacity))
    keys = dict(zip((f"_lx_key_{k}" for k in range(len(order_by))), map(col, order_by), strict=True))  # Arrow functions take no dots
    sized = pieces.select(F.col(row).alias("row"), *[c.alias(k) for k, c in keys.items()], F.xxhash64(*keys.values()).alias("h"), col(length_col).cast("bigint").alias("size"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("row", "size", "part", "nth")])
    ranged = sized.repartitionByRange("size", "h", *keys).sortWithinPartitions("size", "h", *keys).select("row", "size")
    numbered = stored(ranged.mapInArrow(giving_back(_numberer(schema.names)), schema), "numbered")
    sums = numbered.groupBy("size", "part").agg((F.max("nth") + 1).alias("base"))
    before = F.sum("base").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = stored(sums.select("size", "part", F.coalesce(before, F.lit(0)).alias("base")), "bases")

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint, sequence_length: bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(x) for x in layout.place(length.to_numpy(), rank.to_numpy())], names=["sequence_id", "offset", "sequence_length"])

    places = numbered.join(bases, ["size", "part"]).select(F.col("row").alias(size), place(F.col("size"), F.col("nth") + F.col("base")).alias(out))
    done = pieces.join(stored(places, "places"), F.col(row) == F.col(size))
    whole = F.col(out)["sequence_length"]
    padded = F.when(whole.bitwiseAND(whole - 1) == 0, whole).otherwise(F.lit(capacity))
    return done.select(*[col(c) for c in pieces.columns if c != row], *[F.col(out)[c].alias(c) for c in ADDED[:3]], padded.cast("bigint").alias(ADDED[3]))


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", capacity: int = MAX_TOKENS, remembered: int = REMEMBERED, narrow: bool = False) -> DataFrame:
    """Whole texts encoded, end_id appended, cut into pieces of capacity ids and a rest: id_col, start, length, ids (binary,
    little-endian unsigned 32-bit), doc_tokens. A null text is an empty one. A document without any id (no end_id) has no piece. Control
    strings of the tokenizer that stand in a text are ordinary text. Rows that repeat an id are documents of their own.
    remembered: stretches that a worker keeps encoded, memory against time. narrow: two bytes an id if the whole vocabulary and end_id fit."""
    plain = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer, remembered)
        encode, end = tokens.encode, b"" if end_id is None else struct.pack("<I", end_id)
        width = 2 if narrow and max(tokens.tokenizer.get_vocab_size() - 1, end_id or 0) < 1 << 16 else 4
        step = width * capacity
        for batch in batches:
            owner, start, ids, total = [], [], [], []
            for i, own in enumerate(encode([t or "" for t in batch.column(1).to_pylist()])):
                own += end
                if width == 2:
                    own = np.frombuffer(own, "<u4").astype("<u2").tobytes()
                for at in range(0, len(own), step):
                    owner.append(i)
                    start.append(at // width)
                    ids.append(own[at : at + step])
                    total.append(len(own) // width)
            arrays = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(start, pa.int64()), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "start", "length", "ids", "doc_tokens"])

    longs = [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens")]
    schema = T.StructType([plain.schema["id"], longs[0], longs[1], T.StructField("ids", T.BinaryType()), longs[2]])
    return plain.mapInArrow(giving_back(cut), schema).withColumnRenamed("id", id_col)


def packed_sequences(placed: DataFrame, ids_col: str = "ids", pad_id: int | None = None, width: int = 4) -> DataFrame:
    """The sequences themselves: sequence_id, ids (binary), lengths (of the pieces, in order, for attention masks). With pad_id, ids are
    filled up to padded_length with it, in width bytes, little-endian. A sequence has at most capacity ids, so no group is large."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", col(ids_col).alias("ids"))))
    rows = placed.groupBy("sequence_id").agg(parts.alias("parts"), F.max(F.col("padded_length") - F.col("sequence_length")).alias("missing"))
    joined = F.aggregate(F.col("parts"), F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    if pad_id is not None:
        joined = F.concat(joined, F.unhex(F.repeat(F.lit(pad_id.to_bytes(width, "little").hex()), F.col("missing").cast("int"))))
    return rows.select("sequence_id", joined.alias("ids"), F.transform("parts", lambda p: p["length"]).alias("lengths"))

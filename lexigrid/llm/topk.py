"""Exact top-k by inner product over a bit-sliced index.

A block of candidates is kept as bit slices: for each component and each bit of its quantised, shifted value, one bitmap over the
block's rows. A query's scores are sums of slices, added as bitmaps: a slice goes in at the bit positions of the query's component
(complemented for a negative one), and carry-save adders reduce the bitmaps at each position to one, which makes the slices of the
score. The top rows come from the most significant score slice downward: rows with the bit set are kept while they are no more than
wanted. Rows that tie at the boundary are resolved exactly: those with the smallest ids, which are the first in the block. Integers are
of any size, so no finite vector is too large.

Each block's slices are built once, where its rows are read, and written to files in the shared folder; so are the queries, in batches.
A searching task loads a group of blocks, streams batches of queries past them, and sends on at most k rows a query and group. Nothing
but these rows, and the queries once, goes through a shuffle. Files have new names in each attempt, and only those in the manifests
count, so tasks may be run again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import col, filesystem, scratch_path, stored

K = 20
SCALE = 64
#: Components of a block of candidates, and rows at most: 32,768 vectors of 64.
CELLS, ROWS = 1 << 21, 1 << 15
#: Bytes of the slices that a searching task holds, about, and blocks at most.
GROUP_BYTES, GROUP_BLOCKS = 32 << 20, 16
#: Queries that are read at once, and pairs of a query and a block for a task, at least.
QUERIES, PAIRS = 256, 512
#: Tasks of the search, at most; each then takes several groups.
TASKS = 20_000
_SMALL = 1 << 62


class BitSlices:
    """An index over rows of integers, in their order: a number for each row, the least value of each component, and for each component
    a matrix of bitmaps (bits, words)."""

    def __init__(self, ids: np.ndarray, low: list[int], slices: list[np.ndarray]):
        self.ids, self.low, self.slices = ids, low, slices
        self.words = -(-len(ids) // 64)
        self.all = self.bitmap(0, len(ids))

    @classmethod
    def of(cls, ids: np.ndarray, values: np.ndarray) -> BitSlices:
        """values: a matrix of 64-bit integers of less than 2**62, or of Python's integers."""
        n, words = len(values), -(-len(values) // 64)
        low, slices = values.min(0), []
        for d in range(values.shape[1]):
            shifted = values[:, d] - low[d]
            bits = int(shifted.max()).bit_length()
            size = -(-bits // 8)
            raw = shifted.astype("<u8").view("u1").reshape(n, 8)[:, :size] if values.dtype != object else np.frombuffer(b"".join(x.to_bytes(size, "little") for x in shifted), "u1").reshape(n, size)
            planes = np.zeros((bits, 64 * words), "u1")
            planes[:, :n] = np.unpackbits(raw, axis=1, bitorder="little", count=bits).T if bits else 0
            slices.append(np.packbits(planes, axis=1, bitorder="little").view("<u8"))
        return cls(ids, [int(x) for x in low], slices)

    def bitmap(self, first: int, last: int) -> np.ndarray:
        """With the rows from first to before last set."""
        bits = np.zeros(64 * self.words, "u1")
        bits[first:last] = 1
        return np.packbits(bits, bitorder="little").view("<u8")

    def record(self) -> tuple[bytes, str, bytes]:
        return self.ids.astype("<i8").tobytes(), json.dumps([self.low, [len(s) for s in self.slices]]), b"".join(s.tobytes() for s in self.slices)

    @classmethod
    def read(cls, ids: bytes, facts: str, slices: bytes) -> BitSlices:
        numbers, (low, bits) = np.frombuffer(ids, "<i8"), json.loads(facts)
        planes = np.frombuffer(slices, "<u8").reshape(sum(bits), -(-len(numbers) // 64))
        return cls(numbers, low, np.split(planes, np.cumsum(bits[:-1], dtype="i8")) if bits else [])

    def scores(self, query: list[int]) -> tuple[list[np.ndarray], int]:
        """Slices of the scores, least significant first, and what is to be added to each score."""
        at: list[list[np.ndarray]] = [[]]
        base = sum(w * x for w, x in zip(query, self.low, strict=False))
        for weight, own in zip(query, self.slices, strict=False):
            if not weight or not len(own):
                continue
            if weight < 0:  # w * v = |w| * (full - v) + w * full, and full - v is v's complement
                base += weight * ((1 << len(own)) - 1)
                own = ~own
                weight = -weight
            for shift in range(weight.bit_length()):
                if weight >> shift & 1:
                    while len(at) < shift + len(own):
                        at.append([])
                    for bit, s in enumerate(own):
                        at[shift + bit].append(s)
        position = 0
        while position < len(at):
            here = at[position]
            while len(here) > 1:
                if position + 1 == len(at):
                    at.append([])
                a, b = here.pop(), here.pop()
                if here:
                    c = here.pop()
                    half = a ^ b
                    here.insert(0, half ^ c)
                    half &= c
                    half |= a & b
                    at[position + 1].append(half)
                else:
                    here.append(a ^ b)
                    at[position + 1].append(a & b)
            position += 1
        return [here[0] if here else np.zeros(self.words, "<u8") for here in at], base

    def top(self, query: list[int], k: int, query_id: int | None = None) -> list[tuple[int, int]]:
        """(score, id) of the k highest scores, ties to the first rows, without the rows of query_id. In no order."""
        slices, base = self.scores(query)
        open_ = self.all
        if query_id is not None:
            first, last = np.searchsorted(self.ids, query_id), np.searchsorted(self.ids, query_id, "right")
            if first < last:
                open_ = open_ & ~self.bitmap(int(first), int(last))
        sure = np.zeros(self.words, "<u8")
        for s in reversed(slices):
            higher = sure | open_ & s
            n = int(np.bitwise_count(higher).sum())
            if n > k:
                open_ = open_ & s
            else:
                sure, open_ = higher, open_ & ~s
                if n == k:
                    open_ = np.zeros(self.words, "<u8")
                    break
        rows = self.members(sure, k)
        rows = np.concatenate([rows, self.members(open_, k - len(rows))])
        word, bit = rows >> 6, (rows & 63).astype("u8")
        bits = [(s[word] >> bit & np.uint64(1)).tolist() for s in slices]
        totals = [base + sum(b << p for p, b in enumerate(own)) for own in zip(*bits, strict=True)]
        return list(zip(totals, self.ids[rows].tolist(), strict=True))

    def members(self, bitmap: np.ndarray, most: int) -> np.ndarray:
        """The first rows that are set."""
        words = np.flatnonzero(bitmap)[:most]
        bits = np.unpackbits(bitmap[words].view("u1").reshape(-1, 8), axis=1, bitorder="little")
        word, bit = np.nonzero(bits)
        return (words[word] * 64 + bit)[:most]


def quantised(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite numbers, as 64-bit integers if all are less than 2**62, else as Python's integers."""
    with np.errstate(over="ignore"):
        y = np.floor(x * float(scale))
    if not y.size or np.abs(y).max() < _SMALL:
        return y.astype("i8")
    flat = [int(a) if np.isfinite(a) else int(b) * scale for a, b in zip(y.ravel(), x.ravel(), strict=True)]
    out = np.empty(len(flat), object)
    out[:] = flat
    return out.reshape(x.shape)


def fine(vector: Column) -> Column:
    """Whether the vector and all its components are there and finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


class _File:
    """An Arrow file of the shared folder, opened with its first batch."""

    def __init__(self, folder: str):
        self.store, root = filesystem(folder)
        name = f"part-{uuid.uuid4().hex}.arrow"
        self.uri, self.path, self.root, self.n, self.sink = f"{folder}/{name}", f"{root}/{name}", root, 0, None

    def write(self, batch: pa.RecordBatch) -> None:
        if self.sink is None:
            self.store.create_dir(self.root, recursive=True)
            self.stream = self.store.open_output_stream(self.path)
            self.sink = pa.ipc.new_file(self.stream, batch.schema)
        self.sink.write_batch(batch)
        self.n += 1

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            self.stream.close()


def _batches(uri: str, numbers: range | list[int]) -> Iterator[pa.RecordBatch]:
    store, name = filesystem(uri)
    with store.open_input_file(name) as f:
        reader = pa.ipc.open_file(f)
        for k in numbers:
            yield reader.get_batch(k)


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids, and vectors as a matrix, of rows that have the same width."""
    ids, vectors = batch.column(0).to_numpy(), batch.column(1)
    widths, flat = vectors.value_lengths().to_numpy(), vectors.flatten().to_numpy()
    begins = np.cumsum(widths, dtype="i8") - widths
    for width in np.unique(widths):
        some = np.flatnonzero(widths == width)
        yield ids[some], flat[begins[some, None] + np.arange(width)]


def _index_writer(folder: str, scale: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, groups, held, some = _File(folder), [], 0, {}

        def block(width: int) -> None:
            nonlocal held
            ids, x = (np.concatenate(parts) for parts in zip(*some.pop(width), strict=True))
            order = np.argsort(ids, kind="stable")
            record = BitSlices.of(ids[order], quantised(x[order], scale)).record()
            size = len(record[0]) + len(record[2])
            if not groups or held + size > GROUP_BYTES or out.n - groups[-1][0] == GROUP_BLOCKS:
                groups.append([out.n, out.n])
                held = 0
            held += size
            out.write(pa.RecordBatch.from_pydict({"ids": [record[0]], "facts": [record[1]], "slices": pa.array([record[2]], pa.large_binary())}))
            groups[-1][1] = out.n

        for batch in batches:
            for ids, x in _vectors(batch):
                width = x.shape[1]
                most = max(64, min(ROWS, CELLS // max(1, width) // 64 * 64))
                while len(ids):
                    own = some.setdefault(width, [])
                    room = most - sum(len(i) for i, _ in own)
                    own.append((ids[:room], x[:room]))
                    ids, x = ids[room:], x[room:]
                    if sum(len(i) for i, _ in own) == most:
                        block(width)
                if sum(i.size + x.size for own in some.values() for i, x in own) > 4 * CELLS:  # many widths
                    block(max(some, key=lambda w: sum(x.size for _, x in some[w])))
        for width in list(some):
            block(width)
        out.close()
        yield pa.RecordBatch.from_pydict({"path": pa.array([out.uri] * len(groups), pa.string()), "first": pa.array([a for a, _ in groups], pa.int64()), "last": pa.array([b for _, b in groups], pa.int64())})

    return write


def _query_writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = _File(folder), 0
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                out.write(batch.slice(at, QUERIES))
            n += batch.num_rows
        out.close()
        if out.n:
            yield pa.RecordBatch.from_pydict({"path": [out.uri], "batches": [out.n], "n": [n]})

    return write


def _far(score: int) -> tuple[int, bytes | None]:
    """Where a score lies: 0 in 64 bits, 1 above, -1 below; and for the latter, bytes in the order of such scores."""
    if -(1 << 63) <= score < 1 << 63:
        return 0, None
    size = (abs(score).bit_length() + 7) // 8
    data = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return (1, data) if score > 0 else (-1, bytes(255 - b for b in data))


def _searcher(files: list[tuple[str, int]], k: int, scale: int):
    names = ["query_id", "vec_id", "score", "side", "far"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    places = [(path, b) for path, n in files for b in range(n)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, last, nth, splits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                blocks = [BitSlices.read(*(c[0].as_py() for c in b.columns)) for b in _batches(path, range(first, last))]
                mine: dict[str, list[int]] = {}
                for uri, b in places[nth::splits]:
                    mine.setdefault(uri, []).append(b)
                for uri, own in mine.items():
                    for queries in _batches(uri, own):
                        out = []
                        for ids, x in _vectors(queries):
                            for query_id, query in zip(ids.tolist(), quantised(x, scale).tolist(), strict=True):
                                found = sorted((-score, vec_id) for block in blocks for score, vec_id in block.top(query, k, query_id))[:k]
                                out += [(query_id, vec_id, None if (far := _far(-less))[0] else -less, *far) for less, vec_id in found]
                        columns = list(zip(*out, strict=True)) or [()] * len(names)
                        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)

    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """For each row with is_query, the k highest inner products of quantised vectors with all other rows (all, if fewer): query_id, rank
    (from 1), vec_id, score. Ties go to the smaller id.

    Rows whose vector is null or holds null, NaN or infinite components, and rows without an id, take no part. Ids must be integers.
    Rows with the query's id are the query's own. Rows that repeat an id are candidates each; of queries that repeat an id the smallest
    vector counts. Shorter vectors are filled up with zeros, an empty one scores 0. Ranks are exact whatever the size of the numbers;
    a score beyond 64 bits, which a long cannot say, is null. No queries, or nothing else than queries' own rows: no result rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(col(id_col).cast("bigint").alias("vec_id"), col(vector_col).cast("array<double>").alias("x"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("vec_id").isNotNull() & fine(F.col("x")))
    asked = rows.where("q").groupBy("vec_id").agg(F.min("x").alias("x"))
    asked = stored(asked.mapInArrow(_query_writer(scratch_path(spark, "queries")), "path string, batches bigint, n bigint"), "queries")
    files = [(r["path"], r["batches"], r["n"]) for r in asked.collect()]  # a row a partition that wrote
    n_queries, n_batches = sum(n for _, _, n in files), sum(b for _, b, _ in files)
    parts = -(-max(1, vectors.count()) // (ROWS * GROUP_BLOCKS))
    groups = stored(rows.select("vec_id", "x").coalesce(parts).mapInArrow(_index_writer(scratch_path(spark, "slices"), scale), "path string, first bigint, last bigint"), "groups")
    n_groups, n_blocks = groups.agg(F.count("*"), F.coalesce(F.sum(F.col("last") - F.col("first")), F.lit(0))).first()
    splits = max(1, min(n_batches, -(-n_queries * n_blocks // (PAIRS * max(1, n_groups)))))
    work = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("nth"), F.lit(splits).alias("splits"))
    work = work.repartition(max(1, min(TASKS, n_groups * splits)), "path", "first", "nth") if n_groups * splits > 1 else work
    kind = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType()), T.StructField("side", T.IntegerType()), T.StructField("far", T.BinaryType())])
    found = work.mapInArrow(_searcher([(path, n) for path, n, _ in files], k, scale), kind)
    by = Window.partitionBy("query_id").orderBy(F.desc("side"), F.desc("score"), F.desc("far"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

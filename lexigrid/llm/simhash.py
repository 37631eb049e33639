"""SimHash near-dedup: fingerprints over word shingles, pigeonhole blocks, Hamming verification, connected components.

Equal fingerprints collapse to one node first, so copies cost nothing further. The 64 bits are cut into 6 blocks; two fingerprints
that differ in at most 3 bits agree on at least 3 blocks, so each node goes to the 20 buckets named by (mask of 3 blocks, bits under
it): 32 bits of key, few chance meetings at any corpus size. A bucket yields a spanning forest of its links, not its pairs. A bucket
of over BUCKET nodes is not compared in one task: its nodes go to narrower buckets, the free bits cut into 6 blocks again. The third
cut leaves 8 free bits, hence at most 256 nodes, so this ends, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import col, fresh, giving_back, stored
from ._components import star_forest

WORDS = 3
SEED = 42
MAX_BITS = 3
BLOCKS = 6
BUCKET = 8192
#: A bucket with so few free bits has 1024 nodes at most and is not cut again.
LAST_BITS = 10
#: Buckets up to this size are compared all at once, larger ones node by node.
SMALL = 8

_LANES = (np.arange(8) * 256).astype("i8")
_BYTE_BITS = np.unpackbits(np.arange(256, dtype="u1")[:, None], axis=1, bitorder="little").astype("i8")
_POWERS = np.uint64(1) << np.arange(64, dtype="u8")


def shingle_hashes(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of every shingle of the A-Z-lower-cased text; of the whole sequence if it has fewer words; none without words."""
    parts = (text or b"").lower().split()
    if len(parts) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), SEED)] if parts else [], "u8")
    joined = b" ".join(parts)
    gaps = np.flatnonzero(np.frombuffer(joined, "u1") == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=False)], "u8")


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """A bit is 1 if set in over half of the hashes; 0 for a text without words."""
    h = shingle_hashes(text, words)
    counts = np.bincount((h.view("u1").reshape(-1, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int(_POWERS[counts.ravel() * 2 > len(h)].sum(dtype="u8"))


def block_masks(free: int, blocks: int = BLOCKS, differ: int = MAX_BITS) -> list[int]:
    """The unions of blocks - differ of the blocks into which the bits of free are cut."""
    bits = [k for k in range(64) if free >> k & 1]
    cut = [sum(1 << k for k in bits[len(bits) * i // blocks : len(bits) * (i + 1) // blocks]) for i in range(blocks)]
    return [sum(some) for some in combinations(cut, blocks - differ)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning_links(nodes: np.ndarray, most: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links that connect what Hamming distances up to most connect."""
    links, rest = [], nodes
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= most
            if near.any():
                found, rest = rest[near], rest[~near]
                links += [(x, y) for y in found]
                front.extend(found)
    return links


def _linker(bucket: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _link(batches, bucket)

    return link


def _link(batches: Iterator[pa.RecordBatch], bucket: int) -> Iterator[pa.RecordBatch]:
    """Rows (mask, key, fp) sorted by bucket -> links (a, b, false), and (mask, fp, true) for each node of a bucket that is too large."""

    def rows(a: np.ndarray, b: np.ndarray, over: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), over))], names=["a", "b", "over"])

    def whole(fp: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        few = np.repeat(sizes <= SMALL, sizes)
        owner = np.repeat(starts, sizes)
        for lag in range(1, min(SMALL, len(fp))):
            hit = (owner[lag:] == owner[:-lag]) & few[lag:] & (np.bitwise_count((fp[lag:] ^ fp[:-lag]).view("u8")) <= MAX_BITS)
            if hit.any():
                yield rows(fp[lag:][hit], fp[:-lag][hit], False)
        for at, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
            if links := spanning_links(fp[at : at + n].view("u8")):
                yield rows(*np.array(links, "u8").view("i8").reshape(-1, 2).T.copy(), False)

    kept = np.zeros((3, 0), "i8")
    overfull = None  # the bucket whose nodes are being passed on
    for batch in batches:
        data = np.concatenate([kept, np.stack([batch.column(i).to_numpy() for i in range(3)])], 1)
        if overfull is not None:
            same = (data[0] == overfull[0]) & (data[1] == overfull[1])
            if same.any():
                yield rows(data[0][same], data[2][same], True)
                data = data[:, ~same]
            if not data.shape[1]:
                kept = data
                continue
            overfull = None
        change = np.flatnonzero((data[0, 1:] != data[0, :-1]) | (data[1, 1:] != data[1, :-1])) + 1
        starts = np.concatenate([[0], change]) if data.shape[1] else change
        ends = np.append(starts[1:], data.shape[1])
        full = (ends - starts > bucket) & (64 - np.bitwise_count(data[0, starts].view("u8")) > LAST_BITS)
        for k in np.flatnonzero(full).tolist():
            at, end = int(starts[k]), int(ends[k])
            yield rows(data[0, at:end], data[2, at:end], True)
            if k + 1 == len(starts):
                overfull = (data[0, at], data[1, at])
        last = int(starts[-1]) if len(starts) else 0
        sizes = np.diff(starts)
        fit = ~full[:-1]
        if fit.any():
            yield from whole(data[2, :last], starts[:-1][fit], sizes[fit]) if fit.all() else _some(whole, data[2], starts[:-1][fit], sizes[fit])
        kept = data[:, data.shape[1] :] if overfull is not None else data[:, last:]
    if kept.shape[1] > 1:
        yield from whole(kept[2], np.zeros(1, "i8"), np.array([kept.shape[1]]))


def _some(whole, fp: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(sizes)
    yield from whole(np.concatenate([fp[a : a + n] for a, n in zip(starts, sizes, strict=True)]), ends - sizes, sizes)


def _narrower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mask, fp) of overfull buckets -> (mask, key, fp) of the buckets within."""
    for batch in batches:
        mask, fp = (batch.column(i).to_numpy() for i in range(2))
        for outer in np.unique(mask):
            own = fp[mask == outer]
            for inner in block_masks(~int(outer) & (1 << 64) - 1):
                m = np.int64(_signed(int(outer) & (1 << 64) - 1 | inner))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), m)), pa.array(own & m), pa.array(own)], names=["mask", "key", "fp"])


def near_links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """From distinct fingerprints (fp long), links (u, v) that connect all that Hamming distances up to MAX_BITS connect."""
    masks = F.array(*[F.lit(_signed(m)).cast("bigint") for m in block_masks((1 << 64) - 1)])
    keyed = nodes.select("fp", F.explode(masks).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    links = None
    while True:
        found = stored(keyed.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(giving_back(_linker(bucket)), "a bigint, b bigint, over boolean"), "links")
        own = found.where(~F.col("over")).select(F.col("a").alias("u"), F.col("b").alias("v"))
        links = own if links is None else links.union(own)
        over = found.where("over").select("a", "b")
        if over.isEmpty():
            return links
        keyed = over.mapInArrow(_narrower, "mask bigint, key bigint, fp bigint")


def fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fp", words: int = WORDS) -> DataFrame:
    """docs with a 64-bit fingerprint as a long."""

    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, words) for t in texts.cast(pa.binary()).to_pylist()], "u8").view("i8"))

    return docs.withColumn(name, of(col(text_col).cast("string")))


def _labelled(marked: DataFrame) -> DataFrame:
    """From a stored table with fp and id, a row for each fp: fp, root (one fp of its component) and component_id."""
    nodes = stored(marked.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    stars = star_forest(near_links(nodes.select("fp")))
    rooted = nodes.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = stored(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "roots")
    return stored(rooted.join(least, "root").select("fp", "root", "component_id"), "labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per row of docs: its id, fingerprint (16 lowercase hex digits) and component_id, the smallest id reachable.

    Null and wordless texts have fingerprint zero and link like any other. Rows with the same id and text come back as often as they
    are there. A null id is never the smallest unless its whole component has none. An empty table gives an empty table.
    """
    plain = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    marked = stored(fingerprints(plain, words=words).select("id", "fp"), "fingerprints")
    return marked.join(_labelled(marked).drop("root"), "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """docs with one row of each component: that with the smallest id, and of several that have it the one whose text has the smallest
    hash; of rows equal in id and text one stays. Where rows repeat an id with unlike texts, each component keeps its own. Rows without
    an id have no say in which stays and all stay. Null and wordless texts are one component. An empty table gives an empty table.

    Which rows stay is found from ids and hashes, and looked up by them; texts move again only where rows repeat.
    """
    head, text_hash, times, nth = fresh(docs, "head", "text_hash", "times", "nth")
    plain = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    marked = stored(fingerprints(plain, words=words).select("id", "text_hash", "fp"), "fingerprints")
    own = marked.join(_labelled(marked), "fp").where(F.col("id") == F.col("component_id"))
    heads = own.groupBy("root", "id").agg(F.min("text_hash").alias("least"), F.count("*").alias("n"))
    heads = heads.select(F.col("id").alias(head), F.col("least").alias(text_hash), (F.col("n") > 1).alias(times))
    heads = stored(heads.groupBy(head, text_hash).agg(F.max(times).alias(times)), "heads")
    keyed = docs.join(heads, (col(id_col) == F.col(head)) & (F.xxhash64(col(text_col).cast("string")) == F.col(text_hash)))
    alone = keyed.where(~F.col(times))
    by = Window.partitionBy(head, text_hash).orderBy(*[col(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    first = keyed.where(F.col(times)).withColumn(nth, F.row_number().over(by)).where(F.col(nth) == 1)
    columns = [col(c) for c in docs.columns]
    return alone.select(*columns).unionByName(first.select(*columns)).unionByName(docs.where(col(id_col).isNull()))

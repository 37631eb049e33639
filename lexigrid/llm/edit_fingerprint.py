"""Document fingerprints: randomised edit embedding, then bit-sampled bands and verification.

The embedding (Chakraborty, Goldenberg and Koucky, 2016) walks over a text: at step j it writes the character under the pointer and
moves the pointer on by 0 or 1, a random bit that all texts share for (j, character), until it leaves the text. Two walks that are apart
by d characters meet again after some d * d steps, so a small edit distance gives a small Hamming distance. A text is walked once from
its beginning to its end, however long; of a walk only the steps that it stays at each character are computed, a byte each.

A fingerprint has REGISTERS bytes. Register r hashes one position of the embedding with what stands there. The position is the one
within the walk with the smallest random key of r: these keys' successive minima are the same for all texts, so texts whose walks end
at nearly the same step look at the same positions, and every position of a whole text is as likely as any other. The share of equal
registers estimates the share of equal positions. An empty text has zeros only, which no other register has.

ASCII characters have classes of their own; all other code points share 127 classes by a hash, so two such characters are taken for
the same with a probability of 1 in 127, and texts in other scripts look a little more alike than they are.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ._base import col, giving_back, stored
from ._components import star_forest

REGISTERS = 128
SEED = 42
LIKE = 0.8
#: Bands for candidates, and the registers of which each samples all bits: likeness 0.8 meets in a band with a probability of 0.991.
#: With the band's number, a band's key is just 8 bytes.
BANDS, BAND_REGISTERS = 20, 7
#: Nodes of a bucket that are compared in one group, about.
BUCKET = 8192
#: Buckets up to this size are compared all at once, larger ones node by node.
SMALL = 8
#: Code points of a text that are looked at together; and of each text when many are walked side by side, which FEW are not.
STRETCH, STRIP, FEW = 1 << 16, 256, 32
#: Rows of a part of the order of all documents, about, and parts at most.
ROWS_PER_PART, MOST_PARTS = 256, 1 << 16
#: Bytes of the texts that a worker walks side by side, about.
TOGETHER = 16 << 20
#: Random steps before the table repeats, and the characters' classes, the last of which stands for the end of a text.
PERIOD = 4096
CLASSES = 256


@lru_cache(1)
def _moves() -> np.ndarray:
    moves = np.random.default_rng([SEED, 1]).integers(0, 2, (PERIOD, CLASSES), "u1").astype("i4")
    moves[:, CLASSES - 1] = 0
    return moves


@lru_cache(32)
def _records(limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Per register the positions below limit at which its key is smaller than at all before, in order, and where each register begins.
    Gaps between successive minima are geometric, so they are drawn outright."""
    registers, positions = [], []
    for r in range(REGISTERS):
        rng, at, key = np.random.default_rng([SEED, 2, r]), 0, 1.0
        while at < limit:
            registers.append(r)
            positions.append(at)
            key *= 1.0 - rng.random()
            at += int(rng.geometric(max(key, 1e-15)))
    return np.array(positions), np.searchsorted(registers, np.arange(REGISTERS))


@lru_cache(1)
def _stays() -> np.ndarray:
    """By class and step (modulo PERIOD), the steps from the one that writes a character to the one that writes the next."""
    moves = _moves()
    out = np.zeros((CLASSES, PERIOD), "u1")
    for c in range(CLASSES - 1):
        on = np.flatnonzero(moves[:, c])
        on = np.append(on, on[0] + PERIOD)
        steps = np.arange(PERIOD)
        out[c] = on[np.searchsorted(on, steps)] - steps + 1
    return out


@lru_cache(1)
def _stays_by_class() -> list[bytes]:
    return [row.tobytes() for row in _stays()]


def stays(points: list[np.ndarray], starts: list[int] | None = None) -> list[np.ndarray]:
    """For each text (classes of code points) how many steps its walk, from this step on, stays at each character. Texts are walked side
    by side, character by character; the few that are longer than all others one by one."""
    order = sorted(range(len(points)), key=lambda k: -len(points[k]))
    texts, lengths = [points[k] for k in order], [-len(points[k]) for k in order]
    now = np.array([starts[k] if starts else 0 for k in order], "i8")
    out = [np.empty(len(t), "u1") for t in texts]
    flat, last, at = _stays().ravel(), PERIOD - 1, 0
    while (active := bisect_left(lengths, -at)) >= FEW:
        block = np.zeros((STRIP, active), "i8")
        for k in range(active):
            some = texts[k][at : at + STRIP]
            block[: len(some), k] = some
        block *= PERIOD
        own, place, steps = now[:active], np.empty(active, "i8"), np.empty((STRIP, active), "u1")
        for k in range(min(STRIP, -lengths[0] - at)):
            np.bitwise_and(own, last, out=place)
            place += block[k]
            np.take(flat, place, out=steps[k], mode="clip")
            own += steps[k]
        for k in range(active):
            some = out[k][at : at + STRIP]
            some[:] = steps[: len(some), k]
        at += STRIP
    rows = _stays_by_class()
    for k in range(active):
        j = int(now[k])
        for begin in range(at, len(texts[k]), STRETCH):
            first = j
            left = [j := j + rows[c][j & last] for c in texts[k][begin : begin + STRETCH].tobytes()]
            out[k][begin : begin + STRETCH] = np.diff(left, prepend=first)
    done = [np.zeros(0, "u1")] * len(points)
    for k, own in zip(order, out, strict=True):
        done[k] = own
    return done


class Walk:
    """The embedding of a text (classes of code points), from how long its walk stays at each."""

    def __init__(self, points: np.ndarray, stays: np.ndarray):
        self.points, self.stays = points, stays
        self.ends = np.cumsum(np.add.reduceat(stays, np.arange(0, len(stays), STRETCH), dtype="i8")) if len(stays) else np.zeros(0, "i8")
        self.steps = int(self.ends[-1]) if len(stays) else 0

    def at(self, positions: np.ndarray) -> np.ndarray:
        """What stands at these positions, in any order; all are below steps."""
        order = np.argsort(positions, kind="stable")
        ordered, out, done, before = positions[order], np.zeros(len(positions), "u1"), 0, 0
        for k, end in enumerate(self.ends.tolist()):
            upto = int(np.searchsorted(ordered, end))
            if upto > done:
                left = before + np.cumsum(self.stays[k * STRETCH : (k + 1) * STRETCH], dtype="i8")
                out[order[done:upto]] = self.points[k * STRETCH + np.searchsorted(left, ordered[done:upto], "right")]
            done, before = upto, end
        return out

    def fingerprint(self) -> bytes:
        if not self.steps:
            return bytes(REGISTERS)
        positions, first = _records(1 << (self.steps - 1).bit_length())
        at = positions[first + np.add.reduceat(positions < self.steps, first) - 1]
        mixed = (at.astype("u8") * np.uint64(0x9E3779B97F4A7C15)) ^ ((self.at(at).astype("u8") + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((mixed >> np.uint64(33)) % np.uint64(255) + np.uint64(1)).astype("u1").tobytes()


def walks(texts: list[str | None]) -> list[Walk]:
    points = [classes(text) for text in texts]
    return [Walk(p, s) for p, s in zip(points, stays(points), strict=True)]


def classes(text: str | None) -> np.ndarray:
    """The class of each code point; ASCII has classes of its own."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    far = (points * np.uint32(0x9E3779B1) >> np.uint32(8)) % np.uint32(CLASSES - 1 - 128) + np.uint32(128)
    return np.where(points < 128, points, far).astype("u1")


def fingerprints_of(texts: list[str | None]) -> list[bytes]:
    return [walk.fingerprint() for walk in walks(texts)]


def likeness(a: bytes, b: bytes) -> float:
    """The share of equal registers, 0 to 1."""
    return float((np.frombuffer(a, "u1") == np.frombuffer(b, "u1")).mean())


def gathered(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[list[list]]:
    """The columns of the batches as lists, many batches together: up to TOGETHER bytes of the column of texts."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(text).nbytes
        if size > TOGETHER:
            yield [[x for b in held for x in b.column(k).to_pylist()] for k in range(batch.num_columns)]
            held, size = [], 0
    if held:
        yield [[x for b in held for x in b.column(k).to_pylist()] for k in range(held[0].num_columns)]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint (binary) of each whole text; a null text is an empty one."""
    plain = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    kind = T.StructType([plain.schema["id"], T.StructField("fp", T.BinaryType())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in gathered(batches, 1):
            yield pa.RecordBatch.from_arrays([pa.array(ids, to_arrow_type(kind[0].dataType)), pa.array(fingerprints_of(texts), pa.binary())], names=["id", "fp"])

    return plain.mapInArrow(giving_back(mark), kind)


def sampled_registers() -> np.ndarray:
    """For each band the registers whose bits it samples."""
    rng = np.random.default_rng([SEED, 3])
    return np.stack([rng.permutation(REGISTERS)[:BAND_REGISTERS] for _ in range(BANDS)])


def _matrix(fps: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(fps.to_pylist()), "u1").reshape(-1, REGISTERS)


def _spanning(fps: np.ndarray, like: float) -> list[tuple[int, int]]:
    """Links between rows that connect what likenesses of at least like connect."""
    links, rest = [], np.arange(len(fps))
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = (fps[rest] == fps[x]).mean(1) >= like
            if near.any():
                links += [(x, y) for y in rest[near]]
                front.extend(rest[near])
                rest = rest[~near]
    return links


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, fp) -> (key, node) for each band; the key is the registers sampled and the band's number."""
    for batch in batches:
        fps = _matrix(batch.column(1))
        for band, sampled in enumerate(sampled_registers()):
            keys = np.concatenate([fps[:, sampled], np.full((len(fps), 1), band, "u1")], 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(keys).view("<i8").ravel()), batch.column(0)], names=["key", "node"])


def _verifier(like: float):
    """Rows (key, chunk, node, fp) sorted by key and chunk -> links (u, v) that connect what likenesses within a chunk of a bucket do."""

    def links(nodes: np.ndarray, fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        u, v = [], []
        owner, few = np.repeat(starts, sizes), np.repeat(sizes <= SMALL, sizes)
        for lag in range(1, min(SMALL, len(nodes))):
            at = np.flatnonzero((owner[lag:] == owner[:-lag]) & few[lag:])
            at = at[(fps[at + lag] == fps[at]).mean(1) >= like]
            u.append(nodes[at + lag])
            v.append(nodes[at])
        for at, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
            own = np.array(_spanning(fps[at : at + n], like), "i8").reshape(-1, 2)
            u.append(nodes[at + own[:, 0]])
            v.append(nodes[at + own[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, "i8"), *x])) for x in (u, v)], names=["u", "v"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, nodes, fps = np.zeros((0, 2), "i8"), np.zeros(0, "i8"), np.zeros((0, REGISTERS), "u1")
        for batch in batches:
            where = np.concatenate([where, np.stack([batch.column(i).to_numpy() for i in range(2)], 1)])
            nodes, fps = np.concatenate([nodes, batch.column(2).to_numpy()]), np.concatenate([fps, _matrix(batch.column(3))])
            starts = np.concatenate([[0], np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1])
            last = int(starts[-1]) if len(where) else 0  # the last one may go on
            if last:
                yield links(nodes[:last], fps[:last], starts[:-1], np.diff(starts))
            where, nodes, fps = where[last:], nodes[last:], fps[last:]
        if len(where) > 1:
            yield links(nodes, fps, np.zeros(1, "i8"), np.array([len(nodes)]))

    return verify


def _across(like: float):
    """Of a group of rows (label, minor, node, fp), links of the minor rows to one near row of each other label."""

    def link(group: pa.Table) -> pa.Table:
        labels, minor, nodes = (group.column(c).to_numpy() for c in ("label", "minor", "node"))
        fps, u, v = _matrix(group.column("fp")), [], []
        for x in np.flatnonzero(minor):
            near = np.flatnonzero(((fps == fps[x]).mean(1) >= like) & (labels != labels[x]))
            near = near[np.unique(labels[near], return_index=True)[1]]
            u += [nodes[x]] * len(near)
            v += nodes[near].tolist()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return link


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    stars = star_forest(links).select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))


def classes_of(marked: DataFrame, like: float = LIKE) -> DataFrame:
    """From rows (id, fp), a row for each fingerprint: fp, n (its rows), low (the smallest id among them) and component_id, the smallest
    id that links of at least this likeness reach.

    Equal fingerprints are one node first. Candidates agree on all sampled bits of a band. Fingerprints go only to buckets that two
    nodes are in, and a bucket yields links that connect what all its links do. Of a bucket of over BUCKET nodes, chunks are compared
    within first; then, as many near copies are in one component by now, its nodes of other components than the most frequent one are
    compared with all of its chunks. So no group is large and no link lost, and a hot bucket of copies costs no all-pairs work.
    """
    nodes = stored(marked.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()), "edit-nodes")
    keyed = nodes.select("node", "fp").mapInArrow(_banded, "key bigint, node bigint")
    sizes = stored(keyed.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > 1), "edit-sizes")
    met = keyed.join(sizes, "key").join(nodes.select("node", "fp"), "node")
    met = stored(met.select("key", F.ceil(F.col("size") / BUCKET).alias("chunks"), "node", "fp"), "edit-met")
    chunk = F.pmod(F.xxhash64("node", "key"), F.col("chunks"))
    dealt = met.select("key", chunk.alias("chunk"), "node", "fp").repartition("key", "chunk").sortWithinPartitions("key", "chunk")
    links = stored(dealt.mapInArrow(_verifier(like), "u bigint, v bigint"), "edit-links")
    hot = met.where(F.col("chunks") > 1)
    if not hot.isEmpty():
        labelled = stored(hot.join(_labelled(nodes.select("node"), links), "node").withColumnRenamed("root", "label"), "edit-hot")
        counts = labelled.groupBy("key", "label").agg(F.count("*").alias("held"))
        major = counts.groupBy("key").agg(F.max_by("label", F.struct("held", "label")).alias("major"), F.sum("held").alias("all"), F.max("held").alias("most"))
        major = stored(major.where(F.col("all") > F.col("most")).select("key", "major", F.ceil((F.col("all") - F.col("most")) / BUCKET).alias("others")), "edit-major")
        both = labelled.join(major, "key").withColumn("minor", F.col("label") != F.col("major"))
        every = both.select("*", chunk.alias("a"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("others") - 1)).alias("b")).withColumn("minor", F.lit(False))
        some = both.where("minor").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("a"), F.pmod(F.xxhash64("key", "node"), F.col("others")).alias("b"))
        pairs = every.unionByName(some).select("key", "a", "b", "label", "minor", "node", "fp")
        links = links.union(stored(pairs.groupBy("key", "a", "b").applyInArrow(_across(like), "u bigint, v bigint"), "edit-links"))
    rooted = _labelled(nodes, links)
    least = stored(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "edit-roots")
    return stored(rooted.join(least, "root").select("fp", "n", "low", "component_id"), "edit-labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: float = LIKE) -> DataFrame:
    """One row per row of docs: its id, fingerprint (hex) and component_id, the smallest id that links of at least this likeness reach.

    Null texts are empty. Rows that repeat an id and text come back as often as they are there; a null id is never the smallest unless
    its whole component has none. An empty table gives an empty table. Other columns, whatever their names, are not looked at.
    """
    marked = stored(fingerprint(docs, id_col, text_col), "edit-fingerprints")
    return marked.join(classes_of(marked, like).select("fp", "component_id"), "fp").select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def edited(text: str, after: str) -> str:
    """text with its last third (rounded down) replaced by as many of the first code points of after (or all)."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def _edited_walks(pairs: list[tuple[Walk, Walk]]) -> list[Walk]:
    """The walks of edited texts, from those of the texts and the next ones: up to the place of the edit they are the texts' own."""
    sizes = [len(a.points) // 3 for a, _ in pairs]
    kept = [(a.points[: len(a.points) - n], a.stays[: len(a.points) - n]) for (a, _), n in zip(pairs, sizes, strict=True)]
    tails = [b.points[:n] for (_, b), n in zip(pairs, sizes, strict=True)]
    more = stays(tails, [int(own.sum(dtype="i8")) for _, own in kept])
    return [Walk(np.concatenate([p, tail]), np.concatenate([own, on])) for (p, own), tail, on in zip(kept, tails, more, strict=True)]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, tail, id, text) in order -> what each row that is no tail is beside the next."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def rows(pairs: list[tuple[tuple, tuple]]) -> pa.RecordBatch:
        out = []
        for (a, b), walk in zip(pairs, _edited_walks([(a[4], b[4]) for a, b in pairs]), strict=True):
            fp, digest = walk.fingerprint(), hashlib.sha256(edited(a[3], b[3]).encode("utf-8", "surrogatepass")).digest()
            out.append((a[2], len(a[3]), digest, a[5], fp, likeness(a[5], fp), likeness(a[5], b[5])))
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 3, *[pa.float64()] * 2]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    first = before = None
    for part, tail, ids, texts in gathered(batches, 3):
        texts = [t or "" for t in texts]
        own, pairs = walks(texts), []
        for row in zip(part, tail, ids, texts, own, [walk.fingerprint() for walk in own], strict=True):
            if before is not None and before[0] != row[0]:
                if not before[1]:
                    pairs.append((before, first))  # a part without a tail is the only one
                before = None
            if before is None:
                first = row
            elif not before[1]:
                pairs.append((before, row))
            before = row
        yield rows(pairs)
    if before is not None and not before[1]:
        yield rows([(before, first)])


def _compared(docs: DataFrame, id_col: str, text_col: str, rows_per_part: int, most_parts: int) -> DataFrame:
    """edit_likeness with the digest and the fingerprints as binary, which is half as long where they move."""
    plain = docs.select(col(id_col).cast("bigint").alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    every = max(rows_per_part, -(-docs.count() // most_parts))
    place = F.struct(F.col("id").isNull().alias("none"), F.coalesce(F.bitwise_not("id"), F.lit(0).cast("bigint")).alias("down"), "h")
    cuts = F.collect_set(F.when(F.pmod(F.xxhash64("id", "h"), F.lit(every)) == 0, place))
    found = plain.agg(cuts.alias("cuts"), F.min(place).alias("top")).first()
    top, cuts = found["top"] and tuple(found["top"]), sorted(map(tuple, found["cuts"]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Part p holds the rows that p cuts are not behind. A cut is the first of its part."""
        known = set(cuts)
        for batch in batches:
            keys = [(i is None, 0 if i is None else ~i, h) for i, h in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            part = [bisect_right(cuts, key) for key in keys]
            at_cut = [k for k, key in enumerate(keys) if key in known and part[k]]
            wrap = [k for k, key in enumerate(keys) if cuts and key == top]
            rows = pa.array([*range(len(keys)), *at_cut, *wrap])
            parts = [*part, *(part[k] - 1 for k in at_cut), *([len(cuts)] * len(wrap))]
            tails = [k >= len(keys) for k in range(len(rows))]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(tails), *batch.take(rows).columns], names=["part", "tail", "id", "text", "h"])

    dealt = plain.select("id", "text", "h").mapInArrow(deal, "part bigint, tail boolean, id bigint, text string, h bigint")
    ordered = dealt.repartition("part").sortWithinPartitions("part", "tail", F.desc_nulls_last("id"), "h", "text").drop("h")
    return ordered.mapInArrow(giving_back(_compare), "doc_id bigint, n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double")


def _in_hex(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.lower(F.hex(c)).alias(c) if kind == "binary" else F.col(c) for c, kind in rows.dtypes])


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_part: int = ROWS_PER_PART, most_parts: int = MOST_PARTS) -> DataFrame:
    """For each document: doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint (hex), near_edited, near_next; the edited
    text takes the place of its last third from the next document, in descending order of id (after the last: the first).

    The order is by id, then by a hash of the text, then by the text; ids must be integers, null ids come last. Some places in it, chosen
    by a hash of id and text, at most about most_parts, cut it into parts, so an id that many rows repeat is many parts too; a row that
    begins a part also ends the one before it. Whole texts move once, and no order of all rows is needed. Rows that are equal in id and
    text stream through one task. A null text is empty. A single document is its own next. An empty table gives an empty table.
    """
    return _in_hex(_compared(docs, id_col, text_col, rows_per_part, most_parts))


def fingerprints_and_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: float = LIKE) -> DataFrame:
    """edit_likeness with component_id: the smallest id that links of at least this likeness reach, as near_duplicates has it."""
    classes = classes_of(fingerprint(docs.select(col(id_col).cast("bigint").alias("id"), col(text_col).alias("text")), "id", "text"), like)
    # a fingerprint of one row that leads its component needs no looking up
    told = stored(classes.where((F.col("n") > 1) | ~F.col("component_id").eqNullSafe(F.col("low"))).select("fp", "component_id"), "edit-told")
    rows = _compared(docs, id_col, text_col, ROWS_PER_PART, MOST_PARTS).join(told, F.col("fingerprint") == F.col("fp"), "left")
    return _in_hex(rows.withColumn("component_id", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))).drop("fp"))

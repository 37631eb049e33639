"""Mixing sources to target weights: exact block quotas, split among output shards by a multivariate-hypergeometric tree.

The documents of a source fall into blocks by a hash of their row, about docs_per_block each, so a hot source is many blocks and no
document needs a rank. A source's target is some whole passes over its blocks and a part of one more; a pass takes the blocks in a
permuted order, the part ends within one block, where documents are taken in hash order as long as they fit, and one that does not if
that comes nearer. That gives each source an exact number of block draws, its quota.

A binary tree over the shards divides these quotas: each node draws, seeded by its own place, how many blocks of each source go left.
What a leaf gets are disjoint runs of each source's permuted blocks: these runs are the draws that the mix takes, and a draw that no
shard has is not taken. Within a shard, documents are put in hash order. Sources are dealt into groups of GROUP; the tree draws for the
groups first, then for the sources within each group, which has the same distribution. So a task holds a number for each group, or for
each source of one group, and the tree's nodes stream past it.

The driver holds a number for each group of sources, and a few for each weight. Blocks and sources are ranked by range shuffles. There
may be fewer than 10**9 draws (numpy's generator raises beyond that): take larger blocks then.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import col, fresh, stored

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
SEED = 42
DOCS_PER_BLOCK = 64
#: Words of a shard, about; and shards for a task that walks down the tree, about.
SHARD_SIZE = 250_000
SHARDS_PER_TASK = 1 << 16
#: Sources that a task divides at once.
GROUP = 4096


def words(text_col: str = "text") -> Column:
    """The number of [^\\x20\\x09-\\x0D]+ in a text, 0 for null: on bytes, split() splits at just those."""

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([len((t or b"").split()) for t in texts.cast(pa.binary()).to_pylist()], pa.int64())

    return count(col(text_col).cast("string"))


def water_level(total: float, counts: list[int], weights: tuple[float, ...], cap: float, capped: Callable[[float], list[tuple[int, int]]]) -> float:
    """The level t at which the sources' min(cap * size, weight * t) sum up to total: what is above a cap goes to the others by weight,
    until none is above. counts: sources of each weight. capped(t): for each weight, how many sources have cap * size < weight * t, and
    the sum of their sizes. Each round caps more sources, and few rounds do."""
    over, t = [(0, 0)] * len(counts), 0.0
    while True:
        open_ = sum(w * (n - m) for w, n, (m, _) in zip(weights, counts, over, strict=True))
        if open_ <= 0:
            return float("inf") if any(counts) else 0.0
        t = max(t, (total - cap * sum(size for _, size in over)) / open_)
        now = capped(t)
        if now == over:
            return t
        over = now


def _divided(n: np.ndarray, goes: int, *place: int) -> np.ndarray:
    return np.random.default_rng(place).multivariate_hypergeometric(n, goes, method="marginals")


def group_splits(quotas: np.ndarray, shards: int, first: int, last: int, seed: int = SEED) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The tree's inner nodes over shards from first to before last, each before its children and the left before the right one: (low,
    high, groups that have draws there, how many of each go left). All shards get as many draws, but for one."""
    total, some = int(quotas.sum()), np.flatnonzero(quotas)
    stack = [(0, shards, some, quotas[some])]
    while stack:
        low, high, groups, n = stack.pop()
        if high - low == 1 or not len(groups) or low >= last or high <= first:
            continue
        middle = (low + high) // 2
        left = _divided(n, total * middle // shards - total * low // shards, seed, low, high)
        yield low, high, groups, left
        right = n - left
        stack += [(middle, high, groups[right > 0], right[right > 0]), (low, middle, groups[left > 0], left[left > 0])]


def source_runs(quotas: np.ndarray, splits: Iterator[tuple[int, int, int]], shards: int, first: int, last: int, *place: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each shard from first to before last that gets some of these sources: (shard, sources, the first of each one's draws, how
    many). splits: (low, high, how many draws of all these sources go left), in the order of group_splits."""
    some = np.flatnonzero(quotas)
    stack = [(0, shards, some, np.zeros(len(some), "i8"), quotas[some])]
    while stack:
        low, high, sources, begin, n = stack.pop()
        if not len(sources) or low >= last or high <= first:
            continue
        if high - low == 1:
            yield low, sources, begin, n
            continue
        found = next(splits)
        if found[:2] != (low, high):
            raise ValueError(f"the tree's nodes are out of order: {found} at {(low, high)}")
        middle, left = (low + high) // 2, _divided(n, found[2], *place, low, high)
        right = n - left
        stack += [(middle, high, sources[right > 0], (begin + left)[right > 0], right[right > 0]), (low, middle, sources[left > 0], begin[left > 0], left[left > 0])]


def _runs(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """From (k, quota), a row for each source and shard that gets some of its draws: (shard, k, first, last)."""
    spark = quotas.sparkSession
    by_group = {r["g"]: r["n"] for r in quotas.groupBy(F.floor(F.col("k") / GROUP).alias("g")).agg(F.sum("quota").alias("n")).collect()}  # a row a group
    n_groups = max(by_group, default=0) + 1
    totals = np.array([by_group.get(g, 0) for g in range(n_groups)], "i8")
    ranges = max(1, -(-shards // (SHARDS_PER_TASK * n_groups)))
    bounds = [shards * r // ranges for r in range(ranges + 1)]
    names = ["r", "g", "kind", "a", "b", "n"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.column(0).to_pylist():
                held, size = [], 0
                for low, high, groups, left in group_splits(totals, shards, bounds[r], bounds[r + 1], seed):
                    held.append((low, high, groups, left))
                    size += len(groups)
                    if size > 50_000:
                        yield rows(r, held)
                        held, size = [], 0
                yield rows(r, held)

    def rows(r: int, held: list[tuple]) -> pa.RecordBatch:
        sizes = [len(g) for _, _, g, _ in held]
        low, high = (np.repeat(np.array([h[i] for h in held], "i8"), sizes) for i in range(2))
        groups, left = (np.concatenate([np.zeros(0, "i8"), *(h[i] for h in held)]) for i in (2, 3))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(low), r), groups, np.ones(len(low), "i8"), low, -high, left)], names=names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        ahead = next(stream, None)
        out: list[tuple] = []

        def run(kind: int) -> Iterator[tuple]:
            """The coming rows of this group and kind."""
            nonlocal ahead
            while ahead is not None and ahead[:3] == (r, g, kind):
                row = ahead[3:]
                ahead = next(stream, None)
                yield row

        def made() -> pa.RecordBatch:
            columns = [np.concatenate([np.zeros(0, "i8"), *c]) for c in zip(*out, strict=True)] or [np.zeros(0, "i8")] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shard", "k", "first", "last"])

        while ahead is not None:
            r, g = ahead[:2]
            quotas = np.zeros(GROUP, "i8")
            for k, _, n in run(0):
                quotas[k - g * GROUP] = n
            nodes = ((low, -high, left) for low, high, left in run(1))
            for shard, sources, begin, n in source_runs(quotas, nodes, shards, bounds[r], bounds[r + 1], seed, g + 1):
                out.append((np.full(len(sources), shard), sources + g * GROUP, begin, begin + n - 1))
                if len(out) > 10_000:
                    yield made()
            yield made()

    kind = ", ".join(f"{c} bigint" for c in names)
    splits = spark.range(0, ranges, 1, min(ranges, 10_000)).mapInArrow(split, kind)
    own = quotas.where(F.col("quota") > 0).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(ranges - 1).cast("bigint"))).alias("r"), F.floor(F.col("k") / GROUP).alias("g"), F.lit(0).cast("bigint").alias("kind"), F.col("k").alias("a"), F.lit(0).cast("bigint").alias("b"), F.col("quota").alias("n"))
    dealt = splits.unionByName(own).repartition("r", "g").sortWithinPartitions("r", "g", "kind", "a", "b")
    return dealt.mapInArrow(walk, "shard bigint, k bigint, first bigint, last bigint")


def _ranked(rows: DataFrame, by: list[str], order: list[str], size: str, name: str) -> DataFrame:
    """rows with nth (from 0) and upto (the sum of sizes up to and with the row) within by, in this order. One range shuffle deals even a
    hot key over many partitions; each numbers its own rows, and what is before it is a sum over partitions."""
    part, n, total = "_part", "_rows_before", "_size_before"
    dealt = stored(rows.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id()), name)
    own = Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = dealt.groupBy(*by, part).agg(F.count("*").alias(n), F.sum(size).alias(total))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    bases = stored(sums.select(*by, part, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in (n, total)]), name)
    counted = dealt.withColumn("nth", F.count("*").over(own)).withColumn("upto", F.sum(size).over(own)).join(bases, [*by, part])
    return counted.withColumn("nth", F.col("nth") + F.col(n) - 1).withColumn("upto", F.col("upto") + F.col(total)).drop(part, n, total)


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """From (s, size, n), a row a source: those and k (its place by code point, null last) and target."""
    numbered = sources.select("*", F.lit(0).alias("all"), F.col("s").isNull().alias("none"))
    ranked = stored(_ranked(numbered, ["all"], ["none", "s"], "size", "sources").select("s", "size", "n", F.col("nth").alias("k")), "sources")
    nth = F.col("k") % len(weights)

    def sums(rows: DataFrame) -> list[tuple[int, int]]:
        found = {r["w"]: (r["n"], int(r["size"])) for r in rows.groupBy(nth.alias("w")).agg(F.count("*").alias("n"), F.sum(F.col("size").cast("decimal(38, 0)")).alias("size")).collect()}  # a row a weight
        return [found.get(w, (0, 0)) for w in range(len(weights))]

    weight = F.element_at(F.array(*map(F.lit, weights)), (nth + 1).cast("int"))
    every = sums(ranked)
    t = water_level(share * sum(size for _, size in every), [n for n, _ in every], weights, cap, lambda t: sums(ranked.where(F.lit(cap) * F.col("size") < weight * F.lit(t))))
    return ranked.withColumn("target", F.least(F.lit(cap) * F.col("size"), weight * F.lit(t)))


def _fit(rest: str, taken: str, order: str, size_col: str):
    def fit(block: pa.Table) -> pa.Table:
        block = block.sort_by([(order, "ascending")])
        left, flags = float(block.column(rest)[0].as_py()), []
        sizes = block.column(size_col).to_pylist()
        for size in sizes:
            flags.append(size <= left)
            left -= size * flags[-1]
        over = [(abs(left - size), k) for k, (size, flag) in enumerate(zip(sizes, flags, strict=True)) if not flag]
        if over and min(over)[0] < left:  # one more document comes nearer than none
            flags[min(over)[1]] = True
        return block.set_column(block.schema.get_field_index(taken), taken, pa.array(flags))

    return fit


def mix(docs: DataFrame, size_col: str, id_col: str = "doc_id", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED, docs_per_block: int = DOCS_PER_BLOCK, shard_size: int = SHARD_SIZE) -> DataFrame:
    """All rows and columns of docs, and: source_size, target (of the row's source), draws: an array of (pass, shard, place), one for
    each time that the mix takes the row; empty if it does not.

    Sources in code-point order, null last, have the weights, repeating; there may be any number of them. A null source is a source, a
    null size is 0. Rows that repeat an id, or have none, are documents of their own; rows that are equal in all columns share a block. A
    source without words has the target 0. docs is read three times: store it if it is costly. Input columns named source_size, target or
    draws are replaced. An empty table gives an empty table. Rerunning gives the same mix.
    """
    docs = docs.drop("source_size", "target", "draws")
    size, k, block, order, n_blocks, full, rest, src, every, taken = fresh(docs, "size", "k", "block", "order", "blocks", "full", "rest", "src", "all", "taken")
    sized = docs.withColumn(size, F.coalesce(col(size_col).cast("bigint"), F.lit(0).cast("bigint")))
    sources = sized.groupBy(col(source_col).cast("string").alias("s")).agg(F.sum(size).alias("size"), F.count("*").alias("n"))
    known = source_targets(stored(sources, "sources"), weights, share, cap)
    passes = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(0)).cast("bigint")
    blocks_of = F.ceil(F.col("n") / F.lit(docs_per_block)).cast("bigint")
    facts = known.select(F.col("s").alias(src), F.col("k").alias(k), F.col("size").alias("source_size"), "target", blocks_of.alias(n_blocks), passes.alias(full), (F.col("target") - passes * F.col("size")).alias(rest))
    facts = stored(facts, "source-facts")  # its measured size decides whether the joins broadcast it
    marked = sized.join(facts, col(source_col).cast("string").eqNullSafe(F.col(src)))
    whole = [col(f.name) for f in docs.schema.fields if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]
    marked = marked.withColumn(order, F.xxhash64(F.lit(seed + 1), *whole)).withColumn(block, F.pmod(F.xxhash64(F.lit(seed), col(order)), col(n_blocks)))

    blocks = stored(marked.groupBy(F.col(k).alias("k"), F.col(block).alias("block")).agg(F.sum(size).alias("size")), "blocks")
    own = facts.select(F.col(k).alias("k"), F.col(full).alias("full"), F.col(rest).alias("rest"))
    filled = blocks.groupBy("k").agg(F.count("*").alias("filled"))  # empty blocks take no draw
    taking = blocks.join(stored(own.join(filled, "k"), "passes"), "k").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full"))))
    taking = taking.withColumn("h", F.xxhash64(F.lit(seed), F.col("pass"), F.col("k"), F.col("block")))
    ranked = _ranked(taking, ["k", "pass"], ["h", "block"], "size", "passes")
    last = F.col("pass") == F.col("full")
    ranked = ranked.where(~last | (F.col("upto") <= F.col("rest")) | (F.col("upto") - F.col("size") < F.col("rest")))
    partly = last & (F.col("upto") > F.col("rest"))
    left = F.when(partly, F.col("rest") - (F.col("upto") - F.col("size"))).alias("left")
    drawn = stored(ranked.select("k", "block", "pass", (F.col("pass") * F.col("filled") + F.col("nth")).alias("draw"), left), "draws")

    quotas = stored(drawn.groupBy("k").agg(F.count("*").alias("quota")), "quotas")
    total = known.agg(F.sum("target")).first()[0] or 0.0
    shards = max(1, -(-int(total) // shard_size))
    runs = stored(_runs(quotas, shards, seed), "runs")
    places = runs.select("shard", "k", F.explode(F.sequence("first", "last")).alias("draw"))
    by_block = drawn.join(places, ["k", "draw"]).groupBy("k", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard", F.col("left").isNotNull().alias("partly")))).alias("all"), F.max("left").alias("left"))
    by_block = stored(by_block.select(F.col("k").alias(k), F.col("block").alias(block), F.col("all").alias(every), F.col("left").alias(rest)), "by-block")

    joined = marked.drop(rest).join(by_block, [k, block], "left").withColumn(taken, F.lit(False))
    row = F.struct(*[col(c) for c in joined.columns if c != taken]).alias("row")  # Arrow functions take no names with dots
    cut = joined.where(F.col(rest).isNotNull()).select(row, F.col(k).alias("k"), F.col(block).alias("block"), F.col(order).alias("order"), F.col(size).alias("size"), F.col(rest).alias("rest"), F.col(taken).alias("taken"))
    cut = cut.groupBy("k", "block").applyInArrow(_fit("rest", "taken", "order", "size"), T.StructType([T.StructField(f.name, f.dataType) for f in cut.schema.fields]))
    both = joined.where(F.col(rest).isNull()).unionByName(cut.select("row.*", F.col("taken").alias(taken)))
    stay = F.filter(F.coalesce(F.col(every), F.array().cast("array<struct<pass: bigint, shard: bigint, partly: boolean>>")), lambda d: ~d["partly"] | F.col(taken))
    place = F.transform(stay, lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), F.xxhash64(F.lit(seed + 2), d["pass"], d["shard"], F.col(order)).alias("place")))
    return both.select(*[col(c) for c in docs.columns], "source_size", "target", place.alias("draws"))


def mixed_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row for each draw, with its shard; to be written by shard in order of place. Columns of these names are replaced."""
    (draw,) = fresh(mixed, "draw")
    rows = mixed.withColumn(draw, F.explode("draws"))
    return rows.select(*[col(c) for c in mixed.columns if c.lower() not in ("draws", "shard", "place")], F.col(draw)["shard"].alias("shard"), F.col(draw)["place"].alias("place"))


def write_shards(mixed: DataFrame, path: str) -> None:
    """The mix as Parquet, a folder for each shard, rows shuffled within it."""
    mixed_rows(mixed).repartition("shard").sortWithinPartitions("shard", "place").write.partitionBy("shard").parquet(path)

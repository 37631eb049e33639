from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import mixing


def slow_targets(sizes, weights, share=1.5, cap=2.0):
    total, out, open_ = share * sum(sizes), {}, set(range(len(sizes)))
    while open_:
        rest = total - sum(out.values())
        give = {k: rest * weights[k] / sum(weights[j] for j in open_) for k in open_}
        over = {k for k in open_ if give[k] > cap * sizes[k]}
        out.update({k: cap * sizes[k] for k in over} if over else give)
        open_ = open_ - over if over else set()
    return [out[k] for k in range(len(sizes))]


def level(sizes, weights, share=1.5, cap=2.0):
    own = [weights[k % len(weights)] for k in range(len(sizes))]

    def capped(t):
        over = [(k % len(weights), s) for k, (s, w) in enumerate(zip(sizes, own, strict=True)) if cap * s < w * t]
        return [(sum(c == w for c, _ in over), sum(s for c, s in over if c == w)) for w in range(len(weights))]

    counts = [len(range(w, len(sizes), len(weights))) for w in range(len(weights))]
    t = mixing.water_level(share * sum(sizes), counts, weights, cap, capped)
    return [min(cap * s, w * t) for s, w in zip(sizes, own, strict=True)]


def test_targets():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5, 8, 40):
        for _ in range(50):
            sizes = (rng.integers(0, 1000, n) ** rng.integers(1, 4)).tolist()
            weights = [(3.0, 1.0, 2.0)[k % 3] for k in range(n)]
            assert level(sizes, mixing.WEIGHTS) == pytest.approx(slow_targets(sizes, weights))
    assert level([], mixing.WEIGHTS) == [] and level([0, 0], mixing.WEIGHTS) == [0, 0]


def test_source_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(f"host-{k}", int(rng.integers(0, 5000)), 1) for k in range(500)] + [(None, 77, 1), ("é", 5, 1), ("Z", 9, 1)]
    got = mixing.source_targets(spark.createDataFrame(rows, "s string, size long, n long").repartition(7)).orderBy("k").collect()
    names = sorted((r[0] for r in rows), key=lambda s: (s is None, s or ""))
    assert [(r.s, r.k) for r in got] == [(s, k) for k, s in enumerate(names)]
    sizes = dict((r[0], r[1]) for r in rows)
    want = slow_targets([sizes[s] for s in names], [(3.0, 1.0, 2.0)[k % 3] for k in range(len(names))])
    assert [r.target for r in got] == pytest.approx(want)


def test_shards_divide_the_quotas(spark, monkeypatch):
    rng = np.random.default_rng(4)
    for quotas, shards in (([1000, 0, 37, 5], 11), ([3], 7), (rng.integers(0, 4, 300).tolist(), 40), ([5, 9], 1)):
        df = spark.createDataFrame([(k, q) for k, q in enumerate(quotas) if q], "k long, quota long")
        seen = []
        for group, per_task in ((4096, 1 << 16), (16, 2), (2, 3)):
            monkeypatch.setattr(mixing, "GROUP", group)
            monkeypatch.setattr(mixing, "SHARDS_PER_TASK", per_task)
            rows = [tuple(r) for r in mixing._runs(df, shards, 42).collect()]
            for k, quota in enumerate(quotas):
                assert sorted(x for _, s, first, last in rows if s == k for x in range(first, last + 1)) == list(range(quota))
            sizes = [sum(last - first + 1 for s, _, first, last in rows if s == shard) for shard in range(shards)]
            assert sum(sizes) == sum(quotas) and max(sizes) - min(sizes) <= 1
            seen.append(sorted(rows))
        assert seen[1] == sorted(tuple(r) for r in again(spark, monkeypatch, df, shards, 16, 1 << 16))  # however the tree is dealt to tasks


def again(spark, monkeypatch, df, shards, group, per_task):
    monkeypatch.setattr(mixing, "GROUP", group)
    monkeypatch.setattr(mixing, "SHARDS_PER_TASK", per_task)
    return mixing._runs(df, shards, 42).collect()


def test_splits_are_hypergeometric():
    """Mean and variance of what the first of two shards gets, by groups of one source and by one group."""
    quotas, n = np.array([60, 30, 10]), 4000
    for by_group in (True, False):
        got = []
        for seed in range(n):
            if by_group:
                (_, _, _, left), = mixing.group_splits(quotas, 2, 0, 2, seed)
                got.append(left)
            else:
                runs = {shard: dict(zip(s.tolist(), m.tolist(), strict=True)) for shard, s, _, m in mixing.source_runs(quotas, iter([(0, 2, 50)]), 2, 0, 2, seed, 1)}
                got.append([runs[0].get(k, 0) for k in range(3)])
        got = np.array(got)
        assert got.mean(0) == pytest.approx(quotas / 2, rel=0.02)
        assert got.var(0) == pytest.approx(50 * quotas / 100 * (1 - quotas / 100) * 50 / 99, rel=0.1)


def test_words(odd):
    got = odd.select("text", mixing.words().alias("n")).collect()
    assert all(r.n == len([w for w in __import__("re").split("[\x20\x09-\x0d]+", r.text or "") if w]) for r in got)


def targets_of(rows):
    return {r.source: r.target for r in rows}.values()


def test_mix(small, odd, empty):
    for docs in (small, odd):
        sized = docs.withColumn("own_size", mixing.words()).cache()
        mixed = mixing.mix(sized, "own_size", docs_per_block=4, shard_size=5000)
        assert set(mixed.columns) == set(sized.columns) | {"source_size", "target", "draws"}
        rows = mixed.collect()
        assert len(rows) == docs.count()
        by = defaultdict(list)
        shards = {d["shard"] for r in rows for d in r.draws}
        assert 1 < len(shards) and shards <= set(range(-(-int(sum(targets_of(rows))) // 5000)))
        for r in rows:
            by[r.source].append(r)
            assert len(r.draws) <= 2 and len({d["pass"] for d in r.draws}) == len(r.draws)
        names = sorted(by, key=lambda s: (s is None, s or ""))
        sizes = [sum(r.own_size for r in by[s]) for s in names]
        want = slow_targets(sizes, [(3.0, 1.0, 2.0)[k % 3] for k in range(len(names))])
        for s, size, target in zip(names, sizes, want, strict=True):
            assert {r.source_size for r in by[s]} == {size} and by[s][0].target == pytest.approx(target)
            taken = sum(r.own_size * len(r.draws) for r in by[s])
            smallest = min((r.own_size for r in by[s] if r.own_size), default=0)
            largest = max((r.own_size for r in by[s]), default=0)
            assert abs(taken - target) <= max(smallest, largest / 2)
        again = mixing.mix(sized.repartition(5), "own_size", docs_per_block=4, shard_size=5000)
        key = lambda r: (str(r.doc_id), str(r.text), str(r.draws))
        assert sorted(map(key, rows)) == sorted(map(key, again.collect()))
    assert mixing.mix(empty.withColumn("own_size", F.lit(1)), "own_size").count() == 0


def test_rows_and_shards(small, tmp_path):
    mixed = mixing.mix(small.withColumn("own_size", mixing.words()), "own_size", docs_per_block=4, shard_size=5000).cache()
    rows = mixing.mixed_rows(mixed)
    assert rows.count() == mixed.select(F.sum(F.size("draws"))).first()[0]
    mixing.write_shards(mixed, str(tmp_path / "mix"))
    assert small.sparkSession.read.parquet(str(tmp_path / "mix")).count() == rows.count()


def test_repeated_rows_leave_blocks_empty(spark):
    rows = spark.createDataFrame([(1, "a", 3)] * 2000, "doc_id long, source string, size long")
    got = mixing.mix(rows, "size", share=1.75, cap=4.0).selectExpr("sum(size * size(draws)) AS taken", "max(target) AS target", "max(source_size) AS source_size").first()
    assert got["target"] > got["source_size"] == 6000 and abs(got["taken"] - got["target"]) <= 1.5

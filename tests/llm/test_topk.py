import math
import random

import numpy as np
from pyspark.sql import functions as F

from lexigrid.llm import topk


def slow(rows, k=20):
    fit = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in fit:
        if q % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in fit if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string, score string")
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, **kw).collect()))


def test_index_against_matrix():
    rng = np.random.default_rng(1)
    for n, width, spread in ((1, 3, 5), (70, 4, 1), (500, 8, 40), (300, 2, 3), (90, 3, 10**30), (5, 0, 1)):
        draw = lambda *shape: (rng.integers(-40, 41, shape).astype(object) * (spread // 40) if spread > 10**9 else rng.integers(-spread, spread + 1, shape))  # noqa: B023, E731
        values = draw(n, width)
        ids = np.sort(rng.integers(0, 2 * n, n))
        made = topk.BitSlices.of(ids, values)
        for index in (made, topk.BitSlices.read(*made.record())):
            for _ in range(10):
                query = [int(w) for w in draw(width)]
                scores = [sum(w * int(x) for w, x in zip(query, row, strict=True)) for row in values]
                slices, base = index.scores(query)
                got = [base + sum(int(np.unpackbits(s.view("u1"), bitorder="little")[r]) << p for p, s in enumerate(slices)) for r in range(n)]
                assert got == scores
                but = int(rng.choice(ids))
                want = sorted((r for r in range(n) if ids[r] != but), key=lambda r: (-scores[r], r))[:20]
                assert sorted(index.top(query, 20, but)) == sorted((scores[r], int(ids[r])) for r in want)


def test_odd_vectors_ties_and_hot_vectors(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(5)]) for k in range(90)] + [(k, [0.5] * 5) for k in range(90, 150)]
    rows += [(160, None), (180, [None] * 5), (200, [math.nan, 0.0, 0.0, 0.0, 0.0]), (220, [math.inf, 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 5), (240, [0.0] * 5), (241, [-0.001] * 5)]
    want = slow(rows)
    rows = [(i, v, "a", "b") for i, v in rows]
    assert run(spark, rows) == want
    for name, value in (("ROWS", 64), ("QUERIES", 3), ("PAIRS", 2), ("GROUP_BLOCKS", 1), ("GROUP_BYTES", 1)):
        monkeypatch.setattr(topk, name, value)
        assert run(spark, rows) == want


def test_large_components_rank_exactly(spark, monkeypatch):
    rng = random.Random(3)
    for large in (3e5, 1e6, 1e12, 1e30):
        rows = [(k, [rng.uniform(-1, 1) for _ in range(3)]) for k in range(50)] + [(k, [rng.choice([-large, large, large / 3]) * rng.random(), 0.5, 1.0]) for k in range(50, 90)]
        want = [(q, n, i, s if -(1 << 63) <= s < 1 << 63 else None) for q, n, i, s in slow(rows)]
        assert any(s is None for _, _, _, s in want) == (large > 1e9)
        assert {i for _, _, i, _ in want} & set(range(50, 90))
        made = [(i, v, "a", "b") for i, v in rows]
        assert run(spark, made) == want
        with monkeypatch.context() as m:
            m.setattr(topk, "ROWS", 64)
            m.setattr(topk, "GROUP_BLOCKS", 1)
            assert run(spark, made) == want


def test_unscaled_doubles_and_widths(spark):
    rows = [(0, [1e308, 1.0]), (1, [1e308]), (2, [-1e308, 3.0, 9.0]), (3, []), (4, [0.0, 2.0]), (20, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, k, i) for k, i in enumerate((1, 4, 3, 20, 2), 1)] + [(20, k, i) for k, i in enumerate((0, 1, 2, 3, 4), 1)]


def test_few_or_no_rows(spark):
    assert run(spark, [(20, [1.0], "", "")]) == []
    assert run(spark, [(1, [1.0], "", ""), (2, [1.0], "", "")]) == []
    assert run(spark, [(20, [1.0], "", ""), (3, [-1.0], "", ""), (3, [-1.0], "", "")]) == [(20, 1, 3, -4096), (20, 2, 3, -4096)]
    assert run(spark, []) == []

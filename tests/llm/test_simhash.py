import numpy as np
import pytest
import xxhash

from lexigrid.llm import simhash
from lexigrid.llm._components import star_forest


def slow_fingerprint(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def expect(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    low = {}
    roots = slow_components(fps)
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return sorted(((i, f"{f:016x}", low.get(r)) for (i, _), f, r in zip(rows, fps, roots, strict=True)), key=str)


def test_tables(small):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    assert sorted(map(tuple, simhash.near_duplicates(small).collect()), key=str) == expect(rows)


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, simhash.near_duplicates(odd).collect()), key=str) == expect(rows)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    heads = {c for i, _, c in expect(rows) if i is not None}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(heads)
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_each_component_keeps_a_row(spark):
    """Rows that repeat an id with unlike texts are in components of their own."""
    a, b, c = "one two three four five", "six seven eight nine ten", "eleven twelve thirteen fourteen fifteen"
    rows = [(5, a), (5, b), (5, b), (3, b), (7, a), (9, c), (9, c), (9, a), (None, c), (None, None), (2, None)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(5, a), (3, b), (9, c), (None, c), (None, None), (2, None)], key=str)
    rows = [(5, a), (5, b), (5, c)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect())) == sorted(rows)


def test_masks_leave_no_pair_out():
    rng = np.random.default_rng(1)
    masks = simhash.block_masks((1 << 64) - 1)
    assert len(masks) == 20 and all(32 - 2 <= m.bit_count() <= 33 for m in masks)
    for _ in range(300):
        flips = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(not flips & m for m in masks)
    narrow = masks[0]
    for _ in range(2):
        narrow |= simhash.block_masks(~narrow & (1 << 64) - 1)[0]
    assert 64 - narrow.bit_count() <= 9


@pytest.mark.parametrize("bucket", [8192, 40, 10])
def test_dense_buckets(spark, bucket):
    """Fingerprints that share most bits, so that buckets overflow and are cut again."""
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 1 << 62))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(20, rng.integers(0, 7), replace=False) * 3) for _ in range(400)})
    nodes = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long").repartition(3)
    stars = {r["u"]: r["v"] for r in star_forest(simhash.near_links(nodes, bucket)).collect()}
    want = slow_components(fps)
    got = [stars.get(simhash._signed(f), simhash._signed(f)) for f in fps]
    pairs = set(zip(got, want, strict=True))
    assert len(pairs) == len(set(got)) == len(set(want))


def test_stars(spark):
    chain = [(k, k + 1) for k in range(0, 60)] + [(100, 90), (90, 95), (5, 5)]
    forest = star_forest(spark.createDataFrame(chain, "u long, v long"))
    assert sorted(map(tuple, forest.collect())) == [(k, 0) for k in range(1, 61)] + [(95, 90), (100, 90)]
    assert star_forest(spark.createDataFrame([], "u long, v long")).count() == 0
    rng = np.random.default_rng(6)
    for n, m in ((40, 25), (40, 60), (200, 150)):
        pairs = rng.integers(-n, n, (m, 2)).tolist()
        root = {x: x for x in range(-n, n)}
        for u, v in pairs:
            a, b = root[u], root[v]
            root = {x: min(a, b) if r in (a, b) else r for x, r in root.items()}
        forest = star_forest(spark.createDataFrame([tuple(p) for p in pairs], "u long, v long"))
        assert sorted(map(tuple, forest.collect())) == sorted((x, r) for x, r in root.items() if x != r)

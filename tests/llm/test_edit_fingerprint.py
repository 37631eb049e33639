import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from lexigrid.llm import edit_fingerprint as ef


def slow_walk(classes):
    """The embedding, step by step, until the pointer leaves the text."""
    moves, out, p = ef._moves(), [], 0
    while p < len(classes):
        out.append(int(classes[p]))
        p += int(moves[len(out[:-1]) % ef.PERIOD][out[-1]])
    return out


def slow_fingerprint(text):
    """Each register from its own walk over the successive minima."""
    walk = slow_walk(ef.classes(text))
    out = bytearray(ef.REGISTERS)
    for r in range(ef.REGISTERS if walk else 0):
        rng, at, key, best = np.random.default_rng([ef.SEED, 2, r]), 0, 1.0, 0
        while at < len(walk):
            best = at
            key *= 1.0 - rng.random()
            at += int(rng.geometric(max(key, 1e-15)))
        mixed = (best * 0x9E3779B97F4A7C15 & 2**64 - 1) ^ ((walk[best] + 1) * 0xC2B2AE3D27D4EB4F & 2**64 - 1)
        mixed = (mixed ^ mixed >> 29) * 0xBF58476D1CE4E5B9 & 2**64 - 1
        out[r] = (mixed >> 33) % 255 + 1
    return bytes(out)


def text(rng, n):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz   eeettaaé漢") for _ in range(n))


def test_walks_and_fingerprints():
    rng = random.Random(1)
    texts = [text(rng, n) for n in (0, 1, 2, 3, 500, 4096, 4097)]
    for t, walk in zip(texts, ef.walks(texts), strict=True):
        want = slow_walk(ef.classes(t))
        assert walk.steps == len(want) and walk.at(np.arange(walk.steps)).tolist() == want
    assert ef.fingerprints_of(texts) == [slow_fingerprint(t) for t in texts]
    assert ef.fingerprints_of([None]) == ef.fingerprints_of([""]) == [bytes(ef.REGISTERS)]


def test_few_edits_are_near_and_other_texts_far():
    rng = random.Random(2)
    near, far = [], []
    for _ in range(30):
        a = text(rng, rng.randint(300, 9000))
        b = list(a)
        for _ in range(3):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["x", ""])
        x, y, z = ef.fingerprints_of([a, "".join(b), text(rng, len(a))])
        near.append(ef.likeness(x, y))
        far.append(ef.likeness(x, z))
    assert np.mean(near) > 0.8 and np.mean(far) < 0.15


def check(df, rows_per_part):
    hashes = {r.text: r.h for r in df.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).collect()}
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]], r[1]))
    out = ef.edit_likeness(df, rows_per_part=rows_per_part).collect()
    want = []
    for (i, a), (_, b) in zip(rows, [*rows[1:], *rows[:1]], strict=True):
        e = a[: len(a) - len(a) // 3] + b[: len(a) // 3]
        fa, fe, fb = ef.fingerprints_of([a, e, b])
        want.append((i, len(a), hashlib.sha256(e.encode()).hexdigest(), fa.hex(), fe.hex(), ef.likeness(fa, fe), ef.likeness(fa, fb)))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


def test_next_documents(small, odd, empty):
    for rows_per_part in (1, 3, 50, 10_000):
        check(small.limit(60), rows_per_part)
    check(odd, 2)
    check(odd, 512)
    check(small.limit(1), 1)
    check(small.limit(1), 10)
    assert ef.edit_likeness(empty).count() == 0


def test_one_id_or_none_is_cut_into_parts(spark):
    rng = random.Random(8)
    rows = [(None if k % 3 else 7, text(rng, 20 + k)) for k in range(60)] + [(9, "same text")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rows_per_part in (1, 4):
        check(df, rows_per_part)


def slow_components(rows, like=ef.LIKE):
    fps = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if ef.likeness(fps[i], fps[j]) >= like:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    low = {r: least(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in root}
    return sorted([(rows[k][0], fps[k].hex(), low[root[k]]) for k in range(len(rows))], key=str)


def family(rng, n, seeds=12):
    """Chains of near copies, each a little different from the one before, and other texts."""
    rows = []
    for s in range(seeds):
        now = text(rng, 1500)
        for k in range(n if s < 3 else 2):
            rows.append((100 * s + k, now))
            at = rng.randrange(len(now) - 60)
            now = now[:at] + text(rng, 30) + now[at + 30 :]
    return [*rows, (5000, rows[0][1]), (5001, None), (5002, ""), (None, "alone"), (None, rows[1][1])]


def test_near_duplicates_against_all_pairs(spark, odd, empty, monkeypatch):
    rows = family(random.Random(4), 30)
    want = slow_components(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bucket in (8192, 4):
        monkeypatch.setattr(ef, "BUCKET", bucket)
        assert sorted(map(tuple, ef.near_duplicates(df).collect()), key=str) == want
    assert ef.near_duplicates(odd).count() == odd.count() and ef.near_duplicates(empty).count() == 0


def test_likeness_and_classes_in_one(spark, odd, empty):
    rows = family(random.Random(7), 6)
    for df in (spark.createDataFrame(rows, "doc_id long, text string"), odd):
        got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in ef.fingerprints_and_classes(df).collect()), key=str)
        assert got == sorted(map(tuple, ef.near_duplicates(df).collect()), key=str)
    assert ef.fingerprints_and_classes(empty).count() == 0


def test_recall_on_the_small_table(spark, small):
    """Links of all pairs that are in one component by bands and verification."""
    got = {r.doc_id: r for r in ef.near_duplicates(small).collect()}
    fps = np.array([np.frombuffer(bytes.fromhex(r.fingerprint), "u1") for r in got.values()])
    component = [r.component_id for r in got.values()]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] == fps[j]).mean() >= ef.LIKE]
    assert links and np.mean([component[i] == component[j] for i, j in links]) >= 0.99


def test_long_texts_with_a_passage_put_in_front():
    """Long texts are walked once, as short ones are: what is put in at the start costs no more than until the walks meet again."""
    rng = random.Random(5)
    for n, d, least in ((60_000, 30, 0.7), (150_000, 30, 0.7), (150_000, 50, 0.6)):
        near = []
        for _ in range(8):
            a = text(rng, n)
            x, y = ef.fingerprints_of([a, a[:9] + text(rng, d) + a[9:]])
            near.append(ef.likeness(x, y))
        assert np.mean(near) > least, (n, d, near)
    a = text(rng, 60_000)
    some = [a, text(rng, 120) + a]
    assert ef.fingerprints_of(some) == [slow_fingerprint(t) for t in some]


def test_walks_over_stretches(monkeypatch):
    rng = random.Random(6)
    a = text(rng, 3000)
    want = slow_walk(ef.classes(a))
    places = np.array(rng.choices(range(len(want)), k=500))
    for stretch in (1, 7, 1000, 3000, 1 << 16):
        monkeypatch.setattr(ef, "STRETCH", stretch)
        assert ef.walks([a])[0].at(places).tolist() == [want[p] for p in places]


def test_side_by_side_as_one_by_one(monkeypatch):
    rng = random.Random(9)
    texts = [text(rng, n) for n in (0, 1, 2, 255, 256, 257, 700, 700, 1500, 3)]
    want = [w.stays.tolist() for w in ef.walks(texts)]
    for few, strip in ((1, 256), (1, 3), (4, 64), (100, 256)):
        monkeypatch.setattr(ef, "FEW", few)
        monkeypatch.setattr(ef, "STRIP", strip)
        assert [w.stays.tolist() for w in ef.walks(texts)] == want
        pairs = list(zip(ef.walks(texts), ef.walks(texts[::-1]), strict=True))
        edited = ef._edited_walks(pairs)
        assert [w.fingerprint() for w in edited] == ef.fingerprints_of([ef.edited(a, b) for a, b in zip(texts, texts[::-1], strict=True)])

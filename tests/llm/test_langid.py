import math

import numpy as np
from pyspark.sql import functions as F

from lexigrid.llm import langid


def test_held_out_accuracy(small):
    model = langid.fit(small, ~langid.held_out())
    rows = langid.identify(small, model).withColumn("held", langid.held_out()).collect()
    held = [r for r in rows if r.held and r.lang is not None]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows) and {r.lang_pred for r in rows} <= {"en", "fr", "de", "es", "und"}
    sure = [r for r in held if r.score > 0.99]
    assert np.mean([r.lang == r.lang_pred for r in sure]) > 0.97


def test_labels_of_held_out_rows_are_not_learned(small):
    twisted = small.withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang")))
    a, b = langid.fit(small, ~langid.held_out()), langid.fit(twisted, ~langid.held_out())
    assert a.languages == b.languages and (a.weights == b.weights).all() and a.temperature == b.temperature


def test_odd_rows(odd, empty):
    model = langid.fit(odd.where("doc_id is not null"), ~langid.held_out())
    out = langid.identify(odd, model)
    assert sorted(out.columns) == sorted(odd.columns)
    for r in out.collect():
        if r.text is None or not any(map(str.isalpha, r.text)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in model.languages and 0 < r.score <= 1
    none = langid.fit(empty, F.lit(True))
    assert none.languages == [] and {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


def test_grams_against_slow_ones():
    texts = ["Abc", "", "a", "ÉÀ漢 x" * 50, "ab"]

    def slow(text):
        out = {}
        for n in langid.GRAMS:
            for i in range(len(text) - n + 1):
                total = 0
                for place, c in enumerate(text[i : i + n]):
                    m = ord(c) * langid._MIX[place] & 0xFFFFFFFF
                    total += m ^ m >> 15
                h = (total + n) * 0x27D4EB2F & 0xFFFFFFFF
                b = (h ^ h >> 16) & langid.BUCKETS - 1
                out[b] = out.get(b, 0) + 1
        return out

    assert [dict(zip(b.tolist(), c.tolist(), strict=True)) for b, c in langid.gram_counts(texts)] == [slow(t.lower()) for t in texts]


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(4000, 3)) * 2
    p = langid._softmax(logits)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert abs(langid.temperature(logits * 4, y) - 4) < 0.4


def test_learning_against_slow_ftrl():
    """Every weight, step by step, with dictionaries and no vectors."""
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(3)), np.sort(rng.choice(30, 4, replace=False)), rng.random(4).astype("f4")) for _ in range(60)]
    z, n = {}, {}

    def weight(i, c):
        zi = z.get((i, c), 0.0)
        if abs(zi) <= langid.L1:
            return 0.0
        return -(zi - math.copysign(langid.L1, zi)) / ((langid.BETA + math.sqrt(n.get((i, c), 0.0))) / langid.ALPHA + langid.L2)

    for _ in range(langid.PASSES):
        for y, buckets, values in rows:
            x = [*zip(buckets.tolist(), values.tolist(), strict=True), (langid.BUCKETS, 1.0)]
            w = {(i, c): weight(i, c) for i, _ in x for c in range(3)}
            e = [math.exp(sum(v * w[i, c] for i, v in x)) for c in range(3)]
            for i, v in x:
                for c in range(3):
                    g = v * (e[c] / sum(e) - (c == y))
                    old = n.get((i, c), 0.0)
                    n[i, c] = old + g * g
                    z[i, c] = z.get((i, c), 0.0) + g - (math.sqrt(n[i, c]) - math.sqrt(old)) / langid.ALPHA * w[i, c]
    got = langid.learn(rows, 3)
    want = np.zeros_like(got)
    for i, c in z:
        want[i, c] = weight(i, c)
    assert np.abs(got - want).max() < 1e-5 and (got != 0).any()


def test_document_frequencies_and_rare_languages(spark, small):
    rows = [r for r in small.collect() if r.lang is not None and langid.has_letter(r.text)]
    model = langid.fit(small, F.lit(True), max_languages=2)
    n = {lang: sum(r.lang == lang for r in rows) for lang in {r.lang for r in rows}}
    assert model.languages == sorted(sorted(n, key=lambda x: (-n[x], x))[:2])
    df = np.zeros(langid.BUCKETS)
    for buckets, _ in langid.gram_counts([r.text for r in rows]):
        df[buckets] += 1
    assert np.allclose(model.idf, np.log((1 + len(rows)) / (1 + df)) + 1)

"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Grams of 1 to 3 code points of the lower-cased text go to BUCKETS hash buckets. Document frequencies are counted over all rows to learn
from. The weights are learned by follow-the-regularised-leader with elastic-net penalties (McMahan et al., 2013) on about PER_LANGUAGE
rows of each language, chosen by a hash, in one task; a fifth of them only fits the temperature that calibrates the probabilities.
The LANGUAGES most frequent values of the language column are learned, ties in code-point order; rarer ones are taken for noise and
their rows are predicted like any other. What one task or the driver holds is bounded by BUCKETS, PER_LANGUAGE and LANGUAGES.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import col, fresh, giving_back, stored

BUCKETS = 1 << 15
GRAMS = (1, 2, 3)
#: The sample's bound: the expected number of rows of each language that the weights and the temperature are fitted to.
PER_LANGUAGE = 800
#: The languages that are learned, at most: weights are BUCKETS + 1 numbers a language.
LANGUAGES = 256
PASSES = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1e-3, 1e-3
SEED = 42
UNKNOWN = "und"
#: Code points whose grams are hashed together.
TOGETHER = 1 << 19
#: The multipliers of the hash of a gram, by place; odd, from the golden ratio's and its square's fractions.
_MIX = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


def gram_counts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text, the buckets of its grams and how often each occurs."""
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text)
        if size > TOGETHER:
            yield from _gram_counts(some)
            some, size = [], 0
    yield from _gram_counts(some)


def _gram_counts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    low = [t.lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    hashed, sums = [], np.zeros(len(points), "u4")
    for place, n in enumerate(GRAMS):
        shifted = points[place:] * np.uint32(_MIX[place])
        sums = sums[: len(points) - place] + (shifted ^ shifted >> np.uint32(15))
        h = (sums + np.uint32(n)) * np.uint32(0x27D4EB2F)
        hashed.append(((h ^ h >> np.uint32(16)) & np.uint32(BUCKETS - 1)).astype("u2" if BUCKETS <= 1 << 16 else "u4"))
    at = 0
    for t in low:
        end = at + len(t)
        grams = np.concatenate([h[at : max(at, end - n + 1)] for n, h in zip(GRAMS, hashed, strict=True)])
        counts = np.bincount(grams, minlength=BUCKETS)
        buckets = np.flatnonzero(counts)
        yield buckets, counts[buckets]
        at = end


def weighted(buckets: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[buckets]
    return (x / max(np.sqrt(x @ x), 1e-9)).astype("f4")


def has_letter(text: str | None) -> bool:
    return bool(text) and (text[0].isalpha() or any(map(str.isalpha, text)))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def learn(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, passes: int = PASSES) -> np.ndarray:
    """Weights (BUCKETS + 1, classes), the last row the bias, from (class, buckets, values)."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def at(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(passes):
        for y, buckets, values in rows:
            i, x = np.append(buckets, BUCKETS), np.append(values, 1.0)
            w = at(i)
            p = _softmax(x @ w)
            p[y] -= 1
            g = np.outer(x, p)
            ni = n[i]
            z[i] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[i] = ni + g * g
    return at(np.arange(BUCKETS + 1))


def temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The divisor of the logits that makes the true classes likeliest, by golden-section search over its logarithm."""
    if not len(logits):
        return 1.0

    def loss(t: float) -> float:
        return -float(np.log(_softmax(logits / np.exp(t))[np.arange(len(classes)), classes] + 1e-12).mean())

    low, high, ratio = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [k for k, t in enumerate(texts) if has_letter(t)]
        out, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if self.languages:
            for k, (buckets, counts) in zip(known, gram_counts([texts[k] for k in known]), strict=True):
                p = _softmax((weighted(buckets, counts, self.idf) @ self.weights[buckets] + self.weights[BUCKETS]) / self.temperature)
                best = int(p.argmax())
                out[k], score[k] = self.languages[best], float(p[best])
        return out, score


def fit(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, seed: int = SEED, max_languages: int = LANGUAGES) -> Model:
    """The model from the rows for which learn_from holds, with a language and a text that has a letter. No such rows: no languages.
    Rows that repeat are learned from as often. Other columns, whatever their names, are not looked at."""
    rows = docs.where(F.coalesce(learn_from, F.lit(False)) & col(lang_col).isNotNull()).select(col(lang_col).cast("string").alias("lang"), col(text_col).cast("string").alias("text"), F.xxhash64(F.lit(seed), col(id_col)).alias("h"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, langs = np.zeros(BUCKETS, "i8"), 0, {}
        for batch in batches:
            rows = [(lang, t) for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if has_letter(t)]
            for lang, _ in rows:
                langs[lang] = langs.get(lang, 0) + 1
            for buckets, _ in gram_counts([t for _, t in rows]):
                df[buckets] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([None] * len(some), pa.string()), pa.array(some), pa.array(df[some])], names=["lang", "bucket", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(list(langs), pa.string()), pa.array([-1] * len(langs), pa.int64()), pa.array(list(langs.values()), pa.int64())], names=["lang", "bucket", "n"])

    counted = rows.select("lang", "text").mapInArrow(giving_back(frequencies), "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counted = stored(counted, "frequencies")
    by_lang, by_bucket = counted.where(F.col("lang").isNotNull()), counted.where(F.col("lang").isNull())
    n_lang = {r["lang"]: r["n"] for r in by_lang.orderBy(F.desc("n"), "lang").limit(max_languages).collect()}
    languages, total = sorted(n_lang), by_lang.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    idf = np.full(BUCKETS, np.log(1 + total) + 1)
    for r in by_bucket.collect():  # at most BUCKETS
        idf[r["bucket"]] = np.log((1 + total) / (1 + r["n"])) + 1
    if not languages:
        return Model([], idf, np.zeros((BUCKETS + 1, 0)), 1.0)
    number = {lang: k for k, lang in enumerate(languages)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(number[lang], t, h) for lang, t, h in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) if has_letter(t)]
            x = [(b, weighted(b, c, idf)) for b, c in gram_counts([t for _, t, _ in rows])]
            arrays = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([b.astype("<i4").tobytes() for b, _ in x], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in x], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["y", "h", "i", "x"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for y, i, x in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
                rows.append((y, np.frombuffer(i, "<i4"), np.frombuffer(x, "<f4")))
        w = learn([r for k, r in enumerate(rows) if k % 5 or len(rows) < 10], len(languages))
        held = [r for k, r in enumerate(rows) if not k % 5]
        logits = np.array([x @ w[i] + w[BUCKETS] for _, i, x in held]).reshape(len(held), len(languages))
        yield pa.RecordBatch.from_pydict({"w": [w.astype("<f4").tobytes()], "t": [temperature(logits, np.array([y for y, _, _ in held], "i8"))]})

    share = F.create_map(*[F.lit(v) for lang in languages for v in (lang, min(1.0, per_language / n_lang[lang]))])
    sample = rows.where(F.pmod("h", F.lit(1_000_003)) < F.lit(1_000_003) * F.element_at(share, F.col("lang")))
    sampled = stored(sample.mapInArrow(giving_back(features), "y bigint, h bigint, i binary, x binary"), "features")
    got = sampled.repartition(1).sortWithinPartitions("h", "y", "i").mapInArrow(train, "w binary, t double").first()
    return Model(languages, idf, np.frombuffer(got["w"], "<f4").reshape(BUCKETS + 1, len(languages)), got["t"])


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, from whole texts alone. A text that is null, or without a letter, or any text if the model knows no
    language: und, with score 0. Input columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score")
    (out,) = fresh(docs, "lang")

    def predict(texts: pa.Array) -> pa.Array:
        lang, score = model.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"])

    done = docs.withColumn(out, F.arrow_udf(predict, "struct<lang_pred: string, score: double>")(col(text_col).cast("string")))
    return done.select(*[col(c) for c in docs.columns], F.col(out)["lang_pred"].alias("lang_pred"), F.col(out)["score"].alias("score"))

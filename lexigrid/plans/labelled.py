"""Queries on labelled text: split, seeded shuffle, slice, encoding. Labels are documents' quality; ids divisible by ten are the test split."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BASIC_TOKEN, CONTROLS, tokenize
from ..operators import encoding, selection
from ..session import spread
from ..sources.collections import read_labelled

KEPT = 1000


def _data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_labelled(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet")


def labelled_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _data(spark, sf_dir).select("doc_id", "split", F.md5("text").alias("text_md5"), "label")


_DATA = """data AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, text, quality AS label FROM documents JOIN labels USING (doc_id))"""
LABELLED_SCAN = f"WITH {_DATA} SELECT doc_id, split, md5(text) AS text_md5, label FROM data"


def split_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.split_of(_data(spark, sf_dir), "test").select("doc_id", "label")


SPLIT_SELECT = f"WITH {_DATA} SELECT doc_id, label FROM data WHERE split = 'test'"


def _taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.shuffled_take(selection.split_of(_data(spark, sf_dir), "test"), "doc_id", KEPT)


def shuffle_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _taken(spark, sf_dir).select("position", "doc_id", "label")


SHUFFLE_TAKE = f"""WITH {_DATA}, keyed AS (SELECT *, CAST('0x' || substr(md5('42:' || doc_id), 1, 15) AS BIGINT) AS k FROM data WHERE split = 'test')
SELECT CAST(row_number() OVER (ORDER BY k, doc_id) - 1 AS INTEGER) AS position, doc_id, label FROM keyed QUALIFY position < {KEPT}"""


def shuffle_take_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 of the other split, which has more at any size."""
    data = selection.split_of(_data(spark, sf_dir), "train")
    return selection.shuffled_take(data, "doc_id", 100).select("position", "doc_id", "label")


SHUFFLE_TAKE_TRAIN = SHUFFLE_TAKE.replace("split = 'test'", "split = 'train'").replace(f"position < {KEPT}", "position < 100")


def first_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffle_take(spark, sf_dir).orderBy("position").limit(1)


FIRST_EXAMPLE = f"SELECT * FROM ({SHUFFLE_TAKE}) WHERE position = 0"


def permutation_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """numpy's own permutation."""
    data = selection.split_of(_data(spark, sf_dir), "test").select("doc_id", "label")
    return selection.permutation_take(data, "doc_id", KEPT)


#: The multiplier of PCG64; and its state and increment after seeding with 42, in halves, as numpy gives them.
_MULTIPLIER = 0x2360ED051FC65DA44385DF649FCCF645
_SEEDED = np.random.PCG64(42).state["state"]
_U = "CAST({} AS UHUGEINT)".format
_HALF = _U(1 << 64)
_M_HI, _M_LO, _I_HI, _I_LO = (_U(x) for v in (_MULTIPLIER, _SEEDED["inc"]) for x in divmod(v, 1 << 64))
#: The generator's steps, its outputs as halves, low first, and the swaps of a shuffle from the last row down: each takes the low bits of
#: the next half that is not beyond the row. Four halves a row are more than it needs.
PERMUTATION_TAKE = f"""WITH RECURSIVE {_DATA},
own AS (SELECT doc_id, label, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS r FROM data WHERE split = 'test'),
size AS (SELECT CAST(count(*) AS BIGINT) AS n FROM own),
steps(k, hi, lo) AS (
  SELECT CAST(-1 AS BIGINT), {_U(_SEEDED["state"] >> 64)}, {_U(_SEEDED["state"] % (1 << 64))}
  UNION ALL
  SELECT k + 1, ((lo * {_M_LO} + {_I_LO}) // {_HALF} + (hi * {_M_LO}) % {_HALF} + (lo * {_M_HI}) % {_HALF} + {_I_HI}) % {_HALF}, (lo * {_M_LO} + {_I_LO}) % {_HALF}
  FROM steps, size WHERE k < 2 * n + 32),
mixed AS (
  SELECT k, {_U("xor(CAST(hi AS UBIGINT), CAST(lo AS UBIGINT))")} AS x, CAST(hi >> 58 AS INTEGER) AS turn FROM (SELECT k, CAST(hi AS UBIGINT) AS hi, lo FROM steps WHERE k >= 0)),
turned AS (
  SELECT k, CASE turn WHEN 0 THEN x ELSE x // {_U("CAST(1 AS UBIGINT) << turn")} + (x % {_U("CAST(1 AS UBIGINT) << turn")}) * {_U("CAST(1 AS UBIGINT) << (64 - turn)")} END AS u FROM mixed),
halves AS (
  SELECT 2 * k AS t, u % {_U(1 << 32)} AS u FROM turned UNION ALL SELECT 2 * k + 1, u // {_U(1 << 32)} FROM turned),
shuffle(t, i, rows) AS (
  SELECT CAST(0 AS BIGINT), n - 1, range(n) FROM size
  UNION ALL
  SELECT t + 1, CASE WHEN j > i THEN i ELSE i - 1 END,
    CASE WHEN j > i THEN rows ELSE list_transform(rows, lambda x, place: CASE place - 1 WHEN i THEN rows[j + 1] WHEN j THEN rows[i + 1] ELSE x END) END
  FROM (SELECT shuffle.t, i, rows, CAST(u AS BIGINT) & ((CAST(1 AS BIGINT) << length(bin(i))) - 1) AS j FROM shuffle JOIN halves ON halves.t = shuffle.t WHERE i > 0)),
placed AS (
  SELECT unnest(rows) AS r, generate_subscripts(rows, 1) - 1 AS position FROM (SELECT rows FROM shuffle ORDER BY t DESC LIMIT 1))
SELECT doc_id, label, CAST(position AS INTEGER) AS position FROM own JOIN placed USING (r) WHERE position < {KEPT}"""


_BASE = encoding.base_tokens()


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 most frequent words, ties in code-point order, which the vocabulary takes; a top-k report."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    own = encoding.build_vocabulary(docs, size=2000 + len(_BASE))
    return spark.createDataFrame([(k, w) for k, w in enumerate(own)], "id int, token string").where(F.col("id") >= len(_BASE))


def _basic(text: str) -> str:
    return f"regexp_extract_all(strip_accents(lower(regexp_replace(coalesce({text}, ''), '{CONTROLS}', '', 'g'))), '{BASIC_TOKEN}')"


def _vocabulary_sql(size: int) -> str:
    return f"""SELECT CAST({len(_BASE) - 1} + row_number() OVER (ORDER BY count(*) DESC, token) AS INTEGER) AS id, token
FROM (SELECT unnest({_basic('text')}) AS token FROM documents) WHERE length(token) > 1 GROUP BY token QUALIFY id < {size}"""


VOCABULARY = _vocabulary_sql(2000 + len(_BASE))


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = encoding.build_vocabulary(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return encoding.encode_batch(_taken(spark, sf_dir).select("position", "label", "text"), words)


def encode_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per example: the number of real tokens, and a digest of its ids."""
    real = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    return _encoded(spark, sf_dir).select("position", real.alias("n_tokens"), F.size("input_ids").alias("length"), F.md5(F.array_join("input_ids", " ")).alias("ids_md5"))


def encode_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that a model takes, arrays written as text."""
    joined = [F.array_join(c, " ").alias(c) for c in ("input_ids", "attention_mask")]
    return _encoded(spark, sf_dir).select("label", *joined)


_QUOTED = ", ".join("({}, '{}')".format(k, t.replace("'", "''")) for k, t in enumerate(_BASE))
_ENCODED = f"""WITH RECURSIVE {_DATA},
keyed AS (SELECT *, CAST('0x' || substr(md5('42:' || doc_id), 1, 15) AS BIGINT) AS k FROM data WHERE split = 'test'),
taken AS (SELECT CAST(row_number() OVER (ORDER BY k, doc_id) - 1 AS INTEGER) AS position, label, {_basic('text')}[1:510] AS words FROM keyed QUALIFY position < {KEPT}),
vocab(id, token) AS (SELECT * FROM (VALUES {_QUOTED}) b UNION ALL SELECT * FROM ({_vocabulary_sql(30_000)})),
found AS (SELECT position, unnest(words) AS w, generate_subscripts(words, 1) AS nth FROM taken),
known AS (SELECT DISTINCT w FROM found),
walk(w, done, ids) AS (
  SELECT w, CAST(0 AS BIGINT), CAST([] AS INTEGER[]) FROM known WHERE length(w) <= {encoding.LONGEST_WORD}
  UNION ALL
  SELECT w, done + n, list_append(ids, id) FROM (
    SELECT c.w, c.done, c.ids, c.n, v.id, row_number() OVER (PARTITION BY c.w ORDER BY c.n DESC) AS best
    FROM (SELECT w, done, ids, unnest(range(1, length(w) - done + 1)) AS n FROM walk WHERE done < length(w)) c
    JOIN vocab v ON v.token = CASE WHEN c.done = 0 THEN '' ELSE '##' END || substr(c.w, c.done + 1, c.n)) WHERE best = 1),
pieces AS (SELECT known.w, coalesce(walk.ids, [1]) AS ids FROM known LEFT JOIN walk ON walk.w = known.w AND walk.done = length(walk.w)),
joined AS (SELECT position, flatten(list(ids ORDER BY nth)) AS ids FROM found JOIN pieces USING (w) GROUP BY position),
real AS (SELECT position, label, list_concat(list_concat([2], coalesce(ids, [])[1:510]), [3]) AS ids FROM taken LEFT JOIN joined USING (position))"""
ENCODE_BATCH = f"""{_ENCODED}
SELECT position, CAST(len(ids) AS INTEGER) AS n_tokens, CAST(512 AS INTEGER) AS length, md5(array_to_string(list_resize(ids, 512, 0), ' ')) AS ids_md5 FROM real"""
ENCODE_PROJECT = f"""{_ENCODED}
SELECT label, array_to_string(list_resize(ids, 512, 0), ' ') AS input_ids, array_to_string(list_resize(list_transform(ids, lambda x: 1), 512, 0), ' ') AS attention_mask FROM real"""


def attention_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of whole-word lengths: [CLS], a token a word, [SEP], cut at 512."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.size(tokenize(F.col("text"))) + 2).alias("n"))
    masked = docs.withColumn("mask", encoding.mask_from_length(F.col("n")))
    return masked.select("doc_id", F.array_join("mask", "").alias("mask"))


ATTENTION_MASK = """WITH t AS (SELECT doc_id, CAST(least(512, 2 + len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> ''))) AS INTEGER) AS n FROM documents)
SELECT doc_id, repeat('1', n) || repeat('0', 512 - n) AS mask FROM t"""

QUERIES = {
    "labelled_scan": labelled_scan,
    "split_select": split_select,
    "shuffle_take": shuffle_take,
    "shuffle_take_train": shuffle_take_train,
    "first_example": first_example,
    "permutation_take": permutation_take,
    "vocabulary": vocabulary,
    "encode_batch": encode_batch,
    "encode_project": encode_project,
    "attention_mask": attention_mask,
}
ORACLE_SQL = {
    "labelled_scan": LABELLED_SCAN,
    "split_select": SPLIT_SELECT,
    "shuffle_take": SHUFFLE_TAKE,
    "shuffle_take_train": SHUFFLE_TAKE_TRAIN,
    "first_example": FIRST_EXAMPLE,
    "permutation_take": PERMUTATION_TAKE,
    "vocabulary": VOCABULARY,
    "encode_batch": ENCODE_BATCH,
    "encode_project": ENCODE_PROJECT,
    "attention_mask": ATTENTION_MASK,
}

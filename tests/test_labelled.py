import unicodedata

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from lexigrid.functions.text import BASIC_TOKEN, CONTROLS, basic_tokens
from lexigrid.operators import encoding, selection


def test_shuffle_is_a_permutation_that_partitions_do_not_change(spark):
    data = spark.range(500).withColumnRenamed("id", "doc_id")
    orders = [[r["doc_id"] for r in selection.shuffled_take(d, "doc_id", 500).orderBy("position").collect()] for d in (data.repartition(9), data.coalesce(1))]
    assert orders[0] == orders[1] and sorted(orders[0]) == list(range(500)) and orders[0] != sorted(orders[0])
    assert [r["doc_id"] for r in selection.shuffled(data, "doc_id").collect()] == orders[0]


def test_numpys_permutation(spark):
    data = spark.range(10, 60).withColumnRenamed("id", "doc_id")
    got = [r["doc_id"] for r in selection.permutation_take(data, "doc_id", 7).orderBy("position").collect()]
    assert got == (np.random.default_rng(42).permutation(50)[:7] + 10).tolist()


def slow_tokens(text):
    """Character by character, by Unicode's categories."""
    ideograph = lambda c: any(a <= ord(c) <= b for a, b in ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F)))
    sign = lambda c: unicodedata.category(c)[0] == "P" or (c.isascii() and c.isprintable() and not c.isalnum() and c != " ")
    text = "".join(c for c in text or "" if c in "\t\n\r" or (unicodedata.category(c) not in ("Cc", "Cf") and c != "\ufffd"))
    text = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    out, word = [], ""
    for c in text + " ":
        if c in "\t\n\r" or unicodedata.category(c)[0] == "Z" or sign(c) or ideograph(c):
            out += [word] if word else []
            word = ""
            out += [c] if sign(c) or ideograph(c) else []
        else:
            word += c
    return out


@pytest.mark.parametrize("table", [None, "documents"])
def test_basic_tokens(spark, table):
    rows = ["Crème brûlée, señor! (N° 5)", "don't stop—now", "漢字 kanji かな", "a\u0301b\x00c\u200bd", None, "", " \t\n", "x_y z^2 `q` ~", "Straße ŁÓDŹ Ñandú", "e\u0301\u0302 ǅ"]
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text") if table else spark.createDataFrame([(r,) for r in rows], "text string")
    for r in df.select("text", basic_tokens(F.col("text")).alias("t")).collect():
        assert r["t"] == slow_tokens(r["text"])
        assert r["t"] == regex.findall(BASIC_TOKEN, "".join(c for c in unicodedata.normalize("NFD", regex.sub(CONTROLS, "", r["text"] or "").lower()) if unicodedata.category(c) != "Mn"))


def slow_pieces(vocabulary, text, most):
    ids = {t: k for k, t in enumerate(vocabulary)}
    out = [ids["[CLS]"]]
    for word in slow_tokens(text):
        rest, own = word, []
        while rest:
            fits = [n for n in range(1, len(rest) + 1) if ("##" if own else "") + rest[:n] in ids]
            if not fits or len(word) > 100:
                own = [ids["[UNK]"]]
                break
            own.append(ids[("##" if own else "") + rest[: max(fits)]])
            rest = rest[max(fits) :]
        out += own
    return [*out[: most - 1], ids["[SEP]"]]


def test_encoding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = encoding.build_vocabulary(docs, size=500)
    assert len(words) == len(set(words)) == 500 and words[:4] == list(encoding.SPECIAL)
    some = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "a" * 3000), (-4, "a" * 99 + " naïve, (x)" + " ,." * 400)], "doc_id long, text string"))
    for row in encoding.encode_batch(some, words).collect():
        want = slow_pieces(words, row["text"] or "", 512)
        assert len(row["input_ids"]) == len(row["attention_mask"]) == 512
        assert row["input_ids"][: len(want)] == want and not any(row["input_ids"][len(want) :])
        assert sum(row["attention_mask"]) == len(want)


def test_the_limit_comes_before_the_encoding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    plan = encoding.encode_batch(selection.shuffled_take(docs, "doc_id", 5), ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "a"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("TakeOrderedAndProject")


def test_mask(spark):
    assert spark.range(1).select(encoding.mask_from_length(F.lit(2), 4)).first()[0] == [1, 1, 0, 0]

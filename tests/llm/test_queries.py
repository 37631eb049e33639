"""The registered queries that SQL cannot express, on the smallest tables, column by column against brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexigrid.llm import edit_fingerprint, langid
from lexigrid.llm.queries import QUERIES
from tests.llm.test_edit_fingerprint import slow_components as slow_likeness_components
from tests.llm.test_edit_fingerprint import slow_fingerprint
from tests.llm.test_mixing import slow_targets
from tests.llm.test_simhash import expect

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(small):
    return sorted(((r.doc_id, r.text, r.lang, r.source) for r in small.collect()), key=lambda r: r[0])


def result(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, SMALL).collect()]


def whole_ids(name, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op3(spark, docs):
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in result(spark, "op3_simhash")]
    assert sorted(got, key=str) == expect([(i, t) for i, t, _, _ in docs])


def test_op4(spark, docs):
    got = {r["doc_id"]: r for r in result(spark, "op4_language_id")}
    assert got.keys() == {i for i, *_ in docs}
    learned = {lang for i, t, lang, _ in docs if lang is not None and zlib.crc32(str(i).encode()) % 3 != 1 and langid.has_letter(t)}
    for i, text, _, _ in docs:
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        letters = text is not None and any(c.isalpha() for c in text)
        assert (r["lang_pred"] in learned and 0 < r["score"] <= 1) if letters else (r["lang_pred"], r["score"]) == ("und", 0.0)
    held = [(got[i]["lang_pred"], lang) for i, _, lang, _ in docs if lang is not None and got[i]["held_out"] and got[i]["lang_pred"] != "und"]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_op6(spark, docs):
    ids = {i: [*x, 2] for (i, *_), x in zip(docs, whole_ids("word_bpe_49k.json", [t for _, t, _, _ in docs]), strict=True)}
    rows, seen, sequences = result(spark, "op6_packing"), defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == crc(own[r["start"] : r["start"] + r["length"]])
        seen[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["sequence_length"], r["padded_length"]))
    for i, own in ids.items():
        assert [k for start, n in sorted(seen[i]) for k in range(start, start + n)] == list(range(len(own)))
    for parts in sequences.values():
        n = sum(length for _, length, _, _ in parts)
        assert [k for offset, m, _, _ in sorted(parts) for k in range(offset, offset + m)] == list(range(n)) and n <= 4096
        assert {p[2:] for p in parts} == {(n, n if n in {1 << k for k in range(13)} else 4096)}
    total = sum(map(len, ids.values()))
    assert len(sequences) <= total / 4096 * 1.05 + 1


def test_op7(spark, docs):
    order = sorted(((i, t or "") for i, t, _, _ in docs), reverse=True)
    components = {i: c for i, _, c in slow_likeness_components([(i, t) for i, t, _, _ in docs])}
    fps = {i: slow_fingerprint(t) for i, t in order}
    got = {r["doc_id"]: r for r in result(spark, "op7_fingerprints")}
    assert len(got) == len(docs)
    for (i, text), (after, other) in zip(order, [*order[1:], order[0]], strict=True):
        n = len(text) // 3
        edited = text[: len(text) - n] + other[:n]
        fp, r = edit_fingerprint.fingerprints_of([edited])[0], got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fps[i].hex(), fp.hex())
        assert r["near_edited"] == sum(a == b for a, b in zip(fps[i], fp, strict=True)) / len(fp)
        assert r["near_next"] == sum(a == b for a, b in zip(fps[i], fps[after], strict=True)) / len(fp)
        assert r["component_id"] == components[i]


def test_op8(spark, docs):
    by = defaultdict(list)
    rows = result(spark, "op8_mixing")
    sources = {i: s for i, _, _, s in docs}
    texts = {i: t for i, t, _, _ in docs}
    for r in rows:
        by[sources[r["doc_id"]]].append(r)
        assert r["size"] == len((texts[r["doc_id"]] or "").encode().split())
        assert r["taken"] == r["size"] * len(r["shards"]) <= 2 * r["size"] and len(r["places"]) == len(r["shards"])
    assert sorted(r["doc_id"] for r in rows) == sorted(sources)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    for s, size, target in zip(names, sizes, slow_targets(sizes, [(3.0, 1.0, 2.0)[k % 3] for k in range(len(names))]), strict=True):
        assert {r["source_size"] for r in by[s]} == {size} and by[s][0]["target"] == pytest.approx(target)
        assert abs(sum(r["taken"] for r in by[s]) - target) <= max(r["size"] for r in by[s])
    key = lambda r: r["doc_id"]
    assert sorted(rows, key=key) == sorted(result(spark, "op8_mixing"), key=key)


def test_op10(spark, docs):
    ids = [[*x, 0] for x in whole_ids("byte_bpe_50k.json", [t for _, t, _, _ in docs])]
    starts = np.cumsum([0, *map(len, ids)])[:-1].tolist()
    want = [(i, s, len(x), crc(x)) for (i, *_), s, x in zip(docs, starts, ids, strict=True)]
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in result(spark, "op10_token_records")) == want

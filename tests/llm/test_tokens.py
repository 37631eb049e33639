import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexigrid.llm import _tokens, packing, token_records

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def whole(path, texts):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", FILES)
def test_stretches_give_the_ids_of_whole_texts(small, odd, name):
    rng = random.Random(1)
    signs = "abcdeE é'’s t.,!\n\t\r \x85\xa0 　́ÅÅ12½\x1c<|endoftext|>\U0001f600中​ẞİΣς\x00ŉǆﬁ"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["<|endoftext|> <|startoftext|>", " ", " \n", "\n\n a", "a  \n  b", "don't 's", *(r.text or "" for r in odd.collect()), *(r.text for r in small.collect())]
    path = public_tokenizers.path(name)
    for remembered in (_tokens.REMEMBERED, 50):
        assert _tokens.Encoder(path, remembered).encode(texts) == whole(path, texts)


def test_records_there_and_back(odd, small, empty):
    path = public_tokenizers.path(FILES[0])
    for docs in (odd, small.repartition(5)):
        manifest = token_records.write_records(docs, path, 0)
        rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        ids = [x + b"\0\0\0\0" for x in whole(path, [t for _, t in rows])]
        starts = np.cumsum([0, *(len(x) // 4 for x in ids)])[:-1].tolist()
        got = sorted(((r.start, r.doc_id, bytes(r.ids)) for r in token_records.read_records(manifest).collect()))
        assert got == [(s, i, x) for s, (i, _), x in zip(starts, rows, ids, strict=True)]
    assert token_records.read_records(token_records.write_records(empty, path, 0)).count() == 0


def test_damage_is_seen():
    record = token_records.framed(b"payload")
    assert token_records.unframed(b"xx" + record, 2) == (b"payload", 2 + len(record))
    for k in range(len(record)):
        torn = bytearray(record)
        torn[k] ^= 1
        with pytest.raises((ValueError, MemoryError, OverflowError)):
            token_records.unframed(bytes(torn))


def check_packed(rows, capacity=4096):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for r in rows:
        n = sum(length for _, length in sequences[r.sequence_id])
        assert r.sequence_length == n and r.padded_length == (n if n.bit_count() == 1 else capacity)
    assert sorted(sequences) == list(range(len(sequences)))
    return sequences


def test_packing(odd, small, empty):
    path = public_tokenizers.path(FILES[1])
    for docs in (odd, small):
        pieces = packing.token_pieces(docs, path, 2)
        placed = packing.pack(pieces).collect()
        sequences = check_packed(placed)
        total = sum(r.length for r in placed)
        assert len(sequences) <= total / 4096 * 1.02 + 1
        want = [x + b"\2\0\0\0" for x in whole(path, [r.text for r in docs.orderBy("doc_id").collect()])]
        assert total == sum(len(x) for x in want) // 4
        whole_docs = defaultdict(dict)
        for r in placed:
            whole_docs[r.doc_id][r.start] = bytes(r.ids)
        if docs is small:
            ids = [r.doc_id for r in docs.orderBy("doc_id").collect()]
            assert [b"".join(x for _, x in sorted(whole_docs[i].items())) for i in ids] == want
    assert packing.pack(packing.token_pieces(empty, path, 2)).count() == 0


def test_sequences_hold_their_pieces(small):
    placed = packing.pack(packing.token_pieces(small, public_tokenizers.path(FILES[1]), 2).drop("doc_tokens")).cache()
    parts = defaultdict(dict)
    for r in placed.collect():
        parts[r.sequence_id][r.offset] = bytes(r.ids)
    for r in packing.packed_sequences(placed).collect():
        assert bytes(r.ids) == b"".join(x for _, x in sorted(parts[r.sequence_id].items()))
        assert sum(r.lengths) == len(r.ids) // 4


def test_histograms():
    rng = random.Random(3)
    for capacity in (1, 7, 64, 500):
        for _ in range(20):
            histogram = {rng.randint(1, capacity): rng.randint(1, 400) for _ in range(rng.randint(1, 12))}
            groups = packing.shortest_pack_first(histogram, capacity)
            placed = defaultdict(int)
            for packs, runs in groups:
                assert sum(n * c for n, c in runs) <= capacity
                for n, c in runs:
                    placed[n] += packs * c
            assert placed == histogram
            layout, seen = packing.Layout(groups), set()
            for n, count in histogram.items():
                seqs, offsets, _ = layout.place(np.full(count, n), np.arange(count))
                seen |= {(s, o + k) for s, o in zip(seqs.tolist(), offsets.tolist(), strict=True) for k in range(n)}
            assert len(seen) == sum(n * c for n, c in histogram.items()) and max(s for s, _ in seen) == layout.sequences - 1
    with pytest.raises(ValueError, match="not in 1..4"):
        packing.shortest_pack_first({5: 1}, 4)


def test_a_hot_length_and_extra_columns(spark):
    rows = [(k % 3, 5 if k % 3 else 1 + k % 9, 0, 7, "x") for k in range(300)]
    pieces = spark.createDataFrame(rows, "doc_id long, length int, start long, part long, sequence_id string").repartition(6)
    packed = packing.pack(pieces, capacity=16)
    assert packed.columns == ["doc_id", "length", "start", "part", "sequence_id", "offset", "sequence_length", "padded_length"]
    check_packed(packed.collect(), 16)
    assert zlib.crc32(b"") == 0

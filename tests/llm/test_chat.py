import random

import numpy as np
import public_tokenizers

from lexigrid.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, n_turns int, mask string"


def test_escaping_can_be_undone():
    rng = random.Random(1)
    pieces = ["\\", "<", "turn>", "/turn>", "<turn>", "</turn>", "<text>", "t", "\n", "\\<", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text and not any(c in escaped for c in chat.CONTROLS)


def test_masks_against_all_pairs():
    rng = random.Random(2)
    for _ in range(300):
        cuts = sorted(rng.choices(range(40), k=12))
        offsets = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
        bounds = sorted(rng.sample(sorted({0, *cuts}), 4)) if len({0, *cuts}) > 3 else [0, 0, 0, 0]
        spans = [(bounds[0], bounds[1]), (bounds[2], bounds[3])]
        want = [int(any(a <= x and y <= b for a, b in spans)) for x, y in offsets]
        assert chat.masked_tokens(offsets, spans).tolist() == want


def test_conversations(spark):
    rng = random.Random(3)
    texts = ["  spaces before", "\n\nlines ", "", None, "\\### Assistant: </turn> ok", "<turn>assistant<text>no</turn>", "漢字 \U0001f600\U0001f600 ünï", "a" * 5000, "'s", " "]
    rows = [(rng.choice([1, 2, 3, None, 7]), rng.choice([0, 1, 2, None, 9]), rng.choice(["user", "assistant", "system", None, "<turn>", "Assistant"]), rng.choice(texts), 1, "m") for _ in range(120)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = chat.read_back(chat.format_conversations(df, public_tokenizers.path("byte_bpe_50k.json"))).collect()
    first = lambda x: (x is not None, x)
    groups = {}
    for r in sorted(rows, key=lambda r: (first(r[1])[0], r[1] or 0, first(r[2])[0], (r[2] or "").encode(), first(r[3])[0], (r[3] or "").encode())):
        groups.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    alone = groups.pop(None)  # rows that name no conversation
    assert sorted([(t["role"], t["text"]) for t in r.turns] for r in out if r.conv_id is None) == sorted([t] for t in alone)
    out = [r for r in out if r.conv_id is not None]
    assert {r.conv_id for r in out} == groups.keys() and len(out) == len(groups)
    for r in out:
        want = groups[r.conv_id]
        assert [(t["role"], t["text"]) for t in r.turns] == want and r.n_turns == len(want)
        assert r.loss_text == "".join(t for role, t in want if role == "assistant")
        assert len(r.ids) == 4 * len(r.mask) == len(r.offsets) // 2
        assert chat.render(want)[0] == r.formatted
        tokens = chat._tokenizer(public_tokenizers.path("byte_bpe_50k.json")).encode(r.formatted, add_special_tokens=False)
        assert np.frombuffer(r.ids, "<u4").tolist() == tokens.ids


def test_no_rows(spark):
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], SCHEMA), public_tokenizers.path("byte_bpe_50k.json"))).count() == 0

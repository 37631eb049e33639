"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: for each turn TURN, role, TEXT, text, END. In roles and texts the control strings are escaped, and
that can be undone: backslashes are doubled, then one goes in after the "<" of each control string; a single backslash is therefore
always one that was put in. The tokenizer gets the control strings as added tokens, so none of its tokens spans one. The rendered
conversation is encoded once, with offsets. The spans of the assistants' texts and of the tokens are both sorted; binary searches find
the tokens that lie in each turn's span, and these make up the loss mask.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _tokens  # noqa: F401  (before tokenizers, whose threads it turns off)
from ._base import col, fresh

from tokenizers import AddedToken, Tokenizer  # noqa: E402, I001

TURN, TEXT, END = "<turn>", "<text>", "</turn>"
CONTROLS = (TURN, TEXT, END)
ASSISTANT = "assistant"
_CONTROL = re.compile("<(?=" + "|".join(re.escape(c[1:]) for c in CONTROLS) + ")")
_ESCAPE = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendered conversation, and the span of each assistant's text, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        own = escape(text)
        parts += (TURN, escape(role), TEXT, own, END)
        begin = at + len(TURN) + len(parts[-4]) + len(TEXT)
        if role == ASSISTANT:
            spans.append((begin, begin + len(own)))
        at = begin + len(own) + len(END)
    return "".join(parts), spans


def parse(rendered: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    out = []
    for turn in rendered.split(END)[:-1]:
        role, _, text = turn[len(TURN) :].partition(TEXT)
        out.append((unescape(role), unescape(text)))
    return out


@lru_cache(2)
def _tokenizer(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenizer.add_tokens([AddedToken(c, special=False, normalized=False) for c in CONTROLS])
    return tokenizer


def masked_tokens(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for each token that lies in a span. Tokens and spans are in order; tokens that share a character have the same offsets."""
    begins, ends = [a for a, _ in offsets], [b for _, b in offsets]
    mask = np.zeros(len(offsets), "u1")
    for a, b in spans:
        mask[bisect_left(begins, a) : bisect_right(ends, b)] = 1
    return mask


def _formatter(path: str):
    def format_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)

        def rows(found: list[tuple]) -> pa.RecordBatch:
            shown = [render(turns) for _, turns in found]
            encoded = tokenizer.encode_batch([text for text, _ in shown], add_special_tokens=False)
            out = []
            for (key, turns), (text, spans), e in zip(found, shown, encoded, strict=True):
                offsets = e.offsets
                out.append((key, len(turns), text, np.array(e.ids, "<u4").tobytes(), masked_tokens(offsets, spans).tobytes(), np.array(offsets, "<u4").tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "formatted", "ids", "mask", "offsets"])

        key, turns, started, done, size = None, [], False, [], 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not started or conv is None or conv != key:
                    if started:
                        done.append((key, turns))
                        if size > 1 << 20:
                            yield rows(done)
                            done, size = [], 0
                    key, turns, started = conv, [], True
                turns.append((role or "", text or ""))
                size += len(text or "")
        if started:
            done.append((key, turns))
        if done:
            yield rows(done)

    return format_all


def format_conversations(turns: DataFrame, tokenizer: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each conversation: conv_id, n_turns, formatted (text), ids (little-endian unsigned 32-bit), mask (a byte a token, 1 for
    loss), offsets (two little-endian unsigned 32-bit code-point offsets a token).

    Turns are in order of turn (nulls first), those that repeat one by role and text. Null roles and texts are empty. A row that names no
    conversation is one of its own. Ids must be integers. Only the role "assistant", in just this spelling, is under the mask. No rows:
    no conversations. Control strings of the tokenizer itself that stand in a text are ordinary text. Conversations are dealt by their id,
    rows without one by their texts; a task holds one conversation, which has to fit in a row of the result, and about a million code
    points of others at a time.
    """
    plain = turns.select(col(conv_col).cast("bigint").alias("conv"), col(role_col).cast("string").alias("role"), col(text_col).cast("string").alias("text"), col(turn_col).alias("turn"))
    alone = F.when(F.col("conv").isNull(), F.xxhash64("turn", "role", "text"))
    ordered = plain.withColumn("alone", alone).repartition("conv", "alone").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    return ordered.mapInArrow(_formatter(tokenizer), "conv_id bigint, n_turns bigint, formatted string, ids binary, mask binary, offsets binary")


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns (array of role and text, from the formatted text) and loss_text (what the tokens under the mask cover, taken
    from the formatted text by their offsets and unescaped)."""

    def read(texts: pa.Array, masks: pa.Array, offsets: pa.Array) -> pa.Array:
        turns, losses = [], []
        for text, mask, spans in zip(texts.to_pylist(), masks.to_pylist(), offsets.to_pylist(), strict=True):
            turns.append([{"role": r, "text": t} for r, t in parse(text)])
            own = np.frombuffer(spans, "<u4").reshape(-1, 2)[np.frombuffer(mask, "u1") == 1]
            parts, last = [], 0
            for a, b in own.tolist():  # tokens that share a character cover it once
                if b > last:
                    parts.append(text[max(a, last) : b])
                    last = b
            losses.append(unescape("".join(parts)))
        kind = pa.struct([("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("loss_text", pa.string())])
        return pa.array([{"turns": t, "loss_text": x} for t, x in zip(turns, losses, strict=True)], kind)

    kind = T.StructType().add("turns", T.ArrayType(T.StructType().add("role", "string").add("text", "string"))).add("loss_text", "string")
    (out,) = fresh(formatted, "read")
    done = formatted.withColumn(out, F.arrow_udf(read, kind)("formatted", "mask", "offsets"))
    return done.select(*[col(c) for c in formatted.columns], F.col(out)["turns"].alias("turns"), F.col(out)["loss_text"].alias("loss_text"))

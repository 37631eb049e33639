"""Subword encoding with truncation, padding and masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basic_tokens

#: The first ids.
SPECIAL = ("[PAD]", "[UNK]", "[CLS]", "[SEP]")
MAX_LENGTH = 512
#: Longer words are unknown.
LONGEST_WORD = 100


def base_tokens() -> list[str]:
    """What any vocabulary begins with: the special tokens, a to z and 0 to 9 at a word's start and within one (##), ASCII signs."""
    single = "abcdefghijklmnopqrstuvwxyz0123456789"
    signs = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    return [*SPECIAL, *single, *(f"##{c}" for c in single), *signs]


def build_vocabulary(docs: DataFrame, text_col: str = "text", size: int = 30_000) -> list[str]:
    """A deterministic vocabulary: base_tokens(), then the most frequent words, ties in code-point order, up to size. No pretrained
    vocabulary is at hand, so ids differ from one's."""
    base = base_tokens()
    words = docs.select(F.explode(basic_tokens(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    top = words.where(F.length("word") > 1).orderBy(F.desc("n"), "word").limit(max(0, size - len(base))).collect()  # at most size words
    return [*base, *(r["word"] for r in top)]


class WordPieces:
    """Greedy longest match first over a vocabulary."""

    def __init__(self, vocabulary: list[str]):
        self.ids = {token: k for k, token in enumerate(vocabulary)}
        self.longest = max(map(len, vocabulary))
        self.known: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        found = self.known.get(word)
        if found is None:
            found, at = [], 0
            if len(word) > LONGEST_WORD:
                found, at = [self.ids["[UNK]"]], len(word)
            while at < len(word):
                for end in range(min(len(word), at + self.longest), at, -1):
                    piece = self.ids.get(word[at:end] if not at else f"##{word[at:end]}")
                    if piece is not None:
                        found.append(piece)
                        at = end
                        break
                else:
                    found = [self.ids["[UNK]"]]
                    break
            if len(self.known) < 200_000:
                self.known[word] = found
        return found

    def encode(self, words: list[str], most: int = MAX_LENGTH) -> list[int]:
        """[CLS], at most most - 2 pieces, [SEP]; what is cut off is never matched."""
        out = [self.ids["[CLS]"]]
        for word in words:
            out += self.word(word)
            if len(out) >= most - 1:
                break
        return [*out[: most - 1], self.ids["[SEP]"]]


def encoder(vocabulary: list[str], length: int = MAX_LENGTH):
    """A vectorised column function: basic tokens -> struct of input_ids (of this length, padded) and attention_mask. A task builds its
    table of pieces once."""

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = WordPieces(vocabulary)
        for words in batches:
            ids, mask = np.zeros((len(words), length), "i4"), np.zeros((len(words), length), "i4")
            for k, some in enumerate(words.to_pylist()):
                own = pieces.encode(some, length)
                ids[k, : len(own)] = own
                mask[k, : len(own)] = 1
            offsets = pa.array(np.arange(len(words) + 1, dtype="i4") * length)
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(a.ravel())) for a in (ids, mask)], names=["input_ids", "attention_mask"])

    return F.arrow_udf(encode, "struct<input_ids: array<int>, attention_mask: array<int>>")


def encode_batch(data: DataFrame, vocabulary: list[str], text_col: str = "text", length: int = MAX_LENGTH) -> DataFrame:
    """data with input_ids and attention_mask. Take and project rows before this; the filter and limit do not pass it. Texts are cut into
    words by column expressions; no more words than fit go to Python, as each gives a piece at least."""
    words = F.slice(basic_tokens(F.col(text_col)), 1, max(1, length - 2))
    encoded = data.withColumn("_encoded", encoder(vocabulary, length)(words))
    return encoded.select(*data.columns, "_encoded.input_ids", "_encoded.attention_mask")


def mask_from_length(n: Column, length: int = MAX_LENGTH) -> Column:
    """1 for each real token, 0 for padding."""
    real = F.least(n, F.lit(length)).cast("int")
    return F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), F.lit(length) - real))

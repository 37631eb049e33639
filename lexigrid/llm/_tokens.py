"""Whole-text encoding with the tokenizers library, each distinct stretch of a text encoded once per worker.

A text is cut only where no token of its tokenizer can span: before white space that follows other characters, and between a
Latin letter and ASCII punctuation. The pre-tokenizers known here never match across either, and what they match depends on nothing before
its start, so the ids of the stretches, joined, are the ids of the whole text (the tests compare them). A tokenizer of another make
encodes whole texts.

Control strings of a tokenizer (such as the string of its end id) are ordinary text where a text holds them: encode_special_tokens is
set, as the vocabulary files' own description has it. With the library's default they would become control ids, and a document could end
another.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402

#: Unicode's White_Space.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters up to U+024F whose lower case and composed form are letters again (U+0130 gives a mark).
LATIN = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_RUN = f"[{LATIN}]++(?=[!-/:-@\\[-`{{-~{WHITE}]|\\Z)|[^{WHITE}]+"
_GLUED = re.compile(f"[{WHITE}]*(?:{_RUN})|[{WHITE}]+")
_WORDS = re.compile(_RUN)
_PLAIN = re.compile(f" ?[{LATIN}]+").fullmatch
#: The characters by which byte-level tokenizers write bytes: printable ones stand for themselves, the others for those from 256 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: Stretches that a worker remembers: up to twice as many, as the last so many are kept when they are full. Longer stretches are not.
REMEMBERED = 350_000
LONGEST = 64
#: Code points of the texts whose stretches are looked up together.
TOGETHER = 1 << 19


def _cutter(spec: dict) -> re.Pattern | None:
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return _GLUED
    first = (pre.get("pretokenizers") or [{}])[0]
    norms = [n["type"] for n in (norm or {}).get("normalizers", [])]
    if first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"[^\s" in first["pattern"].get("Regex", "") and set(norms) <= {"NFC", "Replace", "Lowercase"}:
        return _WORDS
    return None


class Encoder:
    """encode(texts): for each text its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            self.cut = _cutter(json.load(f))
        self.known: dict[str, bytes] = {}
        self.last: dict[str, bytes] = {}

    def _ids(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _new(self, parts: list[str]) -> dict[str, bytes]:
        """What the parts encode to. One that is letters and a space before them at most is one pre-token: it goes to the merges at once."""
        merge, lower, out, rest = self.tokenizer.model.tokenize, self.cut is _WORDS, {}, []
        for p in parts:
            if _PLAIN(p):
                out[p] = array("I", [t.id for t in merge((p.lower() if lower else p).encode().decode("latin-1").translate(_BYTE_CHARS))]).tobytes()
            else:
                rest.append(p)
        out.update(zip(rest, self._ids(rest), strict=True))
        return out

    def _some(self, texts: list[str]) -> list[bytes]:
        cut = [self.cut.findall(text) for text in texts]
        found = [list(map(self.known.get, parts)) for parts in cut]
        holes = [[i for i, ids in enumerate(own) if ids is None] if None in own else () for own in found]
        missing = {parts[i] for parts, own in zip(cut, holes, strict=True) for i in own}
        new = {p: self.last[p] for p in missing if p in self.last}
        new.update(self._new([p for p in missing if p not in new]))
        for parts, ids, own in zip(cut, found, holes, strict=True):
            for i in own:
                ids[i] = new[parts[i]]
        if len(self.known) > self.remembered:
            self.last, self.known = self.known, {}
        self.known.update((p, ids) for p, ids in new.items() if len(p) <= LONGEST)
        return [b"".join(ids) for ids in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.cut is None:
            return self._ids(texts)
        out, some, size = [], [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size > TOGETHER:
                out += self._some(some)
                some, size = [], 0
        return out + self._some(some)


@lru_cache(2)
def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """One for each worker and path."""
    return Encoder(path, remembered)

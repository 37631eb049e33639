"""Column functions on texts and file names. All of them run inside generated code."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokenize(text: Column, unicode: bool = False) -> Column:
    """Lower-cased words: runs of a-z and 0-9, or of all letters and digits with unicode. Null gives no words."""
    apart = r"[^\p{L}\p{N}]+" if unicode else "[^a-z0-9]+"
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), apart), lambda word: word != "")


#: The classes by which a BERT-style tokenizer cuts, in the notation that Java's, DuckDB's and Python's engines share. What is
#: dropped, what counts as punctuation beside Unicode's (ASCII signs), and the blocks whose characters are words of their own.
CONTROLS = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f\\p{Cf}\ufffd]+"
SIGNS = "!-/:-@\\[-`{-~\\p{P}"
IDEOGRAPHS = "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0002a6df\U0002a700-\U0002ceaf\U0002f800-\U0002fa1f"
BASIC_TOKEN = f"[{SIGNS}{IDEOGRAPHS}]|[^\\t\\n\\r\\p{{Z}}{SIGNS}{IDEOGRAPHS}]+"


@lru_cache(1)
def _accented() -> tuple[str, str]:
    """Letters that are another letter with marks (by canonical decomposition), and that letter."""
    pairs = []
    for c in map(chr, range(0xC0, 0x2000)):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and all(unicodedata.category(m) == "Mn" for m in marks) and c == c.lower():
            pairs.append((c, base))
    return "".join(c for c, _ in pairs), "".join(base for _, base in pairs)


def basic_tokens(text: Column) -> Column:
    """What a BERT-style tokenizer cuts into pieces: lower-cased words without accents, and each sign or ideograph by itself. Null gives
    no tokens."""
    plain = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), CONTROLS, ""))
    plain = F.regexp_replace(F.translate(plain, *_accented()), r"\p{Mn}+", "")
    return F.regexp_extract_all(plain, F.lit(BASIC_TOKEN), F.lit(0))


def strip_markers(body: Column) -> Column:
    """Without bracketed renderer marks such as [x.gif] and without FRAME: lines."""
    return F.regexp_replace(F.regexp_replace(body, r"\[[^\]\n]*\]", " "), r"(?m)^\s*FRAME:.*$", "")


def join_path(*parts: Column | str) -> Column:
    return F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def stem_and_extension(name: Column) -> tuple[Column, Column]:
    """Cut at the last dot that follows another character than a dot: .png has no extension, a.b.png has .png."""
    pattern = r"^(\.*[^.].*?)(\.[^.]*)?$"
    only_dots = name.rlike(r"^\.*$")
    return F.when(only_dots, name).otherwise(F.regexp_extract(name, pattern, 1)), F.when(only_dots, F.lit("")).otherwise(F.regexp_extract(name, pattern, 2))


def has_suffix(name: Column, suffix: str = ".png") -> Column:
    """Case counts; a name that is nothing but the suffix has it."""
    return name.endswith(suffix)


def four_decimals(value: Column) -> Column:
    return F.format_string("%.4f", value)

"""Licence scan by sentence rules, in column expressions only.

A text is cut into pieces at sentence marks and line ends, each normalised to its ASCII letters and digits, lower-cased, so comment signs
are gone. A known licence sentence is one piece, or successive lines that make it up: licence texts are wrapped at any width. It becomes
its identifier, other pieces are gaps. A rule is an ordered sequence of identifiers that stand for a licence; it matches where they
follow one another without a gap. Where a longer rule matches, the rules within it do not (BSD-3-Clause begins as BSD-2-Clause does). The
first sentence of a longer text is not that licence yet: without the rest it is reported as a fragment. The known sentences and rules are
the fixed tables below, which make one regular expression and a map literal, so a document's scan is one projection without join or
shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import col, fresh

#: Known sentences of public licences and notices, by identifier, as CUT leaves them (v. ends one).
SENTENCES = {
    "apache-ref": "Licensed under the Apache License, Version 2.0",
    "apache-head": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-copy-https": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "apache-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache-terms": "See the License for the specific language governing permissions and limitations under the License",
    "mit-ref": "Released under the MIT License",
    "mit-ref-licensed": "Licensed under the MIT License",
    "mit-ref-work": "This work is licensed under the MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "gpl3-ref": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-ref-licensed": "Licensed under the GNU General Public License, version 3",
    "gpl2-ref": "This work is licensed under the GNU General Public License, version 2",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-details": "See the GNU General Public License for more details",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-ref": "Released under the BSD License",
    "mpl-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "two-zero": "2.0",
    "cc-by-nc-ref": "Licensed under CC BY-NC 4.0",
    "cc-by-nc-work": "This work is licensed under CC BY-NC 4.0",
    "cc-by-ref": "Licensed under CC BY 4.0",
    "cc-by-sa-ref": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc0-ref": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "spdx-apache": "SPDX-License-Identifier: Apache-2.0",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-gpl3": "SPDX-License-Identifier: GPL-3.0-only",
    "spdx-gpl3-later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "spdx-bsd3": "SPDX-License-Identifier: BSD-3-Clause",
}
#: Sentences with a gap beside those; ANY stands for 1 to 12 words.
ANY = "*"
MORE_SENTENCES = {
    "mit-liability": "IN NO EVENT SHALL * BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "x11-name": "Except as contained in this notice, the name of * shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization",
    "bsd-neither": "Neither the name of * may be used to endorse or promote products derived from this software without specific prior written permission",
}
#: Ordered rules, each a licence and the identifiers that must follow one another. Where one matches, no shorter one matches
#: within it.
RULES = (
    ("X11", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability", "x11-name")),
    ("Apache-2.0", ("apache-head", "apache-copy")),
    ("Apache-2.0", ("apache-head", "apache-copy-https")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-neither")),
    ("MPL-2.0", ("mpl-form", "two-zero")),
    ("Unlicense", ("unlicense",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("Apache-2.0", ("spdx-apache",)),
    ("MIT", ("spdx-mit",)),
    ("GPL-3.0-only", ("spdx-gpl3",)),
    ("GPL-3.0-or-later", ("spdx-gpl3-later",)),
    ("BSD-3-Clause", ("spdx-bsd3",)),
    ("Apache-2.0", ("apache-ref",)),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-ref-licensed",)),
    ("MIT", ("mit-ref-work",)),
    ("GPL-3.0-only", ("gpl3-ref",)),
    ("GPL-3.0-only", ("gpl3-ref-licensed",)),
    ("GPL-2.0-only", ("gpl2-ref",)),
    ("BSD", ("bsd-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-work",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-long",)),
    ("CC-BY-4.0", ("cc-by-ref",)),
    ("CC-BY-4.0", ("cc-by-long",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-ref",)),
)
#: First sentences of longer texts, and what they begin. Of a text with such a licence none is a fragment.
FRAGMENTS = (
    ("Apache-2.0", "apache-head", ("Apache-2.0",)),
    ("MIT", "mit-grant", ("MIT", "X11")),
    ("GPL-3.0-or-later", "gpl-free", ("GPL-3.0-or-later",)),
    ("GPL-2.0-or-later", "gpl2-free", ("GPL-2.0-or-later",)),
    ("BSD", "bsd-grant", ("BSD", "BSD-2-Clause", "BSD-3-Clause")),
)
#: A piece ends with such marks before white space, or with its line; "2.0" does not end one. A semicolon or colon ends none.
MARK = r"[.!?]+[ \t\r\n]+"


def between(line: str) -> str:
    """What stands between the words of a sentence: a space, or a line end and comment signs of letters. line: what stands for a line end."""
    return f"(?: |{line}(?:(?:rem|dnl|c)(?: |{line}))*)"


def label(line: str, stop: str) -> str:
    """What may stand before a sentence: comment signs, a number in a list."""
    return f"(?:(?:rem|dnl|c)(?: |{line}))*(?:(?:[0-9]{{1,2}}|[a-z]|i{{1,3}}|iv)(?: |{line}|{stop}))?"


def normalised(sentence: str) -> str:
    """What the column expression makes of a known sentence."""
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in sentence.lower()).strip()


def known_sentences() -> dict[str, str]:
    return {" ".join(normalised(text).split()): name for name, text in SENTENCES.items()}


def sentences(text: Column) -> Column:
    """The normalised pieces in order, those without a letter or digit left out, as one string: after a sentence mark stands a |, after
    another line end a /, and a | at both ends."""
    lines = lambda s: F.regexp_replace(F.regexp_replace(s, "[^a-z0-9\n]+", " "), " ?\n[ \n]*", "/")
    whole = F.filter(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), MARK), lambda s: F.btrim(lines(s), F.lit(" /"))), lambda s: s != "")
    return F.concat(F.lit("|"), F.array_join(whole, "|"), F.when(F.size(whole) > 0, F.lit("|")).otherwise(F.lit("")))


def known_choice(line: str = "/") -> str:
    """Matches a known sentence; of several the longest."""
    known = [text.split() for text in known_sentences()]
    known += [[ANY if word == ANY else normalised(word) for word in text.split()] for text in MORE_SENTENCES.values()]
    gap = between(line)
    some = [gap.join(f"[a-z0-9]+(?:{gap}[a-z0-9]+){{0,11}}?" if word == ANY else word for word in words) for words in sorted(known, key=lambda w: -len(w))]
    return "|".join(some)


def known_pattern() -> str:
    """Matches a known sentence, its first group, with the boundary before it."""
    return f"[|/]{label('/', '[|]')}({known_choice()})(?=[|/])"


def beginnings() -> list[tuple[str, str]]:
    """How the sentences with gaps begin, and their identifiers."""
    return [(normalised(text.split(f" {ANY}")[0]).replace("  ", " "), name) for name, text in MORE_SENTENCES.items()]


def rules_of_several() -> list[tuple[str, tuple[str, ...]]]:
    """The rules of several sentences, the longest first."""
    return sorted((r for r in RULES if len(r[1]) > 1), key=lambda r: -len(r[1]))


def path_of(rule: tuple[str, ...]) -> str:
    return f"|{'|'.join(rule)}|"


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of docs, and: sentence_ids (the identifiers found, in order), licenses (of the rules that match, in rule order, each
    once), fragments (licences of which only the beginning is there), n_sentences (pieces with a letter or digit).

    A null or empty text has no sentences and no licences. A sentence that occurs twice is found twice. Rows are judged each by itself,
    whole texts however long. Input columns of these names are replaced. An empty table gives an empty table.
    """
    docs = docs.drop("sentence_ids", "licenses", "fragments", "n_sentences")
    cut, ids, path, rest, held = fresh(docs, "pieces", "ids", "path", "rest", "held")
    known = F.create_map(*[F.lit(x) for pair in known_sentences().items() for x in pair])

    def identifier(found: Column) -> Column:
        line = F.regexp_replace(found, between("/"), " ")
        return F.coalesce(F.element_at(known, line), *[F.when(line.startswith(start), F.lit(name)) for start, name in beginnings()])

    texts = docs.withColumn(cut, sentences(col(text_col).cast("string")))
    found = texts.withColumn(ids, F.transform(F.regexp_extract_all(cut, F.lit(known_pattern()), F.lit(1)), identifier))
    # neighbours stay neighbours in the path: an unknown piece is a gap
    gaps = F.split(F.translate(F.regexp_replace(F.regexp_replace(F.col(cut), known_pattern(), "|="), "[^|=/]+", ""), "/", "|"), "=")
    found = found.withColumn(path, F.array_join(F.zip_with(gaps, F.col(ids), lambda gap, i: F.concat(gap, F.coalesce(i, F.lit("")))), ""))
    # a long rule that matches becomes its licence's name, so that no rule within it does
    long = rules_of_several()
    found = found.withColumn(rest, reduce(lambda p, rule: F.replace(p, F.lit(path_of(rule[1])), F.lit(f"|<{rule[0]}>|")), long, F.col(path)))
    by_license: dict[str, list[Column]] = {}
    for name, rule in RULES:
        by_license.setdefault(name, []).append(F.col(rest).contains(f"|<{name}>|" if len(rule) > 1 else path_of(rule)))
    hits = F.array(*[F.when(reduce(Column.__or__, some), F.lit(name)) for name, some in by_license.items()])
    found = found.withColumn(held, F.filter(hits, lambda x: x.isNotNull()))
    begun = F.array(*[F.when(F.array_contains(ids, first) & ~F.arrays_overlap(F.col(held), F.array(*map(F.lit, whole))), F.lit(name)) for name, first, whole in FRAGMENTS])
    n = F.length(F.col(cut)) - F.length(F.translate(cut, "|/", "")) - 1
    return found.select(*[col(c) for c in docs.columns], F.col(ids).alias("sentence_ids"), F.col(held).alias("licenses"), F.filter(begun, lambda x: x.isNotNull()).alias("fragments"), n.cast("bigint").alias("n_sentences"))


def scan_sql() -> str:
    """The scan in DuckDB's SQL. Its regular expressions look at nothing that they do not take, so each boundary stands twice, and a text
    is read from boundary to boundary: a known sentence where there is one, else a piece."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    own = f"[|/]{label('//', '[|][|]')}({known_choice('//')})[|/]"
    known = ", ".join(f"({quoted(text)}, {quoted(name)})" for text, name in known_sentences().items())
    starts = " ".join(f"WHEN starts_with(line, {quoted(start)}) THEN {quoted(name)}" for start, name in beginnings())
    rest = "path"
    for name, rule in rules_of_several():
        rest = f"replace({rest}, {quoted(path_of(rule))}, {quoted(f'|<{name}>|')})"
    by_license: dict[str, list[str]] = {}
    for name, rule in RULES:
        by_license.setdefault(name, []).append(f"contains(rest, {quoted(f'|<{name}>|' if len(rule) > 1 else path_of(rule))})")
    licenses = ", ".join(f"CASE WHEN {' OR '.join(some)} THEN {quoted(name)} END" for name, some in by_license.items())
    begun = ", ".join(f"CASE WHEN contains(path, {quoted(f'|{first}|')}) AND NOT list_has_any(held, [{', '.join(map(quoted, whole))}]) THEN {quoted(name)} END" for name, first, whole in FRAGMENTS)
    return f"""
WITH known(line, name) AS (VALUES {known}),
numbered AS (SELECT row_number() OVER () AS r, doc_id, lower(coalesce(text, '')) AS low FROM documents),
cut AS (
  SELECT r, doc_id, list_filter(list_transform(regexp_split_to_array(low, '{MARK}'),
    lambda s: trim(regexp_replace(regexp_replace(s, '[^a-z0-9\n]+', ' ', 'g'), ' ?\n[ \n]*', '/', 'g'), ' /')), lambda s: s <> '') AS whole FROM numbered),
pieces AS (
  SELECT r, doc_id, '|' || replace(array_to_string(whole, '||'), '/', '//') || CASE WHEN len(whole) > 0 THEN '|' ELSE '' END AS cut,
    coalesce(list_sum(list_transform(whole, lambda s: 1 + length(s) - length(replace(s, '/', '')))), 0) AS n FROM cut),
items AS (
  SELECT r, unnest(found) AS item, generate_subscripts(found, 1) AS pos
  FROM (SELECT r, regexp_extract_all(cut, {quoted(f"{own}|[|/][^|/]+[|/]")}) AS found FROM pieces)),
lines AS (
  SELECT r, pos, regexp_replace(regexp_extract(item, {quoted(f"^{own}$")}, 1), {quoted(between('//'))}, ' ', 'g') AS line FROM items),
named AS (
  SELECT r, pos, coalesce(name, CASE {starts} END) AS name FROM lines LEFT JOIN known USING (line)),
paths AS (
  SELECT r, '|' || string_agg(coalesce(name, ''), '|' ORDER BY pos) || '|' AS path, string_agg(name, ',' ORDER BY pos) AS ids FROM named GROUP BY r),
judged AS (
  SELECT doc_id, n, coalesce(path, '|') AS path, coalesce(ids, '') AS ids, {rest} AS rest FROM pieces LEFT JOIN paths USING (r)),
held AS (SELECT *, list_filter([{licenses}], lambda x: x IS NOT NULL) AS held FROM judged)
SELECT doc_id, ids AS sentence_ids, coalesce(array_to_string(held, ','), '') AS licenses,
  coalesce(array_to_string(list_filter([{begun}], lambda x: x IS NOT NULL), ','), '') AS fragments, CAST(n AS BIGINT) AS n_sentences FROM held"""

import duckdb

from lexigrid.llm import license_scan
from lexigrid.llm.license_scan import FRAGMENTS, MORE_SENTENCES, RULES, SENTENCES, scan, scan_sql


def run(spark, *texts):
    rows = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    return [(r["sentence_ids"], r["licenses"], r["n_sentences"]) for r in rows]


def fragments(spark, *texts):
    return [r["fragments"] for r in scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]


def test_sentences_and_rules(spark):
    whole = "Intro here.\n" + ". ".join(SENTENCES[k] for k in ("mit-grant", "mit-notice", "mit-warranty")) + ".\nOther words."
    torn = f"{SENTENCES['mit-grant']}.\nSomething between. {SENTENCES['mit-notice']}."
    got = run(spark, whole, torn, "LICENSED under the  apache license,\tVersion 2.0!", "Released under the MIT License\nThis work is licensed under the GNU General Public License, version 3.", None, "", "...", "We released under the MIT License it all")
    assert got[0] == (["mit-grant", "mit-notice", "mit-warranty"], ["MIT"], 5)
    assert got[1] == (["mit-grant", "mit-notice"], [], 3)
    assert got[2] == (["apache-ref"], ["Apache-2.0"], 1)
    assert got[3] == (["mit-ref", "gpl3-ref"], ["MIT", "GPL-3.0-only"], 2)
    assert got[4] == got[5] == got[6] == ([], [], 0)
    assert got[7] == ([], [], 1)


def test_every_sentence_is_found_and_every_rule_has_its_sentences(spark):
    names = list(SENTENCES)
    got = run(spark, *(f"Before. {SENTENCES[n]}.\nAfter" for n in names))
    assert [g[0] for g in got] == [[n] for n in names]
    assert {s for _, rule in RULES for s in rule} <= {*names, *MORE_SENTENCES}


def test_every_rule_of_several_sentences_decides(spark):
    """Without one of its sentences the text is no such licence, or another one."""
    whole = {**SENTENCES, **{k: v.replace("*", "the holder") for k, v in MORE_SENTENCES.items()}}
    text = lambda rule: "Code. " + ". ".join(whole[k] for k in rule) + ". More"
    for name, rule in (r for r in RULES if len(r[1]) > 1):
        got = run(spark, text(rule), *(text(rule[:k] + rule[k + 1 :]) for k in range(len(rule))), text(rule[::-1]))
        assert got[0][:2] == (list(rule), [name])
        assert all(name not in licenses for _, licenses, _ in got[1:])
    assert fragments(spark, *(text((first,)) for _, first, _ in FRAGMENTS)) == [[name] for name, _, _ in FRAGMENTS]
    assert fragments(spark, *(text(rule) for _, rule in RULES)) == [[]] * len(RULES)


def test_only_column_expressions(odd, empty):
    out = scan(odd)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Exchange"))
    assert {"sentence_ids", "licenses", "n_sentences"} <= set(out.columns) and out.count() == odd.count()
    assert scan(empty).count() == 0 and license_scan.sentences is not None


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_wrapped_licence_texts(spark):
    whole = {"Apache-2.0": APACHE, "GPL-3.0-or-later": GPL3, "MIT": MIT, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3}
    signs = ("", "# ", "// ", " * ", "rem ", "\t;; ")
    texts = [f"Some code.\n{s}" + f"\n{s}".join(text.split("\n")) + "\nMore code" for text in whole.values() for s in signs]
    x11 = MIT + "\n\nExcept as contained in this notice, the name of the X Consortium shall not be\nused in advertising or otherwise to promote the sale, use or other dealings in this Software without\nprior written authorization."
    x11 = x11.replace("FOR ANY CLAIM.", "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN\nACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER\nDEALINGS IN THE SOFTWARE.")
    assert run(spark, x11)[0][1] == ["X11"]
    got = run(spark, *texts, BSD3.replace("\n", "\r\n"), BSD2 + "\nOther words.\n\n" + BSD3, BSD3.replace("1.", "(a)").replace("2.", "*").replace("3.", "iii)"))
    assert [g[1] for g in got] == [[name] for name in whole for _ in signs] + [["BSD-3-Clause"], ["BSD-2-Clause", "BSD-3-Clause"], ["BSD-3-Clause"]]
    assert [g[0] for g in got[:: len(signs)][:2]] == [["apache-head", "apache-copy", "apache-basis", "apache-terms"], ["gpl-free", "gpl-hope", "gpl-details"]]
    torn = APACHE.replace("You may obtain", "Other words stand here.\nYou may obtain")
    broken = "Released under the\nMIT License. Licensed under the\nother MIT License. Licensed under. The MIT License"
    assert [g[:2] for g in run(spark, torn, broken)] == [(["apache-head", "apache-copy", "apache-basis", "apache-terms"], []), (["mit-ref"], ["MIT"])]
    odd = ["1. \n| / a/b ||", "c rem x\n\nrem\n", "!!", "a.b. c", None, "", x11, "Neither the name of " + "w " * 13 + "may be used", MIT * 2, "rem " + GPL3.replace("\n", "\nrem c ")]
    rows = [*texts, *odd, torn, broken, BSD3.replace("\n", "\r\n"), BSD2 + "\nOther words.\n\n" + BSD3, *(f"{a}.\n{b}" for a in SENTENCES.values() for b in ("x", APACHE))]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, sentence_ids, licenses, fragments, n_sentences FROM ({scan_sql()})").fetchall()}
    for r in scan(df).collect():
        assert want[r["doc_id"]] == (",".join(r["sentence_ids"]), ",".join(r["licenses"]), ",".join(r["fragments"]), r["n_sentences"]), r["text"]

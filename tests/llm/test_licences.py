"""Licence sentences and rules."""

from pyspark.sql import functions as F

from funnelyard.llm import licences as L
from funnelyard.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"

MIT = """Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, and sell copies of the Software, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO FITNESS AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, ARISING FROM THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""


def scan(spark, texts):
    return [(r.sentence_ids, r.licences, r.unmatched) for r in L.scan_licences(spark.createDataFrame([(t,) for t in texts], "text string"), "text").collect()]


def test_query_finds_the_planted_lines_and_nothing_else(spark):
    planted = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
               "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op1_licence_sentences"](spark, SF).collect()
    assert len(rows) == len(text)
    for r in rows:
        expected = {name for line, name in planted.items() if line in text[r.doc_id]}
        assert set(r.licences.split(",")) - {""} == expected and r.n_unmatched == 0 and r.n_sentences == len(expected)


def test_a_whole_licence_wrapped_over_lines(spark):
    ids, licences, rest = scan(spark, [MIT])[0]
    assert ids == ["copyright-line", "mit-grant", "mit-notice", "mit-as-is", "mit-liability"]
    assert licences == ["MIT"] and rest == ["copyright-line"]


def test_licences_of_clauses_without_the_usual_words(spark):
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.
3. Neither the name of the X nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE X "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES OF ANY KIND ARE DISCLAIMED.
IN NO EVENT SHALL THE X BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED."""
    mpl = ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.\n"
           "If a copy of the MPL was not distributed with this file, You can obtain one at https://example.org/MPL/2.0/.")
    got = scan(spark, [bsd, mpl])
    assert got[0][1] == ["BSD-3-Clause"] and got[0][2] == [] and got[1][1] == ["MPL-2.0"] and got[1][2] == []


def test_comment_markers_and_case_do_not_matter(spark):
    text = " * LICENSED under the Apache License, Version 2.0 (the \"License\");\r\n * you may not use this file except in compliance with the License.\r\n"
    assert scan(spark, [text])[0][1] == ["Apache-2.0"]


def test_order_and_neighbourhood_count(spark):
    clauses = ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
               "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"]
    ids, licences, rest = scan(spark, [" ".join(clauses)])[0]
    assert ids == ["bsd-source", "bsd-redistribution"] and licences == [] and rest == ids


def test_several_licences_in_rule_order_once_each(spark):
    text = "Licensed under CC BY-NC 4.0. Released under the MIT License. Released under the MIT License."
    assert scan(spark, [text])[0] == (["cc-by-nc-4", "mit-released", "mit-released"], ["MIT", "CC-BY-NC-4.0"], [])


def test_unknown_sentences_are_told(spark):
    assert scan(spark, ["You need a licence from the king. Nothing here."])[0] == (["unknown"], [], ["unknown"])
    assert scan(spark, ["no stop here\nReleased under the MIT License"])[0][1] == ["MIT"]


def test_nulls_empty_long_and_repeated_texts(spark):
    long = "prose without end " * 50_000 + "\nReleased under the MIT License.\n" + "more\n" * 5_000
    got = scan(spark, [None, "", long, "plain", "plain"])
    assert got == [([], [], []), ([], [], []), (["mit-released"], ["MIT"], []), ([], [], []), ([], [], [])]


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([("Released under the MIT License.", 1, 2)], "text string, Licences int, unmatched int")
    out = L.scan_licences(df, "text")
    assert out.columns == ["text", "sentence_ids", "licences", "unmatched"] and out.first().licences == ["MIT"]
    assert L.scan_licences(df.limit(0), "text").count() == 0


def test_every_rule_names_known_sentences_and_can_be_reached(spark):
    known = {name for name, _ in L.SENTENCES}
    assert all(set(seq) <= known for _, seq in L.RULES)
    df = spark.createDataFrame([(name, list(seq)) for name, seq in L.RULES], "name string, ids array<string>")
    for r in df.select("name", L.match_rules(F.col("ids")).alias("m")).collect():
        assert r.m.licences == [r.name] and r.m.rest == []


GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""


def test_published_gnu_notices_and_subjects(spark):
    lgpl = ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\n"
            "License as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n")
    texts = [GPL3, GPL3.replace("General", "Affero General"), GPL3.replace("General", "Lesser General"), lgpl,
             "This project is licensed under the MIT License.", "This project is licensed under the GNU General Public License, version 3.",
             "This software is distributed under the Apache License, Version 2.0."]
    got = scan(spark, texts)
    assert [g[1] for g in got] == [["GPL-3.0-or-later"], ["AGPL-3.0"], ["LGPL-3.0"], ["LGPL-2.1"], ["MIT"], ["GPL-3.0-only"], ["Apache-2.0"]]
    assert got[0][2] == []

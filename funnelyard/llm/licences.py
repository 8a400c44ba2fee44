"""Licence scans by sentence rules, in DataFrame functions only (the method of German et al., 2010).

A text is cut into sentences, licence-like sentences are normalised and mapped to the identifiers of
known licence sentences, and the sequence of identifiers is matched against ordered rules. A rule
consumes the identifiers that it matches, so the rules of whole licences stand before those of their
parts. All work is within a row: no shuffle, and a long text costs no more memory than its sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelyard.llm.common import drop_clashing

#: What makes a text, and a sentence of it, worth a look.
LICENCE_LIKE = r"(?i)licen[cs]e|copyright|warrant|redistribut|permission|creative commons|public domain|liable|mpl was"
#: Ends of sentences: stops before white space or the end, or an empty line.
SENTENCE_END = r"[.;:!?]+[^A-Za-z0-9 \t\n]*(?:[ \t\n]+|\z)|\n[ \t]*\n"
UNKNOWN = "unknown"

#: Head of the GNU notices with the version in the same sentence, and what may stand before "licensed under".
_HEAD = (r"(?:this (?:program|library|file|software) is free software )?you can redistribute it and or modify it under the terms of the gnu {} public license"
         r" as published by the free software foundation either version {} of the license or at your option any later version")
_SUBJECT = r"this (?:[a-z0-9.]+ ){1,4}is "

# Known licence sentences as patterns over the normalised sentence (lower-case words with
# digits and inner dots, joined by a space). An identifier may have several patterns.
SENTENCES = (
    ("apache2-licensed", r"licensed (?:to .* )?under the apache license,? version 2\.0(?: the license)?(?: .*you may not use this file except in compliance with the license)?"),
    ("apache2-compliance", r"you may not use this file except in compliance with the license"),
    ("apache2-obtain", r"you may obtain a copy of the license at(?: .*)?"),
    ("apache2-as-is", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache2-see", r"see the license for the specific language governing permissions and limitations under the license"),
    ("mit-released", r"(?:released|licensed|distributed|available) under the (?:terms of the )?mit license"),
    ("mit-name", r"the mit license(?: mit)?"),
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction .* subject to the following conditions"),
    ("mit-notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-as-is", r"the software is provided as is without warranty of any kind express or implied .* noninfringement"),
    ("mit-liability", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability .* dealings in the software"),
    ("gpl2-version", r"this (?:work|program|file|software) is licensed under the (?:terms of the )?gnu general public license,? version 2(?: only)?"),
    ("gpl3-version", r"this (?:work|program|file|software) is licensed under the (?:terms of the )?gnu general public license,? version 3(?: only)?"),
    ("gpl-free-2plus", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-free-3plus", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-head-redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-head-2plus", r"either version 2 of the license or at your option any later version"),
    ("gpl-head-3plus", r"either version 3 of the license or at your option any later version"),
    ("gpl-no-warranty", r"this program is distributed in the hope that it will be useful but without any warranty(?: without even the implied warranty of merchantability or fitness for a particular purpose)?"),
    ("gpl-implied", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-details", r"see the gnu general public license for more details"),
    ("gpl-received", r"you should have received a copy of the gnu general public license along with this program(?: .*)?"),
    ("lgpl21-licensed", r"(?:this .* is )?licensed under the gnu lesser general public license,? version 2\.1(?: or later)?"),
    ("lgpl3-licensed", r"(?:this .* is )?licensed under the gnu lesser general public license,? version 3(?: or later)?"),
    ("agpl3-licensed", r"(?:this .* is )?licensed under the gnu affero general public license,? version 3(?: or later)?"),
    ("mpl2-subject", r"this source code form is subject to the terms of the mozilla public license v 2\.0"),
    ("mpl2-subject", r"this source code form is subject to the terms of the mozilla public license v"),
    ("mpl2-obtain", r"if a copy of the mpl was not distributed with this file you can obtain one at(?: .*)?"),
    ("bsd-redistribution", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", r"(?:[0-9] )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", r"(?:[0-9] )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-endorse", r"(?:[0-9] )?neither the name of .* may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-as-is", r"this software is provided by .* as is and any express or implied warranties .* are disclaimed"),
    ("bsd-liability", r"in no event shall .* be liable for any direct indirect incidental special exemplary or consequential damages .*"),
    ("bsd-licensed", r"(?:released|licensed|distributed) under the (?:new |3 clause )?bsd(?: 3 clause)? license"),
    ("isc-grant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by-4", r"(?:this work is )?licensed under (?:a )?(?:the )?(?:cc by|creative commons attribution) 4\.0(?: international)?(?: license)?"),
    ("cc-by-sa-4", r"(?:this work is )?licensed under (?:a )?(?:the )?(?:cc by sa|creative commons attribution sharealike) 4\.0(?: international)?(?: license)?"),
    ("cc-by-nc-4", r"(?:this work is )?licensed under (?:a )?(?:the )?(?:cc by nc|creative commons attribution noncommercial) 4\.0(?: international)?(?: license)?"),
    ("cc-by-nc-sa-4", r"(?:this work is )?licensed under (?:a )?(?:the )?(?:cc by nc sa|creative commons attribution noncommercial sharealike) 4\.0(?: international)?(?: license)?"),
    ("cc0", r"(?:this work is )?(?:licensed|released|dedicated) (?:under|to) (?:the )?(?:cc0(?: 1\.0)?|creative commons zero)(?: license)?"),
    ("public-domain", r"this (?:work|software|file|code) (?:is|has been placed) (?:released )?(?:in|into|to) the public domain"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("rights-reserved", r"(?:copyright .* )?all rights reserved"),
    ("copyright-line", r"(?:c )?copyright (?:c )?[0-9]{4}.{0,100}"),
    ("gpl-free-2plus", _HEAD.format("general", "2")),
    ("gpl-free-3plus", _HEAD.format("general", "3")),
    ("lgpl21-free", _HEAD.format("lesser general", r"2\.1")),
    ("lgpl3-free", _HEAD.format("lesser general", "3")),
    ("agpl3-free", _HEAD.format("affero general", "3")),
    ("lgpl-head-redistribute", r"you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl-head-21plus", r"either version 2\.1 of the license or at your option any later version"),
    ("gpl-see", r"if not see https? www\.gnu\.org licenses"),
    ("apache2-licensed", _SUBJECT + r"(?:released|licensed|distributed) under the (?:terms of the )?apache license,? version 2\.0"),
    ("mit-released", _SUBJECT + r"(?:released|licensed|distributed|available) under the (?:terms of the )?mit license"),
    ("bsd-licensed", _SUBJECT + r"(?:released|licensed|distributed) under the (?:new |3 clause )?bsd(?: 3 clause)? license"),
    ("gpl2-version", _SUBJECT + r"(?:released|licensed|distributed) under the (?:terms of the )?gnu general public license,? version 2(?: only)?"),
    ("gpl3-version", _SUBJECT + r"(?:released|licensed|distributed) under the (?:terms of the )?gnu general public license,? version 3(?: only)?"),
)

# Ordered rules, each a licence and the sentence identifiers that must follow one another.
RULES = (
    ("Apache-2.0", ("apache2-licensed", "apache2-compliance", "apache2-obtain", "apache2-as-is", "apache2-see")),
    ("Apache-2.0", ("apache2-licensed", "apache2-obtain", "apache2-as-is", "apache2-see")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability")),
    ("GPL-2.0-or-later", ("gpl-free-2plus", "gpl-no-warranty", "gpl-implied", "gpl-details", "gpl-received")),
    ("GPL-3.0-or-later", ("gpl-free-3plus", "gpl-no-warranty", "gpl-implied", "gpl-details", "gpl-received", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-free-3plus", "gpl-no-warranty", "gpl-implied", "gpl-details", "gpl-received")),
    ("GPL-2.0-or-later", ("gpl-free-2plus", "gpl-no-warranty", "gpl-details", "gpl-received")),
    ("GPL-3.0-or-later", ("gpl-free-3plus", "gpl-no-warranty", "gpl-details", "gpl-received")),
    ("GPL-2.0-or-later", ("gpl-head-redistribute", "gpl-head-2plus", "gpl-no-warranty", "gpl-implied", "gpl-details", "gpl-received")),
    ("GPL-3.0-or-later", ("gpl-head-redistribute", "gpl-head-3plus", "gpl-no-warranty", "gpl-implied", "gpl-details", "gpl-received")),
    ("GPL-2.0-or-later", ("gpl-head-redistribute", "gpl-head-2plus")),
    ("GPL-3.0-or-later", ("gpl-head-redistribute", "gpl-head-3plus")),
    ("MPL-2.0", ("mpl2-subject", "mpl2-obtain")),
    ("ISC", ("isc-grant", "mit-as-is")),
    ("Apache-2.0", ("apache2-licensed",)),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-name",)),
    ("BSD-3-Clause", ("bsd-licensed",)),
    ("GPL-2.0-or-later", ("gpl-free-2plus",)),
    ("GPL-3.0-or-later", ("gpl-free-3plus",)),
    ("GPL-2.0-only", ("gpl2-version",)),
    ("GPL-3.0-only", ("gpl3-version",)),
    ("LGPL-2.1", ("lgpl-head-redistribute", "lgpl-head-21plus")),
    ("LGPL-2.1", ("lgpl21-free",)),
    ("LGPL-3.0", ("lgpl3-free",)),
    ("AGPL-3.0", ("agpl3-free",)),
    ("LGPL-2.1", ("lgpl21-licensed",)),
    ("LGPL-3.0", ("lgpl3-licensed",)),
    ("AGPL-3.0", ("agpl3-licensed",)),
    ("MPL-2.0", ("mpl2-subject",)),
    ("ISC", ("isc-grant",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4",)),
    ("CC0-1.0", ("cc0",)),
    ("Unlicense", ("unlicense",)),
    ("public-domain", ("public-domain",)),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(sentence: Column) -> Column:
    """Lower-case words of letters, digits and dots, joined by a space, without outer dots."""
    words = F.regexp_replace(F.translate(sentence, _UPPER, _LOWER), "[^a-z0-9.]+", " ")
    return F.regexp_replace(words, "^[ .]+|[ .]+$", "")


def sentence_id(sentence: Column) -> Column:
    """Identifier of a known licence sentence, else null. The first pattern that fits the whole sentence counts."""
    words = normalised(sentence)
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SENTENCES):
        out = F.when(words.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def sentence_ids(text: Column) -> Column:
    """Identifiers of a text's licence-like sentences, in order.

    A sentence over several lines that isn't known as a whole is looked up line by line, as a notice may
    follow a line that ends without a stop; the lines between known ones are looked up together. If
    nothing is known the sentence is UNKNOWN.
    """
    mark = "\x01"  # around the identifiers of known lines; a text's own marks count as spaces

    def by_lines(sentence: Column) -> Column:
        def told(line: Column) -> Column:
            known = F.transform(F.array(line), sentence_id)
            return F.when(F.element_at(known, 1).isNotNull(), F.concat(F.lit(mark), F.element_at(known, 1), F.lit(mark))).otherwise(line)
        lines = F.transform(F.split(F.translate(sentence, mark, " "), "\n"), told)
        parts = F.transform(F.split(F.array_join(lines, " "), mark), lambda x, i: F.when(i % 2 == 1, x).otherwise(sentence_id(x)))
        return F.filter(parts, lambda x: x.isNotNull())

    def ids(sentence: Column) -> Column:
        parts = F.transform(F.array(sentence), lambda x: F.struct(sentence_id(x).alias("id"), x.alias("s")))
        found = F.transform(parts, lambda p: F.when(p["id"].isNotNull(), F.array(p["id"])).otherwise(by_lines(p["s"])))
        return F.flatten(F.transform(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit(UNKNOWN)))))

    sentences = F.split(F.replace(text, F.lit("\r"), F.lit("")), SENTENCE_END)
    found = F.flatten(F.transform(F.filter(sentences, lambda s: s.rlike(LICENCE_LIKE)), ids))
    return F.when(text.rlike(LICENCE_LIKE), found).otherwise(F.expr("cast(array() as array<string>)"))


def _tokens(ids: tuple[str, ...]) -> str:
    return "".join(f"<{i}>" for i in ids)


def match_rules(ids: Column) -> Column:
    """struct(licences: those of the rules that match, in rule order, once each; rest: the identifiers that no rule took)."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_tokens(seq)).alias("seq")) for name, seq in RULES])
    text = F.array_join(F.transform(ids, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    start = F.struct(text.alias("s"), F.expr("cast(array() as array<string>)").alias("found"))

    def step(state: Column, rule: Column) -> Column:
        # what a rule takes leaves a mark, so that its neighbours don't become neighbours
        taken = F.struct(F.replace(state["s"], rule["seq"], F.lit("<=>")).alias("s"), F.array_union(state["found"], F.array(rule["name"])).alias("found"))
        return F.when(F.contains(state["s"], rule["seq"]), taken).otherwise(state)

    def done(state: Column) -> Column:
        rest = F.filter(F.regexp_extract_all(state["s"], F.lit("<([^>]*)>"), F.lit(1)), lambda x: x != "=")
        return F.struct(state["found"].alias("licences"), rest.alias("rest"))
    return F.aggregate(rules, start, step, done)


def scan_licences(df: DataFrame, text_col: str) -> DataFrame:
    """Adds `sentence_ids`, `licences` and `unmatched` (identifiers that no rule took), all array<string>.

    All columns of `df` stay; columns named like the new ones are replaced. Null and empty texts, and
    texts without licence-like sentences, get empty arrays.
    """
    df = drop_clashing(df, [c for c in ("sentence_ids", "licences", "unmatched") if c != text_col])
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    given = df.withColumn("sentence_ids", sentence_ids(text)).withColumn("__rules", F.when(F.size("sentence_ids") > 0, match_rules(F.col("sentence_ids"))))
    none = F.expr("cast(array() as array<string>)")
    return (given.withColumn("licences", F.coalesce("__rules.licences", none)).withColumn("unmatched", F.coalesce("__rules.rest", none))
            .drop("__rules"))

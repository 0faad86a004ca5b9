"""Licences by sentence rules, in DataFrame functions only.

Comment marks at beginnings of lines are dropped, and a text is cut into sentences twice: by sentences (lines joined;
cut at empty lines, before numbered clauses, after colons at ends of lines, and after closing marks before a capital),
and by lines (each line a text of its own, so that notices of one line are found among others). Sentences are
normalised (lower case, runs of anything but letters and digits as one space) and looked up among known licence
sentences, some of which have a slot for a name. What remains is a sequence of sentence numbers for either way; a rule is
an ordered sequence of numbers and matches where it stands in one of them without a known sentence between. Rules of
licences that others extend by a clause (STRICT) match only if no unknown sentence stands between or follows either. A rule
that is part of a longer rule that matches too isn't reported.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of published licence notices, in normalised form, with * for a name. A sentence's number is its
# place here, from 1.
SENTENCES = (
    "licensed under the apache license version 2 0",
    "you may not use this file except in compliance with the license",
    "you may obtain a copy of the license at",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "see the license for the specific language governing permissions and limitations under the license",
    "released under the mit license",
    "licensed under the mit license",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "in no event shall * be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "this work is licensed under the gnu general public license version 3",
    "this work is licensed under the gnu general public license version 2",
    "* is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "* is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "* is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "see the gnu general public license for more details",
    "you should have received a copy of the gnu general public license along with *",
    "licensed under cc by nc 4 0",
    "licensed under cc by 4 0",
    "licensed under cc by sa 4 0",
    "this work is licensed under a creative commons attribution 4 0 international license",
    "this source code form is subject to the terms of the mozilla public license v 2 0",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "this is free and unencumbered software released into the public domain",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "if not see https www gnu org licenses",
    "if not see http www gnu org licenses",
    "you should have received a copy of the gnu general public license along with this program if not write to the free software foundation inc 51 franklin street fifth floor boston ma 02110 1301 usa",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "in no event shall * be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "the software is provided as is and * disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "in no event shall * be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "* is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "* is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "* is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "* is free software you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "* is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "see the gnu lesser general public license for more details",
    "see the gnu affero general public license for more details",
    "you should have received a copy of the gnu lesser general public license along with *",
    "you should have received a copy of the gnu affero general public license along with *",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 *",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 *",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 *",
    "the name of * may not be used to endorse or promote products derived from this software without specific prior written permission",
    "distributed under the boost software license version 1 0",
)

# Fixed values: (licence, the numbers of its sentences, in order).
RULES = (
    ("apache-2.0", (1,)),
    ("apache-2.0", (1, 2, 3, 4, 5)),
    ("apache-2.0", (2, 3, 4, 5)),
    ("mit", (6,)),
    ("mit", (7,)),
    ("mit", (8, 9)),
    ("mit", (8, 9, 10, 11)),
    ("gpl-3.0", (12,)),
    ("gpl-2.0", (13,)),
    ("gpl-3.0-or-later", (14,)),
    ("gpl-3.0-or-later", (14, 16, 17, 18)),
    ("gpl-2.0-or-later", (15,)),
    ("gpl-2.0-or-later", (15, 16, 17, 18)),
    ("cc-by-nc-4.0", (19,)),
    ("cc-by-4.0", (20,)),
    ("cc-by-sa-4.0", (21,)),
    ("cc-by-4.0", (22,)),
    ("mpl-2.0", (23,)),
    ("mpl-2.0", (23, 24)),
    ("mpl-2.0", (23, 34)),
    ("bsd", (25, 26)),
    ("bsd-2-clause", (25, 26, 27)),
    ("bsd-2-clause", (25, 26, 27, 36, 37)),
    ("bsd-3-clause", (25, 26, 27, 35)),
    ("bsd-3-clause", (25, 26, 27, 35, 36, 37)),
    ("isc", (28,)),
    ("isc", (28, 38, 39)),
    ("isc", (41,)),
    ("isc", (41, 38, 39)),
    ("unlicense", (29,)),
    ("apache-2.0", (30,)),
    ("apache-2.0", (30, 3, 4, 5)),
    ("gpl-3.0-or-later", (14, 16, 17, 18, 31)),
    ("gpl-3.0-or-later", (14, 16, 17, 18, 32)),
    ("gpl-2.0-or-later", (15, 16, 17, 18, 31)),
    ("gpl-2.0-or-later", (15, 16, 17, 18, 32)),
    ("gpl-2.0-or-later", (15, 16, 17, 33)),
    ("gpl-2.0-only", (40,)),
    ("gpl-2.0-only", (40, 16, 17, 18)),
    ("gpl-2.0-only", (40, 16, 17, 33)),
    ("lgpl-2.1-or-later", (42,)),
    ("lgpl-2.1-or-later", (42, 16, 46, 48)),
    ("lgpl-3.0-or-later", (43,)),
    ("lgpl-3.0-or-later", (43, 16, 46, 48)),
    ("lgpl-2.0-or-later", (44,)),
    ("agpl-3.0-or-later", (45,)),
    ("agpl-3.0-or-later", (45, 16, 47, 49)),
    ("epl-1.0", (50,)),
    ("epl-2.0", (51,)),
    ("epl-2.0", (52,)),
    ("bsd-3-clause", (25, 26, 27, 53)),
    ("bsd-3-clause", (25, 26, 27, 53, 36, 37)),
    ("bsl-1.0", (54,)),
)

# Licences that others have all sentences of.
STRICT = ("bsd-2-clause",)
# Identifiers that notices without sentences give, besides the names above.
IDENTIFIERS = ("0bsd", "agpl-3.0-only", "cc0-1.0", "gpl-3.0-only", "lgpl-2.1-only", "lgpl-3.0-only", "zlib")

# Steps of cutting, in order: (pattern, what stands for it), with \x01 between sentences.
_START = (("\\r\\n?", "\n"), ("(^|\\n)[ \\t]*(?:/\\*+|\\*+/?|#+|//+|;+|%+|--+|<!--+)[ \\t]*", "{1}"))
_JOINED = ((":[ \\t]*\\n", ":\x01"), ("\\n[ \\t]*(\\(?[0-9]{1,2}[.)])", "\x01{1}"), ("\\n[ \\t]*\\n", "\x01"), ("\\n", " "))
_LINES = (("\\n", "\x01"),)
_ENDS = (("([.!?][\"')\\]]*)[ \\t]+([\"'(\\[]?\\p{Lu})", "{1}\x01{2}"),)
#: The longest name in a slot.
SLOT = 200
_FLAT = "[^\\p{L}\\p{N}\x01]+"


def sentences(text: Column, steps: tuple) -> Column:
    """The normalised sentences of a text, empty ones among them; null gives an empty array."""
    for pattern, mark in steps:
        text = F.regexp_replace(text, pattern, mark.replace("{1}", "$1").replace("{2}", "$2"))
    flat = F.regexp_replace(F.lower(text), _FLAT, " ")
    return F.coalesce(F.transform(F.split(flat, "\x01", -1), lambda s: F.trim(s)), F.array().cast("array<string>"))


def _identified(known: tuple[str, ...], rules: tuple) -> tuple[tuple[str, ...], tuple]:
    """Sentences and rules with those of SPDX lines for every licence: one identifier alone, no expressions."""
    names = sorted({name for name, _ in rules} | set(IDENTIFIERS))
    lines = tuple(f"spdx license identifier {' '.join(re.split('[^a-z0-9]+', name))}" for name in names)
    return known + lines, rules + tuple((name, (n,)) for n, name in enumerate(names, len(known) + 1))


KNOWN, ALL_RULES = _identified(SENTENCES, RULES)


def _sequence(name: str, numbers) -> str:
    """A strict rule of sentences that others go on after ends with the text, or with the sentence that it gives last."""
    found = "," + ",".join(map(str, numbers)) + ","
    return found + "|" if name in STRICT and len(numbers) == 3 else found


def _slots(known: tuple[str, ...]) -> list[tuple[int, str, str]]:
    """(number, what stands before the name, what stands after it)."""
    return [(n, *s.split("*")) for n, s in enumerate(known, 1) if "*" in s]


def number(sentence: Column, known: tuple[str, ...]) -> Column:
    """The number of a known sentence, else 0; names in slots have up to SLOT characters."""
    at = F.array_position(F.array(*[F.lit(s) for s in known]), sentence)
    slot = F.lit(0).cast("long")
    for n, head, tail in reversed(_slots(known)):
        fits = F.length(sentence).between(len(head + tail) + 1, len(head + tail) + SLOT)
        slot = F.when(F.startswith(sentence, F.lit(head)) & F.endswith(sentence, F.lit(tail)) & fits, F.lit(n).cast("long")).otherwise(slot)
    return F.when(at > 0, at).otherwise(slot)


def recognise(docs: DataFrame, id_col: str = "doc_id", known: tuple[str, ...] = KNOWN, rules: tuple = ALL_RULES) -> DataFrame:
    """One row per row of docs: doc_id, n_sentences, sentence_ids, line_ids, n_rules, licenses, in its order of rows.

    sentence_ids and line_ids are numbers of known sentences in text order, comma-joined, by either way of cutting;
    n_sentences is the greater of their counts. licenses are the distinct names of the rules matched, sorted and
    comma-joined. Null and empty texts, and texts without a known sentence, have 0 and empty strings; texts of any
    length are cut whole; an empty table gives no rows. No row leaves its partition, so hot keys and repeated rows
    don't matter; other columns are not looked at.
    """
    plain = F.col("text")
    for pattern, mark in _START:
        plain = F.regexp_replace(plain, pattern, mark.replace("{1}", "$1"))
    found = docs.select(F.col(f"`{id_col}`").alias("doc_id"), plain.alias("plain"))
    # Numbers of clauses, and addresses on lines of their own, are no sentences.
    numbers = lambda steps: F.transform(F.filter(sentences(F.col("plain"), steps), lambda s: (F.length(s) > 3) & ~F.startswith(s, F.lit("http"))), lambda s: number(s, known))
    found = found.select("doc_id", numbers(_JOINED + _ENDS).alias("all_sentences"), numbers(_LINES + _ENDS).alias("all_lines"))
    found = found.select("*", *[F.filter(f"all_{way}", lambda n: n > 0).alias(way) for way in ("sentences", "lines")])
    found = found.select("doc_id", *[F.when(F.size(way) > 0, F.concat(F.lit(","), F.array_join(f"all_{way}", ","), F.lit(",|"))).otherwise("").alias(f"all_{way}") for way in ("sentences", "lines")], F.greatest(F.size("sentences"), F.size("lines")).cast("long").alias("n_sentences"), F.array_join("sentences", ",").alias("sentence_ids"), F.array_join("lines", ",").alias("line_ids"))
    lines = F.concat(F.lit(","), "sentence_ids", F.lit(",|,"), "line_ids", F.lit(","))
    every = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_sequence(name, seq)).alias("seq"), F.lit(name in STRICT).alias("strict")) for name, seq in rules])
    whole = F.concat("all_sentences", "all_lines")
    matched = F.when(F.col("n_sentences") > 0, F.filter(every, lambda r: F.when(r["strict"], F.contains(whole, r["seq"])).otherwise(F.contains(lines, r["seq"]))))
    found = found.withColumn("matched", F.coalesce(matched, F.filter(every, lambda r: F.lit(False))))
    longest = F.filter("matched", lambda r: ~F.exists("matched", lambda o: (o["seq"] != r["seq"]) & F.contains(o["seq"], r["seq"])))
    return found.withColumn("matched", longest).select(
        "doc_id",
        "n_sentences",
        "sentence_ids",
        "line_ids",
        F.size("matched").cast("long").alias("n_rules"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matched", lambda r: r["name"]))), ",").alias("licenses"),
    )


def sql(table: str = "documents", known: tuple[str, ...] = KNOWN, rules: tuple = ALL_RULES) -> str:
    """The same rows in DuckDB's SQL, by joins with tables of sentences and rules."""

    def replaced(text: str, steps: tuple) -> str:
        for pattern, mark in steps:
            shown = "'" + mark.replace("{1}", "\\1").replace("{2}", "\\2").replace("\n", "' || chr(10) || '").replace("\x01", "' || chr(1) || '") + "'"
            text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', {shown}, 'g')"
        return text

    ways = " UNION ALL ".join(
        f"SELECT row, '{way}' AS way, string_split(regexp_replace(lower({replaced('plain', steps + _ENDS)}), '[^\\p{{L}}\\p{{N}}\\x01]+', ' ', 'g'), chr(1)) AS parts FROM texts"
        for way, steps in (("sentence", _JOINED), ("line", _LINES))
    )
    return f"""
WITH known(number, sentence) AS (VALUES {", ".join(f"({n}, '{s}')" for n, s in enumerate(known, 1) if "*" not in s)}),
slots(number, head, tail) AS (VALUES {", ".join(f"({n}, '{head}', '{tail}')" for n, head, tail in _slots(known)) or "(0, 'x', 'x')"}),
rules(name, seq, strict) AS (VALUES {", ".join(f"('{name}', '{_sequence(name, seq)}', {name in STRICT})" for name, seq in rules)}),
texts AS (SELECT row_number() OVER () AS row, doc_id, {replaced("coalesce(text, '')", _START)} AS plain FROM {table}),
ways AS ({ways}),
parts AS (SELECT row, way, generate_subscripts(parts, 1) AS i, trim(unnest(parts)) AS sentence FROM ways),
slotted AS (SELECT sentence, min(number) AS number FROM (SELECT DISTINCT sentence FROM parts) JOIN slots ON starts_with(sentence, head) AND ends_with(sentence, tail) AND length(sentence) - length(head) - length(tail) BETWEEN 1 AND {SLOT} GROUP BY sentence),
found AS (SELECT row, way, i, coalesce(k.number, s.number) AS number FROM parts p LEFT JOIN known k USING (sentence) LEFT JOIN slotted s USING (sentence) WHERE length(sentence) > 3 AND NOT starts_with(sentence, 'http')),
ids AS (SELECT row, way, string_agg(number, ',' ORDER BY i) AS ids, count(number) AS n, ',' || string_agg(coalesce(number, 0), ',' ORDER BY i) || ',|' AS whole FROM found GROUP BY row, way HAVING count(number) > 0),
hits AS (SELECT DISTINCT row, name, seq FROM ids JOIN rules ON CASE WHEN strict THEN contains(whole, seq) ELSE contains(',' || ids || ',', seq) END),
longest AS (SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.row = h.row AND o.seq <> h.seq AND contains(o.seq, h.seq))),
named AS (SELECT row, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM longest GROUP BY row)
SELECT doc_id, greatest(coalesce(a.n, 0), coalesce(b.n, 0))::BIGINT AS n_sentences, coalesce(a.ids, '') AS sentence_ids, coalesce(b.ids, '') AS line_ids,
  coalesce(c.n, 0)::BIGINT AS n_rules, coalesce(licenses, '') AS licenses
FROM texts LEFT JOIN ids a ON a.row = texts.row AND a.way = 'sentence' LEFT JOIN ids b ON b.row = texts.row AND b.way = 'line' LEFT JOIN named c ON c.row = texts.row"""

"""Operator 6, licence scans by sentence rules; DataFrame functions only.

A text is cut into sentences (at closing marks before white space, and at line ends), each is
normalised (A-Z lower-cased, everything but a-z and 0-9 one space) and looked up among known
licence sentences. As files wrap their licences, runs of adjacent lines without a closing mark or a
blank line between them are looked up as well (comment marks fall to the normalisation), each run only as
long as a known sentence begins with it, so a text needs memory in proportion to its length. The identifiers found, in the order of their first lines, are matched against ordered rules: a rule
fits where its identifiers follow one another, unknown sentences between them not counting. The
first rule that fits names the text's licence; all rules that fit are listed.

Every known sentence matches ``CUE``, so a text without any of them is not cut at all.

Defined results: null and empty texts have no sentences and no licence; repeated rows are judged
each; a null doc_id stays null; other columns are not read. ``oracle_sql`` has the reading by single lines only;
both agree where no known sentence is wrapped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioloom.llm.pii import let

# Known sentences (normalised) with their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2-notice",
    "licensed under the apache license version 2 0 the license": "apache2-header",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-copy",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-limits",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "the mit license": "mit-title",
    "mit license": "mit-title",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-include",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "gnu general public license": "gpl-title",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-details",
    "this work is licensed under the gnu lesser general public license version 3": "lgpl3-notice",
    "this work is licensed under the gnu affero general public license version 3": "agpl3-notice",
    "licensed under cc by nc 4 0": "cc-by-nc4-notice",
    "licensed under cc by 4 0": "cc-by4-notice",
    "licensed under cc by sa 4 0": "cc-by-sa4-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by4-notice",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa4-notice",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc4-notice",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-notice",
    "this work is dedicated to the public domain": "public-domain-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-grant",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2-subject",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2-notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0": "epl2-notice",
    "distributed under the boost software license version 1 0": "bsl1-notice",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-dedication",
    "all rights reserved": "all-rights",
}
# Rules in order of precedence.
RULES = (
    ("apache-2.0-header", "Apache-2.0", ("apache2-header", "apache2-comply", "apache2-copy")),
    ("mit-text", "MIT", ("mit-include", "mit-warranty")),
    ("bsd-3-clause-text", "BSD-3-Clause", ("bsd-source", "bsd-binary", "bsd-endorse")),
    ("bsd-2-clause-text", "BSD-2-Clause", ("bsd-source", "bsd-binary")),
    ("agpl-3.0-header", "AGPL-3.0", ("agpl3-grant",)),
    ("lgpl-3.0-header", "LGPL-3.0", ("lgpl3-grant",)),
    ("lgpl-2.1-header", "LGPL-2.1", ("lgpl21-grant",)),
    ("gpl-3.0-header", "GPL-3.0", ("gpl3-grant",)),
    ("gpl-2.0-header", "GPL-2.0", ("gpl2-grant",)),
    ("gpl-header", "GPL", ("gpl-warranty", "gpl-details")),
    ("mpl-2.0-header", "MPL-2.0", ("mpl2-subject",)),
    ("epl-2.0-notice", "EPL-2.0", ("epl2-notice",)),
    ("zlib-grant", "Zlib", ("zlib-grant",)),
    ("cc0-1.0-dedication", "CC0-1.0", ("cc0-dedication",)),
    ("bsl-1.0-notice", "BSL-1.0", ("bsl1-notice",)),
    ("agpl-3.0-notice", "AGPL-3.0", ("agpl3-notice",)),
    ("lgpl-3.0-notice", "LGPL-3.0", ("lgpl3-notice",)),
    ("gpl-3.0-notice", "GPL-3.0", ("gpl3-notice",)),
    ("apache-2.0-notice", "Apache-2.0", ("apache2-notice",)),
    ("mit-notice", "MIT", ("mit-notice",)),
    ("mit-title", "MIT", ("mit-title",)),
    ("isc-grant", "ISC", ("isc-grant",)),
    ("cc-by-nc-4.0-notice", "CC-BY-NC-4.0", ("cc-by-nc4-notice",)),
    ("cc-by-sa-4.0-notice", "CC-BY-SA-4.0", ("cc-by-sa4-notice",)),
    ("cc-by-4.0-notice", "CC-BY-4.0", ("cc-by4-notice",)),
    ("unlicense-notice", "Unlicense", ("unlicense-notice",)),
    ("public-domain-notice", "public-domain", ("public-domain-notice",)),
    ("all-rights-reserved", "proprietary", ("all-rights",)),
)
CUE = "(?i)licen|copyright|warranty|permission|public[^a-z0-9]+domain|rights[^a-z0-9]+reserved"
CUT, OTHER = "[.!?]+[ \\t\\r\\n]+|\\n+", "[^a-z0-9]+"
#: Where a run of lines ends: the cuts but single line ends.
STOP, BREAK = "[.!?]+[ \\t\\r\\n]+|\\n\\n+", "\x01"
#: So many lines at most hold a known sentence, and so many characters.
LINES, LONGEST = max(len(s.split()) for s in SENTENCES), max(map(len, SENTENCES))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scan(documents: DataFrame) -> DataFrame:
    """(doc_id, sentence_ids, rules, licence) of every row of ``documents``."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blocks = F.split(F.regexp_replace(F.translate(text, UPPER + BREAK, LOWER + "_"), STOP, BREAK), BREAK, -1)
    lines = lambda block: F.transform(F.split(block, "\\n", -1), lambda s: F.trim(F.regexp_replace(s, OTHER, " ")))

    none = F.array().cast("array<string>")
    every = F.lit("\n" + "\n".join(SENTENCES))
    begins = lambda s: (F.length(s) <= LONGEST) & F.contains(every, F.concat(F.lit("\n"), s))

    def runs(own):
        """Of each line: the known sentences among itself and the runs of lines that it begins, each only as long as a sentence begins so."""

        def longer(acc, s):
            def noted(read):
                found = F.try_element_at(known, read)
                return F.struct(read.alias("read"), F.when(found.isNotNull(), F.concat(acc["ids"], F.array(found))).otherwise(acc["ids"]).alias("ids"))

            more = F.concat_ws(" ", acc["read"], s)
            return F.when(acc["read"].isNull(), acc).otherwise(let(F.when(begins(more), more), noted))

        def of_line(line, i):
            first = F.try_element_at(known, line)
            start = F.struct(line.alias("read"), F.when(first.isNotNull(), F.array(first)).otherwise(none).alias("ids"))
            return F.when(begins(line), F.aggregate(F.slice(own, i + 2, LINES - 1), start, longer, lambda acc: acc["ids"])).otherwise(none)

        return F.flatten(F.transform(own, of_line))

    ids = F.flatten(F.transform(F.transform(blocks, lines), runs))
    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text.rlike(CUE), ids).otherwise(none).alias("ids"))
    line = F.concat(F.lit("|"), F.array_join("ids", "||"), F.lit("|"))
    fits = lambda rule: F.contains(line, F.lit("|" + "||".join(rule[2]) + "|"))
    named = F.filter(F.array(*[F.when(fits(r), F.lit(r[0])) for r in RULES]), lambda x: x.isNotNull())
    licence = F.coalesce(*[F.when(fits(r), F.lit(r[1])) for r in RULES])
    found = found.withColumn("licence", F.when(F.size("ids") > 0, licence))
    return found.select(
        "doc_id",
        F.array_join("ids", ",").alias("sentence_ids"),
        F.when(F.size("ids") > 0, F.array_join(named, ",")).otherwise("").alias("rules"),
        "licence",
    )


def oracle_sql() -> str:
    """The same in DuckDB SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in SENTENCES.items())
    fits = lambda r: f"contains(line, {quote('|' + '||'.join(r[2]) + '|')})"
    names = ", ".join(f"CASE WHEN {fits(r)} THEN {quote(r[0])} END" for r in RULES)
    first = " ".join(f"WHEN {fits(r)} THEN {quote(r[1])}" for r in RULES)
    return rf"""
WITH known AS (SELECT map_from_entries([{known}]) AS m),
cut AS (
  SELECT doc_id, string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.!?]+[ \t\r\n]+|\n+') AS parts FROM documents),
found AS (
  SELECT doc_id, [x FOR x IN [m[trim(regexp_replace(p, '[^a-z0-9]+', ' ', 'g'))] FOR p IN parts] IF x IS NOT NULL] AS ids
  FROM cut, known),
lined AS (SELECT *, '|' || array_to_string(ids, '||') || '|' AS line FROM found)
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids,
  CASE WHEN len(ids) > 0 THEN array_to_string([x FOR x IN [{names}] IF x IS NOT NULL], ',') ELSE '' END AS rules,
  CASE WHEN len(ids) > 0 THEN CASE {first} END END AS licence
FROM lined
"""

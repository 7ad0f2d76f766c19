"""Licence scans by sentence rules.

A text is cut into sentences, sentences are normalised and looked up in a table
of known licence sentences; what remains is the sequence of their identifiers.
A sentence may be wrapped over lines, with comment leaders before each.
Ordered rules over that sequence then name the licences: longer sequences first,
each match consuming its sentences.  Sentences that no rule consumes are
reported as fragments.  All of it is one projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: sentences of public licence notices, normalised (lower case, runs of other characters as one blank)
SENTENCES: dict[str, str] = {
    "licensed under the apache license version 2 0": "ApacheShort",
    "licensed under the apache license version 2 0 the license": "ApacheHead",
    "you may not use this file except in compliance with the license": "ApacheComply",
    "you may obtain a copy of the license at": "ApacheObtain",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed "
    "on an as is basis without warranties or conditions of any kind either express or implied": "ApacheAsIs",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "released under the mit license": "MitShort",
    "licensed under the mit license": "MitShort",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the "
    "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement": "MitAsIs",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in "
    "an action of contract tort or otherwise arising from out of or in connection with the software or the use or "
    "other dealings in the software": "MitLiability",
    "this work is licensed under the gnu general public license version 2": "Gpl2Short",
    "this work is licensed under the gnu general public license version 3": "Gpl3Short",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version 2 of the license or at your option any later "
    "version": "Gpl2Grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version 3 of the license or at your option any later "
    "version": "Gpl3Grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied "
    "warranty of merchantability or fitness for a particular purpose": "GplHope",
    "see the gnu general public license for more details": "GplSee",
    "you should have received a copy of the gnu general public license along with this program": "GplCopy",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following "
    "disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
    "disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission": "BsdEndorse",
    "licensed under cc by nc 4 0": "CcByNc4Short",
    "licensed under cc by 4 0": "CcBy4Short",
    "licensed under cc by sa 4 0": "CcBySa4Short",
    "this work is licensed under a creative commons attribution 4 0 international license": "CcBy4Long",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "CcByNc4Long",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "CcBySa4Long",
}

# fixed values: licence and the sentences that state it, in this order; earlier rules first
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["ApacheHead", "ApacheComply", "ApacheObtain", "ApacheAsIs", "ApacheSee"]),
    ("Apache-2.0", ["ApacheHead", "ApacheComply", "ApacheObtain"]),
    ("MIT", ["MitGrant", "MitNotice", "MitAsIs", "MitLiability"]),
    ("MIT", ["MitGrant", "MitNotice"]),
    ("GPL-3.0-or-later", ["Gpl3Grant", "GplHope", "GplSee", "GplCopy"]),
    ("GPL-2.0-or-later", ["Gpl2Grant", "GplHope", "GplSee", "GplCopy"]),
    ("GPL-3.0-or-later", ["Gpl3Grant"]),
    ("GPL-2.0-or-later", ["Gpl2Grant"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
    ("Apache-2.0", ["ApacheHead"]),
    ("Apache-2.0", ["ApacheShort"]),
    ("MIT", ["MitShort"]),
    ("GPL-2.0-only", ["Gpl2Short"]),
    ("GPL-3.0-only", ["Gpl3Short"]),
    ("CC-BY-NC-4.0", ["CcByNc4Short"]),
    ("CC-BY-NC-4.0", ["CcByNc4Long"]),
    ("CC-BY-4.0", ["CcBy4Short"]),
    ("CC-BY-4.0", ["CcBy4Long"]),
    ("CC-BY-SA-4.0", ["CcBySa4Short"]),
    ("CC-BY-SA-4.0", ["CcBySa4Long"]),
]

# every known sentence has one of these words, so texts without any need no look-up
CUES = ("licen", "copy", "permi", "redistribut", "warrant", "software", "program")
SENTENCE_END = r"([.!?;:])[\x20\x09-\x0D]+"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known licence sentences of a text, in their order.

    A sentence begins and ends at marks or line ends and may run over any number of
    lines, but not over marks or lines without a letter or digit.  Of several that
    begin at one place the longest counts.
    """
    # a line end stays one, a mark becomes an empty line
    cut = F.regexp_replace(F.lower(F.regexp_replace(text, SENTENCE_END, "$1\n\n")), r"[^a-z0-9\n]+", " ")
    bare = F.trim(F.regexp_replace(cut, r" ?\n ?", "\n"))
    longest_first = sorted(SENTENCES, key=len, reverse=True)
    pattern = r"(?<![^\n])(?:" + "|".join(s.replace(" ", r"[ \n]") for s in longest_first) + r")(?![^\n])"
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    return F.transform(F.regexp_extract_all(bare, F.lit(pattern), F.lit(0)), lambda s: known[F.translate(s, "\n", " ")])


def scan_licenses(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the rows of ``docs`` with a licence sentence, and ``sentences``, ``licenses`` and ``fragments``.

    ``sentences`` are the identifiers in order, ``licenses`` maps every recognised
    licence to how often it is stated, ``fragments`` counts sentences that no rule
    took.  Rows whose text is null, empty or without a known sentence are left
    out; repeated rows are scanned each.
    """
    cue = F.coalesce(F.lower("text").rlike("|".join(CUES)), F.lit(False))
    kept = [F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]
    found = docs.where(cue).select(*kept, sentence_ids(F.col("text")).alias("sentences")).where(F.size("sentences") > 0)

    # the sequence is text like ",a,b,": rules are taken out of it one after the other
    sequence, counts = F.concat(F.lit(","), F.array_join("sentences", ",,"), F.lit(",")), []
    for number, (_, ids) in enumerate(RULES):
        pattern = "".join(f",{x}," for x in ids)
        found = found.withColumn("rest", sequence) if number == 0 else found
        counts.append(f"n{number}")
        found = found.withColumn(f"n{number}", F.regexp_count("rest", F.lit(pattern))).withColumn(
            "rest", F.regexp_replace("rest", pattern, "#"))
    pairs = []
    for name in dict.fromkeys(name for name, _ in RULES):
        total = sum((F.col(f"n{i}") for i, (other, _) in enumerate(RULES) if other == name), F.lit(0))
        pairs.append(F.struct(F.lit(name).alias("key"), total.alias("value")))
    licenses = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"] > 0))
    return found.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "sentences", licenses.alias("licenses"),
        F.regexp_count("rest", F.lit(",[A-Za-z0-9]+,")).alias("fragments"))


def oracle_sql() -> str:
    """The query ``(doc_id, license, stated, fragments)`` in DuckDB SQL, from the same tables of fixed values."""
    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    steps, before = [], "s"
    for number, (_, ids) in enumerate(RULES):
        pattern = "".join(f",{x}," for x in ids)
        kept = ", ".join(["rowno", "doc_id", *(f"n{k}" for k in range(number))])
        steps.append(
            f"r{number} AS (SELECT {kept}, (length(rest) - length(replace(rest, '{pattern}', ''))) // {len(pattern)} AS n{number}, "
            f"replace(rest, '{pattern}', '#') AS rest FROM {before})")
        before = f"r{number}"
    totals = []
    for name in dict.fromkeys(name for name, _ in RULES):
        total = " + ".join(f"n{i}" for i, (other, _) in enumerate(RULES) if other == name)
        totals.append(f"SELECT doc_id, '{name}' AS license, {total} AS stated, len(regexp_extract_all(rest, ',[A-Za-z0-9]+,')) AS fragments FROM {before} WHERE {total} > 0")
    return f"""
      WITH d AS (SELECT row_number() OVER () AS rowno, doc_id, text FROM documents),
      cut AS (SELECT rowno, doc_id, string_split(regexp_replace(text, '([.!?;:])[\\x20\\x09-\\x0D]+', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM d),
      lines AS (SELECT rowno, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS place FROM cut),
      named AS (
        SELECT rowno, doc_id, place, k.id FROM lines
        JOIN (VALUES {known}) AS k(sentence, id) ON trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')) = k.sentence),
      s AS (SELECT rowno, doc_id, ',' || string_agg(id, ',,' ORDER BY place) || ',' AS rest FROM named GROUP BY rowno, doc_id),
      {", ".join(steps)}
      {" UNION ALL ".join(totals)}
    """

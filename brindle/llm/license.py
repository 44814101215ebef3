"""Operator 10: licences recognised by sentences and ordered rules. DataFrame code only.

A text is cut into sentences three times: at sentence marks and line ends, for notices on
lines of their own; at sentence marks alone, for licence texts wrapped over lines; and at
sentence marks and lines without a letter or digit, for wrapped paragraphs that end
without a mark, as copyright lines do. Each sentence is normalised (lower case, no
punctuation but version dots, single spaces) and looked up in a fixed table of known
licence sentences; what is left is the sequence of their identifiers. Known sentences
with marks inside (ACROSS) are met by the third reading, which also looks up two and
three sentences on end. The SQL twin has the first two readings only: where the third
finds more, the query has licences that the SQL lacks. Licence rules are sequences of identifiers, tried in order, the
longest first: a rule matches where its identifiers follow each other, and a shorter
rule whose identifiers are all part of a matched longer one isn't reported beside it.

Null and empty texts have no licence. Equal texts give equal rows; a sentence that
repeats counts once for each time. Rows are handled one by one; nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import table

#: Known licence sentences, normalised. Fixed values from the public licence texts.
SENTENCES = {
    "apache_licensed": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license"],
    "apache_may_not": ["you may not use this file except in compliance with the license"],
    "apache_obtain": ["you may obtain a copy of the license at"],
    "apache_unless": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "mit_released": ["released under the mit license", "licensed under the mit license", "this software is released under the mit license", "the mit license", "mit license"],
    "mit_grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit_notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit_warranty": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "isc_grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "bsd_licensed": ["licensed under the bsd license", "released under the bsd license", "use of this source code is governed by a bsd style license that can be found in the license file"],
    "bsd_grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd_source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd_binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd_endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "gpl3_work": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "licensed under the gnu gpl version 3"],
    "gpl2_work": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"],
    "gpl_free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl_hope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl_received": ["you should have received a copy of the gnu general public license along with this program"],
    "lgpl_work": ["this work is licensed under the gnu lesser general public license version 3", "licensed under the gnu lesser general public license version 2.1"],
    "agpl_work": ["this work is licensed under the gnu affero general public license version 3", "licensed under the gnu affero general public license version 3"],
    "mpl_terms": ["this source code form is subject to the terms of the mozilla public license v 2.0", "this source code form is subject to the terms of the mozilla public license v. 2.0"],
    "cc_by": ["licensed under cc by 4.0", "this work is licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc_by_sa": ["licensed under cc by sa 4.0", "this work is licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "cc_by_nc": ["licensed under cc by nc 4.0", "this work is licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "cc_by_nd": ["licensed under cc by nd 4.0", "this work is licensed under cc by nd 4.0"],
    "cc0": ["licensed under cc0 1.0", "this work is dedicated to the public domain under cc0 1.0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "reserved": ["all rights reserved"],
}
#: Ordered rules: licence, identifiers that follow each other. Longer ones come first.
RULES = [
    ("apache-2.0", ["apache_licensed", "apache_may_not", "apache_obtain", "apache_unless"]),
    ("bsd-3-clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("mit", ["mit_grant", "mit_notice", "mit_warranty"]),
    ("gpl-3.0-or-later", ["gpl_free", "gpl_hope", "gpl_received"]),
    ("bsd-2-clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("apache-2.0", ["apache_licensed"]),
    ("mit", ["mit_released"]),
    ("isc", ["isc_grant"]),
    ("bsd", ["bsd_licensed"]),
    ("gpl-3.0-or-later", ["gpl_free"]),
    ("gpl-3.0", ["gpl3_work"]),
    ("gpl-2.0", ["gpl2_work"]),
    ("lgpl", ["lgpl_work"]),
    ("agpl-3.0", ["agpl_work"]),
    ("mpl-2.0", ["mpl_terms"]),
    ("cc-by-nc-4.0", ["cc_by_nc"]),
    ("cc-by-sa-4.0", ["cc_by_sa"]),
    ("cc-by-nd-4.0", ["cc_by_nd"]),
    ("cc-by-4.0", ["cc_by"]),
    ("cc0-1.0", ["cc0"]),
    ("unlicense", ["unlicense"]),
    ("all-rights-reserved", ["reserved"]),
]
#: What a text of known sentences must have in it somewhere (checked before cutting):
#: single words, so that blanks and line ends don't matter; each known sentence has one.
NEEDLE = r"licen[cs]e|redistribution|permission|warrant|reserved|domain|software|copy|endorse|cc0"
MARK, MARK_OR_LINE = r"[.;:!?]+(?:\s+|$)", r"[.;:!?]*\s*\n\s*|[.;:!?]+(?:\s+|$)"
MARK_OR_PARAGRAPH = r"[.;:!?]+(?:\s+|$)|\n[^A-Za-z0-9\n]*+\n"
#: Sentences whose own wording has sentence marks inside, and the most pieces these make.
ACROSS, MOST_PIECES = ("gpl_free", "gpl_hope", "mpl_terms"), 3


def normalise(sentence: Column) -> Column:
    """Lower case; anything but letters, digits and dots between digits becomes a space."""
    plain = F.regexp_replace(F.lower(sentence), r"[^a-z0-9.]+|\.(?![0-9])|(?<![0-9])\.", " ")
    return F.trim(F.regexp_replace(plain, " +", " "))


def identifiers(text: Column, border: str) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for name, texts in SENTENCES.items() for t in texts for x in (t, name)])
    found = F.transform(F.split(text, border, -1), lambda s: F.try_element_at(known, normalise(s)))
    return F.filter(found, lambda s: s.isNotNull())


def paragraph_identifiers(text: Column) -> Column:
    """The same by sentences and paragraphs, with the known sentences of several pieces."""
    known = F.create_map(*[F.lit(x) for name, texts in SENTENCES.items() for t in texts for x in (t, name)])
    across = F.create_map(*[F.lit(x) for name in ACROSS for t in SENTENCES[name] for x in (t, name)])
    heads = "^(?:" + "|".join(sorted({" ".join(t.split()[:2]) for name in ACROSS for t in SENTENCES[name]})) + r")\b"

    def found(pieces: Column) -> Column:
        joined = lambda i: [F.try_element_at(across, F.array_join(F.slice(pieces, i + 1, k), " ")) for k in range(2, MOST_PIECES + 1)]
        return F.transform(pieces, lambda s, i: F.coalesce(F.try_element_at(known, s), F.when(s.rlike(heads), F.coalesce(*joined(i)))))

    pieces = F.filter(F.transform(F.split(text, MARK_OR_PARAGRAPH, -1), normalise), lambda s: s != "")
    # Inside a lambda the pieces are made once, not once for each of them.
    return F.filter(F.flatten(F.transform(F.array(pieces), found)), lambda s: s.isNotNull())


def _matches(sequence: str) -> Column:
    """Licences of the rules that a sequence meets, in rule order."""
    joined = F.concat(F.lit(","), F.array_join(sequence, ","), F.lit(","))
    hits: list[Column] = []
    for i, (name, ids) in enumerate(RULES):
        longer = [hits[k] for k in range(i) if set(ids) < set(RULES[k][1])]
        hit = joined.contains("," + ",".join(ids) + ",")
        for other in longer:
            hit = hit & ~other
        hits.append(hit)
    return F.filter(F.array(*[F.when(h, F.lit(name)) for h, (name, _) in zip(hits, RULES)]), lambda x: x.isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentences (identifiers in order), licenses (distinct, in code-point order)."""
    text = F.coalesce(docs["text"], F.lit(""))
    needed = F.lower(text).rlike(NEEDLE)
    none = F.array().cast("array<string>")
    readings = {"_lines": identifiers(text, MARK_OR_LINE), "_marks": identifiers(text, MARK), "_parts": paragraph_identifiers(text)}
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *[F.when(needed, r).otherwise(none).alias(c) for c, r in readings.items()])
    # The reading that knows more sentences counts; of equal ones that by lines, then that by marks.
    best = F.when(F.size("_marks") > F.size("_lines"), F.col("_marks")).otherwise(F.col("_lines"))
    rows = rows.withColumn("sentences", F.when(F.size("_parts") > F.greatest(F.size("_lines"), F.size("_marks")), F.col("_parts")).otherwise(best))
    found = F.array_sort(F.array_union(F.array_union(_matches("_lines"), _matches("_marks")), _matches("_parts")))
    return rows.select("doc_id", "sentences", found.alias("licenses"))


def op10_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan of every text of documents."""
    rows = scan(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.array_join("sentences", ",").alias("sentences"), F.array_join("licenses", ",").alias("licenses"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_sql() -> str:
    """The same in DuckDB's SQL."""
    names = ", ".join(f"({_quoted(t)}, {_quoted(name)})" for name, texts in SENTENCES.items() for t in texts)
    plain = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(s), '[^a-z0-9.]+', ' ', 'g'), '\.([^0-9]|$)', ' \1', 'g'), ' +', ' ', 'g'))"
    plain = plain.replace(r"' +', ' ', 'g'))", r"'(^|[^0-9])\.', '\1 ', 'g'))")
    rules = []
    for i, (name, ids) in enumerate(RULES):
        cond = f"contains(q, {_quoted(',' + ','.join(ids) + ',')})"
        for k in range(i):
            if set(ids) < set(RULES[k][1]):
                cond += f" AND NOT contains(q, {_quoted(',' + ','.join(RULES[k][1]) + ',')})"
        rules.append(f"CASE WHEN {cond} THEN {_quoted(name)} END")
    cut = lambda border: f"list_filter(list_transform(string_split_regex(coalesce(text, ''), {_quoted(border)}), lambda s: known[regexp_replace({plain}, ' +', ' ', 'g')]), lambda x: x IS NOT NULL)"
    return f"""
WITH names AS (SELECT map(list(t), list(n)) AS known FROM (VALUES {names}) v(t, n)),
cut AS (SELECT doc_id, {cut(MARK_OR_LINE)} AS l, {cut(MARK)} AS m FROM documents, names),
hit AS (SELECT doc_id, l, m, list_filter(list_concat(
  (SELECT [{", ".join(rules)}] FROM (SELECT ',' || array_to_string(l, ',') || ',' AS q)),
  (SELECT [{", ".join(rules)}] FROM (SELECT ',' || array_to_string(m, ',') || ',' AS q))), lambda x: x IS NOT NULL) AS found FROM cut)
SELECT doc_id, greatest(len(l), len(m))::BIGINT AS n_sentences,
  array_to_string(CASE WHEN len(m) > len(l) THEN m ELSE l END, ',') AS sentences,
  coalesce(array_to_string(list_sort(list_distinct(found)), ','), '') AS licenses
FROM hit
"""

"""License scans by sentence rules.

A text is cut into sentences, each is normalised (ASCII lower case, runs of anything but letters, digits and
points to one space, outer points and spaces off) and looked up among known licence sentences.  Line ends within a
paragraph are read as spaces first; where no such sentence is known its lines are looked up, and where none of
these is known the parts around its colons.  The identifiers found, in order, form a sequence; ordered rules are matched against it, a rule that matches
consumes its identifiers, so a longer rule placed before a shorter one keeps the shorter from matching again.

Everything is an expression over one row: no shuffle, and a document's whole text is read.

Defined results
* n_sentences counts pieces between ``ENDS``, where each line end is one;
* null text: read as empty; no known sentence: an empty sequence and no licences;
* ties: the rule listed first wins; a licence found several times is reported once;
* repeated rows are scanned each, very long texts whole; an empty table gives no rows;
* other columns, whatever their names, are passed on, but for names that the operator adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import columns_of, let, unique

#: Where sentences end.
ENDS = r"[.!?;]+[ \t\r]+|[\r\n]+"
#: Identifier of each normalised sentence.  Fixed values.
SENTENCES = {
    "released under the mit license": "MITref",
    "licensed under the mit license": "MITref",
    "this project is licensed under the mit license": "MITref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "MITgrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITnotice",
    "the software is provided as is without warranty of any kind": "AsIs",
    "licensed under the apache license version 2.0": "Apache2ref",
    "licensed under the apache license version 2.0 the license": "Apache2ref",
    "you may not use this file except in compliance with the license": "ApacheCompliance",
    "you may obtain a copy of the license at": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "ApacheAsIs",
    "this work is licensed under the gnu general public license version 3": "GPL3ref",
    "this program is free software": "GPLfree",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GPLterms",
    "either version 3 of the license or at your option any later version": "GPL3later",
    "either version 2 of the license or at your option any later version": "GPL2later",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDgrant",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDnames",
    "licensed under cc by 4.0": "CCBY4ref",
    "licensed under cc by sa 4.0": "CCBYSA4ref",
    "licensed under cc by nc 4.0": "CCBYNC4ref",
    "this work is dedicated to the public domain": "PDref",
    "all rights reserved": "AllRights",
}
#: Ordered rules: licence and the sequence of identifiers that shows it.  Fixed values.
RULES = (
    ("MIT", ("MITgrant", "MITnotice", "AsIs")),
    ("MIT", ("MITgrant", "MITnotice")),
    ("MIT", ("MITref",)),
    ("Apache-2.0", ("Apache2ref", "ApacheCompliance", "ApacheCopy", "ApacheAsIs")),
    ("Apache-2.0", ("Apache2ref", "ApacheCompliance")),
    ("Apache-2.0", ("Apache2ref",)),
    ("GPL-3.0-or-later", ("GPLfree", "GPLterms", "GPL3later")),
    ("GPL-2.0-or-later", ("GPLfree", "GPLterms", "GPL2later")),
    ("GPL-3.0", ("GPL3ref",)),
    ("BSD-3-Clause", ("BSDgrant", "BSDnames")),
    ("BSD-2-Clause", ("BSDgrant",)),
    ("CC-BY-NC-4.0", ("CCBYNC4ref",)),
    ("CC-BY-SA-4.0", ("CCBYSA4ref",)),
    ("CC-BY-4.0", ("CCBY4ref",)),
    ("Public-Domain", ("PDref",)),
    ("Proprietary", ("AllRights",)),
)

#: Where sentences end if a line end inside a paragraph does not end one; comment marks alone make an empty line.
WRAPPED_ENDS = r"[.!?;]+[ \t\r\n]+|:[ \t]*[\r\n]+|\r?\n[ \t#*/-]*\r?\n"
_MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
_ISC = "permission to use copy modify {} distribute this software for any purpose with or without fee is hereby granted"
_CC = "this work is licensed under {} creative commons attribution{} 4.0 international license"
_GNU = {"GPL": "gnu general public license", "LGPL": "gnu lesser general public license", "AGPL": "gnu affero general public license"}
_GNU_VERSIONS = (("GPL", "2"), ("GPL", "3"), ("LGPL", "2.1"), ("LGPL", "3"), ("AGPL", "3"))
_FREE = [f"this {what} is free software" for what in ("program", "library", "file")]
_TERMS = "you can redistribute it and or modify it under the terms of the {} as published by the free software foundation"
_LATER = "either version {} of the license or at your option any later version"
#: Full sentences of the licences themselves, beside those above.  Fixed values.
FULL_SENTENCES = {
    _MIT: "MITgrant",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "AsIs",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheAsIs",
    **{f"you may obtain a copy of the license at {h} www.apache.org licenses license 2.0": "ApacheCopy" for h in ("http", "https")},
    "apache license version 2.0 january 2004": "Apache2title",
    **{f"apache license version 2.0 january 2004 {h} www.apache.org licenses": "Apache2title" for h in ("http", "https")},
    **{text: "GPLfree" for text in _FREE},
    **{_TERMS.format(name): f"{gnu}terms" for gnu, name in _GNU.items()},
    **{_LATER.format(v): f"GPL{v}later" for _, v in _GNU_VERSIONS},
    "version 2 of the license": "GPL2only",
    "version 3 of the license": "GPL3only",
    **{f"{_TERMS.format(_GNU[g])} {_LATER.format(v)}": f"{g}{v}header" for g, v in _GNU_VERSIONS},
    **{f"{free} {_TERMS.format(_GNU[g])} {_LATER.format(v)}": f"{g}{v}header" for free in _FREE for g, v in _GNU_VERSIONS},
    "gnu general public license version 2 june 1991": "GPL2title",
    "gnu general public license version 3 29 june 2007": "GPL3title",
    "gnu lesser general public license version 2.1 february 1999": "LGPL2.1title",
    "gnu lesser general public license version 3 29 june 2007": "LGPL3title",
    "gnu affero general public license version 3 19 november 2007": "AGPL3title",
    **{_ISC.format(a): "ZeroBSDgrant" for a in ("and", "and or")},
    **{f"{_ISC.format(a)} provided that the above copyright notice and this permission notice appear in all copies": "ISCgrant" for a in ("and", "and or")},
    "this source code form is subject to the terms of the mozilla public license v": "MPLform",
    **{f"if a copy of the mpl was not distributed with this file you can obtain one at {h} mozilla.org mpl 2.0": "MPL2copy" for h in ("http", "https")},
    "mozilla public license version 2.0": "MPL2title",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "boost software license version 1.0 august 17th 2003": "BSL1title",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "Zlibgrant",
    **{_CC.format(a, k): f"CCBY{i}4ref" for a in ("a", "the") for k, i in (("", ""), (" sharealike", "SA"), (" noncommercial", "NC"))},
}
#: Rules over these, matched before and after ``RULES``.  Fixed values.
FULL_RULES_FIRST = (
    ("GPL-3.0", ("GPL3title", "GPL3header")),
    ("GPL-2.0", ("GPL2title", "GPLfree", "GPLterms", "GPL2later")),
    ("AGPL-3.0", ("AGPL3title", "AGPL3header")),
    ("LGPL-2.1", ("LGPL2.1title", "GPLfree", "LGPLterms", "GPL2.1later")),
    ("Apache-2.0", ("Apache2title", "Apache2ref", "ApacheCompliance", "ApacheCopy", "ApacheAsIs")),
)
FULL_RULES = (
    *(
        (f"{g}-{v if '.' in v else v + '.0'}-or-later", ids)
        for g, v in _GNU_VERSIONS
        for ids in (
            (f"{g}{v}header",),
            ("GPLfree", f"{g}{v}header"),
            ("GPLfree", f"{g}terms", f"GPL{v}later"),
            (f"{g}terms", f"GPL{v}later"),
        )
    ),
    *((f"GPL-{v}.0-only", (*free, "GPLterms", f"GPL{v}only")) for v in "23" for free in (("GPLfree",), ())),
    ("GPL-3.0", ("GPL3title",)),
    ("GPL-2.0", ("GPL2title",)),
    ("LGPL-2.1", ("LGPL2.1title",)),
    ("LGPL-3.0", ("LGPL3title",)),
    ("AGPL-3.0", ("AGPL3title",)),
    ("Apache-2.0", ("Apache2title",)),
    ("ISC", ("ISCgrant",)),
    ("0BSD", ("ZeroBSDgrant",)),
    ("MPL-2.0", ("MPLform", "MPL2copy")),
    ("MPL-2.0", ("MPL2title",)),
    ("Unlicense", ("Unlicense",)),
    ("BSL-1.0", ("BSL1title",)),
    ("Zlib", ("Zlibgrant",)),
)


def normalised(sentence: Column) -> Column:
    lower = F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.regexp_replace(lower, r"[^a-z0-9.]+", " "), r"^[ .]+|[ .]+$", "")


def sequence(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order, each after a semicolon, one at the end."""
    known = F.create_map(*(F.lit(x) for pair in (FULL_SENTENCES | SENTENCES).items() for x in pair))
    name = lambda s: F.try_element_at(known, normalised(s))
    none = F.array().cast("array<string>")

    def parts(s: Column, ends: str) -> Column:
        return F.filter(F.transform(F.split(s, ends, -1), name), lambda i: i.isNotNull())

    def one(s: Column) -> Column:
        at_colons = F.when(s.contains(":"), parts(s, r":[ \t\r\n]+")).otherwise(none)
        by_line = let(parts(s, r"[\r\n]+"), lambda found: F.when(F.size(found) > 0, found).otherwise(at_colons))
        apart = F.when(s.rlike(r"[\r\n]"), by_line).otherwise(at_colons)
        return let(name(s), lambda i: F.when(i.isNotNull(), F.array(i)).otherwise(apart))

    ids = F.flatten(F.transform(F.split(text, WRAPPED_ENDS, -1), one))
    return F.concat(F.lit(";"), F.array_join(F.filter(ids, lambda i: i.isNotNull()), ";"), F.lit(";"))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with n_sentences, sentence_ids (joined by ;) and licenses (joined by ,), in place of columns of these names."""
    inner = unique("ids")
    text = F.coalesce(F.col("text"), F.lit(""))
    rules = F.array(
        *(
            F.struct(F.lit(n).alias("name"), F.lit(";" + ";".join(ids) + ";").alias("ids"))
            for n, ids in (*FULL_RULES_FIRST, *RULES, *FULL_RULES)
        )
    )
    begun = F.struct(F.col(inner).alias("left"), F.array().cast("array<string>").alias("found"))

    def one(state: Column, rule: Column) -> Column:
        hit = F.contains(state["left"], rule["ids"])
        return F.struct(
            F.when(hit, F.replace(state["left"], rule["ids"], F.lit(";;"))).otherwise(state["left"]).alias("left"),
            F.when(hit, F.concat(state["found"], F.array(rule["name"]))).otherwise(state["found"]).alias("found"),
        )

    kept = [c for c, name in zip(columns_of(docs), docs.columns) if name not in ("n_sentences", "sentence_ids", "licenses")]
    found = F.aggregate(rules, begun, one, lambda s: F.array_join(F.array_distinct(s["found"]), ","))
    sentences = F.size(F.filter(F.split(text, ENDS, -1), lambda s: F.trim(s) != "")).cast("long")
    return docs.select(*kept, sentences.alias("n_sentences"), sequence(text).alias(inner)).select(
        *kept,
        "n_sentences",
        F.trim(F.col(inner), F.lit(";")).alias("sentence_ids"),
        F.when(F.col(inner) == ";;", F.lit("")).otherwise(found).alias("licenses"),
    )


def duckdb_sql() -> str:
    """The same over the view ``documents``, for DuckDB, but with ``SENTENCES`` and ``RULES`` on unwrapped lines only."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in SENTENCES.items())
    steps = []
    for k, (name, ids) in enumerate(RULES):
        pattern = quoted(";" + ";".join(ids) + ";")
        steps.append(
            f"r{k} AS (SELECT *, replace(l{k}, {pattern}, ';;') AS l{k + 1}, "
            f"CASE WHEN contains(l{k}, {pattern}) THEN {quoted(name)} END AS f{k} FROM {f'r{k - 1}' if k else 'r'})"
        )
    names = list(dict.fromkeys(n for n, _ in RULES))
    spelled = ", ".join(
        f"CASE WHEN coalesce({', '.join(f'f{k}' for k, r in enumerate(RULES) if r[0] == n)}) IS NOT NULL THEN {quoted(n)} END"
        if sum(r[0] == n for r in RULES) > 1
        else f"f{next(k for k, r in enumerate(RULES) if r[0] == n)}"
        for n in names
    )
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
cut AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?;]+[ \\t\\r]+|[\\r\\n]+'),
                     lambda s: trim(s) <> '') AS parts
  FROM documents),
lines AS (SELECT rid, unnest(parts) AS s, generate_subscripts(parts, 1) AS k FROM cut),
named AS (
  SELECT rid, string_agg(id, ';' ORDER BY k) AS ids FROM lines JOIN known ON sentence =
    regexp_replace(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^a-z0-9.]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')
  GROUP BY rid),
r AS (SELECT c.doc_id, len(c.parts) AS n_sentences, coalesce(n.ids, '') AS sentence_ids,
             ';' || coalesce(n.ids, '') || ';' AS l0 FROM cut c LEFT JOIN named n USING (rid)),
{", ".join(steps)}
SELECT doc_id, n_sentences::BIGINT AS n_sentences, sentence_ids, concat_ws(',', {spelled}) AS licenses
FROM r{len(RULES) - 1}
"""

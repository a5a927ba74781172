"""Licence recognition by sentence rules, in DataFrame expressions only.

A text is split into sentences; a line without letters or digits ends one too, be it empty or only comment marks.
Lines are normalised (lower case, every run of other than letters and digits one space, so comment marks
go), and a known sentence is found from the beginning of a line, or of a sentence, to the end of one, wrapped or not,
whatever stands before it; of several that begin together the longest counts. The identifiers of the
sentences found, in text order, are matched against ordered rules: a rule is a sequence of identifiers,
some of them optional. The rules are tried in their order, and what a rule matches it uses up, so the
longer licence of a family comes first and a text of one licence gives one. Everything happens inside the row; there is no shuffle.

Rows: null and empty texts have no sentences; every input row gives one output row; equal rows
stay; an empty table gives no rows. Added columns replace input columns of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without

# Known licence sentences, and the order in which licences use them.
SENTENCES = {
    "apache2-notice": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license"],
    "apache2-comply": ["you may not use this file except in compliance with the license"],
    "apache2-copy": ["you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at"],
    "apache2-url": ["http www apache org licenses license 2 0", "https www apache org licenses license 2 0"],
    "apache2-basis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache2-see": ["see the license for the specific language governing permissions and limitations under the license"],
    "mit-notice": ["released under the mit license", "licensed under the mit license", "the mit license", "mit license", "the mit license mit"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-keep": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as-is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "gpl-notice": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"],
    "fsf-free": ["this program is free software", "this library is free software", "this file is free software", "this software is free software"],
    "gpl-terms": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "you may redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "gpl2-later": ["either version 2 of the license or at your option any later version"],
    "gpl2-only": ["you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2"],
    "gpl3-terms": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "lgpl-terms": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "lgpl2-later": ["either version 2 1 of the license or at your option any later version"],
    "lgpl3-terms": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "agpl3-terms": ["you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "fsf-warranty": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "this program is distributed in the hope that it will be useful but without any warranty", "this library is distributed in the hope that it will be useful but without any warranty"],
    "fsf-implied": ["without even the implied warranty of merchantability or fitness for a particular purpose"],
    "fsf-see": ["see the gnu general public license for more details", "see the gnu lesser general public license for more details", "see the gnu affero general public license for more details"],
    "mpl2-terms": ["this source code form is subject to the terms of the mozilla public license v", "this source code form is subject to the terms of the mozilla public license version 2 0"],
    "mpl2-copy": ["if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"],
    "epl1-terms": ["this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html"],
    "epl2-terms": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "cc-by": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc0": ["this work is licensed under cc0 1 0", "dedicated to the public domain under cc0 1 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}
_FSF_END = ["fsf-warranty?", "fsf-implied?", "fsf-see?"]
# Licence, and its rule over identifiers in the order the rules are tried; "?" marks an optional sentence.
RULES = [
    ("Apache-2.0", ["apache2-notice", "apache2-comply?", "apache2-copy?", "apache2-url?", "apache2-basis?", "apache2-see?"]),
    ("MIT", ["mit-notice?", "mit-grant", "mit-keep?", "as-is?"]),
    ("MIT-notice", ["mit-notice"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "as-is?"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "as-is?"]),
    ("GPL-3.0-notice", ["gpl-notice"]),
    ("AGPL-3.0-or-later", ["fsf-free?", "agpl3-terms", *_FSF_END]),
    ("LGPL-3.0-or-later", ["fsf-free?", "lgpl3-terms", *_FSF_END]),
    ("LGPL-2.1-or-later", ["fsf-free?", "lgpl-terms", "lgpl2-later", *_FSF_END]),
    ("GPL-3.0-or-later", ["fsf-free?", "gpl3-terms", *_FSF_END]),
    ("GPL-2.0-or-later", ["fsf-free?", "gpl-terms", "gpl2-later", *_FSF_END]),
    ("GPL-2.0-only", ["fsf-free?", "gpl2-only", *_FSF_END]),
    ("MPL-2.0", ["mpl2-terms", "mpl2-copy?"]),
    ("EPL-2.0", ["epl2-terms"]),
    ("EPL-1.0", ["epl1-terms"]),
    ("ISC", ["isc-grant", "as-is?"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC0-1.0", ["cc0"]),
    ("Unlicense", ["unlicense"]),
]
#: Every known sentence has one of these; a text or sentence without any is not normalised at all.
CUES = ["licens", "copyright", "software", "public domain", "redistributi", "warranty", "mozilla"]
CUE = "(?i)(" + "|".join(c.replace(" ", "[^a-z0-9]+") for c in CUES) + ")"
#: Ends of sentences: a full stop and the like before white space or the end, or a line without letters or digits.
SENTENCE_END = r"[.!?:;]+(?:[\x20\x09-\x0D]+|$)|\n[^\p{L}\p{N}\n]*\n"
#: Lines a known sentence may be wrapped over: more than it has words.
WRAPPED = max(t.count(" ") for ts in SENTENCES.values() for t in ts) + 2


def rule_pattern(rule: list[str]) -> str:
    """The rule over the identifiers of a text, each between two spaces of its own."""
    return "".join(f"( {s[:-1]} )?" if s.endswith("?") else f" {s} " for s in rule)


def sentence_pattern() -> str:
    """At the beginning of a line, the longest known sentence that ends with a line; lines are normal and joined by line feeds."""
    known = sorted((t for ts in SENTENCES.values() for t in ts), key=lambda t: (-len(t), t))
    return "(?<![^\\n])(?=(" + "|".join(t.replace(" ", "[ \\n]") for t in known) + ")(?![^\\n]))"


def normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def scan(docs: DataFrame) -> DataFrame:
    """All columns of `docs` and `n_sentences` (long: non-empty ones), `sentence_ids` (array of the identifiers
    found, in text order) and `licenses` (array, in rule order)."""
    docs = without(docs, "n_sentences", "sentence_ids", "licenses")
    known = [(text, i) for i, texts in SENTENCES.items() for text in texts]
    ids = F.create_map(*[F.lit(x) for pair in known for x in pair])
    parts = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), SENTENCE_END), lambda s: F.length(F.trim(s)) > 0)

    def look_up(s: Column) -> Column:
        lines = F.array_join(F.filter(F.transform(F.split(s, "\n"), normal), lambda x: x != ""), "\n")
        return F.transform(F.regexp_extract_all(lines, F.lit(sentence_pattern()), F.lit(1)), lambda x: ids[F.translate(x, "\n", " ")])

    found = F.when(F.col("text").rlike(CUE), F.flatten(F.transform(F.filter(parts, lambda s: s.rlike(CUE)), look_up))).otherwise(
        F.array().cast("array<string>"))
    docs = docs.withColumns({"n_sentences": F.size(parts).cast("long"), "sentence_ids": found})
    row, names = F.array_join(F.transform("sentence_ids", lambda x: F.concat(F.lit(" "), x, F.lit(" "))), ""), []
    for name, rule in RULES:
        names.append(F.when(row.rlike(rule_pattern(rule)), F.lit(name)))
        row = F.regexp_replace(row, rule_pattern(rule), " - ")
    none = F.array().cast("array<string>")
    return docs.withColumn("licenses", F.when(F.size("sentence_ids") > 0, F.filter(F.array(*names), lambda x: x.isNotNull())).otherwise(none))


def sql(documents: str = "documents") -> str:
    """The query's rows in DuckDB SQL: every stretch of lines that equals a known sentence, the longest of each beginning."""
    known = ", ".join(f"('{text}', '{i}')" for i, texts in SENTENCES.items() for text in texts)
    end, cue = SENTENCE_END.replace("'", "''"), CUE.replace("'", "''")
    norm = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
    steps = "named0 AS (SELECT *, [] :: VARCHAR[] AS names FROM counted)"
    for i, (name, rule) in enumerate(RULES):
        p = rule_pattern(rule)
        steps += f""",
named{i + 1} AS (SELECT r, doc_id, n_sentences, n, regexp_replace(ids, '{p}', ' - ', 'g') AS ids,
  CASE WHEN regexp_matches(ids, '{p}') THEN list_append(names, '{name}') ELSE names END AS names FROM named{i})"""
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
docs AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{end}'),
                lambda s: length(trim(s)) > 0) AS parts FROM {documents}),
sentences AS (SELECT r, generate_subscripts(parts, 1) AS i, unnest(parts) AS s FROM docs),
lined AS (SELECT r, i, list_filter(list_transform(string_split(s, chr(10)), lambda x: {norm('x')}), lambda x: x <> '') AS ls
          FROM sentences WHERE regexp_matches(s, '{cue}')),
starts AS (SELECT r, i, ls, unnest(range(1, len(ls) + 1)) AS j FROM lined),
spans AS (SELECT r, i, j, ls, unnest(range(j, least(j + {WRAPPED}, len(ls) + 1))) AS k FROM starts),
found AS (SELECT r, i, j, arg_max(id, k) AS id FROM spans JOIN known ON array_to_string(ls[j:k], ' ') = sentence GROUP BY r, i, j),
rows AS (SELECT r, count(*) AS n, string_agg(' ' || id || ' ', '' ORDER BY i, j) AS ids FROM found GROUP BY r),
counted AS (SELECT d.r, d.doc_id, len(d.parts)::BIGINT AS n_sentences, coalesce(f.n, 0)::BIGINT AS n, coalesce(f.ids, '') AS ids
            FROM docs d LEFT JOIN rows f USING (r)),
{steps}
SELECT doc_id, n_sentences, n AS n_license_sentences, array_to_string(names, ',') AS licenses FROM named{len(RULES)}"""

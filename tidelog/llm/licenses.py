"""License scans by sentence rules.

A text is cut into pieces at sentence and line ends; each is normalised (lower case, letters and digits
kept, all else one blank). A known licence sentence is found where one piece, or several that follow one
another, have its words and no others: sentences may be wrapped, quoted or behind comment marks, and may
have colons, semicolons and abbreviations in them. Of sentences that begin at one piece the longest is
taken, and the next search begins behind it. The identifiers found, in order, are held
against ordered rules: a rule matches when its identifiers occur in its order, other identifiers
between them allowed. The first rule that matches names the document's licence; rules are listed
from the most to the least specific, so a full text comes before a mere mention.

Defined cases: null and empty texts have no sentences, and no licence; every row gives one row, and equal
texts equal ones; repeated sentences repeat their identifier; of rules that match alike the first listed
names the licence, and ``licenses`` has all; all other columns are carried in a struct, so no name can clash.
A very long text takes a few copies of itself in the task that has it; patterns have no repeated groups,
so neither a long line nor a hundred thousand sentences recurse.

All of it is Column expressions in one projection. Texts without any anchor, a word that every known
sentence has one of, are settled by a single pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known sentences, normalised, by identifier.
SENTENCES = {
    "apache2-notice": "licensed under the apache license version 2 0",
    "apache2-use": "you may not use this file except in compliance with the license",
    "apache2-obtain": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache2-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-notice": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit-asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-asis": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-asis": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-see": "see the gnu lesser general public license for more details",
    "agpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-see": "see the gnu affero general public license for more details",
    "cc-by-nc4": "licensed under cc by nc 4 0",
    "cc-by4": "licensed under cc by 4 0",
    "cc-by-sa4": "licensed under cc by sa 4 0",
    "cc-by4-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-asis": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "mpl2-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-asis": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
}

# Other wordings of these sentences.
WORDINGS = {
    "licensed under the apache license version 2 0 the license": "apache2-notice",
    "the asf licenses this file to you under the apache license version 2 0 the license": "apache2-notice",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache2-obtain",
    "you may obtain a copy of the license at http www apache org licenses license 2 0 html": "apache2-obtain",
    "you may obtain a copy of the license at https www apache org licenses license 2 0 html": "apache2-obtain",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit-condition",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "neither the name of copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
}

# Rules in order; the identifiers must occur in this order.
RULES = (
    ("Apache-2.0", "full", ("apache2-notice", "apache2-use", "apache2-obtain", "apache2-asis", "apache2-see")),
    ("MIT", "full", ("mit-grant", "mit-condition", "mit-asis")),
    ("BSD-3-Clause", "full", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", "full", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", "full", ("gpl-free", "gpl-asis", "gpl-see")),
    ("GPL-2.0-or-later", "full", ("gpl2-free", "gpl-asis", "gpl-see")),
    ("LGPL-2.1-or-later", "full", ("lgpl21-free", "lgpl-asis", "lgpl-see")),
    ("AGPL-3.0-or-later", "full", ("agpl3-free", "gpl-asis", "agpl-see")),
    ("ISC", "full", ("isc-grant", "isc-asis")),
    ("GPL-3.0", "notice", ("gpl3-notice",)),
    ("GPL-3.0-or-later", "notice", ("gpl-free",)),
    ("GPL-2.0-or-later", "notice", ("gpl2-free",)),
    ("LGPL-2.1-or-later", "notice", ("lgpl21-free",)),
    ("AGPL-3.0-or-later", "notice", ("agpl3-free",)),
    ("MPL-2.0", "notice", ("mpl2-notice",)),
    ("Apache-2.0", "notice", ("apache2-notice",)),
    ("CC-BY-NC-4.0", "notice", ("cc-by-nc4",)),
    ("CC-BY-SA-4.0", "notice", ("cc-by-sa4",)),
    ("CC-BY-4.0", "notice", ("cc-by4",)),
    ("CC-BY-4.0", "notice", ("cc-by4-work",)),
    ("MIT", "notice", ("mit-notice",)),
    ("MIT", "notice", ("mit-licensed",)),
    ("MIT", "grant", ("mit-grant",)),
    ("ISC", "grant", ("isc-grant",)),
    ("Unlicense", "notice", ("unlicense-free",)),
)

ANCHOR = "(?i)(licen[cs]e|permission|redistribut|warrant|copyright|unencumbered)"
BREAK = r"[.!?;:]+([\x20\x09-\x0D]+|$)|[\r\n]+"


# An address ends a piece, as no full stop follows it.
ADDRESS = r"(://[^\x20\x09\n]+)[\x20\x09]?"
# Before a piece: comment words, and list marks as (1) or a).
LEAD = r"\n *(?:dnl|rem)(?=[ \n])"
ITEM = r"\n[^a-z0-9\n]*[a-z0-9]\)(?=[\x20\x09])"


def known_pattern() -> str:
    """Any known sentence between piece ends, the longest first; a piece end may stand between its words."""
    listed = sorted({*SENTENCES.values(), *WORDINGS}, key=lambda s: (-len(s), s))
    return "(?<=\\| )(?:" + "|".join(s.replace(" ", " (?:\\| )?") for s in listed) + ")(?= \\|)"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    ends = F.regexp_replace(F.concat(F.lit("\n"), F.lower(text), F.lit("\n")), BREAK, "\n")
    words = F.regexp_replace(F.regexp_replace(F.regexp_replace(ends, ADDRESS, "$1\n"), ITEM, "\n"), r"[^a-z0-9\n]+", " ")
    pieces = F.regexp_replace(F.regexp_replace(words, LEAD, "\n"), r" *\n[ \n]*", " | ")
    known = F.create_map(*[F.lit(x) for s, k in [*((s, k) for k, s in SENTENCES.items()), *WORDINGS.items()] for x in (s, k)])
    found = F.transform(F.regexp_extract_all(pieces, F.lit(known_pattern()), F.lit(0)), lambda s: F.element_at(known, F.replace(s, F.lit("| "), F.lit(""))))
    return F.when(text.rlike(ANCHOR), found).otherwise(F.array().cast("array<string>"))


def rule_pattern(ids: tuple[str, ...]) -> str:
    """A rule as a pattern, for engines whose patterns are automata."""
    return "(^|,)" + ",(?:[^,]+,)*".join(ids) + "(,|$)"


def follows_rule(sentence_ids: Column, ids: tuple[str, ...]) -> Column:
    """The same: each identifier is sought behind the first place of the one before, in steps as many as the rule has."""
    rest = F.concat(F.lit(","), sentence_ids, F.lit(","))
    for x in ids:
        rest = F.concat(F.lit(","), F.get(F.split(rest, f",{x},", 2), F.lit(1)))
    return rest.isNotNull()


def recognise(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row``, a struct of the columns of ``docs`` but the text, and what was recognised."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    read = docs.select(F.struct(*rest).alias("row"), sentence_ids(F.coalesce(F.col(text), F.lit(""))).alias("ids"))
    seq = read.select("row", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"))
    match = [F.when(follows_rule(F.col("sentence_ids"), ids), F.lit(k)) for k, (_, _, ids) in enumerate(RULES)]
    rules = seq.withColumn("hits", F.when(F.col("n_sentences") > 0, F.array_compact(F.array(*match))).otherwise(F.array().cast("array<int>")))
    names = F.array(*[F.lit(name) for name, _, _ in RULES])
    forms = F.array(*[F.lit(form) for _, form, _ in RULES])
    first = F.get("hits", F.lit(0))
    return rules.select(
        "row",
        "n_sentences",
        "sentence_ids",
        F.get(names, first).alias("license"),
        F.get(forms, first).alias("form"),
        F.array_join(F.array_distinct(F.transform("hits", lambda k: F.get(names, k))), ",").alias("licenses"),
    )


def licenses_query(docs: DataFrame) -> DataFrame:
    """op7: what each document's sentences say about its licence."""
    return recognise(docs.select("doc_id", "text")).select("row.doc_id", "n_sentences", "sentence_ids", "license", "form", "licenses")

"""Licences of documents, found by their sentences.

A text is unwrapped and cut into sentences; a sentence is normalised to lower-case letters and digits with single spaces
and mapped to the identifier of a known licence sentence, or of the licence that it names ("Released under the ...").
Clauses that name their holder are read with the holder of the known sentence. Other sentences between the clauses of a
BSD licence are a gap: with a further condition it is another licence.

Rules are sequences of identifiers; the rules are tried in order on the identifiers of a document, and a rule takes the
identifiers that it matches, so that a full licence text isn't also found as a shorter one.

All of it is column expressions in one narrow pass; only texts with a word of licences are cut into sentences.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postflow.llm.common import aside, text_of

# Sentences of public licence texts, names of licences, and rules over both.
SENTENCES = {
    "MIT-GRANT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:"
    ),
    "MIT-NOTICE": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-WARRANTY": (
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of "
        "merchantability, fitness for a particular purpose and noninfringement."
    ),
    "MIT-LIABILITY": (
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, "
        "tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."
    ),
    "ISC-GRANT": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "ISC-WARRANTY": (
        "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of "
        "merchantability and fitness."
    ),
    "BSD-GRANT": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    ),
    "BSD-SOURCE": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-BINARY": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "BSD-NAMES": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."
    ),
    "BSD-WARRANTY": (
        "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not "
        "limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed."
    ),
    "APACHE-HEADER": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "APACHE-USE": "You may not use this file except in compliance with the License.",
    "APACHE-WARRANTY": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"as is\" basis, "
        "without warranties or conditions of any kind, either express or implied."
    ),
    "GPL2-GRANT": (
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
    ),
    "GPL2-LATER": "Either version 2 of the License, or (at your option) any later version.",
    "GPL3-GRANT": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "LGPL3-GRANT": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "AGPL3-GRANT": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MPL-FORM": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "UNLICENSE": "This is free and unencumbered software released into the public domain.",
    "ALL-RIGHTS": "All rights reserved.",
}
#: Licences and the names they go by in a sentence, normalised.
NAMES = {
    "MIT": ("mit license", "mit licence", "mit"),
    "ISC": ("isc license", "isc"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0", "apache license v2 0"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "bsd 2 clause", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "bsd 3 clause", "new bsd license", "modified bsd license"),
    "GPL-2.0": ("gnu general public license version 2", "gnu general public license v2 0", "gnu gpl v2", "gpl 2 0", "gpl v2", "gplv2", "gpl 2 0 only"),
    "GPL-3.0": ("gnu general public license version 3", "gnu general public license v3 0", "gnu gpl v3", "gpl 3 0", "gpl v3", "gplv3", "gpl 3 0 only"),
    "GPL-2.0-or-later": ("gnu general public license version 2 or later", "gpl 2 0 or later", "gpl v2 or later", "gplv2 or later"),
    "GPL-3.0-or-later": ("gnu general public license version 3 or later", "gpl 3 0 or later", "gpl v3 or later", "gplv3 or later"),
    "LGPL-2.1": ("gnu lesser general public license version 2 1", "lgpl 2 1", "lgpl v2 1", "lgplv2 1"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "lgpl 3 0", "lgpl v3", "lgplv3"),
    "AGPL-3.0": ("gnu affero general public license version 3", "agpl 3 0", "agpl v3", "agplv3"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"),
    "CC0-1.0": ("cc0 1 0", "cc0", "creative commons zero v1 0 universal"),
    "CC-BY-4.0": ("cc by 4 0", "creative commons attribution 4 0 international license"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"),
    "CC-BY-ND-4.0": ("cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license"),
    "CC-BY-NC-ND-4.0": ("cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0 international license"),
    "Unlicense": ("unlicense", "the unlicense"),
}
#: Tried in order. A named licence is an identifier of its own, ``NAMED-x``.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("MIT-GRANT", "MIT-NOTICE", "MIT-WARRANTY", "MIT-LIABILITY")),
    ("ISC", ("ISC-GRANT", "ISC-WARRANTY")),
    ("BSD-3-Clause", ("BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-NAMES", "BSD-WARRANTY")),
    ("BSD-2-Clause", ("BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-WARRANTY")),
    ("Apache-2.0", ("APACHE-HEADER", "APACHE-USE", "APACHE-WARRANTY")),
    ("Apache-2.0", ("APACHE-HEADER", "APACHE-USE")),
    ("GPL-2.0-or-later", ("GPL2-GRANT", "GPL2-LATER")),
    ("GPL-3.0-or-later", ("GPL3-GRANT",)),
    ("LGPL-3.0-or-later", ("LGPL3-GRANT",)),
    ("AGPL-3.0-or-later", ("AGPL3-GRANT",)),
    ("MPL-2.0", ("MPL-FORM",)),
    ("Unlicense", ("UNLICENSE",)),
    *[(name, (f"NAMED-{name}",)) for name in NAMES],
    ("LicenseRef-All-Rights-Reserved", ("ALL-RIGHTS",)),
]
#: A text without a match has no licence sentence.
HINT = r"(?i)licen[sc]|right|warrant|redistribut|permission|free software|unencumbered|in no event|either version"
#: What a line of a comment or a list begins with.
LEADER = r"(?m)^[ \t]*(?:[*#/;-]+|\(?[0-9]{1,2}[.)])[ \t]+"
#: How sentences begin that can follow a text without a full stop.
OPENERS = (
    r"(?i:(?:this|the) (?:work|software|program|project|file|code|document|text|page|content) is (?:licensed|released|distributed|available|"
    r"published|provided)\b|this source code form is|this program is free|permission is hereby|permission to use|the above copyright notice and "
    r"this permission notice shall|in no event shall|redistributions? (?:and use in|of source|in binary)|neither the name|you may not use|"
    r"unless required by|this is free and|all rights reserved|spdx-license-identifier)|(?:Licensed|Released|Distributed|Available|Published) under"
)
#: A normalised sentence that names its licence; the name is the group.
NAMING = (
    r"^(?:(?:this|the) (?:work|software|program|project|file|code|document|text|page|content) is )?(?:licensed|released|distributed|available|"
    r"published) under (?:the )?(?:terms of )?(?:the )?(.+)$|^spdx license identifier (.+)$"
)
#: Clauses that name a holder, and their words with the known one. A holder's full stop ends no sentence.
HOLDERS = (
    (
        r"(?i)\bneither\s+the\s+names?\s+(?:of\s+)?[^\x01;:]+?\s+nor\s+the\s+names?\s+of\s+(?:\w+\s+)?contributors?\s+may\b",
        "Neither the name of the copyright holder nor the names of its contributors may",
    ),
    (
        r"(?i)\bthis\s+software\s+is\s+provided\s+by\s+[^\x01;:]+?\s[^\w\s\x01]*as\s+is\W*?\s+and\s+any\s+express(?:ed)?\b",
        "This software is provided by the copyright holders and contributors as is and any express",
    ),
    (
        r"(?i)\b(the\s+software\s+is\s+provided\s+[^\w\s\x01]*as\s+is\W*?\s+and\s+)[^\x01;:]+?\s+disclaims?\s+all\s+warranties\b",
        "$1the author disclaims all warranties",
    ),
    (
        r"(?i)\bin\s+no\s+event\s+shall\s+[^\x01.;:]+?\s+be\s+liable\s+for\s+any\s+claim\b",
        "In no event shall the authors or copyright holders be liable for any claim",
    ),
)
#: What stands for an unknown sentence of three words or more, and where it counts.
GAP = "~"
OPEN = r"(?<!\|BSD-(?:GRANT|SOURCE|BINARY|NAMES)\|)\|~\|"
# End of fixed values.

#: Stands between sentences while a text is cut. It is a control character, and normalising drops those.
CUT = "\x01"
#: Pattern and replacement, in order.
CUTTING = (
    (CUT, " "),
    (LEADER, ""),
    (r"\n[ \t]*\n", CUT),
    (r"([.!?;]) *[ \n]", "$1" + CUT),
    (rf"[ \n]({OPENERS})", CUT + "$1"),
)
#: Within a sentence: abbreviations whose full stop ends no sentence.
ABBREVIATED = (r"\b([Vv])\. ([0-9])", "$1 $2")


def normalised(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def identifiers() -> dict[str, str]:
    """Normalised sentences and their identifiers."""
    return {normalised(s.replace("v. 2", "v 2")): name for name, s in SENTENCES.items()}


def names() -> dict[str, str]:
    """Normalised names and their identifiers."""
    return {alias: f"NAMED-{name}" for name, aliases in NAMES.items() for alias in aliases}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def sentences(text: Column) -> Column:
    """The normalised sentences of a text, in order."""
    text = F.regexp_replace(text, *ABBREVIATED)
    # paragraphs are cut before holders are looked for, sentences behind that
    for pattern, replacement in (*CUTTING[:3], *HOLDERS, *CUTTING[3:]):
        text = F.regexp_replace(text, pattern, replacement)
    return F.transform(F.split(text, CUT), lambda s: F.btrim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))


def _identifier(sentence: Column) -> Column:
    named = F.concat(F.regexp_extract(sentence, NAMING, 1), F.regexp_extract(sentence, NAMING, 2))
    return F.coalesce(_lookup(identifiers(), sentence), _lookup(names(), named), F.when(F.contains(F.regexp_replace(sentence, "^[^ ]+ [^ ]+", ""), F.lit(" ")), GAP))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with ``licenses``, ``sentence_ids`` and ``unmatched``: names or identifiers joined by
    ``|``, empty strings where there are none.

    ``licenses`` has every licence once, in the order of the rules; ``sentence_ids`` are all identifiers in the order of
    the text, ``unmatched`` those that no rule took.

    **Defined cases.** A null or empty text has no licence. Rows are read one by one, so repeated rows and ids stay; a
    licence that occurs several times in a text is reported once. Other columns stay, ones named like a result are
    replaced. An empty table gives an empty table. Texts are read whole, whatever their length.
    """
    results = ("licenses", "sentence_ids", "unmatched")
    docs, named = aside(docs, "text")
    kept = [F.col(c) for c in docs.columns if c != "text"]
    text = text_of()
    found = F.filter(F.transform(sentences(text), _identifier), lambda i: i.isNotNull())
    step = docs.select(*kept, F.when(text.rlike(HINT), found).otherwise(F.array().cast("array<string>")).alias("_ids"))
    # bars around every identifier, so that neighbours can both be taken
    step = step.select(*kept, F.concat(F.lit("|"), F.array_join("_ids", "||"), F.lit("|")).alias("_all"))
    step = step.select(*kept, F.regexp_replace(F.regexp_replace("_all", r"(?:\|~\|)++", "|~|"), OPEN, "").alias("_left"))
    left, gap = F.col("_left"), F.lit(f"|{GAP}|")
    step = step.select(*kept, "_left", F.btrim(F.replace(F.replace(left, gap, F.lit("")), F.lit("||"), F.lit("|")), F.lit("|")).alias("sentence_ids"))
    taken = []
    for name, rule in RULES:
        sequence = F.lit(f"|{'||'.join(rule)}|")
        taken.append(F.when(F.contains(left, sequence), F.lit(name)))
        left = F.replace(left, sequence, F.lit(""))
    some = F.col("sentence_ids") != ""
    return step.select(
        *[column for c, column in named.items() if c not in ("text", *results)],
        F.when(some, F.array_join(F.array_distinct(F.array(*taken)), "|")).otherwise("").alias("licenses"),
        "sentence_ids",
        F.when(some, F.btrim(F.replace(F.replace(left, gap, F.lit("")), F.lit("||"), F.lit("|")), F.lit("|"))).otherwise("").alias("unmatched"),
    )

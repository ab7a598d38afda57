"""Licence recognition: known sentences, then ordered rules over their identifiers.

Texts are cut into pieces at line ends and after `.`, `!`, `?` or `;` before white space. A sentence
is one piece, or the lines from a line's start to the next sentence end, blank line or list marker.
Sentences are normalised (lower case, everything but letters and digits as one space) and looked up
among known licence sentences. The identifiers found, in order, are matched against rules: a rule
names identifiers that must follow each other in that order, others may lie between. All of it is
expressions inside the row, so the plan is one scan without a shuffle. A cheap test for the stems
that every known sentence holds keeps most texts from being cut at all.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of published licences and of usual notices, by identifier.
SENTENCES = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "Licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:"),
    "mit-condition": (
        "The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."),
    "apache-2-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2-grant": (
        "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    "apache-2-comply": (
        "you may not use this file except in compliance with the License."),
    "gpl-3-notice": (
        "This work is licensed under the GNU General Public License, version 3."),
    "gpl-2-notice": (
        "This work is licensed under the GNU General Public License, version 2."),
    "cc-by-nc-4-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4-notice": "Licensed under CC BY-SA 4.0.",
    "bsd-redistribute": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:"),
    "bsd-endorse": (
        "Neither the name of the copyright holder nor the names of its contributors may be used "
        "to endorse or promote products derived from this software without specific prior written "
        "permission."),
    "no-warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT."),
    "rights-reserved": "All rights reserved.",
}

#: (licence, identifiers in order); for one licence any of its rules will do.
RULES = (
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-notice-2",)),
    ("MIT", ("mit-grant", "mit-condition", "no-warranty")),
    ("MIT", ("mit-title", "mit-grant")),
    ("Apache-2.0", ("apache-2-notice",)),
    ("Apache-2.0", ("apache-2-grant", "apache-2-comply")),
    ("GPL-3.0", ("gpl-3-notice",)),
    ("GPL-2.0", ("gpl-2-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-notice",)),
    ("CC-BY-4.0", ("cc-by-4-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-notice",)),
    ("BSD-3-Clause", ("bsd-redistribute", "bsd-endorse")),
)

#: The tables of the operator: those above, which the SQL counterpart has too, and more.
ALL_SENTENCES = SENTENCES | {
    "mit-title-2": "MIT License",
    "mit-title-3": "The MIT License",
    "bsd-2-title": "BSD 2-Clause License",
    "bsd-3-title": "BSD 3-Clause License",
    "isc-title": "ISC License",
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies."),
    "isc-grant-2": (
        "Permission to use, copy, modify, and distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies."),
    "unlicense-public": (
        "This is free and unencumbered software released into the public domain."),
    **{f"{name}{kind}": f"{start} under the terms of the GNU {title}General Public License as "
                        "published by the Free Software Foundation" + end
       for name, title in (("gpl", ""), ("lgpl", "Lesser "), ("agpl", "Affero "))
       for kind, start, end in (
           ("-terms", "you can redistribute it and/or modify it", ";"),
           ("-terms-2", "you can redistribute it and/or modify it", ", either version 2 of the "
            "License, or (at your option) any later version."),
           ("-head-3", "This program is free software: you can redistribute it and/or modify it",
            ", either version 3 of the License, or (at your option) any later version."),
           ("-head-3-library", "This library is free software: you can redistribute it and/or "
            "modify it", ", either version 3 of the License, or (at your option) any later "
            "version."))},
    **{f"or-later-{v}": f"either version {v} of the License, or (at your option) any later version."
       for v in ("2", "2.1", "3")},
    "mpl-2-head": (  # the cut lies after "v."
        "This Source Code Form is subject to the terms of the Mozilla Public License, v."),
    "mpl-2-copy": (
        "If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/."),
}
ALL_RULES = (
    *RULES,
    ("MIT", ("mit-title-2", "mit-grant")),
    ("MIT", ("mit-title-3", "mit-grant")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("BSD-2-Clause", ("bsd-2-title", "bsd-redistribute")),
    ("BSD-3-Clause", ("bsd-3-title", "bsd-redistribute")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-grant-2",)),
    ("Unlicense", ("unlicense-public",)),
    ("GPL-2.0-or-later", ("gpl-terms or-later-2",)),
    ("GPL-2.0-or-later", ("gpl-terms-2",)),
    ("GPL-3.0-or-later", ("gpl-terms or-later-3",)),
    ("GPL-3.0-or-later", ("gpl-head-3",)),
    ("GPL-3.0-or-later", ("gpl-head-3-library",)),
    ("LGPL-2.0-or-later", ("lgpl-terms or-later-2",)),
    ("LGPL-2.1-or-later", ("lgpl-terms or-later-2.1",)),
    ("LGPL-3.0-or-later", ("lgpl-terms or-later-3",)),
    ("LGPL-3.0-or-later", ("lgpl-head-3",)),
    ("LGPL-3.0-or-later", ("lgpl-head-3-library",)),
    ("AGPL-3.0-or-later", ("agpl-terms or-later-3",)),
    ("AGPL-3.0-or-later", ("agpl-head-3",)),
    ("AGPL-3.0-or-later", ("agpl-head-3-library",)),
    ("MPL-2.0", ("mpl-2-head", "mpl-2-copy")),
)

#: Every known sentence holds one of these in lower case.
STEMS = ("licen", "permission", "permitted", "warrant", "compliance", "rights reserved",
         "mozilla", "unencumbered")

_ENDS, _LINES = r"([.!?;])[ \t]+", r"[\r\n]+"
#: A sentence end before a line end, and a line end before a blank line or a list marker.
_LAST = r"([.!?;][\"')\]]*)[ \t]*(?=[\r\n])"
_BREAK = (r"(\r\n|\n|\r(?!\n))(?=[^a-zA-Z0-9\r\n]*[\r\n]"
          r"|[ \t]*(?:-|\(?[0-9a-zA-Z]{1,2}[.)])[ \t\x1e])")


def normalised_sentence(text: str) -> str:
    return " ".join(re.findall("[a-z0-9]+", text.lower()))


def _normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def sentence_ids(text: Column, known: Mapping[str, str]) -> Column:
    """(piece number, identifier) of the known sentences of a text, in order.

    A sentence over several lines has the number of its first piece.
    """
    names = {normalised_sentence(sentence): name for name, sentence in known.items()}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    most_words = max(len(s.split()) for s in names)

    def named(sentence: Column) -> Column:
        return F.try_element_at(table, sentence)

    def of_lines(lines: Column) -> Column:
        """A line alone, or all from it to the end; no known sentence has more lines than words."""
        return F.transform(lines, lambda line, i: F.when(line != "", F.coalesce(
            named(line),
            F.when((F.size(lines) - i).between(2, most_words), named(F.array_join(
                F.slice(lines, i + 1, F.size(lines)), " "))))))

    marked = F.regexp_replace(F.translate(text, "\x1e", " "), _ENDS, "$1\x1e\n")
    marked = F.regexp_replace(F.regexp_replace(marked, _LAST, "$1\x1e"), _BREAK, "\x1e$1")
    # Every mark lies before a line end, so the pieces of all parts are those of the whole text.
    parts = F.split(marked, "\x1e+[\r\n]+")
    lines = F.transform(parts, lambda part: F.transform(F.split(part, _LINES), _normalised))
    pieces = F.flatten(F.transform(lines, of_lines))
    found = F.transform(pieces, lambda name, i: F.struct(i.alias("at"), name.alias("id")))
    return F.filter(found, lambda x: x["id"].isNotNull())


def rule_pattern(identifiers: Sequence[str]) -> str:
    """A pattern over the identifiers of a text, each between two spaces."""
    return r" (?:\S+ )*?".join(" " + re.escape(i) if n == 0 else re.escape(i)
                               for n, i in enumerate(identifiers)) + " "


def find_licences(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    known: Mapping[str, str] = ALL_SENTENCES,
    rules: Sequence[tuple[str, Sequence[str]]] = ALL_RULES,
    stems: Sequence[str] = STEMS,
) -> DataFrame:
    """doc_id, licence, sentences and first_at: one row per text and licence found in it.

    ``sentences`` holds the identifiers of all known sentences of the text in order; ``first_at``
    is the number of the first of them among the pieces. Texts without a licence, null and empty ones give no row.
    """
    bad = [s for s in known.values() if not any(stem in s.lower() for stem in stems)]
    if bad:
        raise ValueError(f"no stem finds {bad[0]!r}")
    text = F.col(f"`{text_col}`")
    low = F.lower(text)
    likely = F.lit(False)
    for stem in stems:
        likely = likely | F.contains(low, F.lit(stem))
    found = (
        docs.where(likely)
        .select(F.col(f"`{id_col}`").alias("doc_id"), sentence_ids(text, known).alias("found"))
        .where(F.size("found") > 0)
        .select("doc_id", F.transform("found", lambda x: x["id"]).alias("sentences"),
                F.element_at("found", 1)["at"].cast("long").alias("first_at"))
    )
    line = F.concat(F.lit(" "), F.array_join("sentences", " "), F.lit(" "))
    names = list(dict.fromkeys(name for name, _ in rules))
    hits = [
        F.when(
            F.expr("false") if not patterns else
            _any(F.rlike(line, F.lit(p)) for p in patterns), F.lit(name))
        for name in names
        for patterns in [[rule_pattern(ids) for n, ids in rules if n == name]]
    ]
    return found.select(
        "doc_id", F.explode(F.array_compact(F.array(*hits))).alias("licence"),
        F.array_join("sentences", " ").alias("sentences"), "first_at")


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out

"""Licence recognition by sentences and ordered rules, in DataFrame functions only."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of well-known licence texts and notices, by identifier.
SENTENCES: dict[str, str] = {
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit_notice_kept": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as_is": "the software is provided as is without warranty of any kind express or implied",
    "mit_title": "mit license",
    "mit_released": "released under the mit license",
    "mit_licensed": "licensed under the mit license",
    "mit_tag": "spdx license identifier mit",
    "apache_title": "apache license",
    "apache_version": "version 2 0 january 2004",
    "apache_notice": "licensed under the apache license version 2 0",
    "apache_notice_the": "licensed under the apache license version 2 0 the license",
    "apache_compliance": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at",
    "apache_tag": "spdx license identifier apache 2 0",
    "gpl_title": "gnu general public license",
    "gpl_v3_title": "version 3 29 june 2007",
    "gpl_v2_title": "version 2 june 1991",
    "gpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl_v3_later": "either version 3 of the license or at your option any later version",
    "gpl_v2_later": "either version 2 of the license or at your option any later version",
    "gpl_v3_notice": "this work is licensed under the gnu general public license version 3",
    "gpl_v2_notice": "this work is licensed under the gnu general public license version 2",
    "gpl_v3_tag": "spdx license identifier gpl 3 0 or later",
    "gpl_v3_only_tag": "spdx license identifier gpl 3 0 only",
    "gpl_v2_tag": "spdx license identifier gpl 2 0 or later",
    "lgpl_title": "gnu lesser general public license",
    "lgpl_v21_title": "version 2 1 february 1999",
    "lgpl_free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl_v21_later": "either version 2 1 of the license or at your option any later version",
    "lgpl_v3_tag": "spdx license identifier lgpl 3 0 or later",
    "lgpl_v21_tag": "spdx license identifier lgpl 2 1 or later",
    "bsd_allowed": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_neither": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_tag": "spdx license identifier bsd 3 clause",
    "bsd_2_tag": "spdx license identifier bsd 2 clause",
    "mpl_notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl_tag": "spdx license identifier mpl 2 0",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "cc0_notice": "released under cc0 1 0",
    "cc_by_notice": "licensed under cc by 4 0",
    "cc_by_sa_notice": "licensed under cc by sa 4 0",
    "cc_by_nc_notice": "licensed under cc by nc 4 0",
    "cc_by_nd_notice": "licensed under cc by nd 4 0",
    "reserved": "all rights reserved",
}

#: Sentences as published texts go on with them, with the identifiers that they stand for.
WORDINGS: dict[str, str] = {
    SENTENCES["mit_grant"] + " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    SENTENCES["mit_notice_kept"].replace("this permission notice", "this permission notice including the next paragraph"): "mit_notice_kept",
    SENTENCES["as_is"] + " including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as_is",
    SENTENCES["as_is"] + " including but not limited to the warranties of merchantability fitness for a particular purpose and non infringement": "as_is",
    SENTENCES["gpl_free"] + " " + SENTENCES["gpl_v3_later"]: "gpl_free gpl_v3_later",
    SENTENCES["gpl_free"] + " " + SENTENCES["gpl_v2_later"]: "gpl_free gpl_v2_later",
    SENTENCES["lgpl_free"] + " " + SENTENCES["lgpl_v21_later"]: "lgpl_free lgpl_v21_later",
    SENTENCES["lgpl_free"] + " " + SENTENCES["gpl_v3_later"]: "lgpl_free gpl_v3_later",
    SENTENCES["isc_grant"].replace("and or distribute", "and distribute"): "isc_grant",
}

#: Licence, then the identifiers that must be found in this order (others may stand between).
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("mit", ("mit_grant", "mit_notice_kept")),
    ("mit", ("mit_title", "mit_grant")),
    ("mit", ("mit_released",)),
    ("mit", ("mit_licensed",)),
    ("mit", ("mit_tag",)),
    ("apache-2.0", ("apache_title", "apache_version")),
    ("apache-2.0", ("apache_notice",)),
    ("apache-2.0", ("apache_notice_the",)),
    ("apache-2.0", ("apache_tag",)),
    ("gpl-3.0", ("gpl_title", "gpl_v3_title")),
    ("gpl-3.0", ("gpl_free", "gpl_v3_later")),
    ("gpl-3.0", ("gpl_v3_notice",)),
    ("gpl-3.0", ("gpl_v3_tag",)),
    ("gpl-3.0", ("gpl_v3_only_tag",)),
    ("gpl-2.0", ("gpl_title", "gpl_v2_title")),
    ("gpl-2.0", ("gpl_free", "gpl_v2_later")),
    ("gpl-2.0", ("gpl_v2_notice",)),
    ("gpl-2.0", ("gpl_v2_tag",)),
    ("lgpl-3.0", ("lgpl_title", "gpl_v3_title")),
    ("lgpl-3.0", ("lgpl_free", "gpl_v3_later")),
    ("lgpl-3.0", ("lgpl_v3_tag",)),
    ("lgpl-2.1", ("lgpl_title", "lgpl_v21_title")),
    ("lgpl-2.1", ("lgpl_free", "lgpl_v21_later")),
    ("lgpl-2.1", ("lgpl_v21_tag",)),
    ("bsd-3-clause", ("bsd_tag",)),
    ("bsd-3-clause", ("bsd_allowed", "bsd_source", "bsd_binary", "bsd_neither")),
    ("bsd-2-clause", ("bsd_2_tag",)),
    ("bsd", ("bsd_allowed", "bsd_source", "bsd_binary")),
    ("mpl-2.0", ("mpl_notice",)),
    ("mpl-2.0", ("mpl_tag",)),
    ("isc", ("isc_grant",)),
    ("cc0-1.0", ("cc0_notice",)),
    ("cc-by-4.0", ("cc_by_notice",)),
    ("cc-by-sa-4.0", ("cc_by_sa_notice",)),
    ("cc-by-nc-4.0", ("cc_by_nc_notice",)),
    ("cc-by-nd-4.0", ("cc_by_nd_notice",)),
]
#: A sentence ends at a line break, or at a full stop, question or exclamation mark, colon or semicolon before a space or tab.
BREAK = r"[\n\r]|[.!?:;]+[ \t]+"


def normalised(sentence: Column) -> Column:
    """A-Z lowered; each run of other characters than a-z and 0-9 as one space; none at the ends."""
    return F.trim(F.regexp_replace(F.translate(sentence, ascii_uppercase, ascii_lowercase), "[^a-z0-9]+", " "))


def sentence_ids(text: Column, sentences: dict[str, str] | None = None) -> Column:
    """Identifiers of the known sentences of a text, in its order.

    A sentence is one part between breaks, or several in a row: a sentence that
    is wrapped, or that has a colon in it, is found over the breaks, but not over
    a blank line. What one part says by itself goes before what several say.
    """
    known = {words: name for name, words in (SENTENCES if sentences is None else sentences).items()}
    if sentences is None:
        known |= WORDINGS
    longest = max(map(len, known))
    # Normalised parts with a bar around each; what is empty, or longer than every known sentence when normalised, is a second bar, over which none goes.
    parts = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), BREAK)
    line = F.concat(F.lit("|"), F.array_join(F.transform(F.transform(parts, normalised), lambda s: F.when(F.length(s) <= longest, s).otherwise("")), "|"), F.lit("|"))
    by_length = sorted(known, key=lambda words: (-len(words), words))
    pattern = "|".join([*by_length, *(words.replace(" ", "[ |]") for words in by_length)])
    found = F.regexp_extract_all(line, F.lit(f"[|]({pattern})(?=[|])"), F.lit(1))
    table = F.create_map(*[F.lit(x) for words, name in known.items() for x in (words, name)])
    return F.flatten(F.transform(found, lambda s: F.split(F.element_at(table, F.translate(s, "|", " ")), " ")))


def matched_licences(ids: Column, rules: list[tuple[str, tuple[str, ...]]] | None = None) -> Column:
    """Licences whose rule's identifiers stand in ``ids`` in the rule's order, sorted, each once."""
    line = F.concat(F.lit(" "), F.array_join(ids, " "), F.lit(" "))
    hits = []
    for licence, order in RULES if rules is None else rules:
        pattern = ".*".join(f" {i} " if n == 0 else f"(?<= ){i} " for n, i in enumerate(order))
        hits.append(F.when(line.rlike(pattern), F.lit(licence)))
    return F.array_sort(F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull())))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``sentence_ids`` and ``licences`` (arrays), from every whole text.

    Row by row: no shuffle, whatever one source or group of copies holds. Null
    and empty texts give empty arrays; repeated sentences are listed as often as
    they occur. Columns of the same names are replaced.
    """
    kept = [f"`{c}`" for c in docs.columns if c not in ("sentence_ids", "licences")]
    found = docs.select(*kept, sentence_ids(F.coalesce(F.col("text"), F.lit(""))).alias("sentence_ids"))
    return found.withColumn("licences", matched_licences(F.col("sentence_ids")))

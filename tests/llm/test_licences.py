import textwrap

from rinkline.llm import licences

SCHEMA = "doc_id long, text string, licences string"
MIT = (
    "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    'associated documentation files (the "Software"), to deal in the Software without restriction. '
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
)


def found(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: (r.sentence_ids, r.licences) for r in licences.scan(df).collect()}


def test_notices_and_rules(spark):
    got = found(spark, [MIT, "Text. Released under the MIT License.", "# SPDX-License-Identifier: Apache-2.0", "words\nLicensed under CC BY-NC 4.0.\nmore", "Permission is hereby granted. Nothing else."])
    assert got[0] == (["mit_title", "mit_grant", "mit_notice_kept"], ["mit"])
    assert got[1] == (["mit_released"], ["mit"])
    assert got[2][1] in (["apache-2.0"], [])
    assert got[3][1] == ["cc-by-nc-4.0"]
    assert got[4] == ([], [])


def test_order_matters(spark):
    title, version = "GNU GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007"
    got = found(spark, [f"{title}\n{version}", f"{version}\n{title}", f"{title}\nMIT License\n{version}"])
    assert got[0][1] == ["gpl-3.0"] and got[1][1] == [] and got[2][1] == ["gpl-3.0"]


def test_edge_rows(spark):
    got = found(spark, [None, "", ". \n.\n", "All rights reserved.\nall RIGHTS reserved", "x" * 300000 + "\nAll rights reserved", "words " * 50000])
    assert [got[i][0] for i in range(6)] == [[], [], [], ["reserved"] * 2, ["reserved"], []]
    assert found(spark, []) == {}


def test_every_sentence_is_recognised_and_every_rule_can_match(spark):
    names = list(licences.SENTENCES)
    got = found(spark, [licences.SENTENCES[n].upper() for n in names])
    assert [got[i][0] for i in range(len(names))] == [[n] for n in names]
    got = found(spark, ["\n".join(licences.SENTENCES[i] for i in order) for _, order in licences.RULES])
    assert all(licence in got[i][1] for i, (licence, _) in enumerate(licences.RULES))


def test_runs_without_shuffle_or_python(spark):
    plan = licences.scan(spark.createDataFrame([(1, "a", "x")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal '
    "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
    "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
KEPT = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR '
    "A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY."
)
FULL_MIT = ["MIT License", "Copyright (c) 2020 Some One", GRANT, KEPT, AS_IS]
FULL_BSD = [
    "Copyright (c) 2020, Some One\nAll rights reserved.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software.",
]
FULL_ISC = [
    "Copyright (c) 2020 Some One",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
    "notice and this permission notice appear in all copies.",
]
APACHE = [
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of '
    "the License at",
    "http://www.apache.org/licenses/LICENSE-2.0",
]
GPL = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."


def wrapped(paragraphs, width, mark="", end="\n"):
    lines = []
    for p in paragraphs:
        lines += [*(x for part in p.split("\n") for x in textwrap.wrap(part, width)), ""]
    return end.join(mark + x for x in lines)


def test_full_texts_as_published_are_recognised(spark):
    texts = [(FULL_MIT, "mit"), (FULL_BSD, "bsd"), (FULL_ISC, "isc"), (APACHE, "apache-2.0"), ([GPL.format(":", ",", 3)], "gpl-3.0"), ([GPL.format(";", ";", 2)], "gpl-2.0")]
    forms = [(78, "", "\n"), (70, "", "\r\n"), (72, " * ", "\n"), (74, "# ", "\n"), (2000, "", "\n"), (40, "// ", "\n")]
    cases = [(wrapped(p, *form), licence) for p, licence in texts for form in forms]
    got = found(spark, [t for t, _ in cases])
    for i, (text, licence) in enumerate(cases):
        assert got[i][1] == [licence], text
    assert got[0][0] == ["mit_title", "mit_grant", "mit_notice_kept", "as_is"]
    assert got[6][0] == ["reserved", "bsd_allowed", "bsd_source", "bsd_binary"]
    assert got[24][0] == ["gpl_free", "gpl_v3_later"]


def test_no_sentence_over_a_blank_line_or_from_the_middle_of_a_part(spark):
    got = found(spark, ["released under\n\nthe MIT License", "never released under\nthe MIT License", "released under\nthe MIT License", "released under\nthe MIT License here"])
    assert [got[i][0] for i in range(4)] == [[], [], ["mit_released"], []]


def test_marks_do_not_make_a_sentence_too_long(spark):
    got = found(spark, ["MIT License " + "=" * 2000, "Released under the MIT License" + " *" * 5000, "x " * 3000 + "\nMIT License", "MIT License " + "y" * 2000])
    assert [got[i][0] for i in range(4)] == [["mit_title"], ["mit_released"], ["mit_title"], []]


LGPL = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
NEITHER = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


def test_lesser_licences_and_clauses_are_told_apart(spark):
    texts = [
        (["GNU LESSER GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007"], ["lgpl-3.0"]),
        (["GNU Lesser General Public License", "Version 2.1, February 1999"], ["lgpl-2.1"]),
        ([LGPL.format("2.1")], ["lgpl-2.1"]),
        ([LGPL.format("3")], ["lgpl-3.0"]),
        ([*FULL_BSD[:-1], NEITHER], ["bsd", "bsd-3-clause"]),
        (FULL_BSD[:-1], ["bsd"]),
    ]
    cases = [(wrapped(p, *form), want) for p, want in texts for form in ((78, "", "\n"), (60, "# ", "\r\n"), (3000, "", "\n"))]
    got = found(spark, [t for t, _ in cases])
    assert [got[i][1] for i in range(len(cases))] == [want for _, want in cases]

import pytest

from meshwright.llm import licenses as L


@pytest.fixture(scope="module")
def trained(spark):
    return L.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_families_are_found_and_others_left(spark, trained):
    prose = "Then the river turned and the houses stood by the water in a long row"
    texts = {
        1: prose,
        2: f"{prose}\nReleased under the MIT License.\n{prose}",
        3: f"{prose} This work is licensed under the GNU General Public License, version 3. {prose}",
        4: "Licensed under CC BY-NC 4.0.",
        5: "licensed  under the APACHE license version 2.0",
        6: None,
        7: "",
        8: "Licensed under the terms of a license that nobody has seen.",
        9: f"The apache of the village had a license to fish. {prose}",
    }
    docs = spark.createDataFrame([*texts.items(), (4, texts[4]), (None, prose)], "doc_id long, text string").selectExpr("*", "'x' AS license")
    rows = L.scan(docs, trained=trained).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts) + 2
    assert {d: got[d].license for d in range(1, 8)} == {1: "none", 2: "mit", 3: "gpl-3.0", 4: "cc-by-nc-4.0", 5: "apache-2.0", 6: "none", 7: "none"}
    assert got[8].license in ("unknown", "none") and not got[9].confirmed and got[None].license == "none"
    assert got[2].confirmed and got[2].paragraphs == 1
    assert L.scan(docs.limit(0), trained=trained).collect() == []


def wrapped(text, width, mark=""):
    import textwrap

    return "\n".join(mark + x for x in textwrap.wrap(text, width))


def test_wrapped_notices_are_read_whole(spark, trained):
    prose = " ".join(["The river turned and the houses stood by the water in a long row"] * 6)
    texts, want = [], []
    for family, notice in (("mit", L.NOTICES["mit"][3]), ("gpl-3.0", L.NOTICES["gpl-3.0"][1]), ("isc", L.NOTICES["isc"][1]), ("bsd-3-clause", L.NOTICES["bsd-3-clause"][0]), ("apache-2.0", L.NOTICES["apache-2.0"][1])):
        for mark in ("", "# ", " * ", "// "):
            texts.append(f"{prose}\n\n{mark}Copyright (c) 2020 A. Person\n{mark}\n{wrapped(notice, 70, mark)}\n\n{prose}")
            want.append(family)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in L.scan(docs, trained=trained).collect()}
    assert [(i, got[i].license) for i in range(len(texts)) if got[i].license != want[i] or not got[i].confirmed] == []


def test_paragraphs(spark):
    long = "x" * 150
    cases = {"a\nb\n\nc": ["a b", "c"], f"a\n{long}\nb\nc": ["a", long, "b c"], "# a\n#\n# b": ["a", "b"], "": [], " \n\t\n": [], "one": ["one"], "a\r\nb\r\n\r\nc": ["a b", "c"]}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    from pyspark.sql import functions as F

    assert {r.t: r.p for r in df.select("t", L.paragraphs(F.col("t")).alias("p")).collect()} == cases


def test_training_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert L.scan(docs).collect() == []


def test_query_against_the_notices_that_are_in_the_texts(spark):
    got = {r.doc_id: r.license for r in L.op7_licence_scan(spark, "/root/testdata/sf0.01").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    notices = [(f, t) for f, ts in L.NOTICES.items() if f != "unknown" for t in ts]
    for r in rows:
        held = {f for f, t in notices if t.lower() in (r.text or "").lower()}
        assert got[r.doc_id] in held if held else got[r.doc_id] in ("none", "unknown")
    wrong = {r.doc_id: r.text[:60] for r in rows if got[r.doc_id] == "unknown"}
    assert len(wrong) <= 0.01 * len(got), list(wrong.items())[:8]
    assert sum(g == "unknown" for g in got.values()) <= 0.01 * len(got)


def test_siblings_and_other_versions_are_told_apart(spark, trained):
    texts = {
        "This work is licensed under the GNU General Public License, version 2.": "gpl-2.0",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "lgpl-3.0",
        "This work is licensed under the GNU Affero General Public License, version 3.": "agpl-3.0",
        "Licensed under CC BY-SA 4.0.": "cc-by-sa-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa-4.0",
        "Released under the BSD 2-Clause License.": "bsd-2-clause",
        "Licensed under CC BY-ND 4.0.": None,
        "Licensed under CC BY-NC-SA 4.0.": None,
        "Licensed under the Apache License, Version 1.1.": None,
        "This work is licensed under the GNU General Public License, version 1.": None,
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {list(texts)[r.doc_id]: r.license if r.confirmed else None for r in L.scan(docs, trained=trained).collect()}
    assert got == texts
    notices = [(f, t) for f, ts in L.NOTICES.items() if f != "unknown" for t in ts]
    own = L.with_grams(spark.createDataFrame(notices, "family string, paragraph string"))
    for f in sorted(L.NOTICES):
        assert all(r[0] == 1.0 for r in own.where(own.family == f).select(L.shared_with(f, own.pairs, distinct=True)).collect())


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software without
   specific prior written permission.
"""


def test_identifiers_versions_line_ends_and_other_licences(spark, trained):
    """Wordings that are in no list of the module."""
    mit = L.NOTICES["mit"][3].replace(", subject", ",\r\nsubject").replace(", and to permit", ",\r\nand to permit")
    texts = {
        "# SPDX-License-Identifier: MIT": "mit",
        "// SPDX-License-Identifier: Apache-2.0\n\npackage main": "apache-2.0",
        "SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3.0",
        "SPDX-License-Identifier: LGPL-3.0-only": "lgpl-3.0",
        "SPDX-License-Identifier: BSD-2-Clause": "bsd-2-clause",
        "You can use this library under the GNU General Public License, version 3 or later.": "gpl-3.0",
        "Everything here is licensed under the GPLv3.": "gpl-3.0",
        mit: "mit",
        BSD: "bsd-2-clause",
        BSD + THIRD: "bsd-3-clause",
        BSD.replace("\n", "\r\n"): "bsd-2-clause",
        "The photographs are licensed under CC BY 3.0 by their authors.": "unknown",
        "Made available under the Eclipse Public License 2.0, which accompanies this distribution.": "unknown",
        "This is free and unencumbered software released into the public domain by its author.": "unknown",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {list(texts)[r.doc_id]: r.license for r in L.scan(docs, trained=trained).collect()}
    assert {t: g for t, g in got.items() if g != texts[t]} == {}


def test_a_very_long_line_and_a_very_long_text(spark, trained):
    words = "the river turned and the houses stood by the water " * 20_000
    docs = spark.createDataFrame([(1, words + "Released under the ISC License. " + words), (2, (words[:400] + "\n\n") * 2_000 + "Licensed under CC BY-SA 4.0.\n")], "doc_id long, text string")
    assert {r.doc_id: r.license for r in L.scan(docs, trained=trained).collect()}[2] == "cc-by-sa-4.0"


def test_the_driver_gets_few_sums_for_a_step_of_the_fit(spark):
    rows = spark.range(0, 70, 1, 7).selectExpr("id", "id % 10 = 0 AS kept_back")
    fit = L.rows_to_fit(rows)
    assert fit.rdd.getNumPartitions() <= L.FIT_TASKS and fit.count() == 63

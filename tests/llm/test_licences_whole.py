import textwrap

from tactigrid.llm import licences

PLAIN = "the river was quiet that night and nobody spoke"


def test_wrapped_notices_are_read_whole(spark):
    wrapped = ["\n".join(textwrap.wrap(licences.TEXTS[f][0], 40)) for f in ("mit", "bsd")]
    assert all(w.count("\n") > 2 for w in wrapped)
    texts = [f"{PLAIN}\n\n{wrapped[0]}\n\n{PLAIN}", wrapped[1].replace("\n", "\r\n"), f"{PLAIN}\nReleased under the MIT License.\n{PLAIN}", f"Released under the MIT License.\n{PLAIN}\nDistributed under the AGPL v3.", PLAIN]
    got = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    by = lambda i: sorted((r["paragraph"], r["family"]) for r in got if r["doc_id"] == i and r["confirmed"])
    assert [by(i) for i in range(5)] == [[(1, "mit")], [(0, "bsd")], [(0, "mit")], [(0, "agpl-3.0"), (0, "mit")], []]
    assert any(r["doc_id"] == 3 and r["line"] == 2 for r in got)
    assert all(sum(r["doc_id"] == i for r in got) == 1 for i in (0, 1))


def test_repeats_and_clashing_names(spark):
    notice = "Released under the MIT License."
    rows = [(1, PLAIN), (7, notice), (7, notice), (None, notice), (8, f"{PLAIN} " * 600 + "\n\n" + notice)]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "'a' AS paragraph", "2 AS line")).collect()
    assert sorted((r["doc_id"] or 0, r["paragraph"], r["family"], r["confirmed"]) for r in got) == [(0, 0, "mit", True), (7, 0, "mit", True), (7, 0, "mit", True), (8, 1, "mit", True)]


#: Notices that stand in no training example.
UNSEEN = [
    ("gpl-2.0", "This package is free software; you may redistribute it and modify it under the terms of the GNU General Public License published by the Free Software Foundation; either version 2, or (at your option) any later version."),
    ("gpl-3.0", "The tool is free software: redistribute and modify it under the GNU General Public License of the Free Software Foundation, version 3 of the License or any later version."),
    ("gpl-3.0", "Everything here falls under GPLv3."), ("gpl-2.0", "Kernel parts: GPL-2.0 license"), ("lgpl", "The bindings are offered under the GNU LGPL, version 2.1 or any newer one."),
    ("agpl-3.0", "The server is covered by the GNU Affero General Public License v3."), ("apache-2.0", "All code in this directory is under the Apache 2.0 license."), ("apache-2.0", "Contributions are accepted under the Apache License, Version 2.0 only."),
    ("mit", "The package is MIT-licensed."), ("mit", "Copies or substantial portions of the Software shall include the above copyright notice and this permission notice."), ("mit", "These scripts may be used under the MIT license."),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."), ("bsd", "The parser carries the BSD 3-Clause License."),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the copyright notice and this permission notice appear in all copies."),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."),
    ("mpl-2.0", "The contents of this file are subject to the Mozilla Public License Version 2.0"), ("cc-by-sa", "Text is available under the Creative Commons Attribution-ShareAlike License 3.0."),
    ("cc-by", "Figures are shared under the Creative Commons Attribution 4.0 International License."), ("cc-by-nc", "Photos: CC BY-NC 4.0 licence"), ("cc0", "The data set is dedicated to the public domain under CC0."),
]
NO_LICENCE = [
    "Her driving licence was taken away last winter.", "She got a licence to sell beer in the market.", "Das ist mit der Zeit besser.", "He went to MIT to study.", "The software was slow but free of charge.", "Copyright law is a difficult subject.",
    "We had permission to use the hall for any purpose.", "Public interest in version 3 was low.", "An apache pilot told the story.", "The lesser road led to the library.",
]


def test_notices_outside_the_fit(spark):
    made = {text for _, text, _ in licences.examples(spark)}
    assert not any(t in made for _, t in UNSEEN) and not any(t in made for t in NO_LICENCE)
    texts = [t for _, t in UNSEEN] + NO_LICENCE + [PLAIN] * 3
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    right = [i in got and got[i]["family"] == f for i, (f, _) in enumerate(UNSEEN)]
    assert sum(right) >= 0.9 * len(right), [UNSEEN[i] for i, x in enumerate(right) if not x]
    assert not [texts[i] for i in got if i >= len(UNSEEN)]
    wrong = [r for i, r in got.items() if i < len(UNSEEN) and r["confirmed"] and r["family"] != UNSEEN[i][0]]
    assert not wrong

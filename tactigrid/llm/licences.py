"""Licence scans with a trained paragraph classifier, with DataFrame functions and Spark ML only.

Paragraphs (between blank lines, their line ends folded) and the lines of those that have several become sparse vectors of hashed word n-grams; multinomial logistic regression
gives a probability for each licence family, for other licences and for no licence. It is fitted on
the names and texts below, put together by rule, and on sentences of no licence and a bounded sample
of the corpus's own lines. A family's probability must reach a level that held-out wordings set;
licence paragraphs below it are "unknown". Comparison with the family's texts and names confirms or not,
and only if the words are there that tell it from its neighbours, such as a version.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .fingerprint import let

FEATURES = 1 << 14
#: Documents whose last line stands for no licence, about, at most.
SAMPLE = 4000
#: Part of a text's words that a paragraph holds at least, to be confirmed.
OVERLAP = 0.6
#: A paragraph that is not confirmed is some licence from this probability on.
LEAST = 0.5
NONE, OTHER = "none", "unknown"
#: All that is no part of a word; Java matches a class of single characters about nine times as fast as one of ranges.
GAP = "[^abcdefghijklmnopqrstuvwxyz0123456789+]"
# Names of licences by family, paragraphs of their texts and usual notices, other licences, and sentences about licences and other things.
NAMES = {
    "apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0", "Apache Software License 2.0", "Apache licence, v2.0"),
    "mit": ("MIT License", "MIT", "MIT licence", "Expat License", "MIT/X11 license", "MIT-style license"),
    "isc": ("ISC License", "ISC", "ISC licence"),
    "zlib": ("zlib License", "Zlib", "zlib/libpng license"),
    "gpl-3.0": ("GNU General Public License, version 3", "GNU General Public License version 3 or later", "GNU GPL version 3", "GPL v3", "GPLv3", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0"),
    "gpl-2.0": ("GNU General Public License, version 2", "GNU General Public License version 2 or later", "GNU GPL version 2", "GPL v2", "GPLv2", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0"),
    "lgpl": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License version 3", "GNU Library General Public License", "LGPL", "LGPL-2.1-or-later", "LGPLv3", "GNU LGPL"),
    "agpl-3.0": ("GNU Affero General Public License, version 3", "AGPL v3", "AGPLv3", "AGPL-3.0-only", "AGPL-3.0-or-later", "GNU AGPL version 3"),
    "bsd": ("BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "BSD license", "BSD", "BSD-3", "BSD-style license", "New BSD license", "Simplified BSD licence"),
    "mpl-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0", "MPL v2"),
    "cc-by": ("CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 3.0 Unported License", "CC BY"),
    "cc-by-sa": ("CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 3.0 License", "CC BY-SA"),
    "cc-by-nc": ("CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 3.0", "CC BY-NC"),
    "cc0": ("CC0 1.0 Universal", "CC0 1.0", "CC0-1.0", "CC0", "Creative Commons Zero v1.0 Universal"),
}
TEXTS = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such. This notice may not be removed or altered from any source distribution.",
    ),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This file is free software; you may redistribute it under the terms of version 3 of the GNU General Public License, as published by the Free Software Foundation.",
    ),
    "gpl-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This file is free software; you may redistribute it under the terms of version 2 of the GNU General Public License, as published by the Free Software Foundation.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY. See the GNU Lesser General Public License for more details.",
    ),
    "agpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        "This file is subject to the Mozilla Public License, version 2.0; a copy of the MPL comes with it.",
    ),
    "cc-by": ("You are free to share and adapt the material for any purpose under Creative Commons Attribution 4.0, as long as you give appropriate credit.",),
    "cc-by-sa": ("You are free to share and adapt the material under Creative Commons Attribution-ShareAlike 4.0, giving appropriate credit and distributing your contributions under the same license.",),
    "cc-by-nc": ("You are free to share and adapt the material under Creative Commons Attribution-NonCommercial 4.0, giving appropriate credit, but not for commercial purposes.",),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.", "Dedicated to the public domain under CC0 1.0."),
}
CARRIERS = (
    "The sources are licensed under the {}.", "Made available under the {}.", "Distributed under the terms of the {}.", "SPDX-License-Identifier: {}", "{} licensed.", "Code available under {}.", "This project is governed by the {}.",
    "You may copy and modify this program under the conditions of the {}.", "License: {}", "The library is released under the {}.", "Use of this file is subject to the {}.", "Provided under {}", "Published by its authors under a {}.", "You can use the library under the {} or newer.", "{} or later, see the file COPYING.",
)
OTHERS = (
    "Copyright 2019 by the company, all rights are reserved.",
    "The publisher keeps all rights reserved to it.",
    "All rights reserved worldwide.",
    "All rights reserved. No part of this work may be reproduced without permission.",
    "Licensed under a custom license; contact the author for the terms.",
    "This document is distributed under its own licence terms.",
    "Use of this content is governed by the terms of the vendor license agreement.",
    "Copyright the authors. Made available under the terms of an internal license.",
    "This software is proprietary and confidential; unauthorised copying is prohibited.",
    "Licensed to customers under the terms of the end user license agreement.",
    "Free for personal use only; commercial use requires a paid licence.",
    "Distributed under the terms of the Eclipse Public License 2.0.",
    "SPDX-License-Identifier: WTFPL",
    "The sources are licensed under the Artistic License 2.0.",
    "Code available under the Boost Software License 1.0.",
    "This data is provided under the Open Database License.",
    "License: Unlicense",
)
HARD = (
    "His driving license expired in May and was renewed in June.", "She holds a fishing licence for the river.", "The pub lost its licence after the fire.", "A licence fee is paid by every household each year.",
    "The copyright office opened at nine.", "They argued about copyright in music for an hour.", "The museum bought the rights to the film.", "He studied physics at MIT for two years.", "MIT students built a boat.", "She got her degree from MIT in 1990.", "The campus of MIT is by the river.", "MIT researchers wrote a long paper.", "My brother teaches at MIT and likes to travel.",
    "The apache tribe lived in the south.", "An apache helicopter flew over the town.", "The public was free to walk in the park.", "General public opinion changed in version after version of the story.",
    "Permission to land was granted to the pilot.", "The warranty on the car covers any damages.", "All visitors must retain the notice they were given.", "The committee published its terms and conditions.",
    "A lesser man would have stopped.", "The commons were shared by all the farmers.", "He gave credit to the authors of the plan.", "The zero on the clock was broken.", "The council is licensed to collect the tax.",
    "Doctors must be licensed in this state.", "The software update took an hour.", "Version 2 of the novel was better than version 3.", "The library is open to any person without charge.",
    "The ship left the harbour at dawn and nobody saw it again.", "We walked along the river until it was dark.", "Most of the bread was gone by noon.", "It takes an hour to reach the village by bus.", "They sold the house and moved to the coast.",
    "Er ging mit dem Hund in den Park.", "Wir fahren mit der Bahn nach Hause.", "Mit der Zeit wurde es besser und heller.", "Das Haus steht am Ende der Straße.", "Komm mit uns in die Stadt.",
    "Elle a mis le livre sur la table.", "Nous avons mangé dans le jardin avec nos amis.", "El perro duerme en la casa por la tarde.", "La ciudad está cerca del mar y es muy bonita.", "Il a pris le train de nuit pour rentrer.",
)
#: Words of which a notice of the family holds one at least in each group, to be confirmed; and words that none holds.
NEEDED = {
    "apache-2.0": (("apache", "license", "licence"),), "mit": (("mit", "expat", "hereby", "substantial", "noninfringement"),), "isc": (("isc", "appear", "disclaims"),), "zlib": (("zlib", "granted", "origin", "held"),),
    "gpl-3.0": (("3", "v3", "gplv3", "gpl3"), ("gpl", "gplv3", "gpl3", "general")), "gpl-2.0": (("2", "v2", "gplv2", "gpl2"), ("gpl", "gplv2", "gpl2", "general")),
    "lgpl": (("lesser", "library", "lgpl", "lgplv3", "lgplv2"),), "agpl-3.0": (("affero", "agpl", "agplv3"),), "bsd": (("bsd", "redistribution", "redistributions", "endorse", "disclaimed"),), "mpl-2.0": (("mozilla", "mpl"), ("2", "v2")),
    "cc-by": (("by", "attribution"),), "cc-by-sa": (("sa", "sharealike"),), "cc-by-nc": (("nc", "noncommercial"),), "cc0": (("cc0", "zero"),),
}
BARRED = {"gpl-3.0": ("lesser", "affero", "library"), "gpl-2.0": ("lesser", "affero", "library"), "cc-by": ("sa", "nc", "nd", "sharealike", "noncommercial")}
#: Words of which one stands beside a licence's bare name.
CUES = ("license", "licence", "licensed", "licenced", "spdx", "under", "copyright", "governed", "terms")
#: With these, words of which one stands in any licence; a paragraph without one is none unless it is confirmed.
OTHER_CUES = ("rights", "proprietary", "permission", "permitted", "warranty", "warranties", "redistribute", "redistribution", "domain", "unlicense", "reproduced")
#: Words that ordinary texts hold; where possible, a paragraph is looked at because of others.
FREQUENT = ("2", "3", "by", "sa")
#: Words around a text or another licence in training examples.
FRAMES = ("{}", "Notice: {}", "{} See the file LICENSE for the terms.", "Copyright 2020 The authors. {}", "{} Copyright 2021.", "The text below is free. {}")


def words(p: Column) -> Column:
    return F.array_remove(F.split(F.lower(p), f"{GAP}+"), "")


def distinct(text: str) -> set[str]:
    """The distinct words of a text of ASCII."""
    return {*re.findall("[a-z0-9+]+", text.lower())}


def telling() -> set[str]:
    """Words of which one stands in all that can come out: a cue, or else, as a text must confirm then, a word that the family needs or so many of the text's longest words that OVERLAP leaves none of them out."""
    cues = {*CUES, *OTHER_CUES}
    out = set(cues)
    for family, groups in NEEDED.items():
        rare = [g for g in groups if not {*g} & {*FREQUENT}]
        for held in map(distinct, TEXTS[family]):
            least = next(k for k in range(len(held) + 1) if k / len(held) >= OVERLAP)
            out |= {*rare[0]} if rare else {*sorted(held - cues, key=lambda w: (-len(w), w))[: max(0, len(held - cues) - least + 1)]}
    return out


def holds(text: Column, wanted: set[str]) -> Column:
    """Whether one of wanted is among a text's words, which are not cut for that."""
    starts = {}
    for w in sorted(wanted):
        starts.setdefault(w[0], []).append(w[1:])
    either = "|".join(f"{a}(?:{'|'.join(map(re.escape, ends))})" for a, ends in starts.items())
    return F.concat(F.lit(" "), F.lower(text), F.lit(" ")).rlike(f"{GAP}(?:{either}){GAP}")


def grams(w: Column) -> Column:
    """The words and the pairs of neighbours."""
    pairs = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1)))
    return F.concat(w, pairs)


def paragraphs(docs: DataFrame, key: str, wanted: set[str]) -> DataFrame:
    """(key, row, paragraph number, line number, words) of all paragraphs that hold a wanted word, whose line number is null, and of the lines of those of several."""
    x = docs.select(key, F.monotonically_increasing_id().alias("row"), F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\n\s*\n|\r\s*\r")).alias("paragraph", "block"))
    x = x.where(holds(F.col("block"), wanted))
    lines = F.split(F.btrim("block", F.lit(" \t\r\n\f\x0b")), r"[\n\r]+")
    # A line end parts words, so a paragraph's words are those of its lines, which are cut once.
    cut = F.transform(lines, lambda a: F.struct(a.alias("line"), words(a).alias("words")))
    whole = lambda a: F.struct(F.array_join(a["line"], " ").alias("line"), F.flatten(a["words"]).alias("words"))
    units = let(cut, lambda a: F.when(F.size(a) > 1, F.concat(F.array(whole(a)), a)).otherwise(a))
    x = x.select(key, "row", "paragraph", F.posexplode(units).alias("number", "unit"))
    x = x.where(F.btrim("unit.line") != "")
    return x.select(key, "row", "paragraph", F.when(F.col("number") > 0, F.col("number") - 1).alias("line_number"), "unit.words")



def overlaps(w: Column) -> dict[str, Column]:
    """By family, the largest part of a text's distinct words that w holds, or 1 if it holds all of a name's words and a cue."""
    cue = F.arrays_overlap(w, F.array(*map(F.lit, CUES)))
    out = {}
    for family, texts in TEXTS.items():
        held = lambda t: F.size(F.array_intersect(t, w)) / F.size(t)
        parts = [held(F.array_distinct(words(F.lit(x)))) for x in texts]
        names = [F.when(cue & (held(F.array_distinct(words(F.lit(x)))) == 1), 1.0).otherwise(0.0) for x in NAMES[family]]
        out[family] = F.greatest(*parts, *names)
    return out


def likely(w: Column) -> Column:
    """Whether w holds a cue, or as large a part of some text as confirms it."""
    texts = [sorted(distinct(t)) for known in TEXTS.values() for t in known]
    array = lambda of: F.array(*map(F.lit, of))
    enough = lambda v: F.greatest(*[F.size(F.array_intersect(array(t), v)) / len(t) for t in texts]) >= OVERLAP
    return F.arrays_overlap(w, array((*CUES, *OTHER_CUES))) | let(F.array_intersect(array(sorted(set().union(*texts))), w), enough)


def told_apart(w: Column, family: Column) -> Column:
    """Whether w has the words that tell the family from its neighbours, and none of theirs."""
    out = F.lit(False)
    for name, groups in NEEDED.items():
        fine = F.lit(True)
        for g in groups:
            fine = fine & F.arrays_overlap(w, F.array(*map(F.lit, g)))
        if name in BARRED:
            fine = fine & ~F.arrays_overlap(w, F.array(*map(F.lit, BARRED[name])))
        out = F.when(family == name, fine).otherwise(out)
    return out


def examples(spark) -> list[tuple[str, str, bool]]:
    """(label, text, held out): names in all carriers, texts and other licences in all frames, sentences of no licence. A name's whole line of carriers, or a carrier, is held out for some families in turn, and so is each frame for one text in turn."""
    rows = []
    for f, (label, names) in enumerate(NAMES.items()):
        for i, name in enumerate(names):
            for j, carrier in enumerate(CARRIERS):
                rows.append((label, carrier.format(name), j % len(NAMES) == f % len(CARRIERS) or i == 1 + f % max(1, len(names) - 1) and j % 3 == 0))
    for label, texts in [*TEXTS.items(), (OTHER, OTHERS)]:
        for i, t in enumerate(texts):
            for j, frame in enumerate(FRAMES):
                rows.append((label, frame.format(t), j == 1 + i % (len(FRAMES) - 1)))
    return rows + [(NONE, frame.format(t), False) for t in HARD for frame in ("{}", "The text below is free. {}")]


def scan(docs: DataFrame, key: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """A row for each licence paragraph of docs (key, text): key, paragraph (from 0), line, family, probability, overlap, confirmed.

    A paragraph ends at a blank line and is read as a whole (line is null). A line of it (from 0) comes
    besides if it is of another family and no piece of the paragraph's notice, and instead if the paragraph as a whole is no licence
    or less sure.

    family is "unknown" for a licence of no known family, or of too low a probability that no text or name confirms; then overlap is
    null and confirmed false. Null and empty texts have no paragraphs; a paragraph of any length is
    read whole. Repeated rows give repeated rows; null keys stay null. Further columns are ignored;
    an empty table gives an empty table.
    """
    spark = docs.sparkSession
    labels = [NONE, *NAMES, OTHER]
    made = spark.createDataFrame(examples(spark), "label string, line string, held boolean")
    lines = paragraphs(docs, key, telling())
    # Of the documents, not the paragraphs, a part is read; a notice in it would teach the wrong label.
    n = docs.count()
    few = docs if n <= sample else docs.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < int(1_000_003 * sample / n))
    one = few.select(F.try_element_at(F.filter(F.split("text", r"[\n\r]+"), lambda s: F.btrim(s) != ""), F.lit(-1)).alias("line")).where("line is not null")
    cues = F.col("line").rlike(r"(?i)licen[sc]|copyright|rights reserved|public domain|gpl|creative commons|\bcc0|\bcc[ -]by|apache|mozilla|\bmpl\b|\bbsd\b|zlib|spdx|permission|as[ -]is\b|warrant|redistribut|substantial portions|\bISC\b") | F.col("line").rlike(r"\bMIT\b")
    negative = one.where(~cues).select(F.lit(NONE).alias("label"), "line", F.lit(False).alias("held"), F.lit(True).alias("corpus"))
    hashed = HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features")
    code = F.array_position(F.array(*map(F.lit, labels)), F.col("label")).cast("double") - 1
    data = hashed.transform(made.withColumn("corpus", F.lit(False)).unionByName(negative).select("label", "held", "corpus", let(words(F.col("line")), grams).alias("grams"), code.alias("code")))
    weight = F.when((F.col("label") == NONE) & F.col("corpus"), 0.2).otherwise(1.0)
    data = data.select("code", "held", "features", weight.alias("weight")).coalesce(4).cache()
    model = LogisticRegression(labelCol="code", featuresCol="features", weightCol="weight", regParam=1e-4, maxIter=100, family="multinomial", probabilityCol="p", rawPredictionCol="raw", predictionCol="guess").fit(data.where("not held"))
    # The level: nine tenths of the held-out wordings' right classes reach it.
    right = model.transform(data.where("held")).select(F.get(vector_to_array("p"), F.col("code").cast("int")).alias("q"))
    level = min(0.9, right.agg(F.percentile("q", F.lit(0.1))).first()[0] or 0.5)
    data.unpersist()

    named = [key, "row", "paragraph", "line_number"]
    # Nothing else can come out: a row has a cue, or a text confirms it.
    x = lines.where(likely(F.col("words")))
    x = x.select(*named, "words", let(F.col("words"), grams).alias("grams"))
    x = model.transform(hashed.transform(x))
    # In a generator the classes are not computed again by each filter that reads them.
    kinds = F.struct(F.col("guess").cast("int").alias("guess"), F.array_max(vector_to_array("p")).alias("probability"))
    x = x.select(*named, "words", F.inline(F.filter(F.array(kinds), lambda k: k["guess"] > 0)))
    x = x.withColumn("family", F.element_at(F.array(*map(F.lit, labels)), F.col("guess") + 1))

    def match(w: Column) -> Column:
        out = F.lit(None).cast("double")
        for family, part in overlaps(w).items():
            out = F.when(F.col("family") == family, part).otherwise(out)
        return out

    x = x.withColumn("overlap", match(F.col("words")))
    x = x.withColumn("confirmed", F.coalesce((F.col("overlap") >= OVERLAP) & told_apart(F.col("words"), F.col("family")), F.lit(False)))
    held = (F.col("probability") >= level) | F.col("confirmed")
    x = x.withColumns({"family": F.when(held, F.col("family")).otherwise(OTHER), "overlap": F.when(held, F.col("overlap"))})
    x = x.where(F.col("confirmed") | ((F.col("probability") >= LEAST) & F.arrays_overlap("words", F.array(*map(F.lit, (*CUES, *OTHER_CUES))))))
    sure = F.when(F.col("confirmed"), 2).when(F.col("probability") >= level, 1).otherwise(0)
    x = x.select(*named, "family", "probability", "overlap", "confirmed", sure.alias("sure"), "guess", "words")
    of = W.partitionBy("row", "paragraph")
    whole = F.col("line_number").isNull()
    x = x.withColumn("whole", F.max(F.when(whole, F.struct("sure", "family", "guess"))).over(of)).withColumn("best", F.max(F.when(~whole, F.col("sure"))).over(of))
    # An unsure line is a piece of the paragraph's notice if most of its words are those of the family's notices.
    own = F.array(*[F.array_distinct(words(F.lit(" ".join(known)))) for known in [*((*TEXTS[f], *NAMES[f]) for f in NAMES), OTHERS]])
    piece = let(F.array_distinct("words"), lambda w: F.size(F.array_intersect(w, F.get(own, F.col("whole.guess") - 1))) >= OVERLAP * F.size(w))
    other = (F.col("family") != F.col("whole.family")) & ((F.col("sure") > 0) | ~piece)
    apart = F.col("whole").isNull() | (F.col("sure") > F.col("whole.sure")) | other
    x = x.where(F.when(whole, F.coalesce(F.col("best") <= F.col("sure"), F.lit(True))).otherwise(apart))
    return x.select(key, "paragraph", F.col("line_number").alias("line"), "family", "probability", "overlap", "confirmed")

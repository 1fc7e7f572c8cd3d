import random

from pyspark.sql import functions as F

from tactigrid.llm import licences

CUES = {*licences.CUES, *licences.OTHER_CUES}


def test_classes_are_computed_once_and_words_cut_without_ranges(spark):
    plan = licences.scan(spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not [line[:200] for line in plan.split("\n") if "Filter" in line and "UDF(" in line]
    assert "[^a-z0-9+]" not in plan


def test_no_confirmed_words_are_left_out(spark):
    rng = random.Random(3)
    rows = []
    for known in licences.TEXTS.values():
        for held in map(licences.distinct, known):
            for drop in range(len(held) + 1):
                # The longest words go first, then any; with and without the cues.
                for kept in (sorted(held, key=len)[: len(held) - drop], sorted(held - CUES, key=len)[: len(held) - drop], rng.sample(sorted(held), len(held) - drop)):
                    rows.append(("\n".join(kept).upper(), kept))
    texts = [licences.distinct(t) for known in licences.TEXTS.values() for t in known]
    want = [bool(CUES & {*kept}) or any(len(t & {*kept}) / len(t) >= licences.OVERLAP for t in texts) for _, kept in rows]
    got = spark.createDataFrame(rows, "text string, words array<string>").select("words", licences.holds(F.col("text"), licences.telling()).alias("holds"), licences.likely(F.col("words")).alias("likely")).collect()
    assert [r["likely"] for r in got] == want
    # A family's notice is told apart by words that NEEDED names, so only rows that have them can come out.
    for r in got:
        words = {*r["words"]}
        out = bool(CUES & words) or any(len(t & words) / len(t) >= licences.OVERLAP and all({*g} & words for g in licences.NEEDED[f]) for f, known in licences.TEXTS.items() for t in map(licences.distinct, known))
        assert r["holds"] or not out, r["words"]
    assert any(not w for w in want) and any(w and not CUES & {*r["words"]} for r, w in zip(got, want))


def test_words_are_held_as_they_are_cut(spark):
    texts = ["by", "GPLv3", "x GPLv3\ny", "gplv3x", "xgplv3", "gplv3+", "é_gplv3é", "KISC", "\u212aIT", "MİT", "\r\nISC\r\n", "", "copyright", "©copyright2019", "copyright-2019", "a\u0000mit\u0000"]
    wanted = {"gplv3", "isc", "mit", "kit", "copyright"}
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", licences.holds(F.col("text"), wanted).alias("holds"), licences.words(F.col("text")).alias("words"))
    got = df.collect()
    assert [(r["text"], r["holds"]) for r in got] == [(r["text"], bool(wanted & {*r["words"]})) for r in got]
    assert sum(r["holds"] for r in got) == 8

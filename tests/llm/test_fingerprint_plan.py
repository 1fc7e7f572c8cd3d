"""The canonical form of every letter that folds, and the size of the plan that makes it."""

import unicodedata

from pyspark.sql import functions as F

from tactigrid.llm import fingerprint


def test_every_letter(spark):
    points = [c for i in range(128, 0x30000) if not 0xD800 <= i < 0xE000 and ((x := fingerprint.folded(c := chr(i))) != c or i % 97 == 0)] + [chr(0xF0000), chr(0xF0005), chr(0x10FFFD)]
    rows = [(i, f"a{c}b") for i, c in enumerate(points)]
    got = spark.createDataFrame(rows, "i int, t string").select("i", fingerprint.canonical(F.col("t")).alias("c")).collect()
    bare = lambda s: "".join(s.split())
    want = [bare(unicodedata.normalize("NFKD", f"a{fingerprint.folded(c)}b").lower()) for c in points]
    assert [(r["i"], r["c"]) for r in got if bare(r["c"]) != want[r["i"]]] == []


def test_order_of_marks(spark):
    text = "ạ́ͅb̧̈"
    got = spark.createDataFrame([(text,)], "t string").select(fingerprint.canonical(F.col("t"))).first()[0]
    assert got == "".join(c for c in unicodedata.normalize("NFKD", fingerprint.folded(text)))


def test_the_plan_is_short(spark):
    df = spark.createDataFrame([("a",)], "t string").select(fingerprint.canonical(F.col("t")))
    assert len(df._jdf.queryExecution().toString()) < 500_000

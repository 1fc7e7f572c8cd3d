"""The mix with columns that have its own names, against the mix without them."""

from pyspark.sql import functions as F

import corpus_pipeline


def test_clashing_columns_stay(spark):
    rows = [(i, "one two three four five " * (i % 4 + 1), f"s{i % 3}") for i in range(12)] + [(None, None, None), (3, "again", "s0")]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mine = [F.lit("mine").alias(c) for c in ("extra", "size", "times", "copy", "gone", "taken", "blank", "place")]
    want = corpus_pipeline.source_mix(spark, plain, "")
    got = corpus_pipeline.source_mix(spark, plain.select("*", *mine), "")
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect())) and want.count() > 0
    assert got.where("extra = 'mine' AND copy = 'mine' AND size = 'mine'").count() == got.count()
    # Two, three and four repeats have the same five shingles, one has one of them; the others are "again" and the null text.
    kept = corpus_pipeline.near_duplicates(spark, plain.select("*", *mine), "")
    assert kept.columns == plain.select("*", *mine).columns and kept.count() == 4

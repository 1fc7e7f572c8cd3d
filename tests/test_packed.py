"""Documents packed many to a file."""

from pathlib import Path

from pyspark.sql import functions as F

from tactigrid.plans import catalog
from tactigrid.sources import documents as D

TEXTS = {"a": '{"id": "a",\n "n": 1}', "b": "[1, 2]", "c": '{"id": "c", "n": ', "d": '﻿\n {"id": "d"}\n', "e": "", "f": '{"id": "f", "n": "x"}', "g": None}


def test_packed_documents_are_read_as_files_are(spark, tmp_path):
    at = str(tmp_path / "packed")
    D.pack(spark.createDataFrame(list(TEXTS.items()), "file string, text string"), at)
    got = {r["file"]: (r["error"], r["document"] and r["document"]["n"]) for r in D.packed(spark, at, "id string, n long").collect()}
    no = ("not an object", None)
    assert got == {"a": (None, 1), "b": no, "c": ("malformed", None), "d": (None, None), "e": no, "f": ("malformed", None), "g": no}


def test_files_do_not_grow_with_users(spark, tmp_path):
    e = spark.range(3000).select(F.col("id").alias("event_id"), (F.col("id") % 300).alias("user_id"), F.timestamp_seconds("id").alias("ts"), F.lit(1.5).alias("value"), F.lit("view").alias("event_type"))
    e.write.parquet(str(tmp_path / "events.parquet"))
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    for name, rows in (("s1_documents", 300), ("s3_listing", 266)):
        before = set(shared.rglob("part-*"))
        assert catalog.queries()[name](spark, str(tmp_path)).count() == rows
        assert len(set(shared.rglob("part-*")) - before) <= 20

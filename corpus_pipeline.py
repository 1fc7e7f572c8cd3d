"""A corpus pipeline: language ID, near duplicates, source mix, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tactigrid.llm import bpe, language, mixing, parity, store

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Row numbers that are sent to every task, at most; more are joined by a shuffle.
BROADCAST_ROWS = 300_000
ROW = "pipeline_row"


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, for a doc_id may be null or stand in several rows: by file and place where docs is a table just read, else of a copy written with the numbers."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return store.table(docs.withColumn(ROW, F.monotonically_increasing_id()), "pipeline-rows")
    file, place = f"{ROW}_file", f"{ROW}_place"
    files = docs.select(F.col("_metadata.file_path").alias(file)).distinct()
    files = store.table(files.withColumn(ROW, F.row_number().over(W.orderBy(file)).cast("long")), "pipeline-files")  # a row for each file
    side = F.broadcast(files) if files.count() <= BROADCAST_ROWS else files
    x = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place)).join(side, file)
    return x.withColumn(ROW, F.shiftleft(ROW, 40) + F.col(place)).select(*docs.columns, ROW)


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Numbered docs without these rows (a table of one column, their numbers); the numbers are dropped."""
    rows = store.table(rows, "pipeline-gone")
    side = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
    return docs.join(side, ROW, "left_anti").drop(ROW)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known."""
    kept = docs.columns
    docs = numbered(docs)
    found = language.identify(language.of_documents(docs.withColumn("doc_id", F.col(ROW))), ["doc_id"])
    return without(docs, found.where("not kept").select(F.col("doc_id").alias(ROW))).select(kept)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, that of the smallest doc_id (a null one is the last); of repeated rows one."""
    kept = docs.columns
    docs = numbered(docs)
    found = store.table(parity.classes(docs.select(F.col(ROW).alias("doc_id"), "text")).select(F.col("doc_id").alias(ROW), "n_shingles", "component_id"), "pipeline-classes")
    # A text without words is in no class; such rows repeat each other if doc_id and text are the same.
    blank = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col("text")).alias("blank")
    x = found.join(docs.select(ROW, F.col("doc_id").alias("id"), blank), ROW)
    empty = F.col("n_shingles") == 0
    group = [empty, F.when(~empty, F.col("component_id")), F.when(empty, F.col("id")), F.when(empty, F.col("blank"))]
    group = [c.alias(f"g{i}") for i, c in enumerate(group)]
    stays = x.groupBy(*group).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", ROW))[ROW].alias(ROW))
    return without(docs, found.select(ROW).join(stays, ROW, "left_anti")).select(kept)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document as often as it is taken whole, and once more the words that are taken besides; texts without words are never taken."""
    kept = docs.columns
    docs = numbered(docs)
    names = ("size", "times", "extra_from", "extra")
    taken = mixing.mix(docs, keep=(ROW,)).where("taken > 0").select(ROW, *[F.col(c).alias(f"{ROW}_{c}") for c in names])
    size, times, begin, extra = (F.col(f"{ROW}_{c}") for c in names)
    copies = (times + (extra > 0).cast("int")).cast("long")
    x = docs.join(taken, ROW).withColumn(f"{ROW}_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    begin = begin.cast("int")
    end = F.least(size, begin + extra).cast("int")
    around = (extra - (end - begin)).cast("int")
    part = F.array_join(F.concat(F.slice(words, begin + 1, end - begin), F.slice(words, F.lit(1), around)), " ")
    whole = (F.col(f"{ROW}_copy") <= times) | (extra >= size)
    x = x.withColumn("text", F.when(whole, F.col("text")).otherwise(part))
    if "n_chars" in kept:
        x = x.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return x.select(kept)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the mix."""
    return bpe.encoded(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("source_mix", source_mix), ("byte_bpe", encode)]
#: The trained language model, the components and the merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

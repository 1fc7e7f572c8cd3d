"""JSON documents, one for each match, in files of their own or packed many to a file, and a store of imported packages with rows for matches and their children."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType, _parse_datatype_string

_BAD = "corrupt_"


def pack(texts: DataFrame, folder: str) -> None:
    """Documents (file: its name, text) written many to a file, for a file of its own costs a document more than its bytes do; an existing folder is refused."""
    texts.select("file", F.coalesce("text", F.lit("")).alias("text")).write.parquet(folder)


def packed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """objects() of what pack() wrote; a document of no bytes is not an object."""
    return parsed(spark.read.schema("file string, text string").parquet(folder), schema)


def objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row for each file of path (a folder or a pattern): file, document (a struct of schema), error.

    A file that is no JSON object of the schema has a null document, and error says "malformed" or
    "not an object"; fields that lack are null. A file is read whole; one of no bytes has no row, for Spark's readers pass it over.
    """
    return parsed(spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")), schema)


def parsed(texts: DataFrame, schema: str) -> DataFrame:
    """objects() of whole documents (file, text)."""
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    read = StructType([*kind.fields, StructField(_BAD, StringType())])
    text = texts.select("file", F.btrim("text", F.lit(" \t\r\n\ufeff")).alias("text"))
    x = text.withColumn("d", F.from_json("text", read, {"columnNameOfCorruptRecord": _BAD}))
    error = F.when(F.substring("text", 1, 1) != "{", "not an object").when(F.col(f"d.{_BAD}").isNotNull(), "malformed")
    x = x.withColumn("error", error)
    document = F.struct(*[F.col(f"d.{f.name}").alias(f.name) for f in kind.fields])
    return x.select("file", F.when(F.col("error").isNull(), document).alias("document"), "error")


def required(found: DataFrame) -> DataFrame:
    """objects() where every file must be one; raises with the first that is not."""
    bad = found.where("error is not null").orderBy("file").first()
    if bad:
        raise ValueError(f"{bad['file']}: {bad['error']}")
    return found.select("file", "document.*")


def latest_first(found: DataFrame, date: str, created: str) -> DataFrame:
    """The documents of objects() without those that could not be read, numbered by place: by date (created where it lacks) and created, the latest first, then by file."""
    x = found.where("error is null").select("file", "document.*")
    day = F.coalesce(F.nullif(F.col(date).cast("string"), F.lit("")), F.col(created).cast("string"), F.lit(""))
    # A listing of matches, a row for each file: small against what the files hold.
    order = W.orderBy(day.desc(), F.coalesce(F.col(created).cast("string"), F.lit("")).desc(), "file")
    return x.withColumn("place", F.row_number().over(order)).drop("file")


TRACK = "track_id long, start_time_sec double, end_time_sec double, positions array<struct<frame: long, time_sec: double, x: double, y: double, confidence: double>>"


def tracks(spark: SparkSession, path: str, track: str = TRACK) -> DataFrame:
    """A row for each position of each track of files that hold a list of tracks: file, the track's columns, and the position's (null for a track without any). A file that holds no list is left out."""
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.btrim("value", F.lit(" \t\r\n﻿")).alias("text"))
    x = text.where(F.substring("text", 1, 1) == "[").select("file", F.explode(F.from_json("text", ArrayType(_parse_datatype_string(track)))).alias("t"))
    x = x.where("t is not null").select("file", "t.*")
    return x.select("*", F.explode_outer("positions").alias("p")).drop("positions").select("*", "p.*").drop("p")


def write_documents(df: DataFrame, folder: str, key: str, document: Column) -> None:
    """A JSON file for each row under folder/key=..., written elsewhere and moved in whole when all are there; an existing folder is refused."""
    df.select(F.to_json(document).alias("value"), key).repartition(F.col(key)).write.partitionBy(key).option("maxRecordsPerFile", 1).text(folder)


class Packages:
    """Imported packages: rows of several tables, each with the package's key.

    An import appends files and then one index entry for each of its packages; what an index entry
    replaces stays on disk but is not read. So an import writes its own rows alone, is seen whole or not
    at all, and a package's children go with it.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.folder, self.key = spark, folder, key

    def index(self) -> DataFrame | None:
        """(key, import, deleted) of each package's last entry; None before the first."""
        try:
            x = self.spark.read.parquet(f"{self.folder}/index")
        except AnalysisException:
            return None
        last = x.groupBy(self.key).agg(F.max(F.struct("number", "import", "deleted")).alias("e"))
        return last.select(self.key, "e.number", "e.import", "e.deleted")

    def put(self, tables: dict[str, DataFrame], replace: bool = False) -> None:
        """Imports the packages whose keys the first table has; raises FileExistsError if one is there already, unless replace is set. A package of no key, or a repeated one, is refused."""
        first = next(iter(tables.values())).select(self.key)
        bad = first.where(F.col(self.key).isNull()).limit(1).count() or first.groupBy(self.key).count().where("count > 1").limit(1).count()
        if bad:
            raise ValueError(f"each package needs a {self.key} of its own")
        now = self.index()
        if now is not None and not replace:
            there = now.where("not deleted").join(first, self.key, "left_semi").orderBy(self.key).first()
            if there:
                raise FileExistsError(f"{there[self.key]} is there already; set replace to import it again")
        name = uuid.uuid4().hex
        for table, df in tables.items():
            df.join(first, self.key, "left_semi").withColumn("import", F.lit(name)).write.mode("append").partitionBy("import").parquet(f"{self.folder}/tables/{table}")
        self._enter(first, name, False)

    def delete(self, keys: DataFrame) -> None:
        """Packages of these keys are gone, with all their rows."""
        self._enter(keys.select(self.key).distinct(), "", True)

    def _enter(self, keys: DataFrame, name: str, deleted: bool) -> None:
        now = self.index()
        number = 1 + ((now.agg(F.max("number")).first()[0] or 0) if now is not None else 0)
        keys.select(self.key, F.lit(number).cast("long").alias("number"), F.lit(name).alias("import"), F.lit(deleted).alias("deleted")).write.mode("append").parquet(f"{self.folder}/index")

    def read(self, table: str) -> DataFrame:
        """The rows of all packages that are there."""
        now = self.index()
        if now is None:
            raise ValueError("nothing has been imported")
        rows = self.spark.read.parquet(f"{self.folder}/tables/{table}")
        return rows.join(now.where("not deleted").select(self.key, "import"), [self.key, "import"], "left_semi").drop("import")

    def one(self, table: str, key) -> DataFrame:
        return self.read(table).where(F.col(self.key) == F.lit(key))


def assembled(base: DataFrame, key: list[str], artifacts: dict[str, DataFrame], needed: list[str]) -> DataFrame:
    """base with each artifact's columns (key, columns) as a struct under its name, present (a map of names to whether it is there) and state: blocked if a needed one lacks, warnings if another does, else ready. Of an artifact's rows of a key the largest counts."""
    x = base
    for name, df in artifacts.items():
        one = df.groupBy(*key).agg(F.max(F.struct(*[c for c in df.columns if c not in key])).alias(name))
        x = x.join(one, key, "left")
    there = F.create_map(*[c for n in artifacts for c in (F.lit(n), F.col(n).isNotNull())])
    lacks = lambda names: F.greatest(*[F.col(n).isNull() for n in names], F.lit(False))
    return x.withColumn("present", there).withColumn("state", F.when(lacks(needed), "blocked").when(lacks(list(artifacts)), "warnings").otherwise("ready"))

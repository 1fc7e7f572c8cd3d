"""Reading tables and documents, and writing them so that readers see all of a version or none."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON documents, one per file; a malformed one is a row of nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def publish(tables: dict[str, DataFrame], folder: str) -> str:
    """All tables under a new version; the manifest row that names it is written last. If one of them fails, what was written goes and readers keep the version before."""
    version = uuid.uuid4().hex
    spark = next(iter(tables.values())).sparkSession
    try:
        for name, df in tables.items():
            df.write.parquet(f"{folder}/versions/{version}/{name}")
    except Exception:
        remove(spark, f"{folder}/versions/{version}")
        raise
    row = spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at"))
    row.write.mode("append").parquet(f"{folder}/manifest")
    return version


def published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the last published version."""
    version = spark.read.parquet(f"{folder}/manifest").orderBy(F.desc("at"), "version").first()["version"]
    return spark.read.parquet(f"{folder}/versions/{version}/{name}")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of this machine only where a local session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or "/tmp/checkpoints").rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet and read back, so that its lineage ends here and a lost executor costs no rerun."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

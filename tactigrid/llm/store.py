"""Tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where a session of one machine names no folder (tests).
DEFAULT_DIR = "/tmp/checkpoints"
#: Bytes of the rows that pass to Python together while a table is written; each task holds a few such batches, in and outside the JVM's heap.
BATCH_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or DEFAULT_DIR).rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back; it cuts the lineage, and a lost executor costs no rerun."""
    return _written(df, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """Tables of one job under a folder of its own; put() of a name that is there replaces that table, once the new one is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._paths: dict[str, str] = {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        out = _written(df, path)
        self.drop(name)
        self._paths[name] = path
        return out

    def drop(self, *names: str) -> None:
        """Delete these tables; nothing may read them any more."""
        for name in names:
            if path := self._paths.pop(name, None):
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def _written(df: DataFrame, path: str) -> DataFrame:
    conf = df.sparkSession.conf
    before = conf.get(BATCH_BYTES)
    conf.set(BATCH_BYTES, str(BATCH))
    try:
        df.write.parquet(path)
    finally:
        conf.set(BATCH_BYTES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)

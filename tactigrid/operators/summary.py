"""Summaries by group: shares of states, shapes of point sets, covered means, dense counts, medians, medoids, switches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequence import ordered


def shares(df: DataFrame, group: list[str], state: str, states: list[str], total: str) -> DataFrame:
    """Per group the count of all rows, and of each state (0 if it does not occur)."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias(total), *[F.count(F.when(F.col(state) == s, 1)).alias(s) for s in states])


def shape(points: DataFrame, group: list[str], x: str, y: str, least: int, most: int) -> DataFrame:
    """Per group of least to most points: n, width, depth, centroid, and compactness, the mean distance to it.

    A group (a team in a frame) is small; its points are kept in an array rather than joined to the mean.
    """
    g = points.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), (F.max(x) - F.min(x)).alias("width"), (F.max(y) - F.min(y)).alias("depth"),
        F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).alias("at"),
    ).where(F.col("n").between(least, most))
    away = lambda p: F.sqrt((p["x"] - F.col("cx")) * (p["x"] - F.col("cx")) + (p["y"] - F.col("cy")) * (p["y"] - F.col("cy")))
    return g.withColumn("compactness", F.aggregate(F.transform("at", away), F.lit(0.0), lambda s, v: s + v) / F.col("n")).drop("at")


def covered_means(df: DataFrame, group: list[str], t: str, value: str, width: float, expected: int, least: float) -> DataFrame:
    """Per group and bucket of time: n values and their mean, null if less than a share `least` of the expected values is there."""
    x = df.groupBy(*group, F.floor(F.col(t) / width).cast("long").alias("bucket")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return x.withColumn("mean", F.when(F.col("n") >= least * expected, F.col("mean")))


def median_step(df: DataFrame, entity: list[str], t: str) -> DataFrame:
    """The median of the positive differences of an entity's distinct times."""
    x = df.select(*entity, t).distinct()
    x = x.withColumn("step", F.col(t) - F.lag(t).over(ordered(entity, t))).where("step > 0")
    return x.groupBy(*entity).agg(F.median("step").alias("step"))


def dense_counts(df: DataFrame, frame: str) -> DataFrame:
    """Rows of each frame from 0 to the last, also of empty frames; the frames are made by Spark's range, not in the driver."""
    last = df.agg(F.max(frame)).first()[0]
    every = df.sparkSession.range(0 if last is None else last + 1).withColumnRenamed("id", frame)
    n = df.groupBy(frame).agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, frame, "left").fillna({"n": 0})


def medoids(df: DataFrame, group: str, id_: str, vector: str) -> DataFrame:
    """Per group the vector with the least median cosine distance to the others (smaller id on a tie), and that distance, the dispersion.

    A group is one subject's samples, tens of vectors: they meet in one array. Groups of one vector are left out.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    x = df.select(group, id_, F.col(vector).alias("v_"), F.sqrt(dot(F.col(vector), F.col(vector))).alias("n_"))
    all_ = x.groupBy(group).agg(F.collect_list(F.struct(F.col(id_).alias("i"), F.col("v_").alias("v"), F.col("n_").alias("n"))).alias("all_"))
    y = x.join(all_, group).select(group, id_, "v_", "n_", F.explode("all_").alias("o")).where(F.col("o.i") != F.col(id_))
    cosine = dot(F.col("v_"), F.col("o.v")) / (F.col("n_") * F.col("o.n"))
    y = y.select(group, id_, F.round(1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)), 6).alias("d"))
    m = y.groupBy(group, id_).agg(F.median("d").alias("spread"))
    return m.groupBy(group).agg(F.min(F.struct("spread", id_))[id_].alias(id_), F.min("spread").alias("dispersion"))


def switches(df: DataFrame, entity: list[str], t: str, tie: str, state: str) -> DataFrame:
    """How often an entity's state changes from one row to the next, and how many states it has."""
    x = df.select(*entity, state, F.lag(state).over(ordered(entity, t, tie)).alias("before_"))
    return x.groupBy(*entity).agg(F.count(F.when(F.col(state) != F.col("before_"), 1)).alias("switches"), F.count_distinct(state).alias("states"))

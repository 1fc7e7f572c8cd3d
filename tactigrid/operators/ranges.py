"""Range joins by buckets of time: points in intervals, overlapping intervals, gaps between intervals.

Both sides are keyed by (key, bucket), so an interval meets the points of its own buckets alone and
a hot key is split by time. `width` should be near the usual length of an interval: an interval comes
once for each bucket that it touches. An interval without end must be closed by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bucket(t: Column, width: float) -> Column:
    return F.floor(t / width).cast("long")


def points_in(points: DataFrame, intervals: DataFrame, key: list[str], t: str, start: str, stop: str, width: float) -> DataFrame:
    """Each point with each interval of its key that holds it, both ends closed. But for key, the columns' names differ."""
    spread = intervals.where(F.col(start) <= F.col(stop)).withColumn("bucket_", F.explode(F.sequence(bucket(F.col(start), width), bucket(F.col(stop), width))))
    x = points.withColumn("bucket_", bucket(F.col(t), width)).join(spread, [*key, "bucket_"])
    return x.where((F.col(t) >= F.col(start)) & (F.col(t) <= F.col(stop))).drop("bucket_")


def overlaps(left: DataFrame, right: DataFrame, key: list[str], start: str, stop: str, width: float) -> DataFrame:
    """Pairs of a left and a right interval of a key that share more than a point; right's columns get the prefix other_."""
    cut = lambda df, a, b: df.withColumn("bucket_", F.explode(F.sequence(bucket(F.col(a), width), bucket(F.col(b), width))))
    r = right.select(*key, *[F.col(c).alias(f"other_{c}") for c in right.columns if c not in key])
    x = cut(left, start, stop).join(cut(r, f"other_{start}", f"other_{stop}"), [*key, "bucket_"])
    # Of the buckets that a pair shares, the one where it begins to overlap keeps it.
    first = F.col("bucket_") == bucket(F.greatest(start, f"other_{start}"), width)
    return x.where(first & (F.col(start) < F.col(f"other_{stop}")) & (F.col(f"other_{start}") < F.col(stop))).drop("bucket_")


def unique_fraction(df: DataFrame, entity: list[str], start: str, stop: str, tie: str) -> DataFrame:
    """df with unique_fraction: the share of each interval that no earlier one (by start, stop, tie) covers; null for an empty interval."""
    w = W.partitionBy(*entity).orderBy(start, stop, tie).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.max(stop).over(w), F.col(start))
    new = F.greatest(F.lit(0), F.col(stop) - F.greatest(F.col(start), before))
    return df.withColumn("unique_fraction", F.try_divide(new, F.col(stop) - F.col(start)))

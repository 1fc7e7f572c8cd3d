"""Movement statistics of entities from ordered positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sequence import ordered


def steps(df: DataFrame, entity: list[str], t: str, tie: str, x: str, limit: float, observed: float, estimated: float) -> DataFrame:
    """Each row's step from the one before: dt, distance, speed, kind (outlier, observed, estimated, long_gap)."""
    w = ordered(entity, t, tie)
    s = df.select(*entity, t, tie, (F.col(t) - F.lag(t).over(w)).alias("dt"), F.abs(F.col(x) - F.lag(x).over(w)).alias("distance")).where("dt > 0")
    s = s.withColumn("speed", F.col("distance") / F.col("dt"))
    kind = F.when(F.col("speed") > limit, "outlier").when(F.col("dt") <= observed, "observed").when(F.col("dt") <= estimated, "estimated").otherwise("long_gap")
    return s.withColumn("kind", kind)


def movement(df: DataFrame, entity: list[str], t: str, tie: str, x: str, limit: float, observed: float, estimated: float) -> DataFrame:
    """Per entity: steps by kind, observed and estimated distance and time, mean and largest speed, a quality label."""
    s = steps(df, entity, t, tie, x, limit, observed, estimated)
    of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0.0))
    n = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    good = F.col("kind").isin("observed", "estimated")
    m = s.groupBy(*entity).agg(
        *[n(k).alias(f"n_{k}") for k in ("observed", "estimated", "outlier", "long_gap")],
        of("observed", "distance").alias("observed_m"), of("estimated", "distance").alias("estimated_m"),
        of("observed", "dt").alias("observed_s"), of("estimated", "dt").alias("estimated_s"),
        F.max(F.when(good, F.col("speed"))).alias("max_speed"),
    )
    total, time = F.col("observed_m") + F.col("estimated_m"), F.col("observed_s") + F.col("estimated_s")
    m = m.withColumn("mean_speed", F.try_divide(total, time)).withColumn("estimated_ratio", F.coalesce(F.try_divide(F.col("estimated_s"), time), F.lit(0.0)))
    return m.withColumn("quality", F.when(time == 0, "none").when(F.col("estimated_ratio") <= 0.25, "good").when(F.col("estimated_ratio") <= 0.6, "fair").otherwise("poor"))


def sprints(df: DataFrame, entity: list[str], t: str, tie: str, x: str, fast: float, gap: float, least: float) -> DataFrame:
    """Runs of consecutive fast steps no more than gap apart that last least or more: entity, run, start, stop, distance, top_speed."""
    w = ordered(entity, t, tie)
    s = df.select(*entity, F.col(t).alias("stop"), F.lag(t).over(w).alias("start"), F.col(tie).alias("id"), F.abs(F.col(x) - F.lag(x).over(w)).alias("distance")).where("start is not null and stop > start")
    s = s.withColumn("speed", F.col("distance") / (F.col("stop") - F.col("start"))).withColumn("fast", (F.col("speed") >= fast) & (F.col("stop") - F.col("start") <= gap))
    order = ordered(entity, "stop", "id")
    s = s.withColumn("run", F.sum(F.when(F.col("fast"), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0))).where("fast")
    r = s.groupBy(*entity, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("distance").alias("distance"), F.max("speed").alias("top_speed"))
    return r.where(F.col("stop") - F.col("start") >= least).withColumn("run", F.row_number().over(ordered(entity, "start")))

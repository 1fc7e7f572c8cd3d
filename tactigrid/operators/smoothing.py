"""Moving statistics of ordered series: averages, exponential averages with resets, cumulative shares, trailing lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ranges import points_in
from .sequence import ordered, sessionize


def moving_average(df: DataFrame, entity: list[str], t: str, tie: str, value: str, before: int, after: int) -> DataFrame:
    """df with smooth: the mean of the row, so many before it and so many after it."""
    return df.withColumn("smooth", F.avg(value).over(ordered(entity, t, tie).rowsBetween(-before, after)))


def kernel(df: DataFrame, entity: list[str], t: str, tie: str, value: str, usable: Column) -> DataFrame:
    """df with smooth: weights 1/4, 1/2, 1/4 over the neighbours that are usable, renormalised; other rows keep their value."""
    w = ordered(entity, t, tie)
    x = df.withColumn("ok_", F.coalesce(usable, F.lit(False)))
    taps = [(F.lag, 0.25), (None, 0.5), (F.lead, 0.25)]
    at = lambda f, c: F.col(c) if f is None else f(c).over(w)
    weight = [F.when(F.coalesce(at(f, "ok_"), F.lit(False)), k).otherwise(0.0) for f, k in taps]
    total = sum(weight[1:], weight[0])
    value_sum = F.lit(0.0)
    for (f, _), k in zip(taps, weight, strict=True):
        value_sum = value_sum + F.coalesce(at(f, value), F.lit(0.0)) * k
    return x.withColumn("smooth", F.when(F.col("ok_"), value_sum / total).otherwise(F.col(value))).drop("ok_")


def ema(df: DataFrame, entity: list[str], t: str, tie: str, value: str, n: int, gap: float) -> DataFrame:
    """df with ema, alpha = 2 / (n + 1); it begins anew after a gap of that many seconds or more.

    The average of a run is the sum of alpha * (1 - alpha)^k over its rows, k rows back, and what is left
    of the first row's weight; rows of a weight below 1e-18 (`back` rows) are left out, so each row looks
    back over a bounded frame.
    """
    alpha = 2.0 / (n + 1)
    back = 1
    while (1 - alpha) ** back > 1e-18:
        back += 1
    w = ordered(entity, t, tie)
    x = df.withColumn("starts_", F.coalesce(F.col(t) - F.lag(t).over(w) >= gap, F.lit(True)).cast("int"))
    x = x.withColumn("run_", F.sum("starts_").over(w.rowsBetween(W.unboundedPreceding, 0)))
    run = ordered([*entity, "run_"], t, tie)
    seen = F.collect_list(F.struct(F.col(value).cast("double").alias("v"), "starts_")).over(run.rowsBetween(-back, 0))
    total = F.aggregate(seen, F.lit(0.0), lambda s, r: F.when(r["starts_"] == 1, r["v"]).otherwise(s * (1 - alpha) + r["v"] * alpha))
    return x.withColumn("ema", total).drop("starts_", "run_")


def cumulative_share(df: DataFrame, entity: list[str], t: str, tie: str, value: Column) -> DataFrame:
    """df with so_far (exact sum, 2 decimals) and share of the entity's total."""
    exact = value.cast("decimal(28,2)")
    w = ordered(entity, t, tie).rowsBetween(W.unboundedPreceding, 0)
    x = df.withColumn("so_far", F.sum(exact).over(w).cast("double")).withColumn("all_", F.sum(exact).over(W.partitionBy(*entity)).cast("double"))
    return x.withColumn("share", F.try_divide("so_far", "all_")).drop("all_")


def speed_ahead(df: DataFrame, entity: list[str], t: str, id_: str, value: str, least: float, most: float, gap: float | None = None, limit: float | None = None) -> DataFrame:
    """(entity, id, top): the greatest |change| / time from a row to one that is least to most later, up to limit; rows without one are left out.

    No window goes across a step of more than gap, or of a speed beyond limit.
    """
    if gap is not None and limit is not None:
        df, entity = sessionize(df, entity, t, id_, gap, limit, value, 0.001), [*entity, "session"]
    later = df.select(*entity, F.col(t).alias("t_"), F.col(value).alias("v_"))
    spans = df.select(*entity, F.col(id_), F.col(t), F.col(value), (F.col(t) + least).alias("from_"), (F.col(t) + most).alias("to_"))
    x = points_in(later, spans, entity, "t_", "from_", "to_", most)
    if limit is not None:
        x = x.where(F.abs(F.col("v_") - F.col(value)) / (F.col("t_") - F.col(t)) <= limit)
    return x.groupBy(*entity, id_).agg(F.max(F.abs(F.col("v_") - F.col(value)) / (F.col("t_") - F.col(t))).alias("top"))


def speed_behind(df: DataFrame, entity: list[str], t: str, id_: str, value: str, least: float, most: float, limit: float) -> DataFrame:
    """(entity, id, speed): of the rows least to most earlier whose speed is limit or less, the most recent one's (larger id on a tie)."""
    past = df.select(*entity, F.col(t).alias("t_"), F.col(value).alias("v_"), F.col(id_).alias("id_"))
    spans = df.select(*entity, F.col(id_), F.col(t), F.col(value), (F.col(t) - most).alias("from_"), (F.col(t) - least).alias("to_"))
    x = points_in(past, spans, entity, "t_", "from_", "to_", most)
    x = x.withColumn("speed", F.abs(F.col("v_") - F.col(value)) / (F.col(t) - F.col("t_"))).where(F.col("speed") <= limit)
    return x.groupBy(*entity, id_).agg(F.max(F.struct("t_", "id_", "speed"))["speed"].alias("speed"))

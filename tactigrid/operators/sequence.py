"""Ordered-series operators: sessions, islands, gap filling, as-of and range joins, interval unions.

All windows are partitioned by an entity; none orders a whole table. Ties are broken by an id column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seconds(ts: str | Column) -> Column:
    """A timestamp as seconds (double)."""
    return micros(ts) / F.lit(1e6)


def micros(ts: str | Column) -> Column:
    """A timestamp (also one without time zone) as microseconds since 1970."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts) if isinstance(ts, str) else ts)


def ordered(entity: list[str], *by: str):
    return W.partitionBy(*entity).orderBy(*by)


def sessionize(df: DataFrame, entity: list[str], t: str, tie: str, gap: float, speed: float | None = None, x: str | None = None, floor: float = 0.25) -> DataFrame:
    """df with session (from 0): a new one starts if more than gap passed, or if x moved faster than speed."""
    w = ordered(entity, t, tie)
    step = F.col(t) - F.lag(t).over(w)
    split = step > gap
    if speed is not None and x is not None:
        split = split | (F.abs(F.col(x) - F.lag(x).over(w)) / F.greatest(step, F.lit(floor)) > speed)
    marked = df.withColumn("starts", F.coalesce(split, F.lit(False)).cast("int"))
    return marked.withColumn("session", F.sum("starts").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("starts")


def islands(df: DataFrame, entity: list[str], t: str, tie: str, state: list[str]) -> DataFrame:
    """df with island (from 0): a run of rows whose state is the same; a null is a value."""
    w = ordered(entity, t, tie)
    first = F.row_number().over(w) == 1
    same = F.lit(True)
    for c in state:
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    marked = df.withColumn("starts", F.when(first, 0).when(same, 0).otherwise(1))
    return marked.withColumn("island", F.sum("starts").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("starts")


def asof_backward(left: DataFrame, right: DataFrame, entity: list[str], t: str, tie: str, value: str, within: float | None = None) -> DataFrame:
    """left with matched_t and matched_value of the last row of right at or before t, at most within back.

    The two sides are merged into one series for each entity, so there is no join and no pairs.
    """
    cols = [*entity, t, tie]
    a = left.select("*", F.lit(1).alias("own"), F.lit(None).cast(dict(right.dtypes)[value]).alias("from_right"), F.lit(None).cast("double").alias("right_t"))
    b = right.select(*cols, F.lit(0).alias("own"), F.col(value).alias("from_right"), F.col(t).cast("double").alias("right_t"))
    w = ordered(entity, t, "own", tie).rowsBetween(W.unboundedPreceding, 0)
    x = a.unionByName(b, allowMissingColumns=True).withColumn("hit", F.last(F.when(F.col("own") == 0, F.struct("right_t", "from_right")), ignorenulls=True).over(w))
    near = F.lit(True) if within is None else F.col(t) - F.col("hit.right_t") <= within
    hit = F.when(near, F.col("hit"))
    return x.where("own = 1").select(*left.columns, hit["right_t"].alias("matched_t"), hit["from_right"].alias("matched_value"))


def asof_lagged(df: DataFrame, entity: list[str], t: str, tie: str, value: str, lag: float, most: float, slack: float) -> DataFrame:
    """df with lagged_value: of the entity's earlier rows, at most `most` back, the one nearest to `lag` back within `slack`; the earlier on a tie, of equal times the smaller tie. Times count in microseconds; entity has no nulls."""
    us = lambda s: round(s * 1e6)
    x = df.withColumn("us_", F.round(F.col(t) * 1e6).cast("long"))
    w, one = ordered(entity, "us_"), F.struct(F.col("us_").alias("t"), F.col(tie).alias("id"), F.col(value).alias("v"))
    # Of rows of one time the first one has the largest number, so the largest row of a span is the first of its latest time.
    turn = F.row_number().over(ordered(entity, "us_", F.desc(tie), F.desc(value)))
    last = F.struct(F.col("us_").alias("t"), turn.alias("n"), F.col(value).alias("v"))
    span = lambda f, c, a, b: F.when(F.lit(a <= b), f(c).over(w.rangeBetween(a, max(a, b))))
    x = x.withColumn("last_", last).withColumn("at_", span(F.max, "last_", -min(us(lag + slack), us(most)), -us(lag)))
    x = x.withColumn("after_", span(F.min, one, max(1 - us(lag), -us(most)), min(us(slack - lag), -1)))
    nearer = F.col("at_.t").isNotNull() & (F.col("after_").isNull() | (F.col("us_") - F.col("at_.t") - us(lag) <= us(lag) - (F.col("us_") - F.col("after_.t"))))
    return x.withColumn("lagged_value", F.when(nearer, F.col("at_.v")).otherwise(F.col("after_.v"))).select(*df.columns, "lagged_value")


def next_where(df: DataFrame, entity: list[str], t: str, tie: str, condition: Column, within: float) -> DataFrame:
    """df with next_t: the time of the entity's first later row, at most within ahead, that satisfies condition."""
    x = df.withColumn("us_", F.round(F.col(t) * 1e6).cast("long"))
    w = ordered(entity, "us_").rangeBetween(1, round(within * 1e6))
    return x.withColumn("next_t", F.min(F.when(condition, F.col(t))).over(w)).drop("us_")


def periods_of(df: DataFrame, periods: DataFrame, t: str, closed: bool = False) -> DataFrame:
    """df left-joined with the first period (period, start, stop) that holds t: [start, stop), or [start, stop].

    Periods are few, a dimension of one match's calendar: they are expanded into an array literal
    of at most LIMIT entries, so the fact table is not shuffled.
    """
    rows = periods.orderBy("start").limit(PERIODS + 1).collect()
    if len(rows) > PERIODS:
        raise ValueError(f"more than {PERIODS} periods; join by buckets of time instead")
    out = F.lit(None).cast(dict(periods.dtypes)["period"])
    for r in reversed(rows):
        upper = F.lit(True) if r["stop"] is None else (F.col(t) <= r["stop"] if closed else F.col(t) < r["stop"])
        out = F.when((F.col(t) >= r["start"]) & upper, F.lit(r["period"])).otherwise(out)
    return df.withColumn("period", out)


#: Periods of a calendar at most.
PERIODS = 1000


def interval_union(df: DataFrame, entity: list[str], start: str, stop: str) -> DataFrame:
    """Per entity the disjoint intervals that cover its intervals; touching ones merge."""
    w = ordered(entity, start, stop)
    before = F.max(stop).over(w.rowsBetween(W.unboundedPreceding, -1))
    x = df.withColumn("starts", F.when(F.col(start) <= before, 0).otherwise(1))
    x = x.withColumn("piece", F.sum("starts").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy(*entity, "piece").agg(F.min(start).alias("start"), F.max(stop).alias("stop")).drop("piece")


def adjacent_overlaps(df: DataFrame, entity: list[str], start: str, stop: str, tie: str, least: float) -> DataFrame:
    """Rows that overlap their immediate successor (by start) by more than least: entity, tie, next_id, overlap."""
    w = ordered(entity, start, tie)
    x = df.select(*entity, start, stop, tie, F.lead(start).over(w).alias("next_start"), F.lead(stop).over(w).alias("next_stop"), F.lead(tie).over(w).alias("next_id"))
    return x.withColumn("overlap", F.least(stop, "next_stop") - F.col("next_start")).where(F.col("overlap") > least).select(*entity, tie, "next_id", "overlap")


def bounded_pairs(df: DataFrame, entity: list[str], t: str, tie: str, ahead: int) -> DataFrame:
    """Each row with each of its next `ahead` rows: entity, a, b, rank, gap."""
    w = ordered(entity, t, tie)
    nexts = F.array(*[F.struct(F.lit(k).alias("rank"), F.lead(tie, k).over(w).alias("b"), (F.lead(t, k).over(w) - F.col(t)).alias("gap")) for k in range(1, ahead + 1)])
    x = df.select(*entity, F.col(tie).alias("a"), nexts.alias("nexts")).select(*entity, "a", F.explode("nexts").alias("n"))
    return x.where("n.b is not null").select(*entity, "a", F.col("n.b").alias("b"), F.col("n.rank").alias("rank"), F.col("n.gap").alias("gap"))


def interpolate(df: DataFrame, entity: list[str], t: str, tie: str, value: str, most: float, speed: float | None = None, confidence: str | None = None) -> DataFrame:
    """df with filled and source: a null value between two known ones at most `most` apart, which change no faster than speed, is interpolated in time.

    With confidence named, sure is that column where the value is known, 0.55 of the smaller one of both ends where it is filled, and else 0.
    """
    w = ordered(entity, t, tie)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(t).alias("t"), F.col(value).alias("v"), *([F.coalesce(confidence, F.lit(0.0)).alias("c")] if confidence else [])))
    a = F.last(known, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    b = F.first(known, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    x = df.withColumn("before", a).withColumn("after", b)
    inside = F.col("before").isNotNull() & F.col("after").isNotNull() & (F.col("after.t") - F.col("before.t") <= most) & (F.col("after.t") > F.col("before.t"))
    if speed is not None:
        inside = inside & (F.abs(F.col("after.v") - F.col("before.v")) / (F.col("after.t") - F.col("before.t")) <= speed)
    line = F.col("before.v") + (F.col("after.v") - F.col("before.v")) * (F.col(t) - F.col("before.t")) / (F.col("after.t") - F.col("before.t"))
    x = x.withColumn("filled", F.when(F.col(value).isNotNull(), F.col(value)).when(inside, line))
    source = F.when(F.col(value).isNotNull(), "detected").when(F.col("filled").isNotNull(), "interpolated").otherwise("unknown")
    x = x.withColumn("source", source)
    if confidence:
        x = x.withColumn("sure", F.when(F.col("source") == "detected", F.coalesce(confidence, F.lit(0.0))).when(F.col("source") == "interpolated", F.least("before.c", "after.c") * 0.55).otherwise(0.0))
    return x.drop("before", "after")


def downsample(df: DataFrame, entity: list[str], t: str, tie: str, n: int) -> DataFrame:
    """At most n rows of each entity, evenly spaced in order; both ends stay."""
    w = ordered(entity, t, tie)
    x = df.withColumn("i", F.row_number().over(w) - 1).withColumn("all", F.count(F.lit(1)).over(W.partitionBy(*entity)))
    if n < 2:
        return x.where("i = 0").drop("i", "all")
    k = F.floor(F.col("i") * (n - 1) / (F.col("all") - 1) + 0.5)
    mine = F.floor(k * (F.col("all") - 1) / (n - 1) + 0.5) == F.col("i")
    return x.where((F.col("all") <= n) | mine).drop("i", "all")


def detected_around(df: DataFrame, entity: list[str], t: str, tie: str, detected: Column, most: float) -> DataFrame:
    """df with bridged: whether the nearest detected rows before and after a row are both there and at most `most` apart."""
    w = ordered(entity, t, tie)
    at = F.when(detected, F.col(t))
    before = F.last(at, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.first(at, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    return df.withColumn("bridged", F.coalesce(after - before <= most, F.lit(False)))

"""A subject's timeline by frame: one observation a frame, states in the gaps, and runs of equal states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import overlaps, points_in
from .sequence import ordered


def resolved(observations: DataFrame, unreliable: DataFrame, width: float = 256.0) -> DataFrame:
    """observations (subject, frame, tracklet, x, y, confidence, inside) with reliable and eligible, one row for each subject and frame.

    A row in one of its tracklet's unreliable ranges (tracklet, start, stop, both included) is not
    reliable; of several rows a reliable one stays, then the surer one, then the smaller tracklet.
    Eligible for statistics: reliable, inside play, with a place.
    """
    bad = points_in(observations.select("subject", "frame", "tracklet"), unreliable, ["tracklet"], "frame", "start", "stop", width).select("subject", "frame", "tracklet").distinct()
    x = observations.join(bad.withColumn("bad", F.lit(True)), ["subject", "frame", "tracklet"], "left").withColumn("reliable", F.col("bad").isNull()).drop("bad")
    w = W.partitionBy("subject", "frame").orderBy(F.desc("reliable"), F.desc(F.coalesce("confidence", F.lit(0.0))), "tracklet")
    x = x.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")
    return x.withColumn("eligible", F.col("reliable") & F.coalesce("inside", F.lit(False)) & F.col("x").isNotNull() & F.col("y").isNotNull())


def gaps(rows: DataFrame, edges: DataFrame, occlusions: DataFrame, fps: float, near: int, occluded: float, predicted: float, one_end: float, speed: float) -> DataFrame:
    """The frames between a subject's observations: subject, start, stop, status, tracklets at both ends.

    occluded: up to so many seconds with an occlusion (tracklet, start, stop) of either end's tracklet
    within `near` frames; predicted: up to so many seconds between reliable ends (or one of them, across
    an accepted edge (source, target), up to one_end; or within a tracklet) that the speed allows; else
    missing.
    """
    w = ordered(["subject"], "frame")
    nxt = {f"next_{c}": F.lead(c).over(w) for c in ("frame", "tracklet", "x", "y", "reliable")}
    g = rows.withColumns(nxt).where("next_frame > frame + 1")
    g = g.withColumn("start", F.col("frame") + 1).withColumn("stop", F.col("next_frame") - 1).withColumn("seconds", (F.col("stop") - F.col("start") + 1) / fps)
    g = g.join(edges.select(F.col("source").alias("tracklet"), F.col("target").alias("next_tracklet"), F.lit(True).alias("edge")).distinct(), ["tracklet", "next_tracklet"], "left")
    ends = g.select("subject", F.col("frame").alias("id"), (F.col("start") - near).alias("start"), (F.col("stop") + near + 1).alias("stop"), F.explode(F.array("tracklet", "next_tracklet")).alias("tracklet"))
    held = overlaps(ends, occlusions.select("tracklet", "start", (F.col("stop") + 1).alias("stop")), ["tracklet"], "start", "stop", 256.0).select("subject", F.col("id").alias("frame")).distinct()
    g = g.join(held.withColumn("held", F.lit(True)), ["subject", "frame"], "left")
    places = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("next_x").isNotNull() & F.col("next_y").isNotNull()
    slow = F.hypot(F.col("next_x") - F.col("x"), F.col("next_y") - F.col("y")) / F.greatest("seconds", F.lit(1e-6)) <= speed
    both, either = F.col("reliable") & F.col("next_reliable"), F.col("reliable") | F.col("next_reliable")
    sure = both | (F.col("edge").isNotNull() & either & (F.col("seconds") <= one_end)) | (F.col("tracklet") == F.col("next_tracklet"))
    status = F.when(F.col("held").isNotNull() & (F.col("seconds") <= occluded), "occluded").when(places & F.coalesce(slow, F.lit(False)) & sure & (F.col("seconds") <= predicted), "predicted").otherwise("missing")
    return g.select("subject", "start", "stop", status.alias("status"), "tracklet", "next_tracklet")


def encoded(states: DataFrame, entity: list[str], columns: list[str]) -> DataFrame:
    """states (entity, frame, columns; unique frames) as runs: entity, columns, start, stop of consecutive frames whose columns are equal, nulls too."""
    w = ordered(entity, "frame")
    same = F.col("frame") == F.lag("frame").over(w) + 1
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    x = states.withColumn("run_", F.sum(F.when(same, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy(*entity, "run_", *columns).agg(F.min("frame").alias("start"), F.max("frame").alias("stop")).drop("run_")


def expanded(runs: DataFrame, columns: list[str]) -> DataFrame:
    """The frames of runs (start, stop, both included)."""
    return runs.where("start <= stop").select(*columns, F.explode(F.sequence("start", "stop")).alias("frame"))


def timeline(observations: DataFrame, unreliable: DataFrame, edges: DataFrame, occlusions: DataFrame, fps: float, near: int = 2, occluded: float = 1.5, predicted: float = 0.6, one_end: float = 0.5, speed: float = 15.0) -> DataFrame:
    """subject, status, tracklet, reliable, eligible, start, stop: the runs of detected, predicted, occluded and missing frames of each subject, in order without holes."""
    rows = resolved(observations, unreliable)
    none: Column = F.lit(None)
    seen = encoded(rows.withColumn("status", F.lit("detected")), ["subject"], ["status", "tracklet", "reliable", "eligible"])
    blank = gaps(rows, edges, occlusions, fps, near, occluded, predicted, one_end, speed)
    blank = blank.select("subject", "status", none.cast(dict(observations.dtypes)["tracklet"]).alias("tracklet"), F.lit(False).alias("reliable"), F.lit(False).alias("eligible"), "start", "stop")
    return seen.unionByName(blank)

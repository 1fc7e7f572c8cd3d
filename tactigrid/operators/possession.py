"""From ball and player positions to possession, contacts and passes.

A sequence (a match) is keyed; within it frames are in order. Windows are partitioned by sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sequence import islands, ordered


def nearest_players(ball: DataFrame, players: DataFrame, key: list[str], n: int = 4) -> DataFrame:
    """ball (key, bx, by) left-joined with the n nearest players (key, player, team, x, y): nearest, an array of (distance, player, team).

    Distances have three decimals; ties go to the smaller player. A frame has as many players as a pitch holds.
    """
    x = ball.select(*key, "bx", "by").join(players, key)
    far = F.round(F.sqrt((F.col("x") - F.col("bx")) * (F.col("x") - F.col("bx")) + (F.col("y") - F.col("by")) * (F.col("y") - F.col("by"))), 3)
    near = x.groupBy(*key).agg(F.slice(F.array_sort(F.collect_list(F.struct(far.alias("distance"), "player", "team"))), 1, n).alias("nearest"))
    return ball.join(near, key, "left")


def possession(near: DataFrame, control: float = 1.8, contested: float = 2.4, delta: float = 0.8) -> DataFrame:
    """near with first_m, second_m, status (unknown, contested, controlled, free), and the owner's player and team where controlled.

    A ball without position or a frame without players is unknown.
    """
    one, two = F.try_element_at("nearest", F.lit(1)), F.try_element_at("nearest", F.lit(2))
    x = near.withColumn("first_m", one["distance"]).withColumn("second_m", two["distance"])
    both = (F.col("first_m") <= contested) & (F.col("second_m") <= contested) & (F.col("second_m") - F.col("first_m") <= delta)
    status = F.when(F.col("bx").isNull() | F.col("by").isNull() | F.col("first_m").isNull(), "unknown").when(F.coalesce(both, F.lit(False)), "contested").when(F.col("first_m") <= control, "controlled").otherwise("free")
    x = x.withColumn("status", status)
    mine = F.col("status") == "controlled"
    return x.withColumn("player", F.when(mine, one["player"])).withColumn("team", F.when(mine, one["team"]))


def segments(frames: DataFrame, sequence: list[str], frame: str, t: str, fps: float = 30.0) -> DataFrame:
    """Runs of the same status, player and team: start and stop frame, frames, mean and least distance, ball path, displacement, seconds, speed, straightness.

    seconds are frames times the sequence's interval, which is its first step of frames at fps; the speed goes by the times of the first and the last frame.
    """
    w = ordered(sequence, frame)
    x = islands(frames, sequence, frame, frame, ["status", "player", "team"])
    step = F.sqrt((F.col("bx") - F.lag("bx").over(w)) * (F.col("bx") - F.lag("bx").over(w)) + (F.col("by") - F.lag("by").over(w)) * (F.col("by") - F.lag("by").over(w)))
    x = x.withColumn("step", F.when(F.lag("island").over(w) == F.col("island"), step))
    at = lambda f, c: f(F.struct(frame, c))[c]
    s = x.groupBy(*sequence, "island", "status", "player", "team").agg(
        F.min(frame).alias("start_frame"), F.max(frame).alias("stop_frame"), F.count(F.lit(1)).alias("frames"),
        F.count(F.when(F.col("detected"), 1)).alias("detected_frames"), F.avg("first_m").alias("mean_m"), F.min("first_m").alias("least_m"),
        F.coalesce(F.sum("step"), F.lit(0.0)).alias("path_m"), (F.max(t) - F.min(t)).alias("span_"),
        at(F.min, "bx").alias("x0"), at(F.min, "by").alias("y0"), at(F.max, "bx").alias("x1"), at(F.max, "by").alias("y1"),
    )
    ahead = frames.select(*sequence, F.col(frame).alias("f_"), (F.lead(frame).over(w) - F.col(frame)).alias("step_")).where("step_ > 0")
    interval = ahead.groupBy(*sequence).agg((F.min(F.struct("f_", "step_"))["step_"] / fps).alias("interval_"))
    s = s.join(interval, sequence, "left").withColumn("seconds", F.col("frames") * F.coalesce("interval_", F.lit(1.0 / fps))).drop("interval_")
    moved = F.sqrt((F.col("x1") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y1") - F.col("y0")) * (F.col("y1") - F.col("y0")))
    s = s.withColumn("speed", F.col("path_m") / F.greatest("span_", F.lit(0.001))).drop("span_")
    return s.withColumn("straightness", moved / F.greatest("path_m", F.lit(0.001)))


def fly_through(s: DataFrame, frames: int = 3, least: float = 0.95, path: float = 1.5, speed: float = 7.5, straight: float = 0.85) -> DataFrame:
    """Controlled segments that the ball only flies through become free, without owner."""
    flies = (F.col("status") == "controlled") & (F.col("frames") >= frames) & (F.col("least_m") > least) & (F.col("path_m") >= path) & (F.col("speed") >= speed) & (F.col("straightness") >= straight)
    s = s.withColumn("flies", F.coalesce(flies, F.lit(False)))
    return s.withColumn("status", F.when(F.col("flies"), "free").otherwise(F.col("status"))).withColumns({c: F.when(~F.col("flies"), F.col(c)) for c in ("player", "team")})


def pass_pairs(contacts: DataFrame, sequence: list[str], start: str, stop: str, tie: str, least: float = 0.05, most: float = 5.0) -> DataFrame:
    """Each contact with the next: gap, reason (the first why it is no pass, else null) and pass_type."""
    w = ordered(sequence, start, tie)
    lead = {f"next_{c}": F.lead(c).over(w) for c in (tie, "player", "team", start, "x0", "y0")}
    x = contacts.withColumns(lead).where(F.col(f"next_{tie}").isNotNull()).withColumn("gap", F.col(f"next_{start}") - F.col(stop))
    none = lambda *cs: F.greatest(*[F.col(c).isNull() for c in cs])
    reason = F.when(none("player", "next_player"), "missing_player").when(F.col("player") == F.col("next_player"), "same_player").when(F.col("gap") < least, "gap_too_short").when(F.col("gap") > most, "gap_too_long")
    x = x.withColumn("reason", reason.when(none("x1", "y1", "next_x0", "next_y0"), "missing_position"))
    kind = F.when(F.col("team").isNull() | F.col("next_team").isNull(), "unknown").when(F.col("team") == F.col("next_team"), "same_team_pass").otherwise("turnover_or_interception")
    return x.withColumn("pass_type", F.when(F.col("reason").isNull(), kind))


def longest_run(frames: DataFrame, sequence: list[str], frame: str, state: str, value: str) -> DataFrame:
    """The most consecutive rows of a sequence whose state is value; 0 if none."""
    x = islands(frames, sequence, frame, frame, [state])
    runs = x.groupBy(*sequence, "island").agg(F.count(F.when(F.col(state) == value, 1)).alias("n"))
    return runs.groupBy(*sequence).agg(F.max("n").alias("longest"))


def running_counts(frames: DataFrame, sequence: list[str], frame: str, team: str, teams: list[str]) -> DataFrame:
    """frames with n_<team> so far, for each team, and n_skipped for the rest."""
    w = ordered(sequence, frame).rowsBetween(W.unboundedPreceding, 0)
    known = F.coalesce(F.col(team).isin(teams), F.lit(False))
    counts = {f"n_{t}": F.count(F.when(F.col(team) == t, 1)).over(w) for t in teams}
    return frames.withColumns(counts | {"n_skipped": F.count(F.when(~known, 1)).over(w)})

"""Restarts of play: where the ball lies still at a boundary, who restarts, who receives.

All that can be said of a single setup is joined to it in parallel (release, receiver, actor, last
touch); only the choice among overlapping setups, each of which uses up the frames to its receiver, is
a scan, and that sees one narrow row for each setup.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .grouped import listed
from .ranges import bucket
from .sequence import ordered

#: Metres, frames, metres a second.
NEAR, CORNER = 0.8, 5.0
MIN_FRAMES, STILL_SPEED, STILL_MOVE = 8, 0.9, 0.7
RELEASE_SPEED, RELEASE_MOVE, RELEASE_FRAMES = 2.0, 0.9, 45
RECEIVER_FRAMES, ACTOR_REACH, LAST_TOUCH_FRAMES, OUT_MARGIN = 120, 2.6, 180, 0.25


def boundary(x: Column, y: Column, width: float, length: float, near: float = NEAR, corner: float = CORNER) -> Column:
    """(restart_type, line, corner) of the nearest line within near, null if none is; ties in the order left, right, top, bottom."""
    lines = [("left_touchline", F.abs(x)), ("right_touchline", F.abs(F.lit(width) - x)), ("top_goal_line", F.abs(y)), ("bottom_goal_line", F.abs(F.lit(length) - y))]
    first = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i"), F.lit(n).alias("line")) for i, (n, d) in enumerate(lines)]))
    side = F.when(first["i"] == 0, "left").when(first["i"] == 1, "right").when(x <= corner, "left").when(x >= width - corner, "right")
    end = F.when(first["i"] == 2, "top").when(first["i"] == 3, "bottom").when(y <= corner, "top").when(y >= length - corner, "bottom")
    where = F.concat(end, F.lit("_"), side)
    kind = F.when(first["i"] <= 1, "kick_in").when(where.isNotNull(), "corner").otherwise("ignored_goal_line_restart")
    return F.when((first["d"] <= near) & x.isNotNull() & y.isNotNull(), F.struct(kind.alias("restart_type"), first["line"].alias("line"), where.alias("corner")))


class _Still:
    """Windows of at least MIN_FRAMES rows in which the ball lies still, each as long as it goes and beginning after the one before."""

    def __init__(self, least: int, speed: float, move: float):
        self.least, self.speed, self.move, self.rows = least, speed, move, []

    def fast(self, a: tuple, b: tuple) -> bool:
        dt = b[1] - a[1]
        return dt > 0 and round(math.dist(a[2:4], b[2:4]) / dt, 3) > self.speed

    def far(self, a: tuple, b: tuple) -> bool:
        return round(math.dist(a[2:4], b[2:4]), 3) > self.move

    def feed(self, rows: list[tuple]) -> list[tuple]:
        out = []
        for r in rows:
            if len(self.rows) >= self.least and (self.fast(self.rows[-1], r) or self.far(self.rows[0], r)):
                out += self.end()
            self.rows.append(r)
            while len(self.rows) == self.least and not self.still():
                self.rows.pop(0)
        return out

    def still(self) -> bool:
        return not self.far(self.rows[0], self.rows[-1]) and not any(self.fast(a, b) for a, b in zip(self.rows, self.rows[1:], strict=False))

    def end(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        if len(rows) < self.least:
            return []
        n = len(rows)
        return [(int(rows[0][0]), int(rows[-1][0]), n, sum(r[2] for r in rows) / n, sum(r[3] for r in rows) / n, sum(r[4] for r in rows) / n)]


WINDOW = "start_frame long, end_frame long, frames long, x double, y double, confidence double"


def static_windows(ball: DataFrame, sequence: list[str], width: float, length: float, near: float = NEAR, corner: float = CORNER, least: int = MIN_FRAMES, speed: float = STILL_SPEED, move: float = STILL_MOVE) -> DataFrame:
    """sequence, restart_type, line, corner, start_frame, end_frame, frames, x, y (means), confidence of the windows in which ball (sequence, frame, t, x, y, confidence) lies still at one boundary.

    Runs of rows at the same boundary, no more than two frames apart, are cut first; they are independent
    and share tasks. In a run the first window that is still grows as far as it can, and the next begins
    after it. Rows without a place break a run; goal lines away from the corners count as no boundary.
    """
    at = boundary(F.col("x"), F.col("y"), width, length, near, corner)
    x = ball.where("frame is not null").withColumn("at_", at).withColumn("at_", F.when(F.col("at_.restart_type") != "ignored_goal_line_restart", F.col("at_")))
    w = ordered(sequence, "frame")
    same = F.lag("at_").over(w).eqNullSafe(F.col("at_")) & (F.col("frame") <= F.lag("frame").over(w) + 2)
    x = x.withColumn("run_", F.sum(F.when(same, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))).where("at_ is not null")
    x = x.select(*sequence, F.col("at_.restart_type").alias("restart_type"), F.col("at_.line").alias("line"), F.col("at_.corner").alias("corner"), "run_", F.col("frame").cast("long").alias("frame_"), F.coalesce("t", F.col("frame") / 30.0).cast("double").alias("t_"), F.col("x").cast("double").alias("x_"), F.col("y").cast("double").alias("y_"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("c_"))
    return listed(x, [*sequence, "run_", "restart_type", "line", "corner"], ["frame_"], ["frame_", "t_", "x_", "y_", "c_"], lambda key: _Still(least, speed, move), WINDOW).drop("run_")


def within(windows: DataFrame, rows: DataFrame, sequence: list[str], first: Column, last: Column, columns: list[str], size: int) -> DataFrame:
    """windows with each of rows (sequence, frame, columns) whose frame is in [first, last], which is at most about size long; joined on blocks of frames, so a long sequence is dealt out."""
    spread = windows.withColumn("a_", first).withColumn("b_", last).where("a_ <= b_").withColumn("block_", F.explode(F.sequence(bucket(F.col("a_"), size), bucket(F.col("b_"), size))))
    r = rows.select(*sequence, F.col("frame").alias("frame_"), *[F.col(c).alias(f"{c}_") for c in columns]).withColumn("block_", bucket(F.col("frame_"), size))
    return spread.join(r, [*sequence, "block_"]).where("frame_ between a_ and b_").drop("a_", "b_", "block_")


def releases(windows: DataFrame, ball: DataFrame, sequence: list[str], speed: float = RELEASE_SPEED, move: float = RELEASE_MOVE, ahead: int = RELEASE_FRAMES, fps: float = 30.0) -> DataFrame:
    """windows with release: of the next `ahead` frames the first in which the ball is away by move and got there at this speed; null if none."""
    w = ordered(sequence, "frame")
    known = ball.where("x is not null and y is not null")
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    dt = F.coalesce(F.col("t") - F.lag("t").over(w), (F.col("frame") - F.lag("frame").over(w)) / fps)
    known = known.withColumn("v", step / F.greatest(dt, F.lit(0.001)))
    near = within(windows, known, sequence, F.col("end_frame") + 1, F.col("end_frame") + ahead, ["x", "y", "v", "t", "confidence"], ahead)
    far = F.hypot(F.col("x_") - F.col("x"), F.col("y_") - F.col("y"))
    hit = near.withColumn("far_", far).where((F.col("far_") >= move) & (F.col("v_") >= speed))
    hit = hit.groupBy(*sequence, "start_frame").agg(F.min(F.struct(F.col("frame_").alias("frame"), F.col("far_").alias("displacement"), F.col("v_").alias("speed"), F.col("confidence_").alias("confidence"))).alias("release"))
    return windows.join(hit, [*sequence, "start_frame"], "left")


def receivers(found: DataFrame, possession: DataFrame, sequence: list[str], ahead: int = RECEIVER_FRAMES) -> DataFrame:
    """found with receiver: the first frame of control from the release on, up to `ahead` frames later."""
    control = possession.where("status = 'controlled' and player is not null and team is not null")
    near = within(found.select(*sequence, "start_frame", F.col("release.frame").alias("r_")).where("r_ is not null"), control, sequence, F.col("r_"), F.col("r_") + ahead, ["player", "team", "confidence"], ahead)
    hit = near.groupBy(*sequence, "start_frame").agg(F.min(F.struct(F.col("frame_").alias("frame"), F.col("player_").alias("player"), F.col("team_").alias("team"), F.col("confidence_").alias("confidence"))).alias("receiver"))
    return found.join(hit, [*sequence, "start_frame"], "left")


def actors(found: DataFrame, players: DataFrame, sequence: list[str], reach: float = ACTOR_REACH) -> DataFrame:
    """found with actor: the player (sequence, frame, player, team, x, y) who came nearest to the setup's mean place during it, up to reach; then the smaller player."""
    near = within(found.select(*sequence, "start_frame", "end_frame", "x", "y"), players, sequence, F.col("start_frame"), F.col("end_frame"), ["player", "team", "x", "y"], 64)
    far = F.hypot(F.col("x_") - F.col("x"), F.col("y_") - F.col("y"))
    hit = near.where(far <= reach).groupBy(*sequence, "start_frame").agg(F.min(F.struct(F.round(far, 3).alias("distance"), F.col("player_").alias("player"), F.col("team_").alias("team"))).alias("actor"))
    return found.join(hit, [*sequence, "start_frame"], "left")


def last_touches(found: DataFrame, possession: DataFrame, sequence: list[str], width: float, length: float, back: int = LAST_TOUCH_FRAMES, margin: float = OUT_MARGIN) -> DataFrame:
    """found with touch (frame, player, team) and evidence: the last control of team A or B in the `back` frames before the setup, if the ball then was seen outside the pitch, or was missing for three frames or more, or was last within two metres; else both null."""
    near = within(found.select(*sequence, "start_frame", "x", "y"), possession, sequence, F.col("start_frame") - back, F.col("start_frame") - 1, ["status", "player", "team", "bx", "by"], back)
    near = near.withColumn("control_", (F.col("status_") == "controlled") & F.col("team_").isin("A", "B"))
    touch = near.where("control_").groupBy(*sequence, "start_frame").agg(F.max(F.struct(F.col("frame_").alias("frame"), F.col("player_").alias("player"), F.col("team_").alias("team"))).alias("touch"))
    since = near.join(touch, [*sequence, "start_frame"]).where("frame_ >= touch.frame")
    seen = F.col("bx_").isNotNull() & F.col("by_").isNotNull()
    out = seen & ((F.col("bx_") < -margin) | (F.col("bx_") > width + margin) | (F.col("by_") < -margin) | (F.col("by_") > length + margin))
    last = F.max(F.when(seen, F.struct("frame_", F.hypot(F.col("bx_") - F.col("x"), F.col("by_") - F.col("y")).alias("d"))))
    since = since.groupBy(*sequence, "start_frame").agg(F.first("touch").alias("touch"), F.count(F.when(out, 1)).alias("outside"), F.count(F.when(~seen, 1)).alias("missing"), last["d"].alias("d"))
    evidence = F.when(F.col("outside") > 0, "detected_outside_pitch").when(F.col("missing") >= 3, "ball_missing_before_static_boundary_restart").when(F.col("d") <= 2.0, "last_ball_near_restart_boundary")
    since = since.withColumn("evidence", evidence).where("evidence is not null").select(*sequence, "start_frame", "touch", "evidence")
    return found.join(since, [*sequence, "start_frame"], "left")


class _Consumed:
    """Takes a setup if it begins after all that the one taken before it used up."""

    def __init__(self):
        self.until = -math.inf

    def feed(self, rows: list[tuple]) -> list[tuple]:
        out = []
        for start, until in rows:
            if start > self.until:
                self.until = until
                out.append((int(start),))
        return out

    def end(self) -> list[tuple]:
        return []


def consumed(found: DataFrame, sequence: list[str], start: str, until: str) -> DataFrame:
    """Rows of found, by start, that begin after the until of the row kept before them; rows without until are left out. The state is one number."""
    rows = found.where(F.col(until).isNotNull() & F.col(start).isNotNull())
    narrow = rows.select(*sequence, F.col(start).alias("start_frame"), F.col(until).alias("until_"))
    kept = listed(narrow, sequence, ["start_frame", "until_"], ["start_frame", "until_"], lambda key: _Consumed(), "kept_ long")
    return rows.join(kept.withColumnRenamed("kept_", start), [*sequence, start], "left_semi")


def restarts(ball: DataFrame, possession: DataFrame, players: DataFrame, sequence: list[str], width: float, length: float, fps: float = 30.0) -> DataFrame:
    """Restarts of ball (sequence, frame, t, x, y, confidence), possession (sequence, frame, status, player, team, confidence, bx, by) and players (sequence, frame, player, team, x, y).

    A row for each restart, numbered by restart from 1 in a sequence: where and how long the ball lay,
    when it was released and how fast, the actor (else the opponent of the last touch), the receiver,
    result and confidence. Setups without a release are none; a setup that begins before the receiver of
    the restart before it is part of that. Frames are unique in ball and possession of a sequence.
    """
    x = releases(static_windows(ball, sequence, width, length), ball, sequence, fps=fps).where("release is not null")
    x = receivers(x, possession, sequence)
    x = consumed(x.withColumn("until", F.greatest("release.frame", F.coalesce("receiver.frame", "release.frame"))), sequence, "start_frame", "until")
    x = last_touches(actors(x, players, sequence), possession, sequence, width, length)
    other = F.when(F.col("touch.team") == "A", "B").when(F.col("touch.team") == "B", "A")
    x = x.withColumn("team", F.when(F.col("actor").isNotNull(), F.col("actor.team")).otherwise(other))
    x = x.withColumn("team_source", F.when(F.col("actor").isNotNull(), "nearest_setup_player").when(F.col("touch").isNotNull(), "last_touch_out_of_play_opponent"))
    result = F.when(F.col("team").isNull(), "restart_unknown_actor_team").when(F.col("receiver").isNull(), "restart_no_receiver").when(F.col("team") == F.col("receiver.team"), "restart_pass").otherwise("restart_turnover_or_interception")
    sure = 0.25 + F.least("confidence", F.coalesce("release.confidence", F.lit(0.0))) * 0.25 + F.least(F.lit(0.12), F.col("frames") / fps * 0.08) + F.least(F.lit(0.12), F.col("release.speed") / 12.0)
    sure = sure + F.when(F.col("actor").isNotNull(), 0.2).when(F.col("touch").isNotNull(), 0.08).otherwise(0.0) + F.least(F.lit(0.13), F.coalesce("receiver.confidence", F.lit(0.0)) * 0.13)
    x = x.withColumn("result", result).withColumn("sure_", F.least(F.lit(0.88), F.greatest(F.lit(0.05), sure)))
    return x.select(
        *sequence, F.row_number().over(ordered(sequence, "start_frame")).alias("restart"), "restart_type", "line", "corner", "start_frame", "end_frame", "frames",
        F.col("release.frame").alias("release_frame"), F.col("release.speed").alias("release_speed"), F.col("release.displacement").alias("release_displacement"),
        F.col("actor.player").alias("actor"), "team", "team_source", F.col("touch.frame").alias("last_touch_frame"), "evidence",
        F.col("receiver.frame").alias("receiver_frame"), F.col("receiver.player").alias("receiver"), F.col("receiver.team").alias("receiver_team"), "result", F.col("sure_").alias("confidence"),
    )

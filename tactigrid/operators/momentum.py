"""Attacking momentum: pressure of each frame, bins of it and of events, causal smoothing, scores within a match."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tactigrid.functions.geometry import clamp

from .grouped import stepped, value
from .sequence import asof_lagged, ordered

#: Fixed values.
BASE, WEIGHT, EXPONENT = 0.10, 0.90, 1.8
BACK, SLACK, GAP, FULL_M, MOST_BONUS = 1.0, 0.5, 1.5, 6.0, 0.30
COMPLETED, FAILED, PROGRESSIVE, PROGRESSIVE_M, RESTART = 0.10, 0.035, 0.25, 10.0, 0.025
PASS_REVIEW = {"accepted": 1.0, "needs_review": 0.7, "uncertain": 0.45, "rejected": 0.0}
RESTART_REVIEW = {"accepted": 1.0, "needs_review": 0.6, "uncertain": 0.35, "rejected": 0.0}
CAP, RESET, FLOOR, DEAD_ZONE, SURE = 0.40, 20.0, 0.15, 5.0, 0.15


def attack_progress(x: Column, y: Column, direction: Column, width: float, length: float) -> Column:
    """How far along the attack a place is, from 0 to 1; null without a place or direction."""
    along = F.when(direction == "towards_y_min", 1 - clamp(y / length, 0.0, 1.0)).when(direction == "towards_y_max", clamp(y / length, 0.0, 1.0))
    along = along.when(direction == "towards_x_min", 1 - clamp(x / width, 0.0, 1.0)).when(direction == "towards_x_max", clamp(x / width, 0.0, 1.0))
    return F.when(x.isNotNull() & y.isNotNull(), along)


def multiplier(status: Column, table: dict[str, float]) -> Column:
    out = F.lit(table["needs_review"])
    for name, m in table.items():
        out = F.when(status == name, m).otherwise(out)
    return out


def pressure(frames: DataFrame, sequence: list[str], width: float, length: float) -> DataFrame:
    """frames (sequence, frame, t, status, team, period, direction, confidence, bx, by) with progress, bonus and pressure of those under control with a known team, place and direction; else null.

    Pressure is confidence times (0.1 + 0.9 progress^1.8 + bonus); the bonus is for progress made since
    the sample nearest to a second before (half a second either way) in the same run of control: one
    team, one period, no step above 1.5 seconds, no frame out of control between.
    """
    x = frames.withColumn("controlled_", (F.col("status") == "controlled") & F.col("team").isin("A", "B"))
    x = x.withColumn("progress", F.when(F.col("controlled_"), attack_progress(F.col("bx"), F.col("by"), F.col("direction"), width, length)))
    # A row under control whose progress is unknown neither goes on with a run nor ends it; nor does one without a team.
    speaks = (F.col("status") != "controlled") | F.col("progress").isNotNull()
    w = ordered(sequence, "t", "frame")
    said = F.when(speaks, F.struct("t", "team", "period", "direction", F.col("progress").isNotNull().alias("on")))
    before = F.last(said, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    x = x.withColumn("before_", before)
    same = F.col("before_.on") & F.col("before_.team").eqNullSafe(F.col("team")) & F.col("before_.period").eqNullSafe(F.col("period")) & F.col("before_.direction").eqNullSafe(F.col("direction")) & (F.col("t") - F.col("before_.t") <= GAP)
    x = x.withColumn("run_", F.sum(F.when(F.col("progress").isNull() | F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))).drop("before_")
    # Rows without progress are apart from the others of their run, so the rest need not be joined to them again.
    x = asof_lagged(x.withColumn("on_", F.col("progress").isNotNull()), [*sequence, "run_", "on_"], "t", "frame", "progress", BACK, GAP, SLACK)
    axis = F.when(F.col("direction").isin("towards_y_min", "towards_y_max"), length).otherwise(width)
    made = clamp((F.col("progress") - F.col("lagged_value")) * axis / FULL_M, 0.0, 1.0)
    bonus = F.when(F.col("lagged_value").isNotNull(), made * MOST_BONUS)
    x = x.withColumn("bonus", F.when(F.col("progress").isNotNull(), F.coalesce(bonus, F.lit(0.0))))
    sure = clamp(F.coalesce("confidence", F.lit(0.0)), 0.0, 1.0)
    return x.withColumn("pressure", sure * (BASE + WEIGHT * F.pow("progress", F.lit(EXPONENT)) + F.col("bonus"))).drop("run_", "on_", "lagged_value", "controlled_")


def event_bonuses(passes: DataFrame, restarts: DataFrame, sequence: list[str]) -> DataFrame:
    """sequence, t, team, bonus, confidence of passes (t, team, outcome, review_status, confidence, forward_m, restart) and of restarts (restart, t, team, restart_type, review_status, confidence) that no pass came from."""
    sure = clamp(F.coalesce("confidence", F.lit(0.0)), 0.0, 1.0)
    made = F.col("outcome") == "completed_pass"
    ahead = F.least(F.lit(PROGRESSIVE), F.greatest(F.lit(0.0), F.coalesce("forward_m", F.lit(0.0))) / PROGRESSIVE_M * PROGRESSIVE) * F.when(made, 1.0).otherwise(0.2)
    p = passes.where(F.col("outcome").isin("completed_pass", "failed_pass") & F.col("team").isin("A", "B"))
    p = p.select(*sequence, "t", "team", ((F.when(made, COMPLETED).otherwise(FAILED) + ahead) * sure * multiplier(F.col("review_status"), PASS_REVIEW)).alias("bonus"), sure.alias("confidence"))
    used = passes.where("restart is not null").select(*sequence, "restart").distinct().hint("merge")
    r = restarts.join(used, [*sequence, "restart"], "left_anti").where(F.col("restart_type").isin("corner", "kick_in") & F.col("team").isin("A", "B"))
    r = r.select(*sequence, "t", "team", (RESTART * sure * multiplier(F.col("review_status"), RESTART_REVIEW)).alias("bonus"), sure.alias("confidence"))
    return p.unionByName(r).where("bonus > 0")


def bins(frames: DataFrame, events: DataFrame, matches: DataFrame, sequence: list[str], width: float = 5.0) -> DataFrame:
    """A row for each bin of width seconds of each match (sequence, duration), empty ones too: samples, control, a_raw, b_raw, signed, confidence, period, reliable.

    A team's positional score is its pressure over all samples of the bin, unknown ones included; its
    events' bonuses are capped. Frames and events after the match's end are left out.
    """
    n = F.greatest(F.lit(1), F.ceil(F.col("duration") / width).cast("int"))
    every = matches.select(*sequence, "duration", n.alias("bins_"), F.explode(F.sequence(F.lit(0), n - 1)).alias("bin"))
    at = F.least(F.greatest(F.lit(0), F.floor(F.greatest(F.col("t"), F.lit(0.0)) / width).cast("int")), F.col("bins_") - 1)
    # Matches and events grow alike and their size in a file tells little, so none of them is sent to every task.
    ends = matches.select(*sequence, "duration", n.alias("bins_")).hint("merge")
    placed = lambda df: df.join(ends, sequence).where("t < duration").withColumn("bin", at)
    held = (F.col("status") == "controlled") & F.col("team").isin("A", "B")
    sure = F.when(held, clamp(F.coalesce("confidence", F.lit(0.0)), 0.0, 1.0))
    of = lambda team, c: F.coalesce(F.sum(F.when(F.col("team") == team, F.col(c))), F.lit(0.0))
    f = placed(frames).groupBy(*sequence, "bin").agg(
        F.count(F.lit(1)).alias("samples"), F.count(F.when(held & (F.col("team") == "A"), 1)).alias("a_samples"), F.count(F.when(held & (F.col("team") == "B"), 1)).alias("b_samples"),
        of("A", "pressure").alias("a_sum"), of("B", "pressure").alias("b_sum"), F.coalesce(F.avg(sure), F.lit(0.0)).alias("mean_confidence"), F.count("progress").alias("directed"),
    )
    by = placed(frames).where(held).groupBy(*sequence, "bin", F.coalesce("period", F.lit("unknown")).alias("p")).count()
    by = by.groupBy(*sequence, "bin").agg(F.max(F.struct("count", "p"))["p"].alias("period"))
    e = placed(events).groupBy(*sequence, "bin").agg(of("A", "bonus").alias("a_bonus"), of("B", "bonus").alias("b_bonus"), F.sum(F.col("bonus") * F.col("confidence")).alias("weighed"), F.sum("bonus").alias("weight"))
    x = every.join(f, [*sequence, "bin"], "left").join(by, [*sequence, "bin"], "left").join(e, [*sequence, "bin"], "left")
    x = x.fillna(0, ["samples", "a_samples", "b_samples", "directed"]).fillna(0.0, ["a_sum", "b_sum", "mean_confidence", "a_bonus", "b_bonus", "weighed", "weight"])
    all_, control, cap = F.greatest("samples", F.lit(1)), F.col("a_samples") + F.col("b_samples"), CAP * max(1.0, width / 5.0)
    x = x.withColumns({"a_place": F.col("a_sum") / all_, "b_place": F.col("b_sum") / all_, "a_event": F.least(F.lit(cap), "a_bonus"), "b_event": F.least(F.lit(cap), "b_bonus")})
    place_sure = clamp(F.col("mean_confidence") * (F.col("directed") / F.greatest(control, F.lit(1))) * F.sqrt(control / all_), 0.0, 1.0)
    event_sure = F.when(F.col("weight") > 0, clamp(F.col("weighed") / F.greatest("weight", F.lit(1e-9)), 0.0, 1.0)).otherwise(0.0)
    place, event = F.col("a_place") + F.col("b_place"), F.col("a_event") + F.col("b_event")
    confidence = F.when(place + event > 0, clamp((place_sure * place + event_sure * event) / F.greatest(place + event, F.lit(1e-9)), 0.0, 1.0)).otherwise(0.0)
    x = x.withColumns({"a_raw": F.col("a_place") + F.col("a_event"), "b_raw": F.col("b_place") + F.col("b_event"), "confidence": confidence})
    x = x.withColumn("signed", F.col("a_raw") - F.col("b_raw")).withColumn("reliable", (place + event > 0) & (F.col("confidence") > 0))
    return x.select(*sequence, "bin", "samples", "a_samples", "b_samples", "a_raw", "b_raw", "signed", "confidence", "period", "reliable")


class _Ema:
    def __init__(self, alpha: float, width: float, reset: float):
        self.alpha, self.width, self.reset = alpha, width, reset
        self.last, self.period, self.sure_at = None, None, None

    def feed(self, rows: pd.DataFrame) -> list[tuple]:
        out = []
        for k, signed, period, reliable in rows[["bin", "signed", "period", "reliable"]].itertuples(index=False, name=None):
            t, period = (k + 0.5) * self.width, value(period)
            anew = self.last is None or period is not None and self.period is not None and period != self.period or reliable and self.sure_at is not None and t - self.sure_at >= self.reset
            self.last = signed if anew else self.alpha * signed + (1.0 - self.alpha) * self.last
            self.period = self.period if period is None else period
            self.sure_at = t if reliable else self.sure_at
            out.append((int(k), self.last))
        return out

    def end(self) -> list[tuple]:
        return []


def smoothed(points: DataFrame, sequence: list[str], width: float = 5.0, window: float = 30.0, reset: float = RESET) -> DataFrame:
    """points with smooth: the exponential average of signed, alpha = 2 / (bins of the window + 1).

    It goes on through bins without reliable data, and begins anew where the period changes or where
    reliable data come again `reset` seconds or more after the last. The state is three values a match.
    """
    alpha = 2.0 / (max(1, round(window / width)) + 1.0)
    narrow = points.select(*sequence, "bin", "signed", "period", "reliable")
    s = stepped(narrow, sequence, ["bin"], lambda key: _Ema(alpha, width, reset), "bin int, smooth double")
    return points.join(s.hint("merge"), [*sequence, "bin"])


def momentum(frames: DataFrame, passes: DataFrame, restarts: DataFrame, matches: DataFrame, sequence: list[str], width: float, length: float, bin_seconds: float = 5.0, window: float = 30.0) -> DataFrame:
    """The bins() of each match with smooth, score and dominant.

    score is smooth over the match's 95th percentile of its size where it is not zero (0.15 at least),
    from -100 (team B) to 100; dominant is the team of a score of 5 or more with confidence 0.15 or more.
    Scores of different matches do not compare.
    """
    x = bins(pressure(frames, sequence, width, length), event_bonuses(passes, restarts, sequence), matches, sequence, bin_seconds)
    x = smoothed(x, sequence, bin_seconds, window)
    size = F.abs("smooth")
    scale = x.groupBy(*sequence).agg(F.greatest(F.coalesce(F.percentile(F.when(size > 1e-12, size), F.lit(0.95)), F.lit(0.0)), F.lit(FLOOR)).alias("scale"))
    x = x.join(scale, sequence).withColumn("score", clamp(F.col("smooth") / F.col("scale") * 100.0, -100.0, 100.0)).drop("scale")
    clear = (F.abs("score") >= DEAD_ZONE) & (F.col("confidence") >= SURE)
    return x.withColumn("dominant", F.when(clear, F.when(F.col("score") > 0, "A").otherwise("B")))

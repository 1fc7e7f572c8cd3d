"""Who was on the pitch when: observed frames, and gaps that continuity lets one fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import overlaps, points_in
from .sequence import ordered

#: Seconds, shares, metres a second.
HOLE, BRIDGE, LONG_BRIDGE = 2.0, 5.0, 20.0
COVERED, LONG_COVERED = 0.5, 0.85
SPEED, NEAR = 10.0, 3.0
RANKS = {"assigned_detected": 5, "assigned_ambiguous": 4, "assigned_predicted": 3, "assigned_missing": 3, "assignment_short_gap": 2, "same_subject_bridge": 1, "same_subject_long_bridge": 1}


def continuous(frames: Column, far: Column, fps: float) -> Column:
    """Whether a player can get that far in so many frames; false if a place is missing."""
    return F.coalesce((frames > 0) & (far <= F.greatest(F.lit(NEAR), SPEED * frames / fps)), F.lit(False))


def ranked(kind: Column) -> Column:
    out = F.lit(0)
    for name, rank in RANKS.items():
        out = F.when(kind == name, rank).otherwise(out)
    return out


def evidence(fragments: DataFrame, rows: DataFrame, slots: DataFrame, fps: float) -> DataFrame:
    """player, subject, frame, kind, confidence: every reason to take a player for present in a frame.

    fragments (player, subject, fragment, start, stop): frames in which the player is taken for the
    subject. rows (player, subject, fragment, frame, source, x, y, confidence): what was seen inside play.
    slots (subject, frame): all rows of the subject. Observed rows count in their fragment's interval;
    holes of up to two seconds between them, and gaps between a player's fragments of one subject of up
    to five (or twenty) seconds with half (85 %) of their frames seen, are filled if the player can have
    got across and nobody else has the subject then.
    """
    key = ["player", "subject", "fragment"]
    seen = rows.join(fragments, key).where("frame between start and stop")
    kind = F.when(F.col("source").isin("detected", "ambiguous", "predicted"), F.concat(F.lit("assigned_"), F.col("source"))).otherwise("assigned_missing")
    observed = seen.select("player", "subject", "frame", kind.alias("kind"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))

    owners = fragments.select("subject", F.col("player").alias("owner"), F.col("start").alias("o_start"), F.col("stop").alias("o_stop"))
    w = ordered(key, "frame")
    far = F.hypot(F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y"))
    hole = seen.withColumn("next", F.lead("frame").over(w)).withColumn("fine", continuous(F.col("next") - F.col("frame"), far, fps))
    hole = hole.where(F.col("fine") & (F.col("next") - F.col("frame") - 1).between(1, round(HOLE * fps)))
    hole = hole.select("player", "subject", F.explode(F.sequence(F.col("frame") + 1, F.col("next") - 1)).alias("frame"))
    taken = points_in(hole, owners, ["subject"], "frame", "o_start", "o_stop", LONG_BRIDGE * fps).where("owner != player").select("player", "subject", "frame").distinct()
    none = F.lit(0.0).alias("confidence")
    holes = hole.join(taken, ["player", "subject", "frame"], "left_anti").select("player", "subject", "frame", F.lit("assignment_short_gap").alias("kind"), none)

    place = lambda f: f(F.struct("frame", "x", "y"))
    # The places that count for a bridge are a fragment's outermost rows, also beyond its interval.
    ends = rows.groupBy(*key).agg(place(F.min).alias("first"), place(F.max).alias("last"))
    f = fragments.join(ends, key, "left")
    w = ordered(["player", "subject"], "start", "stop", "fragment")
    f = f.select("player", "subject", (F.col("stop") + 1).alias("start"), (F.lead("start").over(w) - 1).alias("stop"), F.col("last").alias("l"), F.lead("first").over(w).alias("r"))
    f = f.withColumn("n", F.col("stop") - F.col("start") + 1).where(F.col("n").between(1, round(LONG_BRIDGE * fps)))
    f = f.where(continuous(F.col("r.frame") - F.col("l.frame"), F.hypot(F.col("r.x") - F.col("l.x"), F.col("r.y") - F.col("l.y")), fps)).select("player", "subject", "start", "stop", "n")
    # Closed intervals of frames overlap if the half-open ones do.
    open_ = lambda df, a, b: df.withColumn(b, F.col(b) + 1)
    rival = overlaps(open_(f, "start", "stop"), open_(owners.withColumnsRenamed({"o_start": "start", "o_stop": "stop"}), "start", "stop"), ["subject"], "start", "stop", LONG_BRIDGE * fps)
    rival = rival.where("other_owner != player").select("player", "subject", "start").distinct()
    f = f.join(rival, ["player", "subject", "start"], "left_anti")
    hit = points_in(slots.select("subject", F.col("frame").alias("s_frame")).distinct(), f, ["subject"], "s_frame", "start", "stop", LONG_BRIDGE * fps)
    hit = hit.groupBy("player", "subject", "start", "stop", "n").agg((F.count(F.lit(1)) / F.col("n")).alias("share"))
    short = F.col("n") <= round(BRIDGE * fps)
    hit = hit.where(F.col("share") >= F.when(short, COVERED).otherwise(LONG_COVERED))
    bridges = hit.select("player", "subject", F.explode(F.sequence("start", "stop")).alias("frame"), F.when(short, "same_subject_bridge").otherwise("same_subject_long_bridge").alias("kind"), none)
    return observed.unionByName(holes).unionByName(bridges)


def presence(fragments: DataFrame, rows: DataFrame, slots: DataFrame, teams: DataFrame, fps: float, frames: int | None = None, most: int = 7) -> DataFrame:
    """player, frame, subject, kind: one row for each frame in which a player counts as present; teams (player, team).

    Of a player's reasons in a frame the strongest stays (by kind, confidence, subject); of players who
    share a subject in a frame the strongest; of a team's players in a frame the `most` strongest (team
    U has no limit). frames: the length of the match, later ones are left out.
    """
    x = evidence(fragments, rows, slots, fps).withColumn("rank", ranked(F.col("kind")))
    x = x if frames is None else x.where(F.col("frame") < frames)
    x = x.groupBy("player", "frame").agg(F.max(F.struct("rank", "confidence", "subject", "kind")).alias("e")).select("player", "frame", "e.*")
    x = x.groupBy("subject", "frame").agg(F.max(F.struct("rank", "confidence", "player", "kind")).alias("e")).select("subject", "frame", "e.*")
    x = x.join(teams, "player", "left").withColumn("team", F.coalesce("team", F.lit("U")))
    w = W.partitionBy("team", "frame").orderBy(F.desc("rank"), F.desc("confidence"), F.desc("player"))
    # Rows of team U are dealt out by player; they are never cut.
    free, held = x.where("team = 'U'"), x.where("team != 'U'").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return held.select("player", "frame", "subject", "kind").unionByName(free.select("player", "frame", "subject", "kind"))


def playing_time(present: DataFrame, fps: float) -> DataFrame:
    """Per player: frames, seconds, and frames by kind."""
    n = lambda *kinds: F.count(F.when(F.col("kind").isin(*kinds), 1))
    return present.groupBy("player").agg(
        F.count(F.lit(1)).alias("frames"), (F.count(F.lit(1)) / fps).alias("seconds"), n("assigned_detected").alias("detected"), n("assigned_ambiguous").alias("ambiguous"),
        n("assignment_short_gap").alias("short_gap"), n("same_subject_bridge").alias("bridge"), n("same_subject_long_bridge").alias("long_bridge"),
    )

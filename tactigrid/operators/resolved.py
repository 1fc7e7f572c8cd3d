"""Players' resolved rows from assignments of slots, reviews carried over to new candidates, snapshots with lookups in time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .grouped import listed
from .ranges import points_in
from .sequence import ordered

SOURCES = ("detected", "ambiguous", "predicted", "missing")


def source_rank(source: Column) -> Column:
    """4 for detected, down to 1 for missing, 0 for others."""
    out = F.lit(0)
    for i, s in enumerate(SOURCES):
        out = F.when(source == s, len(SOURCES) - i).otherwise(out)
    return out


class _Continued:
    """Of a frame's rows that rank alike the one nearest to the place before; then the larger assignment."""

    def __init__(self):
        self.place, self.held = None, []

    def pick(self, rows: list[tuple]) -> list[tuple]:
        best = None
        for r in rows:
            at = None if r[2] is None or r[3] is None else (float(r[2]), float(r[3]))
            near = -math.dist(self.place, at) if self.place and at else -1e6
            best = max(best or (near, r[1], r, at), (near, r[1], r, at), key=lambda b: b[:2])
        self.place = best[3] or self.place
        return [(int(best[2][0]), best[2][1])]

    def feed(self, rows: list[tuple]) -> list[tuple]:
        out = []
        for r in rows:
            if self.held and self.held[0][0] != r[0]:
                out += self.pick(self.held)
                self.held = []
            self.held.append(r)
        return out

    def end(self) -> list[tuple]:
        return self.pick(self.held)


def resolved_rows(assignments: DataFrame, rows: DataFrame, most: int = 7, width: float = 256.0) -> DataFrame:
    """player, frame, subject, assignment, source, x, y: at most one row for each player and frame, and for each subject and frame.

    assignments (assignment, subject, player, team, sure, start, stop), rows (subject, frame, source,
    inside, trusted, confidence, x, y; unique in subject and frame). A row counts for all assignments of
    its subject whose frames (both ends included) hold it. The better one has the better source, is inside
    play, is trusted, has the surer assignment, then the surer row; of what a player has left in a frame
    that is as good, the one nearest to where the player was; then the larger assignment. Of a team's
    players (but U's) the `most` best stay in a frame.
    """
    kind = dict(assignments.dtypes)["assignment"]
    r = rows.withColumns({"s_": source_rank(F.col("source")), "i_": F.coalesce("inside", F.lit(True)).cast("int"), "t_": F.coalesce("trusted", F.lit(True)).cast("int"), "c_": F.coalesce("confidence", F.lit(0.0))})
    a = assignments.where("player is not null").withColumn("sure", F.coalesce("sure", F.lit(0.0)))
    x = points_in(r, a, ["subject"], "frame", "start", "stop", width)
    rank = ["s_", "i_", "t_", "sure", "c_"]
    best = lambda *by: W.partitionBy(*by).orderBy(*[F.desc(c) for c in rank], F.desc("assignment"))
    x = x.withColumn("n_", F.row_number().over(best("subject", "frame"))).where("n_ = 1")
    w = W.partitionBy("player", "frame").orderBy(*[F.desc(c) for c in rank])
    x = x.withColumn("n_", F.rank().over(w)).where("n_ = 1").drop("n_")
    taken = listed(x, ["player"], ["frame", "assignment"], ["frame", "assignment", "x", "y"], lambda key: _Continued(), f"frame long, assignment {kind}")
    x = x.join(taken, ["player", "frame", "assignment"], "left_semi").withColumn("team", F.coalesce("team", F.lit("U")))
    free, held = x.where("team = 'U'"), x.where("team != 'U'").withColumn("n_", F.row_number().over(best("team", "frame"))).where(F.col("n_") <= most).drop("n_")
    out = ["player", "frame", "subject", "assignment", "source", "x", "y"]
    return free.select(out).unionByName(held.select(out))


def carried_over(candidates: DataFrame, reviews: DataFrame, id_: str, keys: list[tuple[str, ...]], fields: list[str]) -> DataFrame:
    """candidates with fields, migration (restored, ambiguous_existing_review or null) and matched_by.

    Each takes the fields of the review that has the same first of keys (tuples of columns, in order)
    that any review has. Several such reviews leave the candidate as it is, marked ambiguous. Keys of
    nulls only and empty texts match nothing; a key of several columns matches nulls in some of them.
    """
    said = None
    for n, key in enumerate(keys):
        blank = F.lit(True)
        for c in key:
            blank = blank & (F.col(c).isNull() | (F.col(c).cast("string") == "" if len(key) == 1 else F.lit(False)))
        name = F.when(~blank, F.to_json(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)])))
        r = reviews.select(name.alias("k"), *fields).where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(*fields)).alias("r"))
        hit = candidates.select(id_, name.alias("k")).join(r, "k").select(id_, F.lit(n).alias("order_"), F.lit("+".join(key)).alias("by_"), "n", "r")
        said = hit if said is None else said.unionByName(hit)
    first = said.groupBy(id_).agg(F.min(F.struct("order_", "by_", "n", "r")).alias("m"))
    x = candidates.join(first, id_, "left")
    one = F.col("m.n") == 1
    x = x.withColumns({f: F.when(one, F.col(f"m.r.{f}")).otherwise(F.col(f) if f in candidates.columns else F.lit(None)) for f in fields})
    return x.withColumn("migration", F.when(one, "restored").when(F.col("m.n") > 1, "ambiguous_existing_review")).withColumn("matched_by", F.col("m.by_")).drop("m")


def snapshot(df: DataFrame, key: list[str], semantic: list[str]) -> DataFrame:
    """df with digest, a hash of the semantic columns by name: rows that differ in other columns only (times, notes) have the same."""
    return df.withColumn("digest", F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted([*key, *semantic])]), {"ignoreNullFields": "false"}), 256))


def changed(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """key and change (added, removed, changed) between two snapshots; rows of equal digests are left out."""
    a, b = (x.select(*key, F.col("digest").alias(n)) for x, n in ((before, "old"), (after, "new")))
    x = a.join(b, key, "full").where(~F.col("old").eqNullSafe(F.col("new")))
    return x.select(*key, F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change"))


def as_of(points: DataFrame, versions: DataFrame, key: list[str], t: str, since: str, columns: list[str]) -> DataFrame:
    """points with the columns of the version (key, since, columns) that held at their time: the last one whose since is at or before it; null before the first. Of versions of one time the largest by columns counts.

    Both sides are merged into one series for each key, so there is no join and no pairs.
    """
    v = versions.groupBy(*key, since).agg(F.max(F.struct(*columns)).alias("v_")).select(*key, F.col(since).alias("t_"), "v_", F.lit(0).alias("own_"))
    p = points.withColumn("row_", F.struct(*points.columns)).select(*key, F.col(t).alias("t_"), "row_", F.lit(1).alias("own_"))
    both = p.unionByName(v, allowMissingColumns=True)
    x = both.withColumn("at_", F.last("v_", ignorenulls=True).over(ordered(key, "t_", "own_").rowsBetween(W.unboundedPreceding, 0))).where("own_ = 1")
    return x.select("row_.*", *[F.col(f"at_.{c}").alias(c) for c in columns])

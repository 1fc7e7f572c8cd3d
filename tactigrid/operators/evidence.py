"""Rules over evidence: classifiers by reasons, majority votes, costs of pairs, chunks with overlap, runs of one owner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ranges import points_in
from .sequence import ordered


def by_reasons(reject: list[Column], accept: list[Column], uncertain: list[Column], accepts: int = 5, doubts: int = 3) -> Column:
    """rejected if any reject reason holds, accepted from so many accept reasons on, uncertain from so many doubts on, else needs_review; nulls do not hold."""
    n = lambda cs: sum((F.when(c, 1).otherwise(0) for c in cs), F.lit(0))
    return F.when(n(reject) > 0, "rejected").when(n(accept) >= accepts, "accepted").when(n(uncertain) >= doubts, "uncertain").otherwise("needs_review")


def majority(reads: DataFrame, subject: list[str], episode: str, value: str, score: str, tie: str, support: int = 3) -> DataFrame:
    """Per subject the value that most episodes' best reads have: value, votes, confidence = mean score * min(1, votes / support) up to 0.75; conflict if another has as many, weak below the support."""
    best = reads.groupBy(*subject, episode).agg(F.max(F.struct(F.col(score).alias("s"), F.col(tie).alias("t"), F.col(value).alias("v"))).alias("r"))
    votes = best.groupBy(*subject, F.col("r.v").alias(value)).agg(F.count(F.lit(1)).alias("votes"), F.avg("r.s").alias("mean"))
    w = W.partitionBy(*subject)
    votes = votes.withColumn("top", F.max("votes").over(w)).where("votes = top").withColumn("tops", F.count(F.lit(1)).over(w))
    x = votes.groupBy(*subject).agg(F.min(value).alias(value), F.max("votes").alias("votes"), F.max("tops").alias("tops"), F.max("mean").alias("mean"))
    state = F.when(F.col("tops") > 1, "conflict").when(F.col("votes") < support, "weak").otherwise("confirmed")
    confidence = F.least(F.lit(0.75), F.col("mean") * F.least(F.lit(1.0), F.col("votes") / support))
    return x.select(*subject, F.when(F.col("tops") == 1, F.col(value)).alias(value), "votes", state.alias("state"), confidence.alias("confidence"))


def successors(df: DataFrame, entity: list[str], t: str, id_: str, value: str, most: float, far: float) -> DataFrame:
    """(entity, id, next, cost, state): each row's cheapest later row at most `most` later and `far` away; cost = 0.4 gap / most + 0.6 distance / far, ties by id; recommended at 0.48 or less."""
    later = df.select(*entity, F.col(t).alias("t_"), F.col(value).alias("v_"), F.col(id_).alias("next"))
    spans = df.select(*entity, F.col(id_), F.col(t), F.col(value), (F.col(t) + most).alias("to_"))
    x = points_in(later, spans, entity, "t_", t, "to_", most).where((F.col("t_") > F.col(t)) & (F.abs(F.col("v_") - F.col(value)) <= far))
    cost = F.round(0.4 * (F.col("t_") - F.col(t)) / most + 0.6 * F.abs(F.col("v_") - F.col(value)) / far, 6)
    best = x.groupBy(*entity, id_).agg(F.min(F.struct(cost.alias("cost"), "next")).alias("r"))
    return best.select(*entity, id_, F.col("r.next").alias("next"), F.col("r.cost").alias("cost"), F.when(F.col("r.cost") <= 0.48, "recommended").otherwise("alternative").alias("state"))


def chunked(df: DataFrame, t: str, length: float, overlap: float) -> DataFrame:
    """Each row with each chunk [k * length, (k + 1) * length + overlap] that reads it."""
    k = F.floor(F.col(t) / length).cast("long")
    again = (k > 0) & (F.col(t) - k * length <= overlap)
    return df.withColumn("chunk", F.explode(F.when(again, F.array(k - 1, k)).otherwise(F.array(k))))


def merged_chunks(chunks: DataFrame, t: str, length: float, overlap: float) -> DataFrame:
    """Rows of chunks without those that the chunk before has read too, those up to its end."""
    before_end = F.col("chunk") * length + overlap
    return chunks.where((F.col("chunk") == 0) | (F.col(t) > before_end))


def long_segments(df: DataFrame, entity: list[str], t: str, tie: str, gap: float, rows: int, seconds: float) -> DataFrame:
    """Rows of segments (no gap larger than gap) that have so many rows and last so long."""
    w = ordered(entity, t, tie)
    x = df.withColumn("starts_", F.coalesce(F.col(t) - F.lag(t).over(w) > gap, F.lit(False)).cast("int"))
    x = x.withColumn("segment_", F.sum("starts_").over(w.rowsBetween(W.unboundedPreceding, 0)))
    s = W.partitionBy(*entity, "segment_")
    x = x.withColumn("n_", F.count(F.lit(1)).over(s)).withColumn("long_", F.max(t).over(s) - F.min(t).over(s))
    return x.where((F.col("n_") >= rows) & (F.col("long_") >= seconds)).drop("starts_", "segment_", "n_", "long_")


def owner_runs(df: DataFrame, sequence: list[str], t: str, tie: str, owner: str, gap: float) -> DataFrame:
    """Runs of one owner in a sequence: a gap up to `gap` in which no other owner has a row is bridged: sequence, owner, start, stop, n."""
    w = ordered(sequence, t, tie)
    same = F.lag(owner).over(w).eqNullSafe(F.col(owner)) & (F.col(t) - F.lag(t).over(w) <= gap)
    x = df.withColumn("starts_", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    x = x.withColumn("run_", F.sum("starts_").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy(*sequence, "run_", owner).agg(F.min(t).alias("start"), F.max(t).alias("stop"), F.count(F.lit(1)).alias("n")).drop("run_")

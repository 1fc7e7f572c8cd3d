"""Lookups, memberships, conflicts and pairs within frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def claims(df: DataFrame, key: list[str], claimant: str, priority: str) -> DataFrame:
    """df with verdict: of the claims on a key the only one of the highest priority wins; if several have it, all are demoted; single if it is the only claim."""
    w = W.partitionBy(*key)
    x = df.withColumn("top_", F.max(priority).over(w)).withColumn("n_", F.count(F.lit(1)).over(w))
    x = x.withColumn("tops_", F.count(F.when(F.col(priority) == F.col("top_"), 1)).over(w))
    verdict = F.when(F.col("n_") == 1, "single").when(F.col("tops_") > 1, "demoted").when(F.col(priority) == F.col("top_"), "winner").otherwise("loser")
    return x.withColumn("verdict", verdict).drop("top_", "n_", "tops_")


def pairs_in_frame(df: DataFrame, frame: str, id_: str, columns: list[str]) -> DataFrame:
    """Pairs a < b of a frame's rows, with the columns of both (suffixes _a, _b). A frame holds the players of a pitch."""
    side = lambda s: df.select(frame, *[F.col(c).alias(f"{c}_{s}") for c in [id_, *columns]])
    return side("a").join(side("b"), frame).where(F.col(f"{id_}_a") < F.col(f"{id_}_b"))


def upsert(base: DataFrame, reviews: DataFrame, key: str, field: str, allowed: list[str], default: str) -> DataFrame:
    """base with field from the reviews, else its own; values not allowed become the default. Of repeated reviews of a key the largest value counts."""
    r = reviews.groupBy(key).agg(F.max(field).alias("review_"))
    x = base.join(r, key, "left").withColumn(field, F.coalesce("review_", field)).drop("review_")
    return x.withColumn(field, F.when(F.col(field).isin(allowed), F.col(field)).otherwise(F.lit(default)))


def validated(candidate: DataFrame, baseline: DataFrame, key: str, value: str, most: float) -> DataFrame:
    """candidate with baseline_value and state: production_baseline_unavailable, ready, or ready_with_review if it differs by more than the share `most`."""
    x = candidate.join(baseline.select(key, F.col(value).alias("baseline_value")), key, "left")
    far = F.abs(F.col(value) - F.col("baseline_value")) > most * F.abs("baseline_value")
    return x.withColumn("state", F.when(F.col("baseline_value").isNull(), "production_baseline_unavailable").when(far, "ready_with_review").otherwise("ready"))

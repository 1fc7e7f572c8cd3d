"""Two groups of feature vectors by weighted two-means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def two_means(df: DataFrame, id_: str, features: str, weight: str, rounds: int = 12, tolerance: float = 0.5) -> tuple[DataFrame, list[list[float]]]:
    """df with cluster (0 or 1) and margin, and the two centres.

    The first centre is the heaviest row (the smaller id on a tie), the second the row whose distance
    from it times its weight is the largest. Rows go to the nearer centre, 0 on a tie; centres become
    their rows' weighted means until neither moves by the tolerance, at most `rounds` times. margin is
    the share of the distances' difference in their sum. Rows without features have neither; rows
    without weight weigh nothing. Each round is one grouped sum; two centres are all that leaves it.
    """
    x = df.where(F.col(features).isNotNull()).select(F.col(id_).alias("id_"), F.transform(features, lambda v: v.cast("double")).alias("f_"), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("w_"))
    lit = lambda c: F.array(*[F.lit(float(v)) for v in c])
    first = x.agg(F.min(F.struct((-F.col("w_")).alias("w"), F.col("id_").alias("i"), F.col("f_").alias("f")))["f"]).first()[0]
    if first is None:
        return df.withColumn("cluster", F.lit(None).cast("int")).withColumn("margin", F.lit(None).cast("double")), []
    second = x.agg(F.min(F.struct((-distance(F.col("f_"), lit(first)) * F.col("w_")).alias("w"), F.col("id_").alias("i"), F.col("f_").alias("f")))["f"]).first()[0]
    centres, n = [list(first), list(second)], len(first)
    for _ in range(rounds):
        near = x.withColumn("k_", F.when(distance(F.col("f_"), lit(centres[0])) <= distance(F.col("f_"), lit(centres[1])), 0).otherwise(1))
        sums = near.groupBy("k_").agg(F.sum("w_").alias("w"), *[F.sum(F.col("f_")[i] * F.col("w_")).alias(f"s{i}") for i in range(n)])
        new = list(centres)
        for r in sums.collect():
            new[r["k_"]] = [r[f"s{i}"] / max(r["w"], 0.001) for i in range(n)]
        still = all(sum((a - b) ** 2 for a, b in zip(centres[k], new[k], strict=True)) ** 0.5 < tolerance for k in range(2))
        centres = new
        if still:
            break
    f = F.transform(features, lambda v: v.cast("double"))
    a, b = distance(f, lit(centres[0])), distance(f, lit(centres[1]))
    out = df.withColumn("cluster", F.when(F.col(features).isNotNull(), F.when(a <= b, 0).otherwise(1)))
    return out.withColumn("margin", F.when(F.col(features).isNotNull(), F.coalesce(F.try_divide(F.abs(a - b), a + b), F.lit(0.0)))), centres

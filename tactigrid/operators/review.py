"""Review overlays: updates and layers of overrides over base rows, membership differences, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of each key by order (descending columns first)."""
    return df.withColumn("rank_", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("rank_ = 1").drop("rank_")


def overlay(base: DataFrame, layers: list[DataFrame], key: list[str], fields: list[str]) -> DataFrame:
    """base with the fields of the highest layer that has the row's key; a null in a layer overrides too.

    Of a layer's rows with the same key the largest by fields counts (the last in their order); use
    latest() first where an order of time should decide. Null keys match nothing.
    """
    out = base
    for i, layer in enumerate(layers):
        one = layer.groupBy(*key).agg(F.max(F.struct(*fields)).alias("r_"))
        side = one.select(*key, *[F.col(f"r_.{f}").alias(f"{f}_{i}") for f in fields], F.lit(True).alias(f"hit_{i}"))
        out = out.join(side, key, "left")
        for f in fields:
            out = out.withColumn(f, F.when(F.col(f"hit_{i}"), F.col(f"{f}_{i}")).otherwise(F.col(f)))
        out = out.drop(f"hit_{i}", *[f"{f}_{i}" for f in fields])
    return out


def owners(df: DataFrame, key: list[str], owner: str) -> DataFrame:
    """Keys that more than one owner claims: key, n_owners, least owner."""
    return df.groupBy(*key).agg(F.count_distinct(owner).alias("n_owners"), F.min(owner).alias("least_owner")).where("n_owners > 1")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one of two sets only, with side."""
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def first_reason(reasons: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first condition that holds."""
    out = F.lit(otherwise)
    for name, condition in reversed(reasons):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def required(n: Column, target: str) -> Column:
    """The exact ceiling of n * target, in decimals."""
    return F.ceil(n.cast("decimal(20,0)") * F.lit(target).cast("decimal(10,6)")).cast("long")

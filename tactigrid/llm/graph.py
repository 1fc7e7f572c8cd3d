"""Connected components of an edge table, by rounds of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def signature(x: DataFrame) -> tuple:
    """Of a set of edges: its size and the XOR and sum of their hashes; equal for equal sets."""
    h = F.xxhash64("a", "b")
    return tuple(x.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs: (node, component), the smallest node reachable; nodes without edge are left out.

    Alternating large-star and small-star steps: each links nodes to the smallest of their
    neighbourhood, so the number of rounds grows with the logarithm of a component's size. A node's
    neighbours are only ever reduced to their minimum, never gathered.
    """
    x = store.table(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    before = signature(x)
    while before[0]:
        both = x.select("a", "b").unionAll(x.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: larger neighbours go to the least of the neighbourhood
        large = x.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least.withColumnRenamed("a", "u"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        # small star: each node and its smaller neighbours go to the least of these
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionAll(low.select("a", F.col("m").alias("b"))).distinct()
        x = store.table(small, "components")
        after = signature(x)
        if after == before:
            break
        before = after
    return x.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(x.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

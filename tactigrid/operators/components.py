"""Connected components of a table of edges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactigrid.sources.tables import remove, shared_dir, written


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) as (node, component): the smallest node that each node reaches; edges with a null or with one node are left out.

    Rounds of two steps on edges that point from the larger to the smaller node: each node's larger
    neighbours are moved to its smallest one, then its smaller neighbours are. Neighbourhoods are only
    ever reduced to a minimum, so a node of many edges needs no room; the rounds grow with the logarithm
    of the longest chain. A round's table replaces the one before.
    """
    spark, folder = edges.sparkSession, f"{shared_dir(edges.sparkSession)}/components-{uuid.uuid4().hex}"
    down = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    at, before, n = "", None, 0
    while True:
        path = f"{folder}/{n}"
        down = written(down, path)
        if at:
            remove(spark, at)
        at, n = path, n + 1
        h = F.xxhash64("a", "b")
        now = down.agg(F.count(F.lit(1)), F.bit_xor(h), F.bit_xor(F.xxhash64(h, F.lit(1)))).first()
        if now == before or not now[0]:
            break
        before = now
        ends = down.select("a", "b").unionAll(down.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hub = ends.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("b"), F.least("a", "least").alias("hub"))
        down = down.join(hub, "b").where("a != hub").select("a", F.col("hub").alias("b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("hub"))
        moved = down.join(low, "a").where("b != hub").select(F.col("b").alias("a"), F.col("hub").alias("b"))
        down = moved.unionAll(low.select("a", F.col("hub").alias("b"))).distinct()
    roots = down.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return down.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)

"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source's documents are dealt to shards by a seeded hash, and laid end to end within a shard in
seeded order. A shard's line of words is cut into blocks of BLOCK words. Blocks go to sources by
highest quotients target / (2 k + 1), then to each source's shards by their sizes in the same way.
A shard takes all its blocks as often as its quota says, and the rest of the quota from a seeded
place on, around the end of the line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import store

#: Words of a block.
BLOCK = 32
#: Words of a shard, about.
SHARD = 500_000
#: Weights of the sources in order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
SEED = 20_240
#: Rows of a side that is sent to every task; a larger side is shuffled.
BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple = WEIGHTS) -> DataFrame:
    """sizes (source, source_size) with target: share of all sizes by weight; a target stops at cap times its source's size and the excess is dealt again by weight.

    The fixed point: target = min(cap * size, level * weight) for one level. With the sources in
    order of size / weight, a prefix is capped, and sums over the order give the level.
    """
    every, seq = W.partitionBy(), W.orderBy(F.col("source").asc_nulls_last())
    x = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(seq) - 1) % len(weights) + 1))
    x = x.withColumn("most", F.col("source_size") * cap).withColumn("at", F.col("most") / F.col("weight"))
    upto = W.orderBy("at", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("capped", F.coalesce(F.sum("most").over(upto), F.lit(0.0))).withColumn("free", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    x = x.withColumn("level", (share * F.sum("source_size").over(every) - F.col("capped")) / F.col("free"))
    x = x.withColumn("level", F.min(F.when(F.col("at") > F.col("level"), F.struct("at", "level"))).over(every)["level"])
    return x.withColumn("target", F.coalesce(F.least("most", F.col("level") * F.col("weight")), F.col("most"))).select("source", "source_size", "target")


def apportion(claims: DataFrame, group: list[str], seats: Column, order: list) -> DataFrame:
    """claims (claim, limit) with quota: the group's seats by highest quotients claim / (2 k + 1), at most limit each; ties by order.

    A seat number that every divisor near the fair one gives for sure is given at once, so few
    quotients per claim are ranked, at any number of seats.
    """
    g = W.partitionBy(*group)
    x = claims.withColumn("seats", seats).withColumn("all", F.sum("claim").over(g)).withColumn("parts", F.count(F.lit(1)).over(g))
    x = x.withColumn("fair", F.when(F.col("all") > 0, F.col("seats") * F.col("claim") / F.col("all")).otherwise(0.0))
    slack = F.col("fair") * F.col("parts") / (2 * F.greatest(F.col("seats"), F.lit(1)))
    x = x.withColumn("sure", F.least(F.col("limit"), F.greatest(F.lit(0), F.floor(F.col("fair") - slack - 1))).cast("long"))
    x = x.withColumn("room", F.least(F.col("limit") - F.col("sure"), F.ceil(2 * slack + 3)).cast("int"))
    x = x.withColumn("left", F.col("seats") - F.sum("sure").over(g))
    k = F.explode_outer(F.when(F.col("room") > 0, F.sequence(F.lit(0), F.col("room") - 1))).alias("k")
    tried = x.select("*", k).withColumn("quotient", F.col("claim") / (2 * (F.col("sure") + F.col("k")) + 1))
    tried = tried.withColumn("won", F.col("k").isNotNull() & (F.row_number().over(g.orderBy(F.col("quotient").desc_nulls_last(), *order, "k")) <= F.col("left")))
    return tried.groupBy(*claims.columns).agg((F.first("sure") + F.sum(F.col("won").cast("long"))).alias("quota"))


def mix(docs: DataFrame, seed: int = SEED, block: int = BLOCK, shard: int = SHARD, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row of docs (doc_id, source, text): doc_id, source, size, source_size, target, taken, times, extra_from, extra.

    The mix takes all the row's words times times, and extra words from the extra_from-th on (around
    its end) once more. Columns of keep come too. A null text has no words and is taken 0 times; a null source is one more
    source, the last. A repeated row is laid on the line as often as it stands there. Further columns
    are ignored; an empty table gives an empty table. Reruns agree: order and places come from hashes
    of (seed, doc_id, text), and rows that tie are alike. Only ids and sizes are shuffled.
    """
    place = F.xxhash64(F.lit(seed), "doc_id", "text")
    sized = store.table(docs.select("doc_id", "source", words(F.col("text")).alias("size"), place.alias("place"), *keep), "mix-sizes")
    goal = store.table(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    few = goal.count() <= BROADCAST_ROWS
    small = (F.broadcast(goal) if few else goal).withColumnRenamed("source", "s")
    dealt = sized.join(small, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "place"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard))))
    lines = dealt.groupBy("source", "target", "shard").agg(F.sum("size").alias("claim"))
    lines = store.table(lines.withColumn("blocks", F.ceil(F.col("claim") / block)).where("blocks > 0"), "mix-shards")

    sources = lines.groupBy("source", "target").agg((CAP * F.sum("blocks")).cast("long").alias("limit")).withColumnRenamed("target", "claim").withColumn("all_", F.lit(0))
    total = F.round(F.sum("claim").over(W.partitionBy("all_")) / block).cast("long")
    by_source = apportion(sources, ["all_"], total, [F.col("source").asc_nulls_last()]).select("source", F.col("claim").alias("t"), F.col("quota").alias("granted"))
    by_source = by_source.withColumnRenamed("source", "s").drop("t")
    claims = lines.withColumn("limit", (CAP * F.col("blocks")).cast("long")).join(F.broadcast(by_source) if few else by_source, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    quotas = apportion(claims, ["source"], F.col("granted"), ["shard"])
    quotas = quotas.select(F.col("source").alias("qs"), F.col("shard").alias("qh"), F.col("claim").alias("line"), F.floor(F.col("quota") / F.col("blocks")).alias("times"), (F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.col("blocks")) * block).alias("from"), (F.col("quota") % F.col("blocks") * block).alias("more"))
    quotas = store.table(quotas, "mix-quotas")
    fits = quotas.count() <= BROADCAST_ROWS
    x = dealt.join(F.broadcast(quotas) if fits else quotas, F.col("source").eqNullSafe(F.col("qs")) & (F.col("shard") == F.col("qh")), "left")
    line = W.partitionBy("source", "shard").orderBy("place", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("begin", F.coalesce(F.sum("size").over(line), F.lit(0)))
    stop, end = F.col("from") + F.col("more"), F.col("begin") + F.col("size")
    overlap = lambda a, b: F.greatest(F.lit(0), F.least(end, b) - F.greatest(F.col("begin"), a))
    first = overlap(F.col("from"), F.least(stop, F.col("line")))
    around = overlap(F.lit(0), stop - F.ceil(F.col("line") / block) * block)
    x = x.withColumn("extra", F.coalesce(first + around, F.lit(0))).withColumn("extra_from", F.when(first > 0, F.greatest(F.lit(0), F.col("from") - F.col("begin"))).otherwise(F.lit(0)))
    x = x.withColumn("taken", (F.col("size") * F.coalesce("times", F.lit(0)) + F.col("extra")).cast("long"))
    return x.select("doc_id", "source", "size", "source_size", "target", "taken", F.coalesce("times", F.lit(0)).alias("times"), "extra_from", "extra", *keep)

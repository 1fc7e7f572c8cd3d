"""Greedy maximum coverage: units ranked by what each adds to the (subject, frame) pairs covered so far."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import components
from .grouped import whole


def lazy_greedy(atoms: list[tuple[list, int]], rest: dict) -> list[tuple]:
    """(unit, gain) in greedy order: atoms are (units that cover it, weight); rest gives each unit's order among equal gains. Units that add nothing are left out.

    Gains only fall, so a unit's last known gain bounds it: the top of the heap is counted anew, and if
    it stays on top it is the best of all.
    """
    of = defaultdict(list)
    for k, (units, _) in enumerate(atoms):
        for u in units:
            of[u].append(k)
    gain = {u: sum(atoms[k][1] for k in at) for u, at in of.items()}
    covered = [False] * len(atoms)
    heap = [(-g, rest[u], u) for u, g in gain.items()]
    heapq.heapify(heap)
    out = []
    while heap:
        g, r, u = heapq.heappop(heap)
        now = sum(atoms[k][1] for k in of[u] if not covered[k])
        if not now:
            continue
        if now < -g:
            heapq.heappush(heap, (-now, r, u))
            continue
        for k in of[u]:
            covered[k] = True
        out.append((u, now))
    return out


def ranked(pairs: DataFrame, units: DataFrame, group: list[str], unit: str, pair: list[str], covered: DataFrame | None = None) -> DataFrame:
    """group, unit, rank, gain, cumulative: the greedy order of each group's units by pairs not covered yet.

    pairs (group, unit, pair); units (group, unit, detected_sec, start_frame): equal gains go to the
    longer evidence, then the earlier start, then the smaller unit (as text). covered (group, pair) is
    covered from the start. Units that add nothing have no row; repeated pairs count once.

    Pairs of the same units become one weighted atom. Units that share no pair, through whatever others,
    do not change each other's gains, so each connected part is ranked in a task of its own, and the
    group's order is that of (gain, tie) over all parts.
    """
    x = pairs.select(*group, unit, *pair).dropDuplicates()
    if covered is not None:
        x = x.join(covered.select(*group, *pair), [*group, *pair], "left_anti")
    tie = units.select(*group, unit, F.coalesce(F.col("detected_sec").cast("double"), F.lit(0.0)).alias("sec_"), F.coalesce(F.col("start_frame").cast("long"), F.lit(0)).alias("start_"))
    name = F.to_json(F.struct(*group, unit))
    atoms = x.withColumn("node_", name).groupBy(*group, *pair).agg(F.sort_array(F.collect_set("node_")).alias("units_")).groupBy("units_").agg(F.count(F.lit(1)).alias("weight_"))
    chain = F.explode(F.transform(F.slice("units_", F.lit(2), F.greatest(F.size("units_") - 1, F.lit(0))), lambda u: F.struct(F.col("units_")[0].alias("a"), u.alias("b"))))
    parts = components(atoms.select(chain.alias("e")).select("e.*")).withColumnRenamed("component", "part_")
    first = atoms.withColumn("node", F.col("units_")[0])
    first = first.join(parts, "node", "left").withColumn("part_", F.coalesce("part_", "node")).select("part_", F.to_json("units_").alias("units_"), "weight_")
    order = tie.withColumn("node", name).join(parts, "node", "left").select(F.coalesce("part_", "node").alias("part_"), "node", "sec_", "start_", F.col(unit).cast("string").alias("id_"))
    both = first.unionByName(order, allowMissingColumns=True)

    def work(b: pd.DataFrame) -> list[tuple]:
        import json

        at = b[b["units_"].notna()]
        rest = {r.node: (-r.sec_, int(r.start_), r.id_) for r in b[b["units_"].isna()].itertuples()}
        return lazy_greedy([(json.loads(u), int(w)) for u, w in zip(at["units_"], at["weight_"], strict=True)], defaultdict(lambda: (0.0, 0, ""), rest))

    gains = whole(both, ["part_"], ["weight_", "units_", "node"], work, "node string, gain long").drop("part_")
    x = tie.withColumn("node", name).join(gains, "node")
    w = W.partitionBy(*group).orderBy(F.desc("gain"), F.desc("sec_"), "start_", F.col(unit).cast("string"))
    return x.select(*group, unit, F.row_number().over(w).alias("rank"), "gain", F.sum("gain").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("cumulative"))


def required(ranks: DataFrame, group: list[str], needed: DataFrame) -> DataFrame:
    """The first of ranked()'s rows whose gains reach needed (group, required); none where nothing is required, all where they fall short."""
    x = ranks.join(needed.select(*group, "required"), group)
    return x.where(F.col("cumulative") - F.col("gain") < F.col("required")).drop("required")

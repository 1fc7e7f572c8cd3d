"""Tracklets linked to players in order of time, and links accepted one after another under constraints."""

from __future__ import annotations

import bisect
import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tactigrid.sources.tables import shared_dir, written

from .components import components
from .grouped import listed
from .sequence import ordered


class _Chains:
    """Players whose last tracklet a later one may still follow; the others are let go."""

    def __init__(self, gap: float, speed: float, far: float):
        self.gap, self.speed, self.far, self.n = gap, speed, far, 0
        self.live: list[dict] = []

    def score(self, p: dict, r: dict) -> float | None:
        gap = r["start"] - p["stop"]
        if gap <= -0.05 or gap > self.gap or p["place"] is None or r["first"] is None:
            return None
        d = math.dist(p["place"], r["first"])
        if d > self.far or d / max(gap, 0.4) > self.speed:
            return None
        if "U" not in (p["team"], r["team"]) and p["team"] != r["team"]:
            return None
        colour = min(1.0, math.dist(p["rgb"], r["rgb"]) / 180.0) if p["rgb"] and r["rgb"] else 0.35
        return round(d + gap * 1.2 + colour * 4.0, 4)

    def feed(self, rows: list[tuple]) -> list[tuple]:
        out = []
        pair = lambda *v: None if any(c is None for c in v) else [float(c) for c in v]
        for i, start, stop, x0, y0, x1, y1, team, red, green, blue in rows:
            r = {"start": start, "stop": stop, "first": pair(x0, y0), "last": pair(x1, y1), "team": team or "U", "rgb": pair(red, green, blue)}
            self.live = [p for p in self.live if start - p["stop"] <= self.gap]
            scored = [(s, p["n"]) for p in self.live if (s := self.score(p, r)) is not None]
            if not scored:
                self.n += 1
                self.live.append({"n": self.n, "stop": stop, "place": r["last"], "team": r["team"], "rgb": r["rgb"], "count": 1})
                out.append((i, self.n, None))
                continue
            s, n = min(scored)
            p = next(p for p in self.live if p["n"] == n)
            p["count"] += 1
            p["stop"], p["place"] = max(p["stop"], stop), r["last"] or p["place"]
            if p["rgb"] and r["rgb"]:
                p["rgb"] = [round((a * (p["count"] - 1) + b) / p["count"], 2) for a, b in zip(p["rgb"], r["rgb"], strict=True)]
            p["rgb"] = p["rgb"] or r["rgb"]
            p["team"] = r["team"] if p["team"] == "U" else p["team"]
            out.append((i, n, s))
        return out

    def end(self) -> list[tuple]:
        return []


COLUMNS = ["id", "start", "stop", "x0", "y0", "x1", "y1", "team", "red", "green", "blue"]


def chained(tracklets: DataFrame, sequence: list[str], gap: float = 3.0, speed: float = 9.5, far: float = 12.0) -> DataFrame:
    """sequence, id, player, score of tracklets (sequence and COLUMNS): each, by start and then the longer first, follows the player of the lowest score, or begins a player of its own (score null).

    A player's last tracklet ends at most gap seconds before, within far metres and this speed, and is
    not of another team (U and null are any). score = metres + 1.2 seconds + 4 times the colours'
    distance (over 180, up to 1; 0.35 where one lacks); on a tie the older player. A sequence is cut
    where nothing is there for longer than gap; players are numbered on across the pieces.
    """
    kind = dict(tracklets.dtypes)["id"]
    known = tracklets.where("start is not null and stop is not null").withColumn("long_", F.col("start") - F.col("stop"))
    w = ordered(sequence, "start", "long_", "id")
    before = F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1))
    cut = known.withColumn("piece", F.sum(F.when(F.col("start") - before <= gap, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    found = listed(cut, [*sequence, "piece"], ["start", "long_", "id"], COLUMNS, lambda key: _Chains(gap, speed, far), f"id {kind}, player long, score double")
    born = found.groupBy(*sequence, "piece").agg(F.max("player").alias("born"))
    first = F.coalesce(F.sum("born").over(ordered(sequence, "piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    born = born.withColumn("first", first).drop("born")
    return found.join(born, [*sequence, "piece"]).select(*sequence, "id", (F.col("player") + F.col("first")).alias("player"), "score")


class _Accepting:
    """Takes links (key, source, target, start and stop of both) in order and says why each is refused; accepted ones have no reason.

    A link is refused if its source has a successor or its target a predecessor already, if both are of
    one chain, or if members of the two chains overlap in time. Holds the chains, not the links: a
    chain's spans are apart, so they are kept sorted; those that end before they begin are kept beside.
    """

    def __init__(self) -> None:
        self.after: set = set()
        self.before: set = set()
        self.up: dict = {}
        self.chain: dict = {}  # of a chain's name: its starts, its stops, its odd spans

    def name(self, t: object, start: float, stop: float) -> object:
        if t not in self.up:
            self.up[t] = t
            self.chain[t] = ([start], [stop], []) if start <= stop else ([], [], [(start, stop)])
        while self.up[t] != t:
            self.up[t] = t = self.up[self.up[t]]
        return t

    def overlap(self, few: tuple, many: tuple) -> bool:
        starts, stops, odd = many
        if odd or few[2]:
            spans = lambda c: [*zip(c[0], c[1], strict=True), *c[2]]
            return any(a <= d and c <= b for a, b in spans(few) for c, d in spans(many))
        at = ((bisect.bisect_left(stops, a), b) for a, b in zip(few[0], few[1], strict=True))
        return any(i < len(starts) and starts[i] <= b for i, b in at)

    def feed(self, rows: list[tuple]) -> list[tuple]:
        out = []
        for key, a, b, *spans in rows:
            reason = "self_link" if a == b else "source_successor_already_assigned" if a in self.after else "target_predecessor_already_assigned" if b in self.before else None
            if reason is None:
                x, y = self.name(a, *spans[:2]), self.name(b, *spans[2:])
                small, large = sorted((x, y), key=lambda n: len(self.chain[n][0]))
                if x == y:
                    reason = "cycle_or_duplicate_link"
                elif self.overlap(self.chain[small], self.chain[large]):
                    reason = "component_temporal_conflict"
                else:
                    self.after.add(a)
                    self.before.add(b)
                    self.up[small] = large
                    starts, stops, odd = self.chain.pop(small)
                    for start, stop in zip(starts, stops, strict=True):
                        i = bisect.bisect_left(self.chain[large][0], start)
                        self.chain[large][0].insert(i, start)
                        self.chain[large][1].insert(i, stop)
                    self.chain[large][2].extend(odd)
            out.append((key, reason))
        return out

    def end(self) -> list[tuple]:
        return []


LINK = ["source", "target", "cost", "key"]


def _mutual(links: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Links that are accepted because no link is before them at either end, round after round, and the links that are still open when a round settles less than a tenth."""
    live, taken, n = links, links.select(LINK).limit(0), 0
    open_ = live.count()
    while open_:
        first = lambda c: live.groupBy(c).agg(F.min(F.struct("cost", "key")).alias("r")).select(c, F.col("r.key").alias("key"))  # noqa: B023, E731
        best = first("source").join(first("target"), "key").select("source", "target", "key")
        best = written(best.join(live.select("key", "cost"), "key").select(LINK), f"{folder}/taken-{n}")
        taken = taken.unionByName(best)
        live = live.join(best.select("source"), "source", "left_anti").join(best.select("target"), "target", "left_anti")
        live, before, n = written(live, f"{folder}/open-{n}"), open_, n + 1
        open_ = live.count()
        if (before - open_) * 10 < before:
            break
    return taken, live


def accepted(links: DataFrame, tracklets: DataFrame, gap: float = 3.0, most: int = 20_000) -> DataFrame:
    """links (key, source, target, cost) with reason: null for accepted ones, which leave chains of tracklets (id, start, stop, team) that never overlap.

    Refused at once: an end that is no tracklet, targets that begin before their source has ended, gaps
    above gap, different known teams. The rest are taken in order of cost and key within each connected
    component, which is fed to a task that holds its chains. Ids of tracklets and keys of links are unique.

    In components of more than `most` links rounds over the whole table come first. A target begins after
    its source has ended, so where no tracklet ends before it begins, a chain's end and another's start
    that may be linked never make an overlap or a cycle: a link that is the first at both ends is accepted,
    and the others there are refused. What rounds leave open is fed to tasks like the rest.
    """
    kinds = dict(links.dtypes)
    t = lambda side: tracklets.select(F.col("id").alias(side), F.col("start").alias(f"{side}_start"), F.col("stop").alias(f"{side}_stop"), F.coalesce("team", F.lit("U")).alias(f"{side}_team"))
    x = links.select("key", "source", "target", "cost").join(t("source"), "source", "left").join(t("target"), "target", "left")
    apart = (F.col("source_team") != F.col("target_team")) & F.col("source_team").isin("A", "B") & F.col("target_team").isin("A", "B")
    wait = F.col("target_start") - F.col("source_stop")
    early = F.when(F.col("source_start").isNull() | F.col("target_start").isNull(), "ineligible_or_missing_tracklet").when(wait <= 0, "temporal_overlap").when(wait > gap, "gap_too_large").when(apart, "team_mismatch")
    x = x.withColumn("early", early)
    able = x.where("early is null")
    of = components(able.select(F.col("source").alias("a"), F.col("target").alias("b"))).withColumnRenamed("node", "source")
    able = able.join(of, "source")
    ends = [f"{side}_{end}" for side in ("source", "target") for end in ("start", "stop")]
    a, b, c, d = (F.col(e).cast("double") for e in ends)
    odd = ~F.coalesce((a <= b) & (c <= d) & ~F.isnan(b) & ~F.isnan(d), F.lit(False))
    folder = f"{shared_dir(links.sparkSession)}/accepted-{uuid.uuid4().hex}"
    able = written(able.join(able.groupBy("component").agg(F.count(F.lit(1)).alias("links_"), F.max(odd).alias("odd_")), "component"), f"{folder}/able")
    fed = lambda df: listed(df, ["component"], ["cost", "key"], ["key", "source", "target", *ends], lambda key: _Accepting(), f"key {kinds['key']}, reason string").drop("component")
    large = able.where((F.col("links_") > most) & ~F.col("odd_"))
    if large.isEmpty():
        found = fed(able)
    else:
        taken, rest = _mutual(large, folder)
        last = fed(rest).where("reason is null").select("key")
        taken = taken.unionByName(rest.join(last, "key").select(LINK))
        taken = written(taken, f"{folder}/taken")
        own = F.struct("cost", "key")
        y = large.join(taken.select("source", own.alias("s_")), "source", "left").join(taken.select("target", own.alias("t_")), "target", "left")
        reason = F.when(F.col("s_") < own, "source_successor_already_assigned").when(F.col("t_") < own, "target_predecessor_already_assigned")
        found = fed(able.where((F.col("links_") <= most) | F.col("odd_"))).unionByName(y.select("key", reason.alias("reason")))
    return links.join(found.unionByName(x.where("early is not null").select("key", F.col("early").alias("reason"))), "key")

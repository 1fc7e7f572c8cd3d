"""Frames chosen for review: diverse by greedy scores, or at random from a seed, both with a least distance."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouped import stepped, whole


def diverse(frames: DataFrame, key: list[str], duration: float, target: int, gap: float, least: float = 0.0, seeded: list | None = None) -> DataFrame:
    """key, place, frame, score, new_subjects: up to target frames (key, frame, t, quality, domain, subjects: an array), one by one the best.

    score = 0.58 quality + 0.24 share of subjects not seen yet + 0.12 distance in time from those
    chosen + 0.06 if its domain is new; ties go to the earlier frame. Frames nearer than gap seconds to
    a chosen one are out; it ends where the best has less than least. seeded subjects count as seen. A
    key's candidates are the sampled frames of one match.
    """

    def work(b: pd.DataFrame) -> list[tuple]:
        left = [(r.frame, r.t, r.quality, r.domain, set(r.subjects) if r.subjects is not None else set()) for r in b.itertuples()]
        seen, chosen, out = set(seeded or []), [], []
        span = max(gap * 3.0, duration / max(1, target))
        while left and len(out) < target:
            left = [r for r in left if all(abs(r[1] - c[1]) >= gap for c in chosen)]
            scored = []
            for r in left:
                fresh = len(r[4] - seen) / max(1.0, len(r[4]))
                away = min(1.0, min(abs(r[1] - c[1]) for c in chosen) / span) if chosen else 1.0
                scored.append((0.58 * r[2] + 0.24 * fresh + 0.12 * away + 0.06 * all(r[3] != c[3] for c in chosen), -r[0], r))
            if not scored:
                break
            score, _, best = max(scored, key=lambda x: x[:2])
            if chosen and round(score, 6) < least:
                break
            out.append((len(out) + 1, int(best[0]), score, len(best[4] - seen)))
            chosen.append(best)
            seen |= best[4]
            left = [r for r in left if r[0] != best[0]]
        return out

    return whole(frames, key, ["frame"], work, "place int, frame long, score double, new_subjects int")


class _Spaced:
    def __init__(self, most: int, gap: int):
        self.most, self.gap, self.chosen, self.n = most, gap, [], 0

    def feed(self, rows: pd.DataFrame) -> list[tuple]:
        out = []
        for f in rows["frame"].tolist():
            at = bisect.bisect_left(self.chosen, f)
            if self.n < self.most and all(abs(f - g) >= self.gap for g in self.chosen[max(0, at - 1) : at + 1]):
                self.chosen.insert(at, f)
                self.n += 1
                out.append((self.n, int(f)))
        return out

    def end(self) -> list[tuple]:
        return []


def spaced_sample(frames: DataFrame, key: list[str], most: int, gap: int, seed: str) -> DataFrame:
    """key, place, frame: up to `most` frames of a key in an order drawn by hash from seed, key and frame, each at least gap frames from those before it. The state is the chosen frames."""
    drawn = F.sha2(F.concat_ws("/", F.lit(seed), *[F.col(k).cast("string") for k in key], F.col("frame").cast("string")), 256)
    x = frames.select(*key, F.col("frame").cast("long").alias("frame")).dropDuplicates().withColumn("drawn", drawn)
    return stepped(x, key, ["drawn"], lambda k: _Spaced(most, gap), "place int, frame long")

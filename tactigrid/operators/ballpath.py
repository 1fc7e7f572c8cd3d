"""The ball's path: one candidate a frame by a speed gate, with restarts by looking ahead; overlaps with players."""

from __future__ import annotations

import math
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouped import runs, stepped

#: Fixed values.
MAX_SPEED, MIN_START = 22.0, 0.08
SURE, UNSURE = 0.55, 0.18
COHERENT, AHEAD = 3, 8


class Path:
    """Selects a candidate (id, confidence, place) for each frame; holds the last selected one and AHEAD frames."""

    def __init__(self, fps: float, speed: float = MAX_SPEED, start: float = MIN_START):
        self.fps, self.speed, self.start = fps, speed, start
        self.ahead: deque[tuple[int, list[tuple]]] = deque()
        self.last: tuple | None = None
        self.any = False

    def seconds(self, a: int, b: int) -> float:
        return max((b - a) / self.fps, 1.0 / self.fps)

    def links(self, a: tuple, b: tuple, dt: float) -> float | None:
        """The speed from a to b, None if a place is missing."""
        if a[2] is None or b[2] is None:
            return None
        return math.dist(a[2], b[2]) / dt

    def sure(self) -> tuple | None:
        """The first frame's best candidate, if it is sure and COHERENT sure ones in a row of links begin with it within AHEAD more frames."""
        frame, candidates = self.ahead[0]
        first = candidates[0]
        least = max(self.start, SURE)
        if first[1] < least:
            return None
        n, last, at = 1, first, frame
        for f, more in list(self.ahead)[1 : AHEAD + 1]:
            near = next((c for c in more if c[1] >= least and (v := self.links(last, c, self.seconds(at, f))) is not None and v <= self.speed), None)
            if near is None:
                continue
            n, last, at = n + 1, near, f
            if n >= COHERENT:
                return first
        return None

    def add(self, frame: int, candidates: list[tuple]) -> list[tuple]:
        self.ahead.append((frame, sorted(candidates, key=lambda c: -c[1])))
        return self.step() if len(self.ahead) > AHEAD else []

    def rest(self) -> list[tuple]:
        out = []
        while self.ahead:
            out += self.step()
        return out

    def step(self) -> list[tuple]:
        """(frame, id, reason) of the first frame held, if it selects one."""
        frame, candidates = self.ahead[0]
        found, reason = self.choice(frame, candidates)
        self.ahead.popleft()
        if found is None:
            return []
        self.last, self.any = (*found[:3], frame), True
        return [(frame, found[0], reason)]

    def choice(self, frame: int, candidates: list[tuple]) -> tuple[tuple | None, str | None]:
        best = candidates[0]
        if self.last is None:
            return (best, "after_gap" if self.any else None) if best[1] >= self.start else (None, None)
        sure = self.sure()
        if sure is not None and self.last[1] <= UNSURE:
            return sure, "after_low_confidence_hijack"
        dt = self.seconds(self.last[3], frame)
        near = [(v / self.speed + (1.0 - c[1]) * 0.3, k) for k, c in enumerate(candidates) if (v := self.links(self.last, c, dt)) is not None and v <= self.speed]
        if near:
            return candidates[min(near)[1]], None
        if sure is not None:
            return sure, "after_impossible_high_conf_run"
        if dt > 1.0:
            if best[1] >= self.start:
                return best, "after_impossible_or_long_gap"
            self.last = None
        return None, None


class _Fed:
    def __init__(self, path: Path, columns: list[str]):
        self.path, self.columns, self.held = path, columns, None

    def feed(self, rows: pd.DataFrame) -> list[tuple]:
        rows = rows if self.held is None else pd.concat([self.held, rows], ignore_index=True)
        cut = int((rows[self.columns[0]] != rows[self.columns[0]].iloc[-1]).sum())
        self.held = rows.iloc[cut:]
        return self.frames(rows.iloc[:cut])

    def frames(self, rows: pd.DataFrame) -> list[tuple]:
        frame, id_, x, y, confidence = self.columns
        out = []
        for (f,), part in runs(rows, [frame]):
            each = zip(part[id_].tolist(), part[confidence].fillna(0.0).tolist(), part[x].tolist(), part[y].tolist(), strict=True)
            out += self.path.add(int(f), [(i, c, None if math.isnan(a) or math.isnan(b) else (a, b)) for i, c, a, b in each])
        return out

    def end(self) -> list[tuple]:
        return self.frames(self.held) + self.path.rest()


def select_path(df: DataFrame, sequence: list[str], frame: str, id_: str, x: str, y: str, confidence: str, fps: float, speed: float = MAX_SPEED, start: float = MIN_START) -> DataFrame:
    """sequence, frame, id, reason: the candidate that each frame selects, if any; reason says why a new segment begins there, else null.

    The nearest in speed and confidence within the speed gate goes on; a run of sure candidates takes
    over from an unsure one, or where none is in reach; more than a second without reach begins anew.
    Candidates of a frame are taken by falling confidence, then by id. A candidate without a place can
    begin a path, but none is linked to it; a null confidence is 0. Rows without a frame are left out.

    What a frame selects depends on all before, so a sequence is one task's stream; the task holds the
    last selected candidate and nine frames of it, however long it is.
    """
    kind = dict(df.dtypes)[id_]
    columns = [frame, id_, x, y, confidence]
    known = df.where(F.col(frame).isNotNull()).select(*sequence, F.col(frame).cast("long").alias(frame), id_, *[F.col(c).cast("double").alias(c) for c in (x, y, confidence)], (-F.coalesce(F.col(confidence).cast("double"), F.lit(0.0))).alias("order_"))
    return stepped(known, sequence, [frame, "order_", id_], lambda key: _Fed(Path(fps, speed, start), columns), f"{frame} long, {id_} {kind}, reason string")


def covering_box(balls: DataFrame, boxes: DataFrame, key: list[str], id_: str, x: str, y: str) -> DataFrame:
    """balls with box: of the players' boxes (key, x1, y1, x2, y2, player) of the same key that hold the ball, edges included, the one whose centre is nearest in its own size; player, vertical (0 top to 1 bottom), distance; null if none."""
    wide, high = F.greatest(F.lit(1.0), F.col("x2") - F.col("x1")), F.greatest(F.lit(1.0), F.col("y2") - F.col("y1"))
    inside = F.col(x).between(F.col("x1"), F.col("x2")) & F.col(y).between(F.col("y1"), F.col("y2"))
    far = F.hypot(F.col(x) - (F.col("x1") + F.col("x2")) / 2, F.col(y) - (F.col("y1") + F.col("y2")) / 2) / F.greatest(wide, high)
    hit = balls.join(boxes, key).where(inside).groupBy(*key, id_).agg(F.min(F.struct(far.alias("distance"), "player", ((F.col(y) - F.col("y1")) / high).alias("vertical"))).alias("box"))
    return balls.join(hit, [*key, id_], "left")


class _Kept:
    """Drops unsure detections inside a player's box, but for those that the last kept one reaches."""

    def __init__(self, columns: list[str], fps: float, sure: float, gap: float, speed: float):
        self.columns, self.fps, self.sure, self.gap, self.speed = columns, fps, sure, gap, speed
        self.last: tuple | None = None

    def feed(self, rows: pd.DataFrame) -> list[tuple]:
        out = []
        for f, i, x, y, c, boxed, anew in rows[self.columns].itertuples(index=False, name=None):
            c = 0.0 if c is None or math.isnan(c) else c
            keep = not boxed or c >= self.sure
            if not keep and self.last is None:
                keep = not anew
            elif not keep:
                dt = max((f - self.last[0]) / self.fps, 1.0 / self.fps)
                keep = dt <= self.gap and math.dist(self.last[1:], (x, y)) / dt <= self.speed
            if keep:
                self.last = (f, x, y)
            out.append((int(f), i, keep))
        return out

    def end(self) -> list[tuple]:
        return []


def without_covered(df: DataFrame, sequence: list[str], frame: str, id_: str, x: str, y: str, confidence: str, boxed: Column, fps: float, reason: str | None = None, sure: float = 0.5, gap: float = 0.5, speed: float = 18.0) -> DataFrame:
    """sequence, frame, id, kept: detections of low confidence inside a player's box (boxed) go, unless the last kept one is at most gap seconds before and reaches them at this speed. Before any is kept such a detection goes only if reason, the column of select_path(), says that it begins a segment after a gap.

    Rows without a place or frame are left out. The state is the last kept detection.
    """
    kind = dict(df.dtypes)[id_]
    anew = F.col(reason).isin("after_gap", "after_impossible_or_long_gap") if reason else F.lit(False)
    known = df.withColumn("boxed_", F.coalesce(boxed, F.lit(False))).withColumn("anew_", F.coalesce(anew, F.lit(False))).where(F.col(frame).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    columns = [frame, id_, x, y, confidence, "boxed_", "anew_"]
    return stepped(known.select(*sequence, *columns), sequence, [frame, id_], lambda key: _Kept(columns, fps, sure, gap, speed), f"{frame} long, {id_} {kind}, kept boolean")

"""A tracker of detections through frames: greedy nearest assignment to live tracks, as a batch job and as a stream.

Frames are integers. A track that no detection continued for more than `patience` frames is over. The
state is the live tracks alone, however long the sequence.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tactigrid.sources.tables import shared_dir, written

from .grouped import frame as rows_of
from .grouped import runs, stepped
from .sequence import ordered, sessionize

#: Where a detection stands; only inside may a track begin.
INSIDE, BOUNDARY, OUTSIDE = "inside_play", "boundary_transient", "outside_play"
#: Pairs of tracks and detections whose distances are computed together, about; rows of a stream's group that are given at a time.
PAIRS, GIVEN = 1 << 20, 50_000


class Tracker:
    """Live tracks in the order of their birth: number, last place, frame in which they were last seen.

    With aware set, detections have a status: tracks begin inside the play area only, go on at its
    boundary, and outside of it only if outside is set.
    """

    def __init__(self, reach: float = 80.0, patience: int = 10, aware: bool = False, outside: bool = False):
        self.reach, self.patience, self.aware, self.outside = reach, patience, aware, outside
        self.next, self.frame = 1, None
        self.ids, self.seen, self.places = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2))

    def step(self, frame: int, places: np.ndarray, status: list[str | None] | None = None) -> list[int | None]:
        """The track of each of a frame's detections, None for one that neither continues nor begins a track.

        The nearest pair of all goes first, then the nearest of what is left, up to reach; equal distances go to the older track, then to the earlier detection.
        """
        alive = frame - self.seen <= self.patience + 1
        if not alive.all():
            self.ids, self.seen, self.places = self.ids[alive], self.seen[alive], self.places[alive]
        self.frame = frame
        states = status if self.aware and status is not None else [INSIDE] * len(places)
        able = [k for k, s in enumerate(states) if s in (INSIDE, BOUNDARY) or self.outside and s == OUTSIDE]
        out: list[int | None] = [None] * len(places)
        if able and len(self.ids):
            i, j = self.near(places[able])
            taken, free = np.zeros(len(self.ids), bool).tolist(), [True] * len(able)
            pairs = []
            for s, t in zip(i.tolist(), j.tolist(), strict=True):
                if free[t] and not taken[s]:
                    taken[s], free[t] = True, False
                    pairs.append((s, able[t]))
            if pairs:
                s, t = (np.array(x) for x in zip(*pairs, strict=True))
                self.seen[s], self.places[s] = frame, places[t]
                for k, n in zip(t.tolist(), self.ids[s].tolist(), strict=True):
                    out[k] = n
        born = [k for k in able if out[k] is None and states[k] == INSIDE]
        if born:
            new = np.arange(self.next, self.next + len(born))
            for k, n in zip(born, new.tolist(), strict=True):
                out[k] = n
            self.ids, self.seen, self.places = np.append(self.ids, new), np.append(self.seen, np.full(len(born), frame)), np.vstack([self.places, places[born]])
            self.next += len(born)
        return out

    def near(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tracks and places at most reach apart, the nearest first: only tracks in a strip of that width around a place are looked at."""
        axis = int(np.ptp(self.places[:, 1]) > np.ptp(self.places[:, 0]))
        order = np.argsort(self.places[:, axis], kind="stable")
        line = self.places[order, axis]
        # A little wider, for the difference of two places may be rounded down to reach.
        wide = self.reach * (1 + 1e-9) + 1e-9 * np.abs(places[:, axis])
        low, high = np.searchsorted(line, places[:, axis] - wide, "left"), np.searchsorted(line, places[:, axis] + wide, "right")
        n = high - low
        found = []
        ends = np.searchsorted(np.cumsum(n), np.arange(PAIRS, n.sum() + PAIRS, PAIRS), "right") + 1
        for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(n)], strict=True):
            if a < b:
                j = np.repeat(np.arange(len(n))[a:b], n[a:b])
                i = order[np.arange(len(j)) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b]) + low[j]]
                gap = places[j] - self.places[i]
                d = np.sqrt((gap * gap).sum(axis=1))
                hit = d <= self.reach
                found.append((d[hit], i[hit], j[hit]))
        d, i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.lexsort((j, i, d))
        return i[by], j[by]


class _Batch:
    """Feeds a tracker frame by frame; the last frame of a batch may go on in the next."""

    def __init__(self, tracker: Tracker, columns: list[str]):
        self.tracker, self.columns, self.held = tracker, columns, None

    def feed(self, rows: pd.DataFrame) -> list[tuple]:
        rows = rows if self.held is None else pd.concat([self.held, rows], ignore_index=True)
        last = rows[self.columns[0]].iloc[-1]
        cut = int((rows[self.columns[0]] != last).sum())
        self.held = rows.iloc[cut:]
        return self.steps(rows.iloc[:cut])

    def end(self) -> list[tuple]:
        return self.steps(self.held)

    def steps(self, rows: pd.DataFrame) -> list[tuple]:
        return list(tracked(self.tracker, rows, self.columns))


def tracked(tracker: Tracker, rows: pd.DataFrame, columns: list[str]) -> Iterator[tuple]:
    """(frame, id, track) of rows in order of frame and id; columns: frame, id, x, y and perhaps status."""
    frame, id_, x, y, *status = columns
    for (at,), part in runs(rows, [frame]):
        places = part[[x, y]].to_numpy(float)
        found = tracker.step(int(at), places, [None if pd.isna(s) else s for s in part[status[0]]] if status else None)
        yield from zip([int(at)] * len(part), part[id_].tolist(), found, strict=True)


def track(df: DataFrame, sequence: list[str], frame: str, id_: str, x: str, y: str, status: str | None = None, reach: float = 80.0, patience: int = 10, outside: bool = False) -> DataFrame:
    """sequence, frame, id, track: the track (from 1 for each sequence) that each detection belongs to, null if none.

    A sequence is cut where no track can live on, at more than patience empty frames; the pieces run in
    parallel, and their tracks are numbered on by the births before them. Detections without a place or
    a frame are left out; repeated rows are detections of their own.
    """
    columns = [frame, id_, x, y, *([status] if status else [])]
    known = df.where(" and ".join(f"{c} is not null and not isnan({c})" for c in (frame, x, y))).select(*sequence, *columns)
    cut = sessionize(known, sequence, frame, id_, patience + 1)
    kind = dict(df.dtypes)[id_]
    start = lambda key: _Batch(Tracker(reach, patience, status is not None, outside), columns)
    found = stepped(cut, [*sequence, "session"], [frame, id_], start, f"{frame} long, {id_} {kind}, track long")
    found = written(found, f"{shared_dir(df.sparkSession)}/tracks-{uuid.uuid4().hex}")  # read twice, tracked once
    births = found.groupBy(*sequence, "session").agg(F.coalesce(F.max("track"), F.lit(0)).alias("births"))
    before = F.coalesce(F.sum("births").over(ordered(sequence, "session").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = births.withColumn("before", before).select(*sequence, "session", "before")
    return found.join(first, [*sequence, "session"]).select(*sequence, frame, id_, (F.col("track") + F.col("before")).alias("track"))


STATE = "next long, frame long, ids array<long>, seen array<long>, xs array<double>, ys array<double>"


def track_stream(df: DataFrame, sequence: list[str], frame: str, id_: str, x: str, y: str, reach: float = 80.0, patience: int = 10) -> DataFrame:
    """The same of a stream: sequence, frame, id, track, late.

    A micro-batch brings whole frames, those of a sequence in order. Rows of a frame that is over (one at
    or before the sequence's last) are late or repeated: they come out with late set and no track, and
    change nothing. The state of a sequence is its live tracks and two numbers.
    """
    kinds = dict(df.dtypes)
    columns = [frame, id_, x, y]

    def work(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts), ignore_index=True).sort_values([frame, id_], ignore_index=True)
        rows = rows[rows[columns].notna().all(axis=1)]
        t = Tracker(reach, patience)
        if state.exists:
            t.next, t.frame, ids, seen, xs, ys = state.get
            t.ids, t.seen, t.places = np.array(ids, np.int64), np.array(seen, np.int64), np.column_stack([xs, ys]).reshape(len(ids), 2).astype(float)
        over = rows[frame] <= t.frame if t.frame is not None else pd.Series(False, rows.index)
        late = ((*key, int(f), i, None, True) for f, i in rows.loc[over, [frame, id_]].itertuples(index=False))
        out = itertools.chain(late, ((*key, *r, False) for r in tracked(t, rows[~over], columns)))
        while len(given := list(itertools.islice(out, GIVEN))) == GIVEN:
            yield rows_of(given, names)
        if t.frame is not None:
            state.update((t.next, t.frame, t.ids.tolist(), t.seen.tolist(), t.places[:, 0].tolist(), t.places[:, 1].tolist()))
        yield rows_of(given, names)

    names = [*sequence, frame, id_, "track", "late"]
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in sequence), f"{frame} long, {id_} {kinds[id_]}, track long, late boolean"])
    return df.select(*sequence, *columns).groupBy(*sequence).applyInPandasWithState(work, schema, STATE, "append", GroupStateTimeout.NoTimeout)

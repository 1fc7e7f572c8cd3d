"""Sequential and combinatorial operators against plain versions, on rows made by hand or at random."""

import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tactigrid.operators import assignment, ballpath, components, coverage, lineage, presence, restarts, teams, timeline, tracker


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))


def ordered(found):
    return sorted(found, key=lambda r: tuple((x is None, x) for x in r))


DETECTIONS = "match long, frame long, id long, x double, y double, status string, extra int"


def detections(seed, frames=120, matches=2):
    r = random.Random(seed)
    out, i = [], 0
    for m in range(matches):
        for f in sorted(r.sample(range(frames), frames // 3)) + [frames + 40, frames + 41, frames + 60]:
            for _ in range(r.choice([1, 1, 2, 4])):
                i += 1
                out.append((m, f, i, float(r.randrange(0, 200, 10)), float(r.randrange(0, 60, 10)), r.choice(["inside_play", "boundary_transient", "outside_play", None]), 0))
    return out


def plain_tracks(found, reach, patience, aware=False, outside=False):
    """{id: track} by looking at every frame, also the empty ones."""
    out = {}
    for m in {r[0] for r in found}:
        frames = defaultdict(list)
        for r in sorted(found):
            if r[0] == m:
                frames[r[1]].append(r)
        live, n = {}, 0
        for f in range(min(frames), max(frames) + 1):
            for t in live.values():
                t["missing"] += 1
            able = [r for r in frames.get(f, []) if not aware or r[5] in ("inside_play", "boundary_transient") or outside and r[5] == "outside_play"]
            free, tracks = list(able), list(live)
            while free and tracks:
                d, _, _, t, r = min((math.hypot(live[t]["x"] - r[3], live[t]["y"] - r[4]), t, r[2], t, r) for t in tracks for r in free)
                if d > reach:
                    break
                live[t] = {"x": r[3], "y": r[4], "missing": 0}
                out[r[2]] = t
                free.remove(r)
                tracks.remove(t)
            for r in free:
                if not aware or r[5] == "inside_play":
                    n += 1
                    live[n], out[r[2]] = {"x": r[3], "y": r[4], "missing": 0}, n
            live = {t: v for t, v in live.items() if v["missing"] <= patience}
    return out


@pytest.mark.parametrize(("seed", "aware", "outside"), [(1, False, False), (2, True, False), (3, True, True)])
def test_tracker(spark, seed, aware, outside):
    found = detections(seed)
    df = spark.createDataFrame([*found, (0, None, 900, 1.0, 1.0, None, 0), (0, 3, 901, None, 1.0, None, 0), (0, 3, 902, math.nan, 1.0, None, 0)], DETECTIONS).repartition(4)
    got = tracker.track(df, ["match"], "frame", "id", "x", "y", "status" if aware else None, reach=40.0, patience=10, outside=outside)
    want = plain_tracks(found, 40.0, 10, aware, outside)
    assert {r["id"]: r["track"] for r in got.collect() if r["track"] is not None} == want
    assert got.count() == len(found)


def test_tracker_patience(spark):
    at = lambda *frames: spark.createDataFrame([(0, f, f, 1.0, 1.0, None, 0) for f in frames], DETECTIONS)
    of = lambda *frames: [r[1] for r in rows(tracker.track(at(*frames), ["match"], "frame", "id", "x", "y"), "frame", "track")]
    assert of(0, 11) == [1, 1] and of(0, 12) == [1, 2]  # ten frames without it, eleven
    assert tracker.track(at(), ["match"], "frame", "id", "x", "y").count() == 0


def test_tracker_stream(spark, tmp_path):
    found = detections(4)
    cuts = [0, 30, 70, 1000]
    source = tmp_path / "in"
    for k, (a, b) in enumerate(itertools.pairwise(cuts)):
        part = [r for r in found if a <= r[1] < b] + ([r for r in found if r[1] < 5] if k == 2 else [])  # late and repeated rows
        spark.createDataFrame(part, DETECTIONS).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(DETECTIONS).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = tracker.track_stream(stream, ["match"], "frame", "id", "x", "y", reach=40.0)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = tracker.track(spark.createDataFrame(found, DETECTIONS), ["match"], "frame", "id", "x", "y", reach=40.0)
    assert rows(got.where("not late"), "match", "frame", "id", "track") == rows(batch, "match", "frame", "id", "track")
    assert rows(got.where("late"), "id", "track") == ordered((r[2], None) for r in found if r[1] < 5)


def best_of_all(pairs, limit):
    """The best assignment by trying every one: least sum, then without the last pair in which they differ."""
    order = sorted(range(len(pairs)), key=lambda k: pairs[k][:2])
    best = None
    for n in range(len(pairs) + 1):
        for some in itertools.combinations(range(len(pairs)), n):
            if len({pairs[k][0] for k in some}) == len({pairs[k][1] for k in some}) == n:
                rank = (sum(round((pairs[k][2] - limit) * 1e6) for k in some), sum(1 << order.index(k) for k in some))
                best = min(best or (rank, some), (rank, some))
    return sorted(best[1])


def test_least_cost():
    r = random.Random(7)
    for _ in range(150):
        cells = r.sample([(a, b) for a in range(4) for b in range(4)], r.randint(0, 9))
        pairs = [(a, b, r.choice([0.0, 0.1, 0.3, 0.5, 0.75, 1.0, 2.5])) for a, b in cells]
        assert assignment.least_cost(pairs, 0.75) == best_of_all(pairs, 0.75)


def test_assigned(spark):
    r = random.Random(8)
    cells = [(f, s, o, float(r.randint(0, 6))) for f in range(30) for s, o in r.sample([(s, o) for s in range(3) for o in range(4)], r.randint(1, 8))]
    odd = [(0, 0, 9, None), (0, 9, 0, math.nan), (1, 0, 8, 5.0), (1, 0, 8, 1.0), (2, 5, 5, 999.0), (2, 6, 6, 998.0)]
    got = assignment.assigned(spark.createDataFrame([*cells, *odd], "frame int, slot int, obs int, cost double").repartition(3), ["frame"], "slot", "obs", "cost")
    want = []
    for f in range(30):
        p = [c[1:] for c in cells if c[0] == f] + {1: [(0, 8, 1.0)], 2: [(5, 5, 999.0), (6, 6, 998.0)]}.get(f, [])
        want += [(f, *p[k]) for k in best_of_all(p, 999.0)]
    assert rows(got, "frame", "slot", "obs", "cost") == ordered(want)
    assert assignment.assigned(spark.createDataFrame([], "frame int, slot int, obs int, cost double"), ["frame"], "slot", "obs", "cost").count() == 0


def test_components(spark):
    edges = [("b", "a"), ("b", "c"), ("x", "y"), ("z", "z"), (None, "a"), ("m", None), *[(f"h{i}", "hub") for i in range(40)], *[(f"k{i:02}", f"k{i + 1:02}") for i in range(30)]]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[k] for k in "abc"} == {"a"} and got["y"] == got["x"] == "x" and "z" not in got and "m" not in got
    assert {v for k, v in got.items() if k[0] == "h"} == {"h0"} and {v for k, v in got.items() if k[0] == "k"} == {"k00"}
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_linked(spark):
    r = random.Random(9)
    edges = {(c * 10 + a, c * 10 + b): r.choice([0.1, 0.2, 0.4, 0.7, 0.75, 0.9]) for c in range(6) for a, b in r.sample([(a, b) for a in range(3) for b in range(4, 8)], 7)}
    table = [(a, b, c, f"{a}>{b}") for (a, b), c in edges.items()]
    (a, b), c = next(iter(edges.items()))
    table += [(a, b, c + 1, "dearer"), (None, 1, 0.1, "no source"), (1, 2, math.nan, "no cost")]
    df = spark.createDataFrame(table, "source int, target int, cost double, key string")
    got = {r["key"]: (r["selected"], r["state"]) for r in assignment.linked(df, "source", "target", "cost", "key").collect()}
    pairs = [(a, b, c) for (a, b), c in edges.items()]
    want = set()
    for c in range(6):
        p = [x for x in pairs if x[0] // 10 == c]
        want |= {f"{p[k][0]}>{p[k][1]}" for k in best_of_all(p, 0.75)}
    assert {k for k, (chosen, _) in got.items() if chosen} == want
    assert got["no source"] == (False, "not_considered") and len(got) == len(table)
    few = assignment.linked(df, "source", "target", "cost", "key", most=3)
    assert not few.where("selected").count() and few.where("state = 'too_large'").count() >= len(edges)


def plain_match(gold, found, tolerance):
    free, out = list(found), []
    for g in gold:
        near = [(abs(f[1] - g[1]), f[0], f) for f in free if f[2] == g[2] and abs(f[1] - g[1]) <= tolerance]
        if near:
            f = min(near)[2]
            free.remove(f)
            out.append((g[2], g[0], f[0], f[1] - g[1]))
        else:
            out.append((g[2], g[0], None, None))
    return out + [(f[2], None, f[0], None) for f in free]


@pytest.mark.parametrize("order", [None, "turn"])
def test_greedy_match(spark, order):
    r = random.Random(10)
    make = lambda n, at: [(at + i, r.randrange(0, 4000), r.choice("ab"), r.randrange(100)) for i in range(n)]
    gold, found = make(80, 0), make(90, 500)
    gold += [(90, 5000, "a", 0), (91, 5200, "a", 0), (92, 5300, "a", 0)]
    found += [(600, 5045, "a", 0), (601, 5246, "a", 0), (602, 5295, "a", 0), (603, 5305, "a", 0)]  # 45 and 46 frames; equal distances
    schema = "id int, frame int, outcome string, turn int"
    got = assignment.greedy_match(spark.createDataFrame([*gold, (99, None, "a", 0)], schema), spark.createDataFrame(found, schema), ["outcome"], "frame", "id", order=order)
    turn = sorted(gold, key=lambda g: (g[3] if order else g[1], g[0]))
    assert rows(got, "outcome", "gold_id", "found_id", "frame_delta") == ordered([*plain_match(turn, found, 45), ("a", 99, None, None)])
    s = assignment.scores(got, ["outcome"]).where("outcome = 'b'").first()
    assert s["precision"] == s["true_positives"] / (s["true_positives"] + s["false_positives"])


def plain_path(frames, fps, limit, start):
    """[(frame, id, reason)] of [(frame, candidates by confidence: (id, confidence, place))], all in memory."""

    def sure(i):
        first = frames[i][1][0]
        if first[1] < max(start, 0.55):
            return None
        n, last, at = 1, first, frames[i][0]
        for f, more in frames[i + 1 : i + 9]:
            dt = max((f - at) / fps, 1 / fps)
            ok = [c for c in more if c[1] >= max(start, 0.55) and math.dist(last[2], c[2]) / dt <= limit]
            if ok:
                n, last, at = n + 1, ok[0], f
                if n == 3:
                    return first
        return None

    out, last, began = [], None, False
    for i, (f, cs) in enumerate(frames):
        pick, why = None, None
        if last is None:
            if cs[0][1] >= start:
                pick, why = cs[0], "after_gap" if began else None
        else:
            s, dt = sure(i), max((f - last[3]) / fps, 1 / fps)
            ok = [(math.dist(last[2], c[2]) / dt / limit + 0.3 * (1 - c[1]), k) for k, c in enumerate(cs) if math.dist(last[2], c[2]) / dt <= limit]
            if s and last[1] <= 0.18:
                pick, why = s, "after_low_confidence_hijack"
            elif ok:
                pick = cs[min(ok)[1]]
            elif s:
                pick, why = s, "after_impossible_high_conf_run"
            elif dt > 1 and cs[0][1] >= start:
                pick, why = cs[0], "after_impossible_or_long_gap"
            elif dt > 1:
                last = None
        if pick:
            last, began = (*pick, f), True
            out.append((f, pick[0], why))
    return out


BALL = "match int, frame int, id int, x double, y double, confidence double"


def test_ball_path(spark):
    r, table = random.Random(11), []
    for m in range(3):
        x, f = 10.0, 0
        for _ in range(400):
            f += r.choice([1, 1, 1, 2, 3, 12])
            x = x + r.uniform(-1, 1) if r.random() > 0.02 else r.uniform(0, 30)
            for _ in range(r.choice([1, 1, 2, 3])):
                far = r.random() < 0.3
                table.append((m, f, len(table), r.uniform(0, 300) if far else x, 5.0, round(r.choice([r.uniform(0, 0.2), r.uniform(0.3, 1)]), 2)))
    got = ballpath.select_path(spark.createDataFrame(table, BALL).repartition(5), ["match"], "frame", "id", "x", "y", "confidence", fps=10.0)
    want, reasons = [], set()
    for m in range(3):
        by = defaultdict(list)
        for _, f, i, x, y, c in [t for t in table if t[0] == m]:
            by[f].append((i, c, (x, y)))
        found = plain_path([(f, sorted(v, key=lambda c: (-c[1], c[0]))) for f, v in sorted(by.items())], 10.0, 22.0, 0.08)
        want += [(m, *p) for p in found]
        reasons |= {p[2] for p in found}
    assert rows(got, "match", "frame", "id", "reason") == ordered(want)
    assert reasons == {None, "after_low_confidence_hijack", "after_impossible_high_conf_run", "after_impossible_or_long_gap", "after_gap"}
    odd = [(0, 0, 1, None, 1.0, 0.9), (0, 1, 2, math.nan, 1.0, 0.9), (0, 2, 3, 1.0, 1.0, None), (0, None, 4, 1.0, 1.0, 0.5)]
    assert rows(ballpath.select_path(spark.createDataFrame(odd, BALL), ["match"], "frame", "id", "x", "y", "confidence", fps=10.0), "id") == [(1,)]  # nothing can be linked to a first one without a place
    assert ballpath.select_path(spark.createDataFrame([], BALL), ["match"], "frame", "id", "x", "y", "confidence", fps=10.0).count() == 0


def test_covered_ball(spark):
    ball = [(0, 0, 1, 5.0, 5.0, 0.4), (0, 5, 2, 5.5, 5.0, 0.4), (0, 11, 3, 5.5, 5.0, 0.4), (0, 12, 4, 5.5, 5.0, 0.5), (0, 13, 5, 9.0, 5.0, 0.1), (0, 14, 6, 50.0, 5.0, 0.1)]
    boxes = spark.createDataFrame([(0, f, 0.0, 0.0, 10.0, 10.0, "far") for f in range(14)] + [(0, 5, 5.5, 4.0, 6.5, 6.0, "near")], "match int, frame int, x1 double, y1 double, x2 double, y2 double, player string")
    hit = ballpath.covering_box(spark.createDataFrame(ball, BALL), boxes, ["match", "frame"], "id", "x", "y").withColumn("reason", F.when(F.col("id") == 1, "after_gap"))
    assert rows(hit.select("id", "box.player"), "id", "player") == [(1, "far"), (2, "far"), (3, "far"), (4, "far"), (5, "far"), (6, None)]
    kept = lambda reason: dict(rows(ballpath.without_covered(hit, ["match"], "frame", "id", "x", "y", "confidence", F.col("box").isNotNull(), fps=10.0, reason=reason), "id", "kept"))
    # 0.5 s after the last kept one, 0.6 s, sure itself, too fast, outside
    assert kept(None) == {1: True, 2: True, 3: False, 4: True, 5: False, 6: True}
    assert kept("reason") == {1: False, 2: True, 3: False, 4: True, 5: False, 6: True}


def plain_windows(ball):
    """[(start, end)] of one match's rows (frame, t, x, y): runs at one line, then windows by index."""

    def line(x, y):
        d, name = min((abs(x), 0, "l"), (abs(30 - x), 1, "r"), (abs(y), 2, "t"), (abs(47.4 - y), 3, "b"), key=lambda q: q[:2])[::2]
        if d > 0.8 or name in "tb" and 5 < x < 25:
            return None
        if name in "lr":
            return name, "t" if y <= 5 else "b" if y >= 42.4 else None
        return name, "l" if x <= 5 else "r"

    cut, run = [], []
    for r in ball:
        key = None if r[2] is None else line(r[2], r[3])
        if run and (key != run[-1][1] or r[0] > run[-1][0][0] + 2):
            cut.append([q[0] for q in run])
            run = []
        if key:
            run.append((r, key))
    cut.append([q[0] for q in run])
    still = lambda w: all(round(math.dist(a[2:], b[2:]) / (b[1] - a[1]), 3) <= 0.9 for a, b in itertools.pairwise(w)) and round(math.dist(w[0][2:], w[-1][2:]), 3) <= 0.7
    out = []
    for run in cut:
        a = 0
        while a <= len(run) - 8:
            b = a + 8
            if not still(run[a:b]):
                a += 1
                continue
            while b < len(run) and still(run[a : b + 1]):
                b += 1
            out.append((run[a][0], run[b - 1][0]))
            a = b
    return out


def test_static_windows(spark):
    r, ball, f = random.Random(12), [], 0
    x, y = 0.2, 20.0
    for _ in range(900):
        f += r.choice([1, 1, 1, 1, 1, 2, 2, 3]) if r.random() < 0.2 else 1
        if r.random() < 0.05:
            x, y = r.choice([(0.2, 20.0), (29.9, 2.0), (3.0, 0.1), (15.0, 0.1), (15.0, 20.0), (0.7, 45.0)])
        x += r.uniform(-0.02, 0.024)
        ball.append((f, f / 30.0, None if r.random() < 0.01 else x, y))
    df = spark.createDataFrame([(0, *b, 0.5) for b in ball] + [(1, *b, None) for b in ball[:300]], "match int, frame int, t double, x double, y double, confidence double").repartition(3)
    got = restarts.static_windows(df, ["match"], 30.0, 47.4)
    want = [(0, *w) for w in plain_windows(ball)] + [(1, *w) for w in plain_windows(ball[:300])]
    assert len(want) > 10 and rows(got, "match", "start_frame", "end_frame") == ordered(want)


def test_restarts(spark):
    ball = [(0, f, f / 30, 0.2, 20.0, 0.8) for f in range(100, 110)] + [(0, f, f / 30, 0.2 + 0.2 * (f - 109), 20.0, 0.8) for f in range(110, 130)]
    ball += [(0, f, f / 30, 29.9, 30.0, 0.8) for f in range(125, 140) if f >= 130]  # begins before the receiver below
    ball += [(0, f, f / 30, 29.9 - 0.3 * (f - 139), 30.0, 0.8) for f in range(140, 150)]
    ball += [(0, f, f / 30, 0.1, 46.0, 0.8) for f in range(400, 410)]  # never released
    ball = spark.createDataFrame(ball, "match int, frame int, t double, x double, y double, confidence double")
    held = [(0, 50, "controlled", "b1", "B", 0.9, 10.0, 10.0), *[(0, f, "unknown", None, None, None, None, None) for f in range(60, 64)], (0, 135, "controlled", "a2", "A", 0.5, 5.0, 20.0)]
    held = spark.createDataFrame(held, "match int, frame int, status string, player string, team string, confidence double, bx double, by double")
    near = spark.createDataFrame([(0, 105, "a1", "A", 1.0, 20.0), (0, 106, "b9", "B", 0.5, 22.59)], "match int, frame int, player string, team string, x double, y double")
    (r,) = restarts.restarts(ball, held, near, ["match"], 30.0, 47.4).collect()
    assert (r["restart_type"], r["line"], r["start_frame"], r["end_frame"], r["frames"]) == ("kick_in", "left_touchline", 100, 109, 10)
    assert (r["actor"], r["team"], r["receiver"], r["receiver_frame"], r["result"]) == ("a1", "A", "a2", 135, "restart_pass")
    assert r["release_frame"] == 114 and r["evidence"] == "ball_missing_before_static_boundary_restart" and r["last_touch_frame"] == 50
    none = spark.createDataFrame([], near.schema)
    (r,) = restarts.restarts(ball, held, none, ["match"], 30.0, 47.4).collect()
    assert (r["actor"], r["team"], r["team_source"], r["result"]) == (None, "A", "last_touch_out_of_play_opponent", "restart_pass")
    assert restarts.restarts(spark.createDataFrame([], ball.schema), held, near, ["match"], 30.0, 47.4).count() == 0


def test_greedy_coverage(spark):
    r = random.Random(13)
    pairs = [(t, u, r.choice("xyz"), r.randrange(25)) for t in "AB" for u in range(25) for _ in range(r.randint(1, 9))]
    pairs += [("A", 77, "q", f) for f in range(9)] + [("A", 78, "q", f) for f in range(9)] + pairs[:20]
    units = [(t, u, float(r.randrange(3)), r.randrange(3)) for t in "AB" for u in range(25)] + [("A", 77, 1.0, 1), ("A", 78, 1.0, 1), ("A", 79, None, None)]
    covered = [("A", "x", 1), ("B", "y", 2)]
    got = coverage.ranked(spark.createDataFrame(pairs, "team string, unit int, subject string, frame int").repartition(4), spark.createDataFrame(units, "team string, unit int, detected_sec double, start_frame int"), ["team"], "unit", ["subject", "frame"], spark.createDataFrame(covered, "team string, subject string, frame int"))
    want = []
    for t in "AB":
        done, left, total = {c[1:] for c in covered if c[0] == t}, {u: {p[2:] for p in pairs if p[:2] == (t, u)} for u in {p[1] for p in pairs if p[0] == t}}, 0
        tie = {u: (-(s or 0), a or 0, str(u)) for k, u, s, a in units if k == t}
        while left:
            u = min(left, key=lambda u: (-len(left[u] - done), tie[u]))
            gain = left.pop(u) - done
            if gain:
                done |= gain
                total += len(gain)
                want.append((t, u, sum(w[0] == t for w in want) + 1, len(gain), total))
    assert rows(got, "team", "unit", "rank", "gain", "cumulative") == ordered(want)
    first = coverage.required(got, ["team"], spark.createDataFrame([("A", 10), ("B", 0)], "team string, required int"))
    assert rows(first, "team", "rank") == ordered(("A", w[2]) for w in want if w[0] == "A" and w[4] - w[3] < 10)


def test_views(spark, tmp_path):
    seen = []

    def totals(i):
        seen.append(rows(i["s"].select("k").distinct(), "k"))
        return i["s"].groupBy("k").agg(F.sum("v").alias("v"))

    v = lineage.Views(spark, str(tmp_path), [lineage.View("totals", ["s"], totals, ["k"]), lineage.View("top", ["totals"], lambda i: i["totals"].agg(F.max("v").alias("v"))), lineage.View("next", ["top"], lambda i: i["top"]), lineage.View("lost", ["gone"], lambda i: i["gone"])])
    s = lambda *r: {"s": spark.createDataFrame(r, "k string, v int")}
    one = s(("a", 1), ("b", 9), (None, 4))
    assert set(v.status(one).values()) == {"missing_inputs"}
    assert v.refresh(one) == {"totals": 1, "top": 2, "next": 3} and v.status(one) == {"totals": "fresh", "top": "fresh", "next": "fresh", "lost": "missing_inputs"}
    assert v.refresh(s((None, 4), ("b", 9), ("a", 1))) == {}  # the order of rows does not matter
    two = s(("a", 1), ("a", 1), ("b", 9), (None, 5))  # a repeated row, a changed row
    assert v.status(two) == {"totals": "stale", "top": "fresh", "next": "fresh", "lost": "missing_inputs"}
    assert v.refresh(two) == {"totals": 4, "top": 5}  # the top comes out the same, so nothing beyond it is built
    assert seen[-1] == [("a",), (None,)] and v.status(two)["next"] == "fresh"
    assert rows(v.read("totals", {}), "k", "v") == [("a", 2), ("b", 9), (None, 5)]
    three = s(("b", 9))
    v.refresh(three)
    assert rows(v.read("totals", {}), "k", "v") == [("b", 9)] and v.read("lost", {}) is None
    spark.createDataFrame([("top", 99, str(tmp_path / "top"), None)], v.SCHEMA).write.mode("append").parquet(str(tmp_path / "manifest"))
    assert v.status(three)["top"] == "legacy_unknown" and v.status(three)["next"] == "missing_inputs"


def test_timeline_round_trip(spark):
    r = random.Random(14)
    states = [(s, f, r.choice([None, "a", "b"])) for s in range(3) for f in range(60) if r.random() < 0.8]
    df = spark.createDataFrame(states, "subject int, frame int, state string")
    runs = timeline.encoded(df, ["subject"], ["state"])
    assert rows(timeline.expanded(runs, ["subject", "state"]), "subject", "frame", "state") == ordered(states)
    assert runs.count() == sum(1 for k, (s, f, x) in enumerate(states) if k == 0 or states[k - 1] != (s, f - 1, x))


def test_timeline_states(spark):
    o = [(1, 0, "a", 0.0, 0.0, 0.9, True), (1, 0, "b", 9.0, 9.0, 0.5, True), (1, 3, "a", 1.0, 0.0, 0.9, True), (1, 8, "a", 1.0, 0.0, 0.9, False), (1, 12, "c", 1.0, 0.0, 0.9, True), (1, 15, "d", 1.0, 0.0, 0.9, True)]
    observations = spark.createDataFrame(o, "subject int, frame int, tracklet string, x double, y double, confidence double, inside boolean")
    spans = lambda *r: spark.createDataFrame(r, "tracklet string, start int, stop int")
    edges = spark.createDataFrame([("c", "d")], "source string, target string")
    got = timeline.timeline(observations, spans(("c", 12, 12)), edges, spans(("c", 13, 13), ("z", 0, 99)), fps=4.0)
    want = [(0, 0, "detected", "a", True), (1, 2, "predicted", None, False), (3, 3, "detected", "a", True), (4, 7, "missing", None, False), (8, 8, "detected", "a", False)]
    want += [(9, 11, "occluded", None, False), (12, 12, "detected", "c", False), (13, 14, "occluded", None, False), (15, 15, "detected", "d", True)]
    assert rows(got, "start", "stop", "status", "tracklet", "eligible") == ordered(want)


def test_presence_edges(spark):
    fragments = spark.createDataFrame([("p", 1, 0, 0, 10), ("p", 1, 1, 16, 20), ("q", 1, 0, 7, 7)], "player string, subject int, fragment int, start int, stop int")
    seen = [("p", 1, 0, 0), ("p", 1, 0, 3), ("p", 1, 0, 6), ("p", 1, 0, 8), ("p", 1, 0, 10), ("p", 1, 1, 16), ("p", 1, 1, 20), ("q", 1, 0, 7)]
    rows_ = spark.createDataFrame([(*s, "detected", 1.0, 1.0, 0.5) for s in seen], "player string, subject int, fragment int, frame int, source string, x double, y double, confidence double")
    slots = lambda *f: spark.createDataFrame([(1, x) for x in f], "subject int, frame int")
    team = spark.createDataFrame([("p", "A")], "player string, team string")
    # One frame a second: holes of two frames, bridges of five; 7 belongs to q, 17 to 19 is too long a hole.
    of = lambda s, **k: rows(presence.presence(fragments, rows_, s, team, 1.0, **k).where("player = 'p'"), "frame")
    assert [f for (f,) in of(slots(11, 12, 15))] == [*range(7), *range(8, 17), 20]
    assert [f for (f,) in of(slots(11, 12))] == [*range(7), 8, 9, 10, 16, 20]
    assert [f for (f,) in of(slots(11, 12, 15), frames=9)] == [*range(7), 8]


def test_two_means(spark):
    r = np.random.default_rng(15)
    x = np.vstack([r.normal(0, 1, (40, 3)), r.normal(6, 1, (30, 3))])
    w = r.integers(1, 5, 70).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), float(k)) for i, (v, k) in enumerate(zip(x, w, strict=True))] + [(99, None, 3.0)], "id int, f array<double>, w double")
    got, centres = teams.two_means(df, "id", "f", "w", tolerance=1e-9)
    first = x[np.lexsort((np.arange(70), -w))[0]]
    second = x[np.argmax(np.linalg.norm(x - first, axis=1) * w)]
    c = [first, second]
    for _ in range(12):
        near = np.linalg.norm(x - c[0], axis=1) > np.linalg.norm(x - c[1], axis=1)
        c = [np.average(x[near == k], axis=0, weights=w[near == k]) for k in (0, 1)]
    assert np.allclose(centres, c) and {r["id"]: r["cluster"] for r in got.collect()} == {**dict(enumerate(near.astype(int).tolist())), 99: None}
    assert teams.two_means(df.where("id = 99"), "id", "f", "w")[1] == []


def test_boundary_values(spark):
    """Hand-made rows at and around the limits of the sequence rules."""
    from tactigrid.functions import geometry
    from tactigrid.operators import matching, possession, review, sequence, smoothing

    series = lambda *r: spark.createDataFrame([(0, i, *x) for i, x in enumerate(r)], "e int, id int, t double, v double")
    # gap of 0.5 and 0.51 s; 22 m/s and more
    fill = lambda *r: [r["source"] for r in sequence.interpolate(series(*r), ["e"], "t", "id", "v", 0.5, 22.0).orderBy("id").collect()]
    assert fill((0.0, 0.0), (0.25, None), (0.5, 11.0))[1] == "interpolated" and fill((0.0, 0.0), (0.25, None), (0.51, 1.0))[1] == "unknown"
    assert fill((0.0, 0.0), (0.25, None), (0.5, 11.01))[1] == "unknown" and fill((0.0, None), (0.1, 1.0))[0] == "unknown"
    # a step that is too fast, or too long, ends every window
    top = lambda *r: rows(smoothing.speed_ahead(series(*r), ["e"], "t", "id", "v", 1.0, 3.0, 1.5, 5.0), "id", "top")
    assert top((0.0, 0.0), (1.0, 4.0), (2.0, 6.0)) == [(0, 4.0), (1, 2.0)] and top((0.0, 0.0), (1.0, 5.01), (2.0, 6.0)) == [(1, pytest.approx(0.99))]
    assert top((0.0, 0.0), (1.6, 1.0)) == [] and top() == []
    # the next within: strictly later, the limit included; the nearest to a lag
    x = series((0.0, 1.0), (0.0, 1.0), (2.0, 1.0), (4.5, 1.0))
    assert rows(sequence.next_where(x, ["e"], "t", "id", F.col("v") == 1, 2.0), "id", "next_t") == [(0, 2.0), (1, 2.0), (2, None), (3, None)]
    lagged = lambda *r, **k: dict(rows(sequence.asof_lagged(series(*r), ["e"], "t", "id", "v", 2.0, k.get("most", 4.0), 1.0), "id", "lagged_value"))
    assert lagged((0.0, 5.0), (0.0, 6.0), (2.0, 7.0), (3.0, 8.0)) == {0: None, 1: None, 2: 5.0, 3: 5.0}
    assert lagged((0.5, 5.0), (1.5, 6.0), (3.0, 8.0))[2] == 5.0 and lagged((0.0, 5.0), (3.0, 8.0))[1] == 5.0 and lagged((0.0, 5.0), (3.01, 8.0))[1] is None
    assert lagged((0.0, 5.0), (3.0, 8.0), most=2.5)[1] is None
    # frames times the interval: one frame lasts as long as any
    f = spark.createDataFrame([(0, k * 2, k / 15, s, p, "A", 1.0, 0.0, 0.0, True) for k, (s, p) in enumerate([("free", None), ("controlled", "a"), ("controlled", "a"), ("free", None)])], "m int, f int, t double, status string, player string, team string, first_m double, bx double, by double, detected boolean")
    assert rows(possession.segments(f, ["m"], "f", "t"), "start_frame", "seconds") == [(0, pytest.approx(1 / 15)), (2, pytest.approx(2 / 15)), (6, pytest.approx(1 / 15))]
    # a side of no length counts as a pixel
    box = lambda *r: [F.lit(float(v)) for v in r]
    r = spark.range(1).select(*[c.alias(n) for n, c in zip(("iou", "inside"), geometry.box_overlap(box(0, 0, 2, 2), box(1, 1, 1, 3)), strict=True)]).first()
    assert (r["iou"], r["inside"]) == (0.0, 0.0)
    r = spark.range(1).select(geometry.box_overlap(box(0, 0, 2, 2), box(1, 0, 1.5, 2))[1].alias("inside")).first()
    assert r["inside"] == 0.5
    # repeated keys of a layer keep the base's rows
    base = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, s string")
    layer = spark.createDataFrame([(1, "x"), (1, "y"), (1, None), (None, "z")], "k int, s string")
    assert rows(review.overlay(base, [layer], ["k"], ["s"]), "k", "s") == [(1, "y"), (2, "b"), (None, "c")]
    assert rows(matching.upsert(base, layer, "k", "s", ["y", "b"], "d"), "k", "s") == [(1, "y"), (2, "b"), (None, "d")]

"""Momentum against a plain loop over frames."""

import math
import random

import pytest

from tactigrid.operators import momentum as M

W, L = 30.0, 50.0


def plain(frames, events, duration, width=5.0, window=30.0):
    """Bins of one match: (a_raw, b_raw, confidence, smooth, score)."""
    n = max(1, math.ceil(duration / width))
    b = [{"n": 0, "A": 0.0, "B": 0.0, "ca": 0, "cb": 0, "sure": [], "dir": 0, "periods": {}, "eA": 0.0, "eB": 0.0, "w": 0.0, "wc": 0.0} for _ in range(n)]
    history, state = [], None
    for t, status, team, period, direction, c, x, y in sorted(frames):
        if t >= duration:
            continue
        k = b[min(n - 1, int(t // width))]
        k["n"] += 1
        if status != "controlled":
            history, state = [], None
            continue
        if team is None:
            continue
        k["ca" if team == "A" else "cb"] += 1
        k["sure"].append(c)
        k["periods"][period or "unknown"] = k["periods"].get(period or "unknown", 0) + 1
        if x is None or direction not in ("towards_y_min", "towards_y_max"):
            continue
        p = min(1.0, max(0.0, y / L))
        p = p if direction == "towards_y_max" else 1 - p
        if state is None or state[1:] != (team, period, direction) or t - state[0] > 1.5:
            history = []
        k["dir"] += 1
        near = [h for h in history if 0 < t - h[0] <= 1.5 and abs(t - h[0] - 1.0) <= 0.5]
        bonus = 0.0
        if near:
            q = min(near, key=lambda h: abs(t - h[0] - 1.0))[1]
            bonus = min(1.0, max(0.0, (p - q) * L / 6.0)) * 0.3
        history.append((t, p))
        state = (t, team, period, direction)
        k[team] += c * (0.1 + 0.9 * p**1.8 + bonus)
    for t, team, bonus, c in events:
        if t < duration:
            k = b[min(n - 1, int(t // width))]
            k["e" + team] += bonus
            k["w"] += bonus
            k["wc"] += bonus * c
    out, last, was, sure_at, alpha = [], None, None, None, 2 / (round(window / width) + 1)
    for i, k in enumerate(b):
        m = max(1, k["n"])
        pa, pb, ea, eb = k["A"] / m, k["B"] / m, min(0.4, k["eA"]), min(0.4, k["eB"])
        held = k["ca"] + k["cb"]
        place = (sum(k["sure"]) / len(k["sure"]) if k["sure"] else 0) * k["dir"] / max(1, held) * math.sqrt(held / m)
        event = k["wc"] / k["w"] if k["w"] else 0
        total = pa + pb + ea + eb
        c = (place * (pa + pb) + event * (ea + eb)) / total if total else 0.0
        signed, period, ok, t = pa + ea - pb - eb, max(k["periods"], key=lambda p: (k["periods"][p], p)) if k["periods"] else None, total > 0 and c > 0, (i + 0.5) * width
        anew = last is None or period and was and period != was or ok and sure_at is not None and t - sure_at >= 20
        last = signed if anew else alpha * signed + (1 - alpha) * last
        was, sure_at = period or was, t if ok else sure_at
        out.append([pa + ea, pb + eb, c, last])
    sizes = sorted(abs(r[3]) for r in out if abs(r[3]) > 1e-12)
    at = (len(sizes) - 1) * 0.95
    scale = max(0.15, sizes[int(at)] * (1 - at % 1) + sizes[math.ceil(at)] * (at % 1)) if sizes else 0.15
    return [(*r, min(100.0, max(-100.0, r[3] / scale * 100))) for r in out]


FRAMES = "match int, frame int, t double, status string, team string, period string, direction string, confidence double, bx double, by double"
PASSES = "match int, t double, team string, outcome string, review_status string, confidence double, forward_m double, restart string"
RESTARTS = "match int, restart string, t double, team string, restart_type string, review_status string, confidence double"


def frames(seed):
    r, out, t = random.Random(seed), [], 0.0
    team, x, y = "A", 10.0, 20.0
    while t < 200:
        t = round(t + r.choice([0.25, 0.25, 0.5, 1.0, 1.75, 30.0 if r.random() < 0.05 else 0.25]), 2)
        team = r.choice("AB") if r.random() < 0.15 else team
        y = min(55.0, max(-3.0, y + r.uniform(-3, 3)))
        status = r.choice(["free", "unknown"]) if r.random() < 0.1 else "controlled"
        some = r.random() > 0.05
        direction = ("towards_y_max" if (team == "A") == (t < 100) else "towards_y_min") if r.random() > 0.03 else "unknown"
        out.append((t, status, team if r.random() > 0.03 else None, "p1" if t < 100 else "p2", direction, round(r.random(), 2), x if some else None, y if some else None))
    return out


def test_momentum(spark):
    each = {m: frames(m) for m in (1, 2)}
    rows = [(m, i, *f) for m, fs in each.items() for i, f in enumerate(fs)]
    passes = [(1, 12.0, "A", "completed_pass", "accepted", 0.8, 5.0, None), (1, 13.0, "A", "completed_pass", None, 0.9, 50.0, None), (1, 14.0, "B", "failed_pass", "uncertain", 0.5, 20.0, "r1"), (1, 15.0, "B", "excluded_non_pass", "accepted", 1.0, 9.0, None), (1, 16.0, "A", "completed_pass", "rejected", 1.0, 9.0, None), (1, 500.0, "A", "completed_pass", "accepted", 1.0, 9.0, None)]
    restarts = [(1, "r1", 13.5, "B", "corner", "accepted", 0.9), (1, "r2", 40.0, "B", "kick_in", "needs_review", 0.5), (1, "r3", 41.0, "B", "goal_kick", "accepted", 0.5)]
    got = M.momentum(spark.createDataFrame(rows, FRAMES).repartition(5), spark.createDataFrame(passes, PASSES), spark.createDataFrame(restarts, RESTARTS), spark.createDataFrame([(1, 203.0), (2, 120.0)], "match int, duration double"), ["match"], W, L)
    events = [(12.0, "A", (0.10 + 0.125) * 0.8, 0.8), (13.0, "A", (0.10 + 0.25) * 0.9 * 0.7, 0.9), (14.0, "B", (0.035 + 0.05) * 0.5 * 0.45, 0.5), (40.0, "B", 0.025 * 0.5 * 0.6, 0.5)]
    for m, duration in ((1, 203.0), (2, 120.0)):
        mine = [(r["a_raw"], r["b_raw"], r["confidence"], r["smooth"], r["score"]) for r in got.where(f"match = {m}").orderBy("bin").collect()]
        want = plain(each[m], events if m == 1 else [], duration)
        assert len(mine) == len(want) == math.ceil(duration / 5)
        for a, b in zip(mine, want, strict=True):
            assert a == pytest.approx(b, abs=1e-9)


def test_smoothing_resets(spark):
    # 19.9 and 20 seconds since the last reliable bin, a period that changes, unreliable bins that are gone through
    points = lambda *r: spark.createDataFrame([(0, k, *x) for k, x in r], "match int, bin int, signed double, period string, reliable boolean")
    of = lambda *r, width=5.0: [round(x["smooth"], 6) for x in M.smoothed(points(*r), ["match"], width).orderBy("bin").collect()]
    a = 2 / 7
    assert of((0, (1.0, "p", True)), (1, (0.0, "p", False)), (2, (0.0, None, False))) == [1.0, round(1 - a, 6), round((1 - a) ** 2, 6)]
    assert of((0, (1.0, "p", True)), (4, (0.0, "p", True))) == [1.0, 0.0] and of((0, (1.0, "p", True)), (3, (0.0, "p", True))) == [1.0, round(1 - a, 6)]
    assert of((0, (1.0, "p", True)), (4, (0.0, "p", False))) == [1.0, round(1 - a, 6)] and of((0, (1.0, "p", True)), (1, (0.0, "q", True))) == [1.0, 0.0]
    assert of() == []


def test_empty(spark):
    none = lambda s: spark.createDataFrame([], s)
    got = M.momentum(none(FRAMES), none(PASSES), none(RESTARTS), spark.createDataFrame([(1, 12.0)], "match int, duration double"), ["match"], W, L).collect()
    assert [(r["samples"], r["score"], r["dominant"]) for r in got] == [(0, 0.0, None)] * 3


def test_no_table_is_sent_to_every_task(spark):
    """Small files of many events and matches unfold to far more than their size, so a plan made by that size filled the driver."""
    from tactigrid.plans import play

    plan = play.e7(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan

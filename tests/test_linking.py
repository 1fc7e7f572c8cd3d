"""Chains, accepted links and chosen frames against plain versions."""

import hashlib
import math
import random

from tactigrid.operators import linking, selection

T = "match int, id int, start double, stop double, x0 double, y0 double, x1 double, y1 double, team string, red double, green double, blue double"


def plain_chains(tracklets, gap=3.0, speed=9.5, far=12.0):
    players, out = [], {}
    for _, i, a, b, x0, y0, x1, y1, team, *rgb in sorted(tracklets, key=lambda t: (t[2], t[2] - t[3], t[1])):
        best = None
        for n, p in enumerate(players):
            wait = a - p["stop"]
            if a <= p["stop"] - 0.05 or wait > gap:
                continue
            d = math.hypot(p["x"] - x0, p["y"] - y0)
            if d > far or d / max(wait, 0.4) > speed or p["team"] not in (None, "U") and team not in (None, "U") and p["team"] != team:
                continue
            c = min(1.0, math.dist(p["rgb"], rgb) / 180) if p["rgb"][0] is not None and rgb[0] is not None else 0.35
            s = round(d + wait * 1.2 + c * 4, 4)
            if best is None or s < best[0]:
                best = (s, n)
        if best is None:
            players.append({"stop": b, "x": x1, "y": y1, "team": team, "rgb": rgb, "n": 1})
            out[i] = (len(players), None)
        else:
            p = players[best[1]]
            p["n"] += 1
            p["stop"], p["x"], p["y"] = max(p["stop"], b), x1, y1
            if p["rgb"][0] is not None and rgb[0] is not None:
                p["rgb"] = [round((u * (p["n"] - 1) + v) / p["n"], 2) for u, v in zip(p["rgb"], rgb, strict=True)]
            elif rgb[0] is not None:
                p["rgb"] = rgb
            p["team"] = team if p["team"] in (None, "U") else p["team"]
            out[i] = (best[1] + 1, best[0])
    return out


def tracklets(seed, n=150):
    r, t = random.Random(seed), 0.0
    for i in range(n):
        t += r.choice([0.0, 0.3, 1.0, 1.0, 6.0])
        rgb = [None] * 3 if r.random() < 0.2 else [float(r.randrange(256)) for _ in range(3)]
        yield (seed, i, round(t, 2), round(t + r.choice([0.5, 1.5, 3.0]), 2), *[round(r.uniform(0, 14), 2) for _ in range(4)], r.choice(["A", "B", "U", None]), *rgb)


def test_chains(spark):
    rows = [*tracklets(1), *tracklets(2)]
    got = linking.chained(spark.createDataFrame(rows, T).repartition(5), ["match"]).collect()
    want = {(m, i): v for m in (1, 2) for i, v in plain_chains([t for t in rows if t[0] == m]).items()}
    assert {(r["match"], r["id"]): (r["player"], r["score"]) for r in got} == want
    assert any(s is not None for _, s in want.values()) and linking.chained(spark.createDataFrame([], T), ["match"]).count() == 0


def plain_accept(links, spans, gap):
    chain, after, before, out = {t: [t] for t in spans}, set(), set(), {}
    for key, a, b, _ in sorted(links, key=lambda x: (x[3], x[0])):
        if a not in spans or b not in spans:
            out[key] = "ineligible_or_missing_tracklet"
        elif spans[b][0] <= spans[a][1]:
            out[key] = "temporal_overlap"
        elif spans[b][0] - spans[a][1] > gap:
            out[key] = "gap_too_large"
        elif {spans[a][2], spans[b][2]} == {"A", "B"}:
            out[key] = "team_mismatch"
        elif a in after:
            out[key] = "source_successor_already_assigned"
        elif b in before:
            out[key] = "target_predecessor_already_assigned"
        elif any(spans[x][0] <= spans[y][1] and spans[y][0] <= spans[x][1] for x in chain[a] for y in chain[b]):
            out[key] = "component_temporal_conflict"
        else:
            out[key] = None
            after.add(a)
            before.add(b)
            new = chain[a] + chain[b]
            for t in new:
                chain[t] = new
    return out


def test_accepted_links(spark):
    r = random.Random(4)
    spans = {i: (a := round(r.uniform(0, 60), 2), round(a + r.uniform(0.2, 4), 2), r.choice(["A", "B", "U"])) for i in range(60)}
    links = [(f"{a}>{b}", a, b, round(r.random(), 1)) for a, b in {(r.randrange(60), r.randrange(62)) for _ in range(900)} if a != b]
    t = spark.createDataFrame([(i, *s) for i, s in spans.items()], "id int, start double, stop double, team string")
    df = spark.createDataFrame(links, "key string, source int, target int, cost double").repartition(4)
    got = {x["key"]: x["reason"] for x in linking.accepted(df, t, gap=8.0).collect()}
    want = plain_accept(links, spans, 8.0)
    assert {k: (got.get(k, "?"), v) for k, v in want.items() if got.get(k, "?") != v} == {}
    assert len(got) == len(want) and sum(v is None for v in want.values()) > 10
    assert {x["reason"] for x in linking.accepted(df, t, gap=8.0, most=1).collect()} <= {*want.values(), "too_large"}


def test_diverse_frames(spark):
    r = random.Random(5)
    rows = [(m, f, float(f), r.random(), r.randrange(3), r.sample(range(9), r.randrange(4))) for m in (1, 2) for f in r.sample(range(100), 40)]
    got = selection.diverse(spark.createDataFrame(rows, "match int, frame long, t double, quality double, domain int, subjects array<int>"), ["match"], 100.0, 8, 5.0, 0.2).collect()
    for m in (1, 2):
        mine = sorted((x["place"], x["frame"]) for x in got if x["match"] == m)
        chosen = []
        while len(chosen) < 8:
            seen = {s for c in chosen for s in c[5]}
            able = [x for x in rows if x[0] == m and all(abs(x[2] - c[2]) >= 5 for c in chosen)]
            score = lambda x: 0.58 * x[3] + 0.24 * len(set(x[5]) - seen) / max(1, len(x[5])) + 0.12 * (min(1.0, min(abs(x[2] - c[2]) for c in chosen) / 15.0) if chosen else 1.0) + 0.06 * all(c[4] != x[4] for c in chosen)  # noqa: B023, E731
            if not able or chosen and max(map(score, able)) < 0.2:
                break
            chosen.append(max(able, key=lambda x: (score(x), -x[1])))
        assert mine == [(k + 1, c[1]) for k, c in enumerate(chosen)]


def test_spaced_sample(spark):
    frames = [(m, f) for m in "ab" for f in range(0, 300, 3)] + [("a", 0)]
    got = selection.spaced_sample(spark.createDataFrame(frames, "match string, frame int").repartition(3), ["match"], 9, 20, "s").collect()
    for m in "ab":
        order, chosen = sorted({f for k, f in frames if k == m}, key=lambda f: hashlib.sha256(f"s/{m}/{f}".encode()).hexdigest()), []
        for f in order:
            if len(chosen) < 9 and all(abs(f - g) >= 20 for g in chosen):
                chosen.append(f)
        assert sorted((x["place"], x["frame"]) for x in got if x["match"] == m) == list(enumerate(chosen, 1))

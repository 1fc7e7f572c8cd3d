"""Resolved rows, carried reviews and lookups in time."""

import math
import random

from pyspark.sql import functions as F

from tactigrid.operators import resolved

A = "assignment string, subject int, player string, team string, sure double, start int, stop int"
R = "subject int, frame int, source string, inside boolean, trusted boolean, confidence double, x double, y double"


def plain(assignments, rows, most):
    order = {"detected": 4, "ambiguous": 3, "predicted": 2, "missing": 1}
    rank = lambda a, r: (order.get(r[2], 0), r[3] is not False, r[4] is not False, a[4] or 0.0, r[5] or 0.0)
    best = {}
    for r in rows:
        for a in assignments:
            if a[2] and a[1] == r[0] and a[5] <= r[1] <= a[6]:
                best[r[:2]] = max(best.get(r[:2], ((),)), (rank(a, r), a[0], a, r))
    players = {}
    for k, i, a, r in best.values():
        players.setdefault(a[2], {}).setdefault(r[1], []).append((k, i, a, r))
    frames = {}
    for p, by in players.items():
        place = None
        for f in sorted(by):
            at = lambda r: (r[6], r[7]) if r[6] is not None and r[7] is not None else None
            k, i, a, r = max(by[f], key=lambda c: (c[0], -math.dist(place, at(c[3])) if place and at(c[3]) else -1e6, c[1]))  # noqa: B023
            place = at(r) or place
            frames.setdefault((a[3] or "U", f), []).append((k, i, p, f, r[0]))
    return {(p, f, s, i) for (team, _), v in frames.items() for k, i, p, f, s in sorted(v, reverse=True)[: None if team == "U" else most]}


def test_resolved_rows(spark):
    r = random.Random(6)
    assignments = []
    for i in range(40):
        start = r.randrange(50)
        assignments.append((f"a{i:02}", r.randrange(6), r.choice("pqrstu") if i else None, r.choice(["A", "B", None]), r.choice([0.5, 0.9, None]), start, start + r.randrange(-1, 30)))
    team = {}
    assignments = [(*a[:3], team.setdefault(a[2], a[3]), *a[4:]) for a in assignments]
    place = lambda: None if r.random() < 0.1 else r.uniform(0, 9)
    rows = [(s, f, r.choice(["detected", "detected", "missing", "odd"]), r.choice([True, True, False, None]), r.choice([True, None]), r.choice([0.3, 0.6]), place(), place()) for s in range(6) for f in range(80) if r.random() < 0.8]
    for most in (7, 1):
        got = resolved.resolved_rows(spark.createDataFrame(assignments, A).repartition(3), spark.createDataFrame(rows, R).repartition(4), most, 16.0)
        assert {(x["player"], x["frame"], x["subject"], x["assignment"]) for x in got.collect()} == plain(assignments, rows, most)
    assert resolved.resolved_rows(spark.createDataFrame([], A), spark.createDataFrame(rows, R)).count() == 0


def test_carried_reviews(spark):
    reviews = spark.createDataFrame([("k1", 1, 2, "accepted"), ("k2", 3, 4, "rejected"), ("k2", 5, 6, "accepted"), (None, 7, None, "uncertain"), ("", None, None, "accepted")], "key string, a int, b int, status string")
    new = spark.createDataFrame([(1, "k1", 3, 4), (2, "k2", 1, 2), (3, "kx", 3, 4), (4, None, 7, None), (5, "", None, None), (6, None, 9, 9)], "id int, key string, a int, b int")
    x = resolved.carried_over(new, reviews, "id", [("key",), ("a", "b")], ["status"])
    got = {r["id"]: (r["status"], r["migration"], r["matched_by"]) for r in x.collect()}
    assert got == {1: ("accepted", "restored", "key"), 2: (None, "ambiguous_existing_review", "key"), 3: ("rejected", "restored", "a+b"), 4: ("uncertain", "restored", "a+b"), 5: (None, None, None), 6: (None, None, None)}


def test_snapshots(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0), (3, "c", 3.0)], "k int, v string, at double")
    a = resolved.snapshot(df, ["k"], ["v"])
    b = resolved.snapshot(df.where("k < 3").withColumns({"v": F.when(F.col("k") == 2, "b").otherwise(F.col("v")), "at": F.lit(9.0)}).unionByName(spark.createDataFrame([(4, "d", 0.0)], df.schema)), ["k"], ["v"])
    assert sorted(map(tuple, resolved.changed(a, b, ["k"]).collect())) == [(2, "changed"), (3, "removed"), (4, "added")] and resolved.changed(a, a, ["k"]).count() == 0
    versions = spark.createDataFrame([(1, 10, "x"), (1, 20, "y"), (1, 20, "z"), (2, 5, "w")], "k int, since int, s string")
    points = spark.createDataFrame([(1, 9), (1, 10), (1, 19), (1, 20), (2, 99), (3, 1), (1, 10)], "k int, t int")
    got = sorted(map(tuple, resolved.as_of(points, versions, ["k"], "t", "since", ["s"]).collect()), key=str)
    assert got == sorted([(1, 9, None), (1, 10, "x"), (1, 10, "x"), (1, 19, "x"), (1, 20, "z"), (2, 99, "w"), (3, 1, None)], key=str)

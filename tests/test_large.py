"""What must not grow with the square of a table."""

import tracemalloc

import numpy as np

from tactigrid.operators import aggregates, tracker


def test_a_frame_of_many_tracks_takes_little_room():
    t = tracker.Tracker(reach=2.0)
    places = np.column_stack([np.arange(30_000) * 10.0, np.zeros(30_000)])
    assert t.step(0, places) == list(range(1, 30_001))
    tracemalloc.start()
    found = t.step(1, np.concatenate([places[::10] + 1.0, [[5.0, 0.0]]]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [*range(1, 30_001, 10), 30_001] and peak < 100e6


def test_more_queries_than_a_task_holds(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(60, 4))
    v[7], v[20:23] = v[5], v[40]
    label = [i % 3 if i < 54 else None for i in range(60)]
    table = spark.createDataFrame([(i, g, x.tolist() if i % 17 else None) for i, (g, x) in enumerate(zip(label, v, strict=True))], "id long, g int, v array<double>")
    queries = table.where("id % 2 = 0").selectExpr("id AS query_id", "g", "v AS q")
    got = {}
    for x in sorted(aggregates.nearest(queries, table, "g", 4, rows=4).collect(), key=lambda x: (x["query_id"], x["rank"])):
        got.setdefault(x["query_id"], []).append((x["distance"], x["id"]))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    far = lambda a, b: 2.0 if a % 17 == 0 or b % 17 == 0 else round(1 - min(1.0, u[a] @ u[b]), 6)
    want = {a: sorted((far(a, b), b) for b in range(54) if b != a and b % 3 == a % 3)[:4] for a in range(0, 54, 2)}
    assert got == want


def test_small_groups_are_fed_as_tuples(spark):
    """Many groups of a few rows: no frame is made for a group, and integers beside nulls stay integers."""
    from tactigrid.operators import grouped

    rows = [(k, i, None if i else k) for k in range(3000) for i in range(k % 3 + 1)] + [(None, 7, 5)]
    df = spark.createDataFrame(rows, "k long, i long, v long")

    def work(given):
        assert isinstance(given, list) and all(isinstance(x, (int, type(None))) for r in given for x in r)
        return [(len(given), sum(v or 0 for _, v in given))]

    got = {(r["k"], r["n"], r["s"]) for r in grouped.together(df, ["k"], ["i"], ["i", "v"], work, "n long, s long").collect()}
    assert got == {(k, k % 3 + 1, k) for k in range(3000)} | {(None, 1, 5)}

"""Exact top-k search against brute force."""

import math

import numpy as np
import pytest

from tactigrid.llm import mtree, registry

SCHEMA = "vec_id long, embedding array<double>, rank string, score int, cell int"


def brute(rows, every, k):
    """(query_id, rank, vec_id, score) of rows (vec_id, vector)."""
    fine = lambda v: v is not None and all(x is not None and math.isfinite(x) and abs(x) < 2.0**54 for x in v)
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if fine(v)]
    out = []
    for at, (i, q) in enumerate(rows):
        if i is None or i % every:
            continue
        found = [(-sum(a * b for a, b in zip(q, v, strict=True)), j is None, j) for n, (j, v) in enumerate(rows) if n != at and len(v) == len(q)]
        for rank, (s, _, j) in enumerate(sorted(found)[:k]):
            out.append((i, rank + 1, j, min(max(-s, -(2**63)), 2**63 - 1)))
    return out


def same(got, want):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(want, key=key)


def table(spark, rows):
    return spark.createDataFrame([(i, v, "r", 1, 2) for i, v in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("sizes", [{"page": 4, "shard": 20, "pivots": 4}, {"page": 128, "shard": 8192, "pivots": 64}])
def test_against_brute_force(spark, sizes):
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] * (1 + i % 3) + r.normal(size=8) * 0.05).tolist()) for i in range(300)]
    rows += [(300 + i, centres[0].tolist()) for i in range(60)]  # copies, more than a shard holds
    rows += [(None, centres[0].tolist()), (50, centres[1].tolist()), (50, centres[1].tolist()), (400, None), (401, [math.nan] * 8), (402, [math.inf] + [0.0] * 7), (403, [None] + [1.0] * 7)]
    rows += [(450, [0.0] * 8), (500, [1.0, 2.0]), (501, [2.0, 1.0]), (550, []), (551, []), (600, [1e9] * 8), (601, [-1e15] * 8), (602, [1e17] + [0.0] * 7), (650, [7.0] * 3)]
    got = mtree.search_every(table(spark, rows), 10, 5, **sizes).collect()
    same(got, brute(rows, 10, 5))
    if sizes["page"] == 4:
        first = [x for x in got if x["query_id"] == 310][0]
        assert first["computed"] < 300  # the bounds leave far clusters out


def test_empty(spark):
    assert mtree.search_every(table(spark, [])).count() == 0
    assert mtree.search_every(table(spark, [(0, None), (1, [1.0])])).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    same(registry.op11_exact_top_k(spark, sf).collect(), brute(rows, 50, 5))

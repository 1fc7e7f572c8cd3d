"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine >= c are at most epsilon = sqrt(2 - 2 c) apart. Vectors are rotated to
their principal axes and sorted by the grid cells (of width epsilon) of the leading ones. The
sequence is cut into intervals with bounding boxes; two intervals whose boxes are more than epsilon
apart hold no pair. Pairs of intervals that are not provably distant are joined, each in a task that
holds the first interval and takes the second one page by page; so a vector is sent once for each
interval, and intervals are as few as keep all tasks busy and fit a task's memory. A task halves both
sides again and again, skipping distant halves, down to small leaves, whose cosines one matrix
product gives. Cosines near the threshold are computed again in double precision.

Equal vectors count as one node with a multiplicity. A task gives each node's number of links and
only so many edges as connect what it has linked, never all pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph, store

COSINE = 0.95
#: Leading principal axes that order the grid and bound the boxes.
AXES = 12
#: Vectors of an interval at most, about, and at least where there are several.
INTERVAL, LEAST = 65_536, 4096
PAGE = 2048
LEAF = 256
#: Single-precision cosines within this of the threshold are computed again.
MARGIN = 1e-4


def usable() -> Column:
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(e, lambda x: x != 0), F.lit(False))


def moments(points: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal axes (by falling variance) of unit vectors, from one row of sums for each task."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, ss = 0, np.zeros(d), np.zeros((d, d))
        for b in batches:
            if len(b):
                u = unit(b["v"])
                n, s, ss = n + len(u), s + u.sum(0), ss + u.T @ u
        yield pd.DataFrame({"i": np.arange(d * d + d + 1), "x": np.concatenate((ss.ravel(), s, [n]))})

    x = points.mapInPandas(work, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i")["x"].to_numpy()
    n = max(x[-1], 1.0)
    mean = x[d * d : -1] / n
    _, axes = np.linalg.eigh(x[: d * d].reshape(d, d) / n - np.outer(mean, mean))
    return mean, axes[:, ::-1]


def unit(v: pd.Series) -> np.ndarray:
    x = np.array(v.tolist(), np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow, no underflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Tree:
    """Union-find over places, which may be added to."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def grow(self, n: int) -> None:
        self.up = np.append(self.up, np.arange(len(self.up), len(self.up) + n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def roots(self, places: np.ndarray) -> np.ndarray:
        at = self.up[places]
        while (far := self.up[at] != at).any():
            at[far] = self.up[at[far]]
        self.up[places] = at
        return at

    def tie(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        """Those of the pairs (i, j) that join what was apart."""
        a, b = self.roots(i), self.roots(j)
        apart = a != b
        if not apart.any():
            return []
        _, first = np.unique(a[apart] * len(self.up) + b[apart], return_index=True)
        out = []
        for s, t in zip(i[apart][first].tolist(), j[apart][first].tolist(), strict=True):
            s2, t2 = self.find(s), self.find(t)
            if s2 != t2:
                self.up[t2] = s2
                out.append((s, t))
        return out


def join(x: np.ndarray, px: np.ndarray, y: np.ndarray, py: np.ndarray, same: bool, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (i, j) with cosine or more of unit vectors, leaf by leaf; px, py: coordinates on the leading axes; same: x is y, pairs i < j."""
    eps2 = 2 - 2 * cosine + 1e-9
    stack = [(0, len(x), 0, len(y))]
    single = x.astype(np.float32), y.astype(np.float32)
    while stack:
        a, b, c, d = stack.pop()
        if same and d <= a or a == b or c == d:
            continue
        gap = np.maximum(0, np.maximum(px[a:b].min(0) - py[c:d].max(0), py[c:d].min(0) - px[a:b].max(0)))
        if gap @ gap > eps2:
            continue
        if b - a > LEAF or d - c > LEAF:
            halves = [(a, (a + b) // 2), ((a + b) // 2, b)] if b - a > LEAF else [(a, b)]
            others = [(c, (c + d) // 2), ((c + d) // 2, d)] if d - c > LEAF else [(c, d)]
            stack += [(*h, *o) for h in halves for o in others]
            continue
        near = single[0][a:b] @ single[1][c:d].T
        i, j = np.nonzero(near >= cosine - MARGIN)
        if not len(i):
            continue
        good = near[i, j] >= cosine + MARGIN
        i, j = i + a, j + c
        unsure = np.flatnonzero(~good)
        good[unsure] = np.einsum("ij,ij->i", x[i[unsure]], y[j[unsure]]) >= cosine
        if same:
            good &= i < j
        if good.any():
            yield i[good], j[good]


def pages(points: DataFrame, mean: np.ndarray, axes: np.ndarray, cosine: float, intervals: int) -> DataFrame:
    """The sequence's pages: part (the interval), page, ids, copies, vectors (float32 bytes), low, high (box on the leading axes)."""
    k = min(AXES, axes.shape[0])
    eps = (2 - 2 * cosine) ** 0.5

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                p = (unit(b["v"]) - mean) @ axes[:, :k]
                cell = np.floor(p / eps).astype(np.int32)
                yield pd.DataFrame({"node": b["node"], "copies": b["copies"], "v": b["v"], "cell": list(cell), "first": p[:, 0]})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= PAGE:
                whole = pd.concat(held)
                for i in range(0, len(whole) - PAGE + 1, PAGE):
                    yield pack(whole.iloc[i : i + PAGE])
                held = [whole.iloc[len(whole) // PAGE * PAGE :]]
        if sum(map(len, held)):
            yield pack(pd.concat(held))

    def pack(b: pd.DataFrame) -> pd.DataFrame:
        p = (unit(b["v"]) - mean) @ axes[:, :k]
        v = np.array(b["v"].tolist(), np.float32)
        return pd.DataFrame({"ids": [b["node"].to_numpy(np.int64).tobytes()], "copies": [b["copies"].to_numpy(np.int64).tobytes()], "vectors": [v.tobytes()], "low": [p.min(0)], "high": [p.max(0)]})

    ordered = points.mapInPandas(cells, "node long, copies long, v array<float>, cell array<int>, first double").repartitionByRange(intervals, "cell", "first", "node").sortWithinPartitions("cell", "first", "node")
    x = ordered.mapInPandas(cut, "ids binary, copies binary, vectors binary, low array<double>, high array<double>")
    return x.withColumns({"part": F.spark_partition_id(), "page": F.monotonically_increasing_id()})


def linked(points: DataFrame, d: int, cosine: float) -> DataFrame:
    """(node, other, links): a node's number of linked copies of other nodes in a row for each task, and edges where other is not null."""
    mean, axes = moments(points, d)
    k, n = min(AXES, d), store.partitions(points.sparkSession)
    rows = points.count()
    # A pair of intervals is a task: there should be two for each partition, unless that makes intervals too small.
    intervals = max(-(-rows // INTERVAL), min(math.isqrt(4 * n) + 1, -(-rows // LEAST)))
    cut = store.table(pages(points, mean, axes, cosine, intervals), "egrid-pages")
    boxes = cut.groupBy("part").agg(F.array(*[F.min(F.get("low", F.lit(i))) for i in range(k)]).alias("low"), F.array(*[F.max(F.get("high", F.lit(i))) for i in range(k)]).alias("high"))
    eps2 = 2 - 2 * cosine + 1e-9
    gap = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(0.0), lambda s, i: s + F.pow(F.greatest(F.lit(0.0), F.get("low", i) - F.get("high2", i), F.get("low2", i) - F.get("high", i)), F.lit(2.0)))
    other = boxes.select(F.col("part").alias("part2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    pairs = store.table(boxes.join(F.broadcast(other), (F.col("part") <= F.col("part2")) & (gap <= eps2)).select("part", "part2"), "egrid-pairs")
    sent = cut.select("part", "page", "ids", "copies", "vectors")
    first = sent.join(F.broadcast(pairs), "part").select("part", "part2", F.lit(0).alias("side"), "page", "ids", "copies", "vectors")
    second = sent.withColumnRenamed("part", "part2").join(F.broadcast(pairs.where("part != part2")), "part2").select("part", "part2", F.lit(1).alias("side"), "page", "ids", "copies", "vectors")

    def opened(r) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        v = np.frombuffer(r.vectors, np.float32).reshape(-1, d).astype(np.float64)
        v = v / np.abs(v).max(axis=1, keepdims=True)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        return np.frombuffer(r.ids, np.int64), np.frombuffer(r.copies, np.int64), v, (v - mean) @ axes[:, :k]

    def counted(ids: np.ndarray, total: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"node": ids[total > 0], "other": pd.array([None] * int((total > 0).sum()), "Int64"), "links": total[total > 0]})

    def meet(a: tuple, b: tuple, tree: Tree, off: int, same: bool) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
        """Edges between what was apart (places of a, and of b after off), and both sides' numbers of linked copies."""
        edges, left, right = [], np.zeros(len(a[0]), np.int64), np.zeros(len(b[0]), np.int64)
        for i, j in join(a[2], a[3], b[2], b[3], same, cosine):
            for total, at, copies in ((left, i, b[1][j]), (right, j, a[1][i])):
                lo, hi = at.min(), at.max() + 1
                total[lo:hi] += np.bincount(at - lo, copies, minlength=hi - lo).astype(np.int64)
            edges += tree.tie(i, j + off)
        return edges, left, right

    def task(held: list[tuple], others: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        """The pairs within an interval if there are no others, else those of it with the pages of another."""
        a = tuple(np.concatenate(x) for x in zip(*held, strict=True))
        tree, alone = Tree(len(a[0])), True
        total = np.zeros(len(a[0]), np.int64)
        for b in others:
            alone, off = False, len(tree.up)
            tree.grow(len(b[0]))
            edges, left, right = meet(a, b, tree, off, False)
            total += left
            yield counted(b[0], right)
            if edges:
                s, t = (np.array(x) for x in zip(*edges, strict=True))
                yield pd.DataFrame({"node": a[0][s], "other": pd.array(b[0][t - off], "Int64"), "links": 0})
        if alone:
            edges, left, right = meet(a, a, tree, 0, True)
            total += left + right
            if edges:
                s, t = (np.array(x) for x in zip(*edges, strict=True))
                yield pd.DataFrame({"node": a[0][s], "other": pd.array(a[0][t], "Int64"), "links": 0})
        yield counted(a[0], total)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in b.itertuples())
        for _, mine in itertools.groupby(rows, lambda r: (r.part, r.part2)):
            sides = itertools.groupby(mine, lambda r: r.side)
            held = [opened(r) for r in next(sides)[1]]
            yield from task(held, (opened(r) for _, side in sides for r in side))

    dealt = first.unionAll(second).repartition(max(n, 2 * pairs.count()), "part", "part2").sortWithinPartitions("part", "part2", "side", "page")
    return dealt.mapInPandas(work, "node long, other long, links long")


def near(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """A row for each row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing;
    vectors of different lengths do not link with each other. Repeated rows keep their rows and link with
    each other, as any equal vectors do. A null vec_id's component is null where no other is
    reachable. Further columns are ignored; an empty table gives an empty table.
    """
    rows = vectors.select("vec_id", "embedding", usable().alias("good"))
    sizes = [r["d"] for r in rows.where("good").groupBy(F.size("embedding").alias("d")).count().orderBy("d").collect()]
    alone = lambda x: x.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not sizes:
        return alone(rows)
    same = rows.where("good").groupBy("embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    same = store.table(same.withColumn("node", F.monotonically_increasing_id()), "egrid-nodes")
    got = None
    for d in sizes:
        x = same.where(F.size("embedding") == d).select("node", F.col("embedding").alias("v"), "copies")
        x = store.table(linked(x, d, cosine), "egrid-links")
        got = x if got is None else got.unionAll(x)
    joined = graph.components(got.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = got.groupBy("node").agg(F.sum("links").alias("links"))
    base = same.join(joined, "node", "left").join(counts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = base.groupBy("component").agg(F.min("least").alias("component_id"))
    base = store.table(base.join(named, "component").select("embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "egrid-classes")
    full = rows.where("good").join(base, "embedding").select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    return full.unionAll(alone(rows.where("not good")))

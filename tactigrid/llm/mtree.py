"""Exact top-k by inner product with M-trees: paged metric nodes, covering radii, stored distances to the parent.

Vectors are integers. An index has cells, one for each pivot of a bounded sample; a cell's vectors are
split into shards of at most SHARD or so, and each shard holds an M-tree, a row for each page. A page
has the vectors of its entries, their distances to the page's own routing vector and, above the leaves,
the entries' covering radii and largest norms. By |q|^2 + |v|^2 - d(q, v)^2 = 2 q.v and the triangle
inequality, each of these bounds the inner products below an entry, so a best-first search opens pages
by falling bound and computes products only for entries that the stored distances leave open.

A search visits the nearest cell's first shard, and with the k-th score found there every shard whose
cell's bound reaches that score; nothing else is left out, so results are exact.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import store

#: Entries of a page.
PAGE = 128
#: Vectors of a shard, about; a cell with more is split by a hash of its rows.
SHARD = 8192
#: Pivots at most; they are drawn by a hash of the row from the whole table, so their number and size are bounded.
PIVOTS = 1024
#: Queries that meet a shard in one task, about.
BLOCK = 8192
K = 5
EVERY = 50
#: Components below this are multiplied in doubles without rounding, up to 2**12 components.
SMALL = 1 << 20
LONG = (-(1 << 63), (1 << 63) - 1)

AT = ["dim", "cell", "shard"]
PAGES = "dim int, cell int, shard int, page int, leaf boolean, entries binary, to_parent binary, radius binary, norm binary, child array<long>, ids array<string>"


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component in doubles; null if the vector is null or holds a null or non-finite component, or one too large for a long."""
    x = F.transform(embedding, lambda v: F.floor(v.cast("double") * F.lit(float(scale))))
    fine = F.forall(embedding, lambda v: v.isNotNull() & (F.abs(v.cast("double")) * float(scale) < F.lit(2.0**62)))
    return F.when(embedding.isNotNull() & F.coalesce(fine, F.lit(False)), x)


def matrix(rows: list) -> np.ndarray:
    """Rows of integers; of Python's own integers if they could pass a double's 53 bits when multiplied."""
    out = np.array([np.asarray(r, np.int64) for r in rows], np.int64).reshape(len(rows), -1)
    if out.size and (np.abs(out).max() >= SMALL or out.shape[1] > 1 << 12):
        return out.astype(object)
    return out.astype(float)


def norms(m: np.ndarray) -> np.ndarray:
    return (m * m).sum(axis=1).astype(float)


def apart(q2: float, norm: np.ndarray, dot: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(q2 + norm - 2 * dot.astype(float), 0.0))


class Page:
    """Entries (vectors by row), their distances to the routing vector, radii, largest squared norms, and pages or vectors below."""

    def __init__(self, leaf: bool, entries: np.ndarray, to_parent: np.ndarray, radius: np.ndarray, norm: np.ndarray, child: np.ndarray):
        self.leaf, self.entries, self.to_parent, self.radius, self.norm, self.child = leaf, entries, to_parent, radius, norm, child
        self.own = norm if leaf else norms(entries)


def split(m: np.ndarray, at: np.ndarray, page: int) -> list[np.ndarray]:
    """The rows `at` of m in groups of at most `page` rows: again and again halved by which of two far rows is the nearer one, or evenly if all are alike."""
    todo, done = [at], []
    while todo:
        at = todo.pop()
        if len(at) <= page:
            done.append(at)
            continue
        x = m[at].astype(float)
        far = lambda i: ((x - x[i]) ** 2).sum(axis=1)
        a = int(np.argmax(far(0)))
        b = int(np.argmax(far(a)))
        gap = far(a) - far(b)
        order = np.argsort(gap, kind="stable")
        cut = int(np.count_nonzero(gap < 0))
        least = max(1, len(at) // 8)
        if not least <= cut <= len(at) - least:
            cut = len(at) // 2
        todo += [at[order[:cut]], at[order[cut:]]]
    return done


def grow(m: np.ndarray, page: int = PAGE) -> list[Page]:
    """An M-tree over the rows of m, from the leaves up; the last page is the root, and its distances are to its first entry."""
    pages: list[Page] = []
    vectors, radius, norm, child, leaf = m, np.zeros(len(m)), norms(m), np.arange(len(m)), True
    while True:
        groups = split(vectors, np.arange(len(vectors)), page)
        up_vectors, up_radius, up_norm, up_child = [], [], [], []
        for g in groups:
            x = vectors[g]
            middle = x.astype(float).mean(axis=0)
            hub = int(np.argmin(((x.astype(float) - middle) ** 2).sum(axis=1)))
            to_parent = np.sqrt(((x - x[hub]).astype(float) ** 2).sum(axis=1))
            pages.append(Page(leaf, x, to_parent, radius[g], norm[g], child[g]))
            up_vectors.append(x[hub])
            up_radius.append(float((to_parent + radius[g]).max()))
            up_norm.append(float(norm[g].max()))
            up_child.append(len(pages) - 1)
        if len(groups) == 1:
            return pages
        vectors, radius, norm, child, leaf = np.array(up_vectors, m.dtype), np.array(up_radius), np.array(up_norm), np.array(up_child), False


def bound(q2: float, norm: np.ndarray, least: np.ndarray) -> np.ndarray:
    """At most this inner product has q with vectors of up to these squared norms at these distances or farther, whatever is rounded."""
    norm = np.asarray(norm, float)
    return ((q2 + norm) * (1 + 1e-9) - np.maximum(least, 0.0) ** 2 * (1 - 1e-9)) / 2 + 1e-3


def cone(q2: float, dot: np.ndarray, radius: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """The same by q.v = q.c + q.(v - c), for balls around centres whose products with q are dot."""
    return dot.astype(float) + math.sqrt(q2) * radius + 1e-9 * (q2 + norm) + 1e-3


def search(pages: list[Page], q: np.ndarray, k: int, floor: float, skip: int | None) -> tuple[list[tuple[int, int]], int]:
    """The k best places below the last page, without place `skip`, as (score, place), best first, equal scores by place; and how many inner products were computed.

    Places that score below floor can be left out.
    """
    q2 = float((q * q).sum())
    best: list[tuple[int, int]] = []
    least, computed = floor, 0
    heap = [(-math.inf, len(pages) - 1, math.nan)]
    while heap:
        top, at, to_hub = heapq.heappop(heap)
        if -top < least:
            break
        p = pages[at]
        some = slice(None)
        if not math.isnan(to_hub):  # what the stored distances say, before any product
            some = np.flatnonzero(bound(q2, p.norm, np.abs(to_hub - p.to_parent) - p.radius) >= least)
            if not len(some):
                continue
        dot = p.entries[some] @ q
        computed += len(dot)
        child = p.child[some]
        if p.leaf:
            good = np.flatnonzero(dot >= least)
            if len(good):
                found = [(int(s), r) for s, r in zip(dot[good].tolist(), child[good].tolist(), strict=True) if r != skip]
                best = sorted([*best, *found], key=lambda x: (-x[0], x[1]))[:k]
                if len(best) == k:
                    least = max(least, best[-1][0])
            continue
        d = apart(q2, p.own[some], dot)
        high = np.minimum(bound(q2, p.norm[some], d - p.radius[some]), cone(q2, dot, p.radius[some], p.norm[some]))
        for i in np.flatnonzero(high >= least).tolist():
            heapq.heappush(heap, (-float(high[i]), int(child[i]), float(d[i])))
    return best, computed


def packed(m: np.ndarray) -> bytes:
    """Integers in as few bytes each as they need, behind a byte that says how many."""
    m = m.astype(np.int64)
    most = int(np.abs(m).max()) if m.size else 0
    size = next(n for n in (1, 2, 4, 8) if n == 8 or most < 1 << (8 * n - 1))
    return bytes([size]) + m.astype(f"<i{size}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64)


def pages_of(rows: pd.DataFrame, page: int) -> Iterator[tuple]:
    """The pages of a shard's rows (row_, none_, id_, vector); a leaf's children are places in its list of rows, by vec_id, which page -1 holds."""
    rows = rows.sort_values(["none_", "id_", "row_"])
    empty = np.zeros(0).tobytes()
    yield -1, True, empty, empty, empty, empty, rows["row_"].tolist(), [None if none else str(x) for none, x in zip(rows["none_"].tolist(), rows["id_"].tolist(), strict=True)]
    for i, p in enumerate(grow(matrix(rows["vector"].tolist()), page)):
        yield i, p.leaf, packed(p.entries), p.to_parent.tobytes(), p.radius.tobytes(), p.norm.tobytes(), p.child.tolist(), None


def tree(rows: pd.DataFrame) -> tuple[list[Page], list, list]:
    """The tree of a shard's page rows, and by place its rows' numbers and ids."""
    pages, numbers, ids = [], [], []
    for r in rows.sort_values("page").itertuples():
        if r.page < 0:
            numbers, ids = list(r.child), list(r.ids)
            continue
        entries = unpacked(r.entries).reshape(len(r.child), -1)
        pages.append(Page(bool(r.leaf), matrix(list(entries)), np.frombuffer(r.to_parent), np.frombuffer(r.radius), np.frombuffer(r.norm), np.array(r.child, np.int64)))
    return pages, numbers, ids


class Index:
    """An M-tree index: rows (row_, vec_id, vector, dim, cell, shard), pages, and the cells' centres, radii, norms and numbers of shards."""

    def __init__(self, rows: DataFrame, pages: DataFrame, cells: pd.DataFrame):
        self.rows, self.pages, self.cells = rows, pages, cells


def build(vectors: DataFrame, page: int = PAGE, shard: int = SHARD, pivots: int = PIVOTS) -> Index:
    """An index over vectors (vec_id, vector: array<long>); rows without a vector are left out, equal ones are all kept.

    Pivots: at most `pivots` rows, one for each `shard` rows of the table, those with the smallest hash
    of their row number; fewer where some are equal. Vectors of another length than any pivot's share
    one cell a length. Every row is in the index.
    """
    spark = vectors.sparkSession
    rows = vectors.where("vector is not null").select("vec_id", "vector").withColumn("row_", F.monotonically_increasing_id()).withColumn("dim", F.size("vector"))
    rows = store.table(rows, "mtree-vectors")
    wanted = min(pivots, max(1, math.ceil(rows.count() / shard)))
    drawn = rows.orderBy(F.xxhash64("row_"), "row_").limit(wanted).select("dim", "vector").collect()
    by_dim: dict[int, np.ndarray] = {}
    for dim in {r["dim"] for r in drawn if r["dim"]}:
        by_dim[dim] = np.array(sorted({tuple(r["vector"]) for r in drawn if r["dim"] == dim}), float)
    shared = spark.sparkContext.broadcast(by_dim)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell, far, norm = np.zeros(len(b), np.int32), np.zeros(len(b)), np.zeros(len(b))
            dims = b["dim"].to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = np.array([np.asarray(v, float) for v in b["vector"].iloc[at]]).reshape(len(at), dim)
                norm[at] = (x * x).sum(axis=1)
                if (p := shared.value.get(int(dim))) is not None:
                    cell[at] = (norm[at][:, None] + (p * p).sum(axis=1) - 2 * (x @ p.T)).argmin(axis=1)
                    far[at] = np.sqrt(((x - p[cell[at]]) ** 2).sum(axis=1))
                else:
                    far[at] = np.sqrt(norm[at])  # such a cell's centre is the origin
            yield b.assign(cell=cell, far_=far, norm_=norm)

    placed = store.table(rows.mapInPandas(assign, rows.withColumns({"cell": F.lit(0), "far_": F.lit(0.0), "norm_": F.lit(0.0)}).schema), "mtree-cells")
    found = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far_").alias("radius"), F.max("norm_").alias("norm")).collect()
    cells = pd.DataFrame([(r["dim"], r["cell"], r["radius"], r["norm"], math.ceil(r["n"] / shard)) for r in found], columns=["dim", "cell", "radius", "norm", "shards"])
    cells["centre"] = [by_dim[d][c].tolist() if d in by_dim else [0.0] * d for d, c in zip(cells["dim"], cells["cell"], strict=True)]
    shards = spark.createDataFrame([(int(d), int(c), int(n)) for d, c, n in zip(cells["dim"], cells["cell"], cells["shards"], strict=True)], "dim int, cell int, shards int")
    # A row for each cell: at most `pivots`, and one for each length of vectors.
    placed = placed.join(F.broadcast(shards), ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("row_"), F.col("shards")).cast("int"))
    placed = store.table(placed.select("row_", "vec_id", "vector", "dim", "cell", "shard"), "mtree-rows")

    def grown(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(list(pages_of(b, page)), columns=["page", "leaf", "entries", "to_parent", "radius", "norm", "child", "ids"])
        for i, c in enumerate(AT):
            out.insert(i, c, int(key[i]))
        return out

    named = placed.select(*AT, "row_", "vector", F.col("vec_id").isNull().alias("none_"), F.coalesce("vec_id", F.lit(0)).alias("id_"))
    pages = named.groupBy(*AT).applyInPandas(grown, PAGES)
    return Index(placed, store.table(pages, "mtree-pages"), cells)


FOUND = {"query": "int64", "row_": "Int64", "vec_id": "object", "score": "Int64", "computed": "int64"}


def visits(index: Index, routed: DataFrame, k: int) -> DataFrame:
    """Searches of routed (query, q, dim, cell, shard, floor) in the shards that they name: at most k rows (query, row_, vec_id, score) each, and one without score that says how many products were computed."""
    blocks = routed.groupBy(*AT).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    pages = index.pages.join(blocks, AT).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    asked = routed.join(blocks, AT).withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int")).drop("blocks")

    def work(key: tuple, p: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(p) and len(asked):
            pages, numbers, ids = tree(p)
            place = {n: i for i, n in enumerate(numbers)}
            for r in asked.itertuples():
                v = unpacked(r.q)
                wide = pages[0].entries.dtype == object or (len(v) and np.abs(v).max() >= SMALL)
                best, n = search(pages, v.astype(object if wide else float), k, r.floor, place.get(r.query))
                out += [(r.query, numbers[i], ids[i], min(max(s, LONG[0]), LONG[1]), 0) for s, i in best]
                out.append((r.query, None, None, None, n))
        columns = zip(*out, strict=True) if out else [()] * 5
        return pd.DataFrame({c: pd.array(list(v), kind) for (c, kind), v in zip(FOUND.items(), columns, strict=True)})

    keys = [*AT, "block"]
    found = pages.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(work, ", ".join(f"{c} {'string' if c == 'vec_id' else 'long'}" for c in FOUND))
    return found.withColumn("vec_id", F.col("vec_id").cast(dict(index.rows.dtypes)["vec_id"]))


def routes(index: Index, asked: DataFrame) -> DataFrame:
    """asked (query, q, dim, seen_cell, seen_shard, floor) with each cell and shard that can hold a score of floor or more, but for the one seen."""
    cells = {int(d): (x["cell"].to_numpy(), np.array(x["centre"].tolist(), float).reshape(len(x), -1), x["radius"].to_numpy(float), x["norm"].to_numpy(float), x["shards"].to_numpy()) for d, x in index.cells.groupby("dim")}
    shared = asked.sparkSession.sparkContext.broadcast(cells)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                if int(r.dim) not in shared.value:
                    continue
                cell, centre, radius, norm, shards = shared.value[int(r.dim)]
                q = unpacked(r.q).astype(float)
                q2, dot = float((q * q).sum()), centre @ q
                high = np.minimum(bound(q2, norm, apart(q2, (centre * centre).sum(axis=1), dot) - radius), cone(q2, dot, radius, norm))
                for i in np.flatnonzero(high >= r.floor).tolist():
                    out += [(r.query, r.q, r.dim, cell[i], s, r.floor) for s in range(shards[i]) if (cell[i], s) != (r.seen_cell, r.seen_shard)]
            yield pd.DataFrame(out, columns=["query", "q", "dim", "cell", "shard", "floor"])

    return asked.mapInPandas(work, "query long, q binary, dim int, cell int, shard int, floor double")


def top(index: Index, queries: DataFrame, k: int = K) -> DataFrame:
    """For each of the index's own rows in queries (row_, with vector, dim, cell and shard) its k best other rows: query, rank, row_, vec_id, score, computed (products computed for the query).

    First the query's own shard is searched; the k-th score there is the floor for all others. Equal
    scores go to the smaller vec_id (null last). A query with fewer than k other rows gets them all.
    """

    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: packed(np.asarray(x)))

    queries = store.table(queries.select(F.col("row_").alias("query"), pack("vector").alias("q"), *AT), "mtree-queries")
    own = store.table(visits(index, queries.withColumn("floor", F.lit(-math.inf)), k), "mtree-own")
    least = own.where("score is not null").groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    floor = F.coalesce(F.col("least").cast("double") - F.abs(F.col("least").cast("double")) * 1e-15, F.lit(-math.inf))
    asked = queries.join(least, "query", "left").select("query", "q", "dim", F.col("cell").alias("seen_cell"), F.col("shard").alias("seen_shard"), floor.alias("floor"))
    more = visits(index, store.table(routes(index, asked), "mtree-routed"), k)
    found = store.table(own.unionByName(more), "mtree-found")
    w = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row_")
    best = found.where("score is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("computed")
    return best.join(found.groupBy("query").agg(F.sum("computed").alias("computed")), "query")


def search_every(df: DataFrame, every: int = EVERY, k: int = K, scale: int = 256, **sizes: int) -> DataFrame:
    """df (vec_id: an integer, embedding) as query_id, rank, vec_id, score, computed: for each row whose vec_id is divisible by `every` the k rows of the largest inner product of floor(scale * x).

    Vectors that are null or hold a null or non-finite component (or one of 2**54 or more) take no
    part. Vectors are compared with those of their own length. A null vec_id is no query, but can be
    found, after equal scores of known ids. Of rows with the same vec_id each is a query and found by
    the others. Scores beyond a long are cut to its range. Further columns are ignored; an empty
    table gives an empty table.
    """
    index = build(df.select("vec_id", quantised(F.col("embedding"), scale).alias("vector")), **sizes)
    queries = index.rows.where(F.col("vec_id") % every == 0)
    found = top(index, queries, k)
    ids = queries.select(F.col("row_").alias("query"), F.col("vec_id").alias("query_id"))
    return found.join(ids, "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "computed")

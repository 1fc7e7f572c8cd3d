"""Grouped statistics, timelines, histograms, ranked selections, roll-ups and similarity."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .grouped import runs


def timeline(df: DataFrame, entity: list[str], t: str, width: float, value: str, first: float, buckets: int) -> DataFrame:
    """Per entity and bucket (also empty ones): count and exact sum of value (2 decimals)."""
    bucket = F.floor((F.col(t) - first) / width)
    seen = df.withColumn("bucket", bucket).where((F.col("bucket") >= 0) & (F.col("bucket") < buckets))
    seen = seen.groupBy(*entity, "bucket").agg(F.count(F.lit(1)).alias("n"), exact_sum(value).alias("total"))
    frame = df.select(*entity).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)).cast("array<long>")))
    return frame.join(seen, [*entity, "bucket"], "left").fillna({"n": 0, "total": 0.0})


def exact_sum(c: str | Column) -> Column:
    """A sum of numbers of two decimals that is the same in any order."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(28,2)")).cast("double")


def grid(df: DataFrame, x: Column, y: Column, width: float, length: float, columns: int, rows: int) -> DataFrame:
    """Counts by cell of a pitch; points on the far edges fall into the last cells."""
    cell = lambda v, most, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(v / most * n))).cast("long")
    return df.groupBy(cell(x, width, columns).alias("cell_x"), cell(y, length, rows).alias("cell_y")).agg(F.count(F.lit(1)).alias("n"))


def top_per_group(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group, with rank."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def capped_top(df: DataFrame, group: list[str], order: list, total: int, each: int) -> DataFrame:
    """total rows: at most `each` of a group by order, then others by order to fill up."""
    x = top_per_group(df, group, order, total)
    x = x.withColumn("filler", (F.col("rank") > each).cast("int"))
    return x.orderBy("filler", *order).limit(total).drop("filler", "rank")


#: Queries that a task of nearest() holds, vectors that it takes, both about, and cosines that it computes together.
QUERIES, VECTORS, CELLS = 8192, 32_768, 1 << 21


class _Best:
    """The k nearest so far of each of some queries, by distance and id."""

    def __init__(self, k: int, n: int):
        self.k, self.most = k, np.full(n, np.inf)
        self.query, self.distance, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def take(self, distance: np.ndarray, mine: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """distance of the queries in mine (whose ids are own) to vectors of these ids."""
        rounded = np.floor(distance * 1e6 + 0.5) / 1e6
        rounded[own[:, None] == ids[None, :]] = np.nan
        i, j = np.nonzero(rounded <= self.most[mine][:, None])
        if not len(i):
            return
        q, d, v = np.append(self.query, mine[i]), np.append(self.distance, rounded[i, j]), np.append(self.id, ids[j])
        order = np.lexsort((v, d, q))
        q, d, v = q[order], d[order], v[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.query, self.distance, self.id = q[keep], d[keep], v[keep]
        last = place == self.k - 1
        self.most[q[last]] = d[last]


def nearest(queries: DataFrame, vectors: DataFrame, group: str, k: int, rows: int = QUERIES) -> DataFrame:
    """For each query (query_id, group, q) the k nearest of its group (id, group, v) by cosine distance (6 decimals), ties by id.

    A task holds some queries of a group, about `rows`, and takes a part of the group's vectors batch by
    batch; of each part the k nearest are left to compare. Blocks and parts follow the group's own size,
    so a row is sent once for each block or part of its group. A vector of nulls, or of another length, is
    as far as can be.
    """
    tasks = 4 * int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict(queries.dtypes)
    kind = kinds["q"] if kinds["q"] == dict(vectors.dtypes)["v"] else "array<double>"
    size = lambda c: F.when(F.col(c).isNull() | F.exists(c, lambda x: x.isNull()), -1).otherwise(F.size(c))
    side = lambda df, i, c, n: df.where(F.col(i).isNotNull() & F.col(group).isNotNull()).select(group, F.lit(n).alias("side_"), F.col(i).cast("long").alias("id"), F.col(c).cast(kind).alias("v"), size(c).alias("size_"))
    of = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    number = lambda df, name, each: df.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / each).alias(name))
    asked, given = side(queries, "query_id", "q", 0), side(vectors, "id", "v", 1)
    sizes = number(asked, "blocks_", rows).join(number(given, "parts_", VECTORS), group)
    held = asked.join(sizes, group).withColumn("block_", of("blocks_")).withColumn("part_", every("parts_"))
    rest = given.join(sizes, group).withColumn("part_", of("parts_")).withColumn("block_", every("blocks_"))

    def sized(b: pd.DataFrame) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(size, places, ids, vectors) of the rows of each size."""
        out = []
        for n in b["size_"].unique().tolist():
            at = np.flatnonzero(b["size_"].to_numpy() == n)
            v = np.array(b["v"].iloc[at].tolist(), np.float64).reshape(len(at), n) if n >= 0 else np.zeros((len(at), 0))
            out.append((n, at, b["id"].to_numpy(np.int64)[at], v))
        return out

    def meet(mine: pd.DataFrame, others: Iterator[pd.DataFrame]) -> pd.DataFrame:
        best, q = _Best(k, len(mine)), sized(mine)
        step = max(1, CELLS // len(mine))
        for b in others:
            for i in range(0, len(b), step):
                for n, _, ids, v in sized(b.iloc[i : i + step]):
                    for m, places, own, u in q:
                        cosine = np.full((len(u), len(v)), -1.0)
                        if n == m >= 0:
                            with np.errstate(all="ignore"):
                                cosine = (u @ v.T) / np.sqrt((u * u).sum(1)[:, None] * (v * v).sum(1)[None, :])
                            cosine = np.clip(np.where(np.isnan(cosine), 1.0, cosine), -1.0, 1.0)
                        best.take(1.0 - cosine, places, ids, own)
        return pd.DataFrame({"query_id": mine["id"].to_numpy()[best.query], "id": best.id, "distance": best.distance})

    keys = [group, "block_", "part_"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = ((*key, int(side), part) for b in batches for (*key, side), part in runs(b, [*keys, "side_"]))
        for _, mine in itertools.groupby(pieces, lambda p: p[:3]):
            first: list[pd.DataFrame] = []
            for side_, piece in itertools.groupby(mine, lambda p: p[3]):
                if side_ == 0:
                    first = [p[4] for p in piece]
                elif first:
                    yield meet(pd.concat(first, ignore_index=True), (p[4] for p in piece))

    dealt = held.unionByName(rest).drop("blocks_", "parts_").repartition(tasks, *keys).sortWithinPartitions(*keys, "side_")
    found = dealt.mapInPandas(work, "query_id long, id long, distance double")
    x = top_per_group(found, ["query_id"], ["distance", "id"], k)
    return x.select(F.col("query_id").cast(kinds["query_id"]), F.col("id").cast(dict(vectors.dtypes)["id"]), "rank", F.round("distance", 6).alias("distance"))


def centroids(df: DataFrame, label: str, vector: str, digits: int = 6) -> DataFrame:
    """The mean vector of each label, one row for each component: label, i, mean, n."""
    x = df.select(label, F.posexplode(vector).alias("i", "x"))
    return x.groupBy(label, "i").agg(F.round(F.avg(F.col("x").cast("double")), digits).alias("mean"), F.count(F.lit(1)).alias("n"))


def medoid(df: DataFrame, label: str, id_: str, vector: str) -> DataFrame:
    """Per label the vector nearest to the label's mean direction, ties by id: the mean is broadcast-free, joined by label."""
    unit = F.transform(vector, lambda x: x.cast("double") / F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, y: s + y.cast("double") * y)))
    x = df.select(label, id_, unit.alias("u"))
    mean = x.select(label, F.posexplode("u").alias("i", "c")).groupBy(label, "i").agg(F.avg("c").alias("c"))
    mean = mean.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("m"))
    y = x.join(mean, label).withColumn("likeness", F.round(F.aggregate(F.zip_with("u", "m", lambda a, b: a * b["c"]), F.lit(0.0), lambda s, a: s + a), 6))
    return top_per_group(y, [label], [F.desc("likeness"), id_], 1).select(label, id_, "likeness")

"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct shingles, by 64-bit hashes. A size band deals shingles to parts
by hash; the XOR of a part's shingles is its parity. Two sets that differ in d shingles differ in d
parts at most, and sets with a Jaccard similarity of 3/4 or more differ in a third of a set's size D
at most; so if a set has more than D filled parts, one of them has the same parity in both
(pigeonhole), and joining on (band, part, parity) finds the pair. A set also joins the next band's
sketches if a partner may be there. A set with too few filled parts also joins by further deals, the
last of which has a part for each shingle.

Of a deal's keys a set sends the D + 1 that come first in one order of all keys: the first key that
two linked sets share has at most D before it in either. The order begins with the keys of rare
shingles, by a count of all shingles in COUNTERS buckets, so a passage or a copy that many documents
share is a key of those sets alone that have little besides.

The sets of a key meet its pivot, the one of them that has most shared keys. Sets that their pivot's
links leave outside the component of most of the pivot's sets then meet, in blocks, all of the
pivot's sets that are not in their own component. So a group of near copies costs a comparison for
each copy, and one with each other copy only for those that are unlike the pivot.

Candidates are first compared by a bit sketch (each shingle flips one bit), whose Hamming distance
is at most the symmetric difference; wider sketches fold to narrower ones. What passes is verified
on the words of the whole texts. Equal sets count as one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, store, text

RATIO = 3
DEALS = 6
#: Buckets in which shingles are counted, and rows that a task's counts come in.
COUNTERS, SLICES = 1 << 18, 64
#: Sets that meet a block at once, and pairs of a set that are verified together.
BLOCK, TOGETHER = 256, 256
#: Bits of a sketch: one or two a shingle, at least and at most so many.
LEAST_BITS, SKETCH_BITS = 512, 1 << 16
#: Rows of a few numbers that are sent to every task, at most; more are joined by a shuffle.
BROADCAST_ROWS = 300_000
FLUSH = 500_000
#: Rounds in which a set verifies one of its pairs, before all that are left are verified.
ROUNDS = 1


@cache
def band(size: int) -> int:
    k, top = 0, RATIO
    while size >= top:
        k, top = k + 1, top * RATIO
    return k


@cache
def parts(k: int) -> tuple[int, int]:
    """A band's number of parts, and of the first ones that are used."""
    most = RATIO ** (k + 1) - 1
    return (2 * most, 2 * most) if most <= 80 else (most, -(-most * 13 // 20))


def bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(COUNTERS - 1)).astype(np.int64)


def keys(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The join keys of a set of hashes; counts: of all shingles, by bucket."""
    n, out, seen = len(h), [], counts[bucket(h)]
    enough = n // 3 + 1
    for k in dict.fromkeys((band(n), band(n * 4 // 3))):
        total, used = parts(k)
        for deal in range(DEALS + 1):
            if deal == DEALS:
                found, weight = text.mix(h, 1000 + k), seen
            else:
                part = text.mix(h, 10 * k + deal + 1) % np.uint64(total)
                mine = np.flatnonzero(part < used)
                if len(mine) == 0:
                    continue
                mine = mine[np.argsort(part[mine], kind="stable")]
                part = part[mine]
                first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                parity, weight = np.bitwise_xor.reduceat(h[mine], first), np.minimum.reduceat(seen[mine], first)
                found = text.mix(parity ^ text.mix(part[first], 10 * k + deal + 500), 7)
            out.append(found[np.lexsort((found, weight))[:enough]])
            if len(found) >= enough:
                break
    return np.concatenate(out)


def node_of(h: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(text.mix(np.array([np.bitwise_xor.reduce(text.mix(h, 31)) + np.uint64(len(h))], np.uint64), 32).view(np.int64)[0])


def bits(h: np.ndarray) -> bytes:
    """The set's bit sketch; its width is a power of two."""
    width = min(SKETCH_BITS, max(LEAST_BITS, 1 << (len(h) - 1).bit_length()))
    flips = np.bincount((text.mix(h, 77) % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def folded(sketch: bytes, size: int = LEAST_BITS // 8) -> np.ndarray:
    """A sketch of that many bytes."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint8).reshape(-1, size), axis=0)


def distance(a: bytes, b: bytes) -> int:
    """The Hamming distance of two sketches; the wider one is folded."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())


def alike(x: str | None, y: str | None, k: int) -> bool:
    """Whether 100 * shared shingles >= 75 * all shingles, by the words themselves."""
    names: dict[bytes, int] = {}
    sets = []
    for t in (x, y):
        ids = [names.setdefault(w, len(names)) for w in text.words(t)]
        m = min(k, len(ids))
        sets.append({tuple(ids[i : i + m]) for i in range(len(ids) - m + 1)} if m else set())
    both = len(sets[0] & sets[1])
    return both > 0 and 100 * both >= 75 * (len(sets[0]) + len(sets[1]) - both)


def spread(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def surveyed(docs: DataFrame, k: int) -> DataFrame:
    """Two kinds of rows. (doc_id, text_hash, n_shingles, node, sketch) of each row; node is null for
    an empty set. (slice, counts): a task's counts of the shingles of its distinct sets, in SLICES rows."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, n_shingles long, node long, sketch binary, slice int, counts binary"
    names = ["doc_id", "text_hash", "n_shingles", "node", "sketch", "slice", "counts"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, kind = np.zeros(COUNTERS, np.int64), set(), pa.null()
        for b in batches:
            n, node, sketch, new = [], [], [], [np.zeros(0, np.uint64)]
            for h in text.shingle_sets(b.column("text").to_pylist(), k):
                n.append(len(h))
                node.append(node_of(h) if len(h) else None)
                sketch.append(bits(h) if len(h) else None)
                if len(h) and node[-1] not in seen:
                    seen.add(node[-1])
                    new.append(h)
            counts += np.bincount(bucket(np.concatenate(new)), minlength=COUNTERS)
            kind = b.column("doc_id").type
            none = len(n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sketch, pa.binary()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], names)
        if seen:
            pieces = [x.astype(np.uint32).tobytes() for x in counts.reshape(SLICES, -1)]
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, kind), *[pa.nulls(SLICES, pa.int64())] * 3, pa.nulls(SLICES, pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array(pieces, pa.binary())], names)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(work, schema)


def totals(found: DataFrame) -> np.ndarray:
    """The counts of all tasks; COUNTERS numbers at any size of the input reach the driver."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b["slice"], b["counts"], strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(x, np.uint32).astype(np.int64)
        yield pd.DataFrame({"slice": np.array(list(sums), np.int32), "counts": [x.tobytes() for x in sums.values()]})

    rows = found.where("slice is not null").select("slice", "counts").repartition("slice").mapInPandas(work, "slice int, counts binary").collect()
    out = np.zeros((SLICES, COUNTERS // SLICES), np.int64)
    for r in rows:
        out[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    return out.ravel()


def keyed(docs: DataFrame, counts: np.ndarray, k: int) -> DataFrame:
    """(key, node) of all sets; a set comes once from each task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            found, names, size = [], [], 0
            for h in text.shingle_sets(b.column("text").to_pylist(), k):
                if len(h) == 0 or (node := node_of(h)) in seen:
                    continue
                seen.add(node)
                mine = keys(h, counts)
                found.append(mine)
                names.append(np.full(len(mine), node, np.int64))
                size += len(mine)
                if size > FLUSH:
                    yield batch(found, names)
                    found, names, size = [], [], 0
            if found:
                yield batch(found, names)

    def batch(found: list[np.ndarray], names: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(names))], ["key", "node"])

    return docs.select("text").mapInArrow(work, "key long, node long")


def shared(rows: DataFrame) -> DataFrame:
    """The distinct (key, node) of keys that several nodes have, from rows sorted by both within partitions."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Held is the last row, unless it is known to share its key; before: the last row that was sent.
        none = np.zeros(0, np.int64)
        held, before = (none, none), None
        for x in batches:
            key, node = (np.concatenate((h, x.column(i).to_numpy())) for i, h in enumerate(held))
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))[: len(key)]
            key, node = key[new], node[new]
            if before is not None and len(key) and before == (key[0], node[0]):
                key, node = key[1:], node[1:]
            if len(key) == 0:
                held = (none, none)
                continue
            same = key[1:] == key[:-1]
            good = np.concatenate(([before is not None and before[0] == key[0]], same)) | np.concatenate((same, [False]))
            if good[-1]:
                held, before = (none, none), (key[-1], node[-1])
            else:
                held, before = (key[-1:], node[-1:]), None
            yield pa.RecordBatch.from_arrays([pa.array(key[good]), pa.array(node[good])], ["key", "node"])

    return rows.mapInArrow(work, "key long, node long")


def near(pairs: DataFrame, per_node: DataFrame) -> DataFrame:
    """Those of distinct pairs (a, b) that sizes and sketches allow."""
    left = per_node.select(F.col("node").alias("a"), F.col("n_shingles").alias("n"), "sketch")
    right = per_node.select(F.col("node").alias("b"), F.col("n_shingles").alias("n2"), F.col("sketch").alias("sketch2"))
    x = pairs.join(left, "a").join(right, "b").where("4 * least(n, n2) >= 3 * greatest(n, n2)").select("a", "b", "n", "n2", "sketch", "sketch2")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good = [7 * distance(s, t) <= m + n for s, t, m, n in zip(b["sketch"], b["sketch2"], b["n"], b["n2"], strict=True)]
            yield b.loc[np.array(good, bool), ["a", "b"]]

    return x.mapInPandas(work, "a long, b long")


def verified(scratch: store.Scratch, pairs: DataFrame, docs: DataFrame, per_node: DataFrame, k: int) -> DataFrame:
    """Those of distinct pairs (a, b), written already, whose sets are 3/4 alike. A text b comes once for TOGETHER of its pairs, and before these."""
    of = scratch.put("of", pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("salts")))
    mine = pairs.join(spread(of), "b").select(F.col("a").alias("node"), "b", F.pmod(F.xxhash64("a"), "salts").cast("int").alias("salt"), F.lit(1).alias("kind"))
    wanted = scratch.put("wanted", mine.unionAll(of.select(F.col("b").alias("node"), "b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"))))
    at = per_node.select("node", F.col("doc_id").alias("id"), F.col("text_hash").alias("id_hash"))
    wanted = scratch.put("wanted", wanted.join(at, "node"))
    n = store.partitions(docs.sparkSession)
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    x = hashed.join(spread(wanted), hashed["doc_id"].eqNullSafe(F.col("id")) & (hashed["text_hash"] == F.col("id_hash"))).select("b", "salt", "kind", "node", "text")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b, y, last = None, None, None
        for x in batches:
            good = []
            for row in x.itertuples(index=False):
                if row.kind == 0:
                    b, y = row.b, row.text
                elif row.b == b and (row.node, b) != last:
                    # Rows that repeat a text and its id come one after another.
                    last = (row.node, b)
                    if alike(row.text, y, k):
                        good.append(last)
            yield pd.DataFrame(np.array(good, np.int64).reshape(-1, 2), columns=["a", "b"])

    return x.repartition(n, "b", "salt").sortWithinPartitions("b", "salt", "kind", "node").mapInPandas(work, "a long, b long")


def blocks(group: DataFrame, side: str, of: str, *more: str) -> DataFrame:
    """Each pivot's rows in so many blocks, BLOCK rows in each or so: (pivot, block, more, side)."""
    row = F.struct("node", "component", "mask", "n_shingles", "sketch")
    return group.groupBy("pivot", F.pmod(F.xxhash64("node"), of).cast("int").alias("block"), *more).agg(F.collect_list(row).alias(side))


def met(rest: DataFrame, every: DataFrame) -> DataFrame:
    """The pairs a < b of a block of rest and one of every that share a key's bit, are in different components, and that sizes and sketches allow."""

    def packed(x: pa.Array) -> dict[str, np.ndarray | list[bytes]]:
        flat = x.flatten()
        out = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("node", "component", "mask", "n_shingles")}
        sketches = flat.field("sketch").to_pylist()
        small = np.array([folded(s) for s in sketches], np.uint8).reshape(len(sketches), -1).view(np.uint64)
        return out | {"sketch": sketches, "small": small}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for i in range(batch.num_rows):
                x, y = (packed(batch.column(j).slice(i, 1)) for j in range(2))
                apart = np.bitwise_count(x["small"][:, None] ^ y["small"][None]).sum(axis=2, dtype=np.int64)
                m, n = x["n_shingles"][:, None], y["n_shingles"][None]
                good = (x["component"][:, None] != y["component"][None]) & (x["mask"][:, None] & y["mask"][None] != 0)
                good &= (4 * np.minimum(m, n) >= 3 * np.maximum(m, n)) & (7 * apart <= m + n)
                for p, q in np.argwhere(good):
                    if 7 * distance(x["sketch"][p], y["sketch"][q]) <= x["n_shingles"][p] + y["n_shingles"][q]:
                        a, b = int(x["node"][p]), int(y["node"][q])
                        found.add((min(a, b), max(a, b)))
            pairs = np.array(list(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    x = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(every, ["pivot", "block"])
    return x.select("rest", "every").mapInArrow(work, "a long, b long").distinct()


def links(scratch: store.Scratch, docs: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Edges (a, b) of nodes that connect all nodes whose sets are 3/4 alike."""
    n = store.partitions(docs.sparkSession)
    held = scratch.put("keys", shared(keyed(docs, totals(found), k).repartition(n, "key").sortWithinPartitions("key", "node")))
    hub = scratch.put("hubs", held.groupBy("node").agg(F.count(F.lit(1)).alias("hub")))
    per_node = found.where("node is not null").join(spread(hub), "node").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("at"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    per_node = scratch.put("nodes", per_node.select("node", "at.*", "n_shingles", "sketch"))
    ranked = scratch.put("ranked", held.join(spread(hub), "node"))
    pivot = scratch.put("pivots", ranked.groupBy("key").agg(F.max(F.struct("hub", F.xxhash64("node").alias("h"), "node"))["node"].alias("pivot")))
    mask = F.bit_or(F.expr("shiftleft(1L, cast(pmod(xxhash64(key), 64) AS int))"))
    members = scratch.put("members", ranked.join(pivot, "key").groupBy("pivot", "node").agg(mask.alias("mask")))
    scratch.drop("keys", "hubs", "ranked", "pivots")
    pairs = scratch.put("pairs", near(members.where("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")), per_node))
    edges = scratch.put("edges", verified(scratch, pairs, docs, per_node, k))
    joined = scratch.put("joined", graph.components(edges))
    x = members.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    x = scratch.put("members", x)
    size = x.groupBy("pivot", "component").agg(F.count(F.lit(1)).alias("n"))
    main = size.groupBy("pivot").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("n"))
    # A group of one component has no rest.
    main = scratch.put("main", main.where("n > main.n").select("pivot", F.col("main.component").alias("main"), F.ceil(F.col("n") / BLOCK).alias("blocks"), F.ceil((F.col("n") - F.col("main.n")) / BLOCK).alias("rests")))
    x = scratch.put("open", x.join(spread(main), "pivot").join(per_node.select("node", "n_shingles", "sketch"), "node"))
    every, rest = blocks(x, "every", "blocks"), blocks(x.where("component != main"), "rest", "rests", "blocks").drop("block")
    left = scratch.put("left", met(rest, every))
    scratch.drop("members", "main", "open")
    for i in range(ROUNDS + 1):
        if left.limit(1).count() == 0:
            break
        # One pair of each set; what that leaves apart is verified at once.
        pairs = scratch.put("pairs", left if i == ROUNDS else left.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        edges = scratch.put("edges", edges.unionAll(verified(scratch, pairs, docs, per_node, k)))
        joined = scratch.put("joined", graph.components(edges))
        left = left.join(spread(pairs), ["a", "b"], "left_anti")
        for side in ("a", "b"):
            left = left.join(spread(joined).select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side, "left")
        left = scratch.put("left", left.where("ca is null or cb is null or ca != cb").select("a", "b"))
    scratch.drop("left", "pairs", "wanted", "edges", "of", "nodes")
    return joined


def classes(docs: DataFrame, k: int = 5) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_shingles, component_id.

    Documents link when 100 * shared shingles >= 75 * all shingles; component_id is the smallest
    doc_id reachable (null if all are null). A null text is an empty one; empty sets link with
    nothing and stand alone. Repeated rows keep their rows. Links are verified by the words
    themselves; sets count as equal if 64-bit hashes of them are. Further columns are ignored; an
    empty table gives an empty table.
    """
    docs = docs.select("doc_id", "text")
    scratch = store.Scratch(docs.sparkSession, "parity")
    found = scratch.put("found", surveyed(docs, k))
    rows = found.where("slice is null")
    joined = links(scratch, docs, found, k) if not rows.where("node is not null").isEmpty() else docs.sparkSession.createDataFrame([], "node long, component long")
    base = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    base = base.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = base.groupBy("component").agg(F.min("least").alias("component_id"))
    base = scratch.put("classes", base.select("node", "component").join(named, "component").select("node", "component_id"))
    full = rows.where("node is not null").join(base, "node").select("doc_id", "n_shingles", "component_id")
    return full.unionAll(rows.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))

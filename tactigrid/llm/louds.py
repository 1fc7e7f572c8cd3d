"""The trie of all conversations' prefixes, in shards of succinct level-order (LOUDS) tries.

A node is a distinct sequence of turns. Its name is a 128-bit hash of the sequence, built turn by turn,
so equal prefixes of different conversations meet in a grouped count, whose partial sums leave one row
a node, however many conversations share it. Nodes below a prefix of at most SHARD conversations make
a shard. A task reads its shards in order, builds one LOUDS bitvector with label arrays for about
TOGETHER nodes at a time, and rolls leaves and tokens up by reverse level order. The heavy nodes above
(more conversations than a shard may have) make a small upper trie, into which the shards' roots are
added. A turn sequence that only one conversation has needs no trie but for its first node: the rest
hangs below it as a tail, a chain whose columns follow from its place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import store

#: Conversations below a shard's root, at most; nodes with more are in the upper trie.
SHARD = 10_000
#: Nodes that are built into one LOUDS at least, if the task has as many; whole shards only.
TOGETHER = 50_000
#: Ids that are joined into one piece of a list.
PIECE = 4096
#: Rows of the upper trie that are sent to every task, at most; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Conversations c to c + FAMILY - 1 take their first turns from c, a multiple of FAMILY; at most LENT - 1 of them.
FAMILY, LENT = 5, 9
EMPTY = hashlib.sha256(b"").hexdigest()


def digest(*parts: Column) -> Column:
    """A pair of longs for these texts, the same for the same texts only (md5)."""
    h = F.md5(F.concat(*[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts]))
    # Fifteen hex digits each fit a long; the last two go with the second.
    return F.struct(F.conv(F.substring(h, 1, 15), 16, 10).cast("long").alias("a"), F.conv(F.substring(h, 16, 15), 16, 10).cast("long").alias("b"), F.substring(h, 31, 2).alias("c"))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, p, label, size) of conversations (conv_id, turn, role, text): p from 1, a hash of role and text, the text's UTF-8 bytes. Texts themselves are not shuffled."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    x = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), digest(role, text).alias("label"), F.octet_length(text).cast("long").alias("size"))
    w = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "label")
    return x.withColumn("p", F.row_number().over(w)).select("conv_id", "p", "label", "size")


def rebuilt(rows: DataFrame) -> DataFrame:
    """turns() of the rebuilt conversations, (conv_id, depth, label, size), depth 0 a row without label for every conversation.

    Conversation c has the first h turns of c - c mod 5, h = crc32(c) mod 9, and then its own from the (h + 1)th on.
    """
    lent = lambda c: F.crc32(c.cast("string")) % LENT
    none = F.lit(None).cast(dict(rows.dtypes)["label"])
    marks = rows.where("p = 1").select("conv_id", F.lit(0).alias("p"), none.alias("label"), F.lit(0).cast("long").alias("size"))
    own = rows.where(F.col("p") > lent(F.col("conv_id"))).select("conv_id", "p", "label", "size")
    base = rows.where((F.pmod("conv_id", F.lit(FAMILY)) == 0) & (F.col("p") < LENT))
    given = base.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(FAMILY - 1)))).withColumn("conv_id", (F.col("conv_id") + F.col("to")).cast(dict(rows.dtypes)["conv_id"]))
    given = given.where(F.col("p") <= lent(F.col("conv_id"))).select("conv_id", "p", "label", "size")
    w = W.partitionBy("conv_id").orderBy("p")
    x = marks.unionByName(own).unionByName(given).withColumn("depth", F.row_number().over(w) - 1).withColumn("is_", F.first("p").over(w) == 0)
    return x.where("is_").select("conv_id", "depth", "label", "size")


def prefixes(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, label, size) with the node's name (x1, x2), its parent's (p1, p2), and last, whether the conversation ends there."""
    w = W.partitionBy("conv_id").orderBy("depth")
    x = rows
    for i in (1, 2):
        # A turn's part depends on its label and place; the parts are joined by XOR.
        own = F.when(F.col("depth") > 0, F.xxhash64(F.lit(i), "depth", "label")).otherwise(F.lit(0).cast("long"))
        x = x.withColumn(f"own{i}", own)
    for i in (1, 2):
        x = x.withColumn(f"x{i}", F.bit_xor(f"own{i}").over(w.rowsBetween(W.unboundedPreceding, 0)))
    x = x.withColumn("last", F.lead("depth").over(w).isNull())
    return x.select("conv_id", "depth", "x1", "x2", F.col("x1").bitwiseXOR(F.col("own1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("own2")).alias("p2"), "size", "last")


def id_lists(ends: DataFrame) -> DataFrame:
    """ends (x1, x2, conv_id) as (x1, x2, ends_sha256): SHA-256 of each node's ids, ascending, joined by commas.

    Ids are sorted over ranges and joined in pieces there; a node's pieces then pass through one hash
    object, which holds none of them.
    """
    order = ["x1", "x2", "conv_id"]

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for at, same in groupby(zip(b["x1"].tolist(), b["x2"].tolist(), b["conv_id"].tolist(), strict=True), key=lambda r: r[:2]):
                ids = [r[2] for r in same]
                out += [(*at, ids[i], ",".join(map(str, ids[i : i + PIECE]))) for i in range(0, len(ids), PIECE)]
            yield pd.DataFrame(out, columns=["x1", "x2", "first", "ids"])

    kind = dict(ends.dtypes)["conv_id"]
    n = store.partitions(ends.sparkSession)
    pieces = ends.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInPandas(joined, f"x1 long, x2 long, first {kind}, ids string")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, h = None, None
        for b in batches:
            out = []
            for x1, x2, ids in zip(b["x1"].tolist(), b["x2"].tolist(), b["ids"], strict=True):
                if (x1, x2) != at:
                    if h:
                        out.append((*at, h.hexdigest()))
                    at, h = (x1, x2), hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["x1", "x2", "ends_sha256"])
        if h:
            yield pd.DataFrame([(*at, h.hexdigest())], columns=["x1", "x2", "ends_sha256"])

    return pieces.repartition(n, "x1", "x2").sortWithinPartitions("x1", "x2", "first").mapInPandas(hashed, "x1 long, x2 long, ends_sha256 string")


class Louds:
    """A forest below a super-root as a level-order bitvector: for each node, in level order, a one for each child and then a zero.

    Built from rows of nodes in any order: their names, their parents' names, and depths; rows whose
    parent is not among them are roots. order: the row of each node in level order; labels: the
    nodes' names in that order; bits: the bitvector; parent: the place of each node's parent, by rank
    and select on the bits, or -1.
    """

    def __init__(self, names: np.ndarray, parents: np.ndarray, depth: np.ndarray):
        n = len(names)
        both = np.concatenate((names, parents))
        sort = np.lexsort((both[:, 1], both[:, 0]))
        fresh = np.concatenate(([True], (both[sort][1:] != both[sort][:-1]).any(axis=1)))
        rank = np.empty(2 * n, np.int64)
        rank[sort] = np.cumsum(fresh) - 1
        row_of = np.full(2 * n, -1)
        row_of[rank[:n]] = np.arange(n)
        up = row_of[rank[n:]]
        up[up == np.arange(n)] = -1  # the root of all names itself its parent
        place = np.full(n + 1, -1)  # the last is the super-root's
        level = np.zeros(n, np.int64)
        todo = np.flatnonzero(up < 0)
        order, k, first = [], 0, 0
        kids = np.argsort(up, kind="stable")
        begin, end = np.searchsorted(up[kids], np.arange(n)), np.searchsorted(up[kids], np.arange(n), side="right")
        while len(todo):
            todo = todo[np.lexsort((names[todo, 1], names[todo, 0], place[up[todo]]))]
            place[todo] = first + np.arange(len(todo))
            level[todo] = k
            order.append(todo)
            first, k = first + len(todo), k + 1
            size = end[todo] - begin[todo]
            starts = np.repeat(begin[todo] - np.concatenate(([0], np.cumsum(size)[:-1])), size)
            todo = kids[starts + np.arange(size.sum())]
        self.order = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.labels, self.levels = names[self.order], np.concatenate(([0], np.cumsum([len(x) for x in order]))).astype(np.int64)
        degree = np.bincount(place[up] + 1, minlength=n + 1)  # the super-root first
        self.bits = np.ones(degree.sum() + n + 1, bool)
        self.bits[np.cumsum(degree) + np.arange(n + 1)] = False
        ones, zeros = np.flatnonzero(self.bits), np.flatnonzero(~self.bits)
        self.parent = ones - np.arange(n) - 1  # zeros before the i-th one, less the super-root
        self.degree = np.diff(zeros, prepend=-1)[1:] - 1

    def rolled_up(self, own: np.ndarray) -> np.ndarray:
        """own (in level order) summed over each node's subtree, level by level from the last."""
        total = own.copy()
        for a, b in reversed(list(zip(self.levels[1:-1], self.levels[2:], strict=True))):
            np.add.at(total, self.parent[a:b], total[a:b])
        return total


ROLLED = "x1 long, x2 long, p1 long, p2 long, depth long, conv_id {kind}, parent_conv_id {kind}, n_convs long, n_ends long, n_children long, n_leaves long, saved_tokens long, below long"


def roll_up(b: pd.DataFrame) -> pd.DataFrame:
    """The columns of nodes that make whole tries; below says whether a node's parent is among them (1) or elsewhere (0)."""
    col = lambda c: b[c].to_numpy(np.int64)
    t = Louds(np.column_stack([col("x1"), col("x2")]), np.column_stack([col("p1"), col("p2")]), col("depth"))
    at = lambda c: col(c)[t.order]
    alone = at("n_convs") == 1  # the rest of a lone conversation hangs below as a tail
    degree = t.degree + at("more_kids") + (alone & (at("n_ends") == 0))
    leaves = t.rolled_up(at("more_leaves") + ((degree == 0) | alone))
    tokens = t.rolled_up(at("more_tokens") + (at("n_convs") - 1) * at("size"))
    conv = b["conv_id"].to_numpy()[t.order]
    own = t.parent >= 0
    out = b.iloc[t.order][["x1", "x2", "p1", "p2", "depth", "n_convs", "n_ends"]].reset_index(drop=True)
    parent_conv = pd.Series(np.where(own, conv[t.parent], 0), dtype="Int64").mask(~own)
    return out.assign(conv_id=conv, parent_conv_id=parent_conv, n_children=degree, n_leaves=leaves, saved_tokens=tokens, below=own.astype(np.int64))


def tries(nodes: DataFrame, kind: str) -> DataFrame:
    """roll_up() of nodes (NODE, and key, the shard): whole shards, as many as make TOGETHER nodes at a time."""
    columns = [c.split()[0] for c in ROLLED.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b)
            if size < TOGETHER:
                continue
            x = pd.concat(held, ignore_index=True)
            cut = int(np.searchsorted(x["key"].to_numpy(), x["key"].iloc[-1]))  # the last shard may go on
            if cut:
                yield roll_up(x[:cut])[columns]
            held, size = [x[cut:]], len(x) - cut
        if size:
            yield roll_up(pd.concat(held, ignore_index=True))[columns]

    return nodes.repartition(store.partitions(nodes.sparkSession), "key").sortWithinPartitions("key").mapInPandas(work, ROLLED.format(kind=kind))


def few(df: DataFrame) -> DataFrame:
    """A written table, to be sent to every task if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def prefix_trie(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """A row for each node of the prefix trie of the rebuilt conversations (conv_id: an integer, turn, role, text), see rebuilt().

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Turns are ordered by turn (null first), then role, then a hash of role and
    text, so repeated turns keep their rows in a fixed order. Null roles and texts are empty ones. Rows
    of a null conv_id belong to no conversation and are left out. A negative conv_id takes its turns from
    the multiple of five at or below it. Further columns are ignored. Texts are read whole. An empty
    table has no root and gives an empty table. A conversation's own turns go through one sorted window.
    """
    spark, kind = conversations.sparkSession, dict(conversations.dtypes)["conv_id"]
    path = store.table(prefixes(rebuilt(turns(conversations))), "louds-paths")
    nodes = path.groupBy("x1", "x2").agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"),
        F.count(F.when(F.col("last"), 1)).alias("n_ends"), F.min("conv_id").alias("conv_id"), F.max("size").alias("size"),
    )
    nodes = store.table(nodes, "louds-nodes")

    # The first node of each conversation's path that a shard can hold is the shard's root; those above are heavy.
    heavy = store.table(nodes.where((F.col("n_convs") > shard) & (F.col("depth") > 0)).select("x1", "x2"), "louds-heavy")
    marked = path.where("depth > 0").select("conv_id", "depth", "x1", "x2").join(few(heavy), ["x1", "x2"], "left_anti")
    roots = marked.groupBy("conv_id").agg(F.min(F.struct("depth", "x1")).alias("r")).select("conv_id", F.col("r.depth").alias("top"), F.col("r.x1").alias("key"))
    # Of the nodes of one member, a conversation's first is in the trie and the rest are its tail.
    w = W.partitionBy("conv_id")
    head = F.min(F.when(F.col("n_convs") == 1, F.col("depth"))).over(w)
    placed = nodes.join(roots, "conv_id", "left").withColumn("tail", (F.col("n_convs") == 1) & (F.col("depth") > F.coalesce(head, F.col("depth"))))
    upper_row = (F.col("depth") == 0) | (F.col("n_convs") > shard)
    placed = store.table(placed.withColumn("upper", upper_row), "louds-placed")

    none = [F.lit(0).cast("long").alias(c) for c in ("more_kids", "more_leaves", "more_tokens")]
    columns = ["x1", "x2", "p1", "p2", "depth", "n_convs", "n_ends", "conv_id", "size"]
    low = store.table(tries(placed.where("not upper and not tail").select(*columns, *none, "key"), kind), "louds-shards")

    # What hangs below each upper node: partial sums leave a row for each of them.
    more = low.where("below = 0").groupBy(F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count(F.lit(1)).alias("more_kids"), F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_tokens"))
    top = placed.where("upper").select(*columns).join(more, ["x1", "x2"], "left").fillna(0, ["more_kids", "more_leaves", "more_tokens"])
    high = store.table(tries(top.withColumn("key", F.lit(0).cast("long")), kind), "louds-upper")

    names = high.select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("above"))
    below = low.join(few(names), ["p1", "p2"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).drop("above")
    one, ends = F.lit(1).cast("long"), F.col("n_ends")
    tail = placed.where("tail").select(*columns, F.col("conv_id").alias("parent_conv_id"), (one - ends).alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))

    out = ["x1", "x2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_ends", "n_children", "n_leaves", "saved_tokens"]
    every = high.select(out).unionByName(below.select(out)).unionByName(tail.select(out))
    # Lists of one id or none need no sort: a lone node's is its own conversation.
    shared = nodes.where("n_ends > 0 and n_convs > 1").select("x1", "x2")
    lists = id_lists(path.where("last").select("x1", "x2", "conv_id").join(shared, ["x1", "x2"], "left_semi"))
    every = every.join(store.table(lists, "louds-ends"), ["x1", "x2"], "left")
    sha = F.coalesce("ends_sha256", F.when(ends > 0, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(EMPTY)))
    long = [F.col(c).cast("long").alias(c) for c in out[2:] if c != "n_ends"]
    return every.select(*long, sha.alias("ends_sha256"))

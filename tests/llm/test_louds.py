"""The conversation prefix trie against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tactigrid.llm import louds, registry

SCHEMA = "conv_id long, turn long, role string, text string, key string, x1 int, depth int, n_convs int"


def brute(rows):
    """The nodes' columns of rows (conv_id, turn, role, text), turns without ties."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: (x[0], x[1] or 0))] for c, v in by.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return [(m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items()]


def same(got, want):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r[n] for n in names) for r in got), key=key) == sorted(want, key=key)


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, 3) for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize(("shard", "together"), [(10_000, 50_000), (3, 5), (1, 1)])
def test_against_brute_force(spark, shard, together, monkeypatch):
    monkeypatch.setattr(louds, "TOGETHER", together)
    monkeypatch.setattr(louds, "PIECE", 3)
    r = random.Random(3)
    rows = []
    for c in [*range(120), -3, -5, 1000, 1003]:
        for turn in range(r.choice([1, 2, 5, 9, 12])):
            rows.append((c, turn * 2, ["user", "assistant", None][turn % 3], r.choice(["hi", "hé", "", None])))
    rows += [(c, turn, "user", f"copy {turn}") for c in range(200, 240) for turn in range(6)]
    rows += [(300, t, "user", f"long {t % 7}") for t in range(400)] + [(301, None, "user", "x"), (301, 0, "user", "y" * 100_000), (302, 0, "a", "1:b"), (303, 0, "a1:b", "")]
    x = table(spark, [*rows, (None, 0, "user", "lost")])
    same(louds.prefix_trie(x, shard).collect(), brute(rows))


def test_small_tables(spark):
    assert louds.prefix_trie(table(spark, [])).count() == 0
    same(louds.prefix_trie(table(spark, [(7, 0, "user", "a")])).collect(), brute([(7, 0, "user", "a")]))
    # Repeated turns stay, in a fixed order.
    got = louds.prefix_trie(table(spark, [(7, 0, "user", "a"), (7, 0, "user", "a"), (7, None, None, None)])).collect()
    assert {(r["depth"], r["n_leaves"], r["saved_tokens"]) for r in got} <= {(d, 1, 0) for d in range(4)}


def test_louds_bits():
    # 0 has the children 1 and 2; 1 has 3.
    names, parents = np.array([[0, 0], [1, 9], [2, 9], [3, 9]]), np.array([[0, 0], [0, 0], [0, 0], [1, 9]])
    t = louds.Louds(names, parents, np.array([0, 1, 1, 2]))
    assert "".join(map(str, t.bits.astype(int))) == "101101000"[:9]
    assert t.parent.tolist() == [-1, 0, 0, 1] and t.degree.tolist() == [2, 1, 0, 0]
    assert t.rolled_up(np.array([1, 10, 100, 1000])).tolist() == [1111, 1010, 100, 1000]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    same(registry.op12_prefix_trie(spark, sf).collect(), brute(rows))

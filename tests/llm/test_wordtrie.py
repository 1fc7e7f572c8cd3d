"""Importance resampling against brute force."""

import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tactigrid.llm import registry, wordtrie

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, weight string, bucket int, rank int"


def features(text, longest):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, buckets, longest, least, percent, seed):
    """Rows (doc_id, n_features, weight, score, rank) of (doc_id, text) and texts."""
    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for f in features(text, longest)[1]:
            s[at(f)] += 1
    for text in target:
        for f in features(text, longest)[1]:
            t[at(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        n, found = features(text, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[at(f)] for f in found)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:4]) + (None if isinstance(r[4], bool) else r[4],) for r in rows]


def same(got, want):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


TEXTS = ["The quick brown fox, the lazy DOG", "", None, " .,;\t\x00 ", "Ünïcode ﬁsh Straße ünïcode ÉTÉ", "a1b2 c3-d4_e5", "x" * 5000, "one two three " * 90, "the quick brown fox", "the quick brown fox"]


@pytest.mark.parametrize(("longest", "nodes"), [(1, 1 << 18), (3, 1 << 18), (2, 4)])
def test_against_brute_force(spark, longest, nodes, monkeypatch):
    monkeypatch.setattr(wordtrie, "STEP", 7)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0]), (None, TEXTS[7]), (3, TEXTS[0]), (8, TEXTS[8])]
    docs = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in rows], SCHEMA).repartition(3)
    target = ["the quick red fox", None, "ÉTÉ one two", ""]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    gain = wordtrie.gains(wordtrie.totals(docs, 50, longest, nodes), wordtrie.totals(bench, 50, longest, nodes), 50)
    scored = wordtrie.weights(docs, gain, longest, nodes).withColumn("score", F.col("weight") + wordtrie.noise(F.col("doc_id"), 7))
    got = wordtrie.ranked(scored, F.col("n_words") >= 3, 60).select("doc_id", "n_features", "weight", "score", "rank").collect()
    same(got, brute(rows, target, 50, longest, 3, 60, 7))


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "text string")
    assert wordtrie.resample(docs, bench).count() == 0
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = wordtrie.resample(spark.createDataFrame(rows, "doc_id long, text string"), bench, least=1, percent=100).collect()
    same(got, brute(rows, [], 10_000, 1, 1, 100, 2024))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    same(registry.op13_importance_resampling(spark, sf).collect(), brute(docs, target, 10_000, 1, 20, 10, 2024))

"""Importance resampling towards a target distribution, with partition-local tries of words.

Features are runs of 1 to `longest` consecutive words, hashed into buckets by crc32. Each task grows a
trie of its texts' words: a node is a run, keeps how often the run stands there, and the state of the
crc32 over its bytes, so that a child's bucket needs only the child's word. Tasks send their buckets'
totals alone; these are added up, and a second walk over the texts finds each node's gain attached to it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

#: A-Z are lower-cased; every other ASCII byte but digits and letters parts words, as a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Nodes of a task's trie; beyond it the counts are handed over and the trie starts anew.
NODES = 1 << 18
#: Words that are walked together.
STEP = 1 << 17


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Trie:
    """Nodes by number; node 0 is the root. A node's run ends with its word, and begins with its parent's run."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.kids: list[dict[bytes, int] | None] = [None]
        self.crc = [0]

    def __len__(self) -> int:
        return len(self.crc)

    def child(self, node: int, word: bytes) -> int:
        kids = self.kids[node]
        if kids is None:
            kids = self.kids[node] = {}
        at = kids.get(word)
        if at is None:
            at = kids[word] = len(self.crc)
            self.crc.append(zlib.crc32(b" " + word if node else word, self.crc[node]))
            self.kids.append(None)
        return at

    def walk(self, run: list[bytes], longest: int) -> Iterator[np.ndarray]:
        """The nodes of all runs of 1 word, of 2 words, and so on, by where they begin."""
        level = [0] * len(run)
        for n in range(min(longest, len(run))):
            level = list(map(self.child, level, run[n:]))
            yield np.array(level, np.int64)

    def bucket(self, first: int = 0) -> np.ndarray:
        return np.array(self.crc[first:], np.int64) % self.buckets


def pieces(run: list[bytes], longest: int) -> Iterator[tuple[list[bytes], int]]:
    """A long text's words in steps: the words of a step with those that its last runs need, and how many runs begin in the step."""
    for first in range(0, len(run), STEP):
        yield run[first : first + STEP + longest - 1], min(STEP, len(run) - first)


def walked(trie: Trie, run: list[bytes], longest: int) -> Iterator[np.ndarray]:
    for part, begins in pieces(run, longest):
        for nodes in trie.walk(part, longest):
            yield nodes[:begins]


def totals(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, nodes: int = NODES) -> DataFrame:
    """(bucket, n) over all rows of texts (text): how many features, repeats counted, fall into each bucket that has some."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, trie, counts = np.zeros(buckets, np.int64), Trie(buckets), np.zeros(1, np.int64)
        for b in batches:
            for t in b["text"]:
                for found in walked(trie, words(t), longest):
                    if len(trie) > len(counts):
                        counts = np.concatenate((counts, np.zeros(2 * len(trie) - len(counts), np.int64)))
                    counts += np.bincount(found, minlength=len(counts)) if len(found) * 8 > len(counts) else 0
                    if len(found) * 8 <= len(counts):
                        np.add.at(counts, found, 1)
                if len(trie) > nodes:
                    np.add.at(total, trie.bucket(1), counts[1 : len(trie)])
                    trie, counts = Trie(buckets), np.zeros(1, np.int64)
        np.add.at(total, trie.bucket(1), counts[1 : len(trie)])
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    return texts.select("text").mapInPandas(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Each bucket's gain, floor(1000 * ln(target's smoothed share / source's)), of two tables of totals; at most `buckets` rows reach the driver."""
    spark = source.sparkSession
    x = spark.range(buckets).withColumnRenamed("id", "bucket")
    x = x.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    x = store.table(x.select("bucket", "s", "t"), "wordtrie-totals")
    all_s, all_t = x.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    share = ((F.col("t") + 1).cast("double") * F.lit(float(all_s + buckets))) / ((F.col("s") + 1).cast("double") * F.lit(float(all_t + buckets)))
    rows = x.select("bucket", F.floor(F.lit(1000.0) * F.ln(share)).cast("long").alias("gain")).collect()
    out = [0] * buckets
    for r in rows:
        out[r["bucket"]] = r["gain"]
    return out


def weights(docs: DataFrame, gain: list[int], longest: int = LONGEST, nodes: int = NODES) -> DataFrame:
    """docs (doc_id, text) as (doc_id, n_words, n_features, weight): the gains of each text's features summed over the trie's paths."""
    buckets, kind = len(gain), dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(np.array(gain, np.int64))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, attached = Trie(buckets), np.zeros(1, np.int64)
        for b in batches:
            rows = []
            for t in b["text"]:
                run, n, weight = words(t), 0, 0
                for found in walked(trie, run, longest):
                    if len(trie) > len(attached):
                        attached = np.concatenate((attached, shared.value[trie.bucket(len(attached))]))
                    n, weight = n + len(found), weight + int(attached[found].sum())
                rows.append((len(run), n, weight))
                if len(trie) > nodes:
                    trie, attached = Trie(buckets), np.zeros(1, np.int64)
            out = pd.DataFrame(rows, columns=["n_words", "n_features", "weight"], dtype="int64")
            out.insert(0, "doc_id", b["doc_id"].array)
            yield out

    return docs.select("doc_id", "text").mapInPandas(work, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of a document in thousandths, from sha256 of seed and doc_id; a null doc_id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """scored with rank: 1, 2, 3 ... for the first floor(percent * N / 100) of the N eligible rows by falling score, ties to the smaller doc_id (null last).

    Rows are dealt by ranges of (score, doc_id, row), sorted where they are and written with their
    place; a range's first rank is the number of rows in the ranges before it, so no task sees them all.
    """
    spark = scored.sparkSession
    rows = store.table(scored.withColumn("row_", F.monotonically_increasing_id()).withColumn("in_", eligible), "wordtrie-scored")
    order = [F.desc("in_"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row_")]
    dealt = rows.repartitionByRange(store.partitions(spark), *order).sortWithinPartitions(*order)
    dealt = store.table(dealt.withColumn("place_", F.monotonically_increasing_id()), "wordtrie-places")
    # monotonically_increasing_id: the partition's number above 33 bits of the row's place in it.
    task = F.shiftright("place_", 33)
    sizes = sorted((r["task"], r["n"], r["n_in"]) for r in dealt.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("in_"), 1)).alias("n_in")).collect())
    drawn = percent * sum(n_in for _, _, n_in in sizes) // 100
    before, first = {}, 0
    for k, n, _ in sizes:
        before[k] = first
        first += n
    if not before:
        return dealt.withColumn("rank", F.lit(None).cast("long")).drop("row_", "in_", "place_")
    begins = spark.createDataFrame(list(before.items()), "task_ long, before_ long")
    x = dealt.withColumn("task_", task).join(F.broadcast(begins), "task_")  # a row for each shuffle partition
    rank = F.col("before_") + F.col("place_").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return x.withColumn("rank", F.when(F.col("in_") & (rank <= drawn), rank)).drop("row_", "in_", "place_", "task_", "before_")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, least: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text) resampled towards target (text): doc_id, n_features, weight, score, rank for every row of docs.

    weight sums the gains of a text's features; score adds seeded Gumbel noise; of the N rows with at
    least `least` words the floor(percent * N / 100) highest scores are drawn and numbered by rank.

    A null or empty text has no features and weighs 0. A null doc_id has noise of its own and comes
    last in ties; repeated rows keep their rows, have equal scores and take consecutive ranks in an
    order that is not fixed. Texts of any length are walked whole. Further columns of either table
    are ignored. An empty target makes every gain a matter of docs alone; empty docs give an empty table.
    """
    gain = gains(totals(docs, buckets, longest), totals(target, buckets, longest), buckets)
    x = weights(docs, gain, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return ranked(x, F.col("n_words") >= least, percent).select("doc_id", "n_features", "weight", "score", "rank")

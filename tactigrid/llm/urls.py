"""Exact URL filters by a cascade of Bloom filters, with DataFrame functions only.

Level 1 holds the listed keys, level 2 those keys of the corpus that level 1 takes for listed ones,
level 3 the listed keys that level 2 takes, and so on until a level takes nothing wrongly. For every
key of the corpus the first level that says no decides, so membership is exact without a join.

A key is a host suffix at a label's border followed by a path prefix. Listed keys are the rules' and
the blocked domains' (with an empty path). All of a corpus's distinct candidate keys are the universe.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

BITS_PER_KEY = 10
HASHES = 5
#: Bytes of all levels together, at most: they go to every task.
FILTER_BYTES = 4_000_000
#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Domains that are blocked where no rule fits.
BLOCKED = ("ads-track.example.com", "casino-win.example.net")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The lower-cased host (A-Z) and the path, both empty for null or without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    ascii_lower = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(ascii_lower, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and each shorter suffix at a label's border; none for an empty host."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), ".")))


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys that could be listed for a url: each host suffix alone and with each path prefix of the rules' lengths."""
    heads = F.array_distinct(F.filter(F.array(F.lit(""), *[F.left(path, F.lit(n)) for n in lengths]), lambda p: F.length(p) <= F.length(path)))
    return F.flatten(F.transform(suffixes(host), lambda s: F.transform(heads, lambda p: F.concat(s, p))))


class Cascade:
    """Levels of Bloom filters, each (bits, words of 64 bits as JSON)."""

    def __init__(self, levels: list[tuple[int, str]]):
        self.levels = levels

    @staticmethod
    def places(key: Column, level: int, bits: int) -> list[Column]:
        """Bit places from two hashes; each level has its own."""
        a, b = F.xxhash64(F.lit(2 * level), key), F.xxhash64(F.lit(2 * level + 1), key)
        return [F.pmod(F.pmod(a, F.lit(bits)) + F.pmod(b, F.lit(bits)) * i, F.lit(bits)) for i in range(HASHES)]

    @classmethod
    def level(cls, keys: DataFrame, n: int, level: int) -> tuple[int, str]:
        bits = max(64, -(-n * BITS_PER_KEY // 64) * 64)
        places = keys.select(F.explode(F.array(*cls.places(F.col("key"), level, bits))).alias("p"))
        words = places.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("x"))
        array = [0] * (bits // 64)
        for r in words.collect():  # the filter: bounded by FILTER_BYTES
            array[r["w"]] = r["x"]
        return bits, json.dumps(array)

    @staticmethod
    def holds(key: Column, level: int, bits: int, words: str) -> Column:
        array = F.from_json(F.lit(words), "array<bigint>")
        out = F.lit(True)
        for p in Cascade.places(key, level, bits):
            out = out & (F.getbit(F.get(array, F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1)
        return out

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame) -> Cascade:
        """The cascade of listed (key) over universe (key), both distinct; a listed key need not be in the universe."""
        inside = store.table(listed.select("key").distinct(), "bloom-listed")
        outside = store.table(universe.select("key").join(inside, "key", "left_anti"), "bloom-others")
        levels: list[tuple[int, str]] = []
        mine, other = inside, outside
        while (n := mine.count()) > 0:
            if sum(b for b, _ in levels) + n * BITS_PER_KEY > 8 * FILTER_BYTES:
                raise ValueError(f"the listed keys need more than {FILTER_BYTES} bytes; build a cascade for each part of the keys")
            levels.append(cls.level(mine, n, len(levels)))
            wrong = store.table(other.where(cls.holds(F.col("key"), len(levels) - 1, *levels[-1])), "bloom-level")
            mine, other = wrong, mine
        return cls(levels)

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe or list is listed: the first level that says no decides; an even level's no means listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k in reversed(range(len(self.levels))):
            out = F.when(~self.holds(key, k, *self.levels[k]), F.lit(k % 2 == 1)).otherwise(out)
        return out


def judge(pages: DataFrame, rules: tuple = RULES, blocked: tuple = BLOCKED) -> DataFrame:
    """pages (page_id, url): page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains where the path starts with its path; the longest wins,
    and without one a blocked domain or subdomain blocks. A null url, or one without "://", has empty
    host and path, no rule, and is allowed. Rows stay as they are, repeated ones and null ids too;
    further columns are ignored; an empty table gives an empty table.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    x = pages.select("page_id", host.alias("host"), path.alias("path"))
    by_rule = {h + p: v for h, p, v in rules}
    lengths = sorted({len(p) for _, p, _ in rules})
    keys = candidates(F.col("host"), F.col("path"), lengths)
    parts = x.select("host", *[F.left("path", F.lit(n)).alias(f"p{n}") for n in lengths[-1:]]).distinct()
    universe = parts.select(F.explode(candidates(F.col("host"), F.col(f"p{lengths[-1]}"), lengths)).alias("key")).distinct()
    listed = spark.createDataFrame([(k,) for k in dict.fromkeys([*by_rule, *blocked])], "key string")
    cascade = Cascade.build(listed, universe)
    hits = F.filter(keys, cascade.contains)
    x = x.withColumn("hits", F.array_sort(hits, lambda a, b: F.length(b) - F.length(a)))
    verdicts = F.create_map(*[F.lit(y) for kv in by_rule.items() for y in kv])
    x = x.withColumn("rule", F.get(F.filter("hits", lambda k: F.contains(k, F.lit("/"))), F.lit(0)))
    verdict = F.coalesce(verdicts[F.col("rule")], F.when(F.size("hits") > 0, "block").otherwise("allow"))
    return x.select("page_id", "host", "path", "rule", verdict.alias("verdict"))

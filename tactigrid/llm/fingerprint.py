"""Canonical exact digests of documents, with DataFrame functions only.

Canonical text: each code point is replaced by the full decomposition of its case folding (tables
made by rule from Python's Unicode data), marks are put in canonical order, white space runs become
one space, ends are trimmed. The digest is two xxhash64 values with different seeds. Texts whose
digests are equal are then compared by their bytes: one row per digest and task reaches the
shuffle, and texts that differ inside a bucket get a number behind the digest.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import store

#: The first Hangul syllable and how many there are; the first code point of the private planes, none of which folds.
HANGUL, SYLLABLES, PRIVATE = 0xAC00, 11_172, 0xF0000
#: Stands between values, none of which has it.
SEPARATOR = "\n"
#: Rows of a side that is sent to every task; a larger side is shuffled.
BROADCAST_ROWS = 500_000
#: The second hash's seed value, hashed before the text.
SEED = "second"
SPACES = r"[\t-\r\x1c-\x20\x85   ]+"


def folded(c: str) -> str:
    """The fixed point of case folding and compatibility decomposition."""
    x = unicodedata.normalize("NFKD", c)
    while (y := unicodedata.normalize("NFKD", x.casefold())) != x:
        x = y
    return x


def marks() -> str:
    """A character class of all code points with a combining class."""
    points = [i for i in range(sys.maxunicode + 1) if unicodedata.combining(chr(i))]
    runs: list[list[int]] = []
    for i in points:
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs) + "]"


_made: dict[str, str] = {}


def tables() -> dict[str, str]:
    """The marks' character class; strings of the code points that fold (but Hangul syllables) with their values, and of the marks with a letter for each one's combining class.

    A plan names them several times over, and the driver keeps and prints its plans, so they have no gaps.
    """
    if not _made:
        points = [chr(i) for i in range(128, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
        fold = {c: x for c in points if not 0 <= ord(c) - HANGUL < SYLLABLES and (x := folded(c)) != c}
        order = {c: chr(x) for c in points if (x := unicodedata.combining(c))}
        _made["folding"], _made["place"], _made["values"] = "".join(fold), "".join(map(chr, range(PRIVATE, PRIVATE + len(fold)))), SEPARATOR.join(fold.values())
        _made["marked"], _made["order"] = "".join(order), "".join(order.values())
        _made["marks"] = marks()
    return _made


def let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def hangul(c: Column) -> Column:
    """The parts of a Hangul syllable, null for other characters; the standard gives them by rule."""
    part = lambda first, n, i: F.substring(F.lit("".join(map(chr, range(first, first + n)))), (i + 1).cast("int"), F.lit(1))
    parts = lambda s: F.concat(part(0x1100, 19, F.floor(s / 588)), part(0x1161, 21, F.floor(s % 588 / 28)), F.when(s % 28 > 0, part(0x11A8, 27, s % 28 - 1)).otherwise(""))
    return let(F.ascii(c) - HANGUL, lambda s: F.when((s >= 0) & (s < SYLLABLES), parts(s)))


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    t = tables()
    values = F.split(F.lit(t["values"]), SEPARATOR)
    fold = lambda c: F.coalesce(F.get(values, F.ascii(F.translate(c, t["folding"], t["place"])) - PRIVATE), hangul(c))
    order = lambda c: F.translate(c, t["marked"], t["order"])
    letters = lambda s: F.filter(F.array_distinct(F.split(s, "")), lambda c: c != "")
    decomposed = F.aggregate(letters(F.regexp_replace(text, r"[\x00-\x7F\x{F0000}-\x{10FFFF}]+", "")), text, lambda s, c: F.coalesce(F.replace(s, c, fold(c)), s))

    def sorted_run(run: Column) -> Column:
        keyed = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c, i: F.struct(order(c), i, c.alias("c")))
        return F.array_join(F.transform(F.array_sort(keyed), lambda x: x["c"]), "")

    runs = lambda s: F.array_sort(F.array_distinct(F.regexp_extract_all(s, F.lit(f"({t['marks']}{{2,}})"), F.lit(1))), lambda a, b: F.length(b) - F.length(a))
    ordered = let(decomposed, lambda s: F.when(s.rlike(r"\p{M}{2}"), F.aggregate(runs(s), s, lambda x, run: F.replace(x, run, sorted_run(run)))).otherwise(s))
    plain = F.when(F.length(text) == F.octet_length(text), text).otherwise(ordered)
    return F.btrim(F.regexp_replace(F.lower(plain), SPACES, " "), F.lit(" "))


def wide(canon: Column, bits: int) -> list[Column]:
    """Two hashes of so many bits each (64 but in tests)."""
    mask = F.lit(-1 if bits == 64 else (1 << bits) - 1)
    return [F.xxhash64(canon).bitwiseAND(mask), F.xxhash64(F.lit(SEED), canon).bitwiseAND(mask)]


def digests(docs: DataFrame, bits: int) -> DataFrame:
    """docs with the digests a, b of their text."""
    a, b = wide(F.col("canon"), bits)
    return docs.withColumn("canon", canonical(F.col("text"))).select(*docs.columns, a.alias("a"), b.alias("b"))


def hexes(a: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def neighbours(docs: DataFrame, bits: int = 64) -> DataFrame:
    """docs (doc_id, text) with their digests a, b, and next_id, next_text, next_a, next_b of the next row by descending doc_id; the last row's next is the first.

    Rows are dealt to bins of consecutive ids; a copy of each bin's first row stands at the end of
    the bin before it, so each bin is worked on alone and the texts move once.
    """
    spark = docs.sparkSession
    n = 8 * store.partitions(spark)
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n))))
    step = max(1, int(len(cuts) ** 0.5))
    coarse, fine = F.array(*map(F.lit, cuts[::step] or [0.0])), F.array(*map(F.lit, cuts or [0.0]))
    row = F.size(F.filter(coarse, lambda x: x <= F.col("doc_id")))
    bin_of = F.when(F.col("doc_id").isNull(), -1).when(row == 0, 0).otherwise((row - 1) * step + F.size(F.filter(F.slice(fine, (row - 1) * step + 1, F.lit(step)), lambda x: x <= F.col("doc_id"))))
    docs = docs.withColumn("bin", bin_of.cast("int")).withColumn("extra", F.lit(0))
    firsts = docs.groupBy("bin").agg(F.max("doc_id").alias("first_id")).collect()  # a row for each bin
    order = sorted((r["bin"] for r in firsts), reverse=True)
    if not order:
        return digests(docs, bits).select("*", *[F.col(x).alias(f"next_{y}") for x, y in (("doc_id", "id"), ("text", "text"), ("a", "a"), ("b", "b"))])
    before = {b: order[i - 1] for i, b in enumerate(order)}  # the first bin's first row follows the last bin
    heads = spark.createDataFrame([(r["bin"], r["first_id"], before[r["bin"]]) for r in firsts], "bin int, first_id long, before int")
    by = [F.col("doc_id").desc_nulls_last(), "a", "b", F.xxhash64("text"), "text"]
    found = docs.join(F.broadcast(heads), (docs["bin"] == heads["bin"]) & docs["doc_id"].eqNullSafe(heads["first_id"])).drop(heads["bin"])
    found = digests(found, bits).withColumn("rank", F.row_number().over(W.partitionBy("bin").orderBy(*by))).where("rank = 1")
    found = found.select("doc_id", "text", "a", "b", F.col("before").alias("bin"), F.lit(1).alias("extra"))
    w = W.partitionBy("bin").orderBy("extra", *by)
    lead = [F.lead(x).over(w).alias(f"next_{y}") for x, y in (("doc_id", "id"), ("text", "text"), ("a", "a"), ("b", "b"))]
    return digests(docs, bits).unionByName(found).select("*", *lead).where("extra = 0").drop("bin", "extra")


def edit(text: Column, other: Column) -> Column:
    """The text with its last third's code points replaced by the first as many of the other text."""
    k = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.left(text, F.length(text) - k), F.left(other, k))


def fingerprints(docs: DataFrame, bits: int = 64) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text is an empty one; all texts of white space alone share the empty text's digest. Rows
    with the same doc_id are ordered by their digests. A null doc_id comes last. Repeated rows keep
    their rows. An exact digest's likeness is 1 for equal fingerprints and 0 for others. Further
    columns are ignored; an empty table gives an empty table.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    a, b = wide(F.col("canon"), bits)
    linked = neighbours(docs, bits)
    edited = linked.withColumn("edited", edit(F.col("text"), F.col("next_text"))).withColumn("canon", canonical(F.col("edited")))
    rows = edited.select("doc_id", "next_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "a", "b", a.alias("ea"), b.alias("eb"), "next_a", "next_b")
    rows = store.table(rows, "fingerprints")

    bucket = rows.select("a", "b").unionAll(rows.select("ea", "eb")).groupBy("a", "b").count().where("count > 1").select("a", "b")
    shared = _small(store.table(bucket, "fingerprint-buckets"))
    own = rows.join(shared, ["a", "b"], "left_semi").select("doc_id").distinct()
    cut = rows.where("ea != a or eb != b").select("doc_id", "next_id", F.col("ea").alias("a"), F.col("eb").alias("b")).join(shared, ["a", "b"], "left_semi")
    own, cut = (store.table(x, "fingerprint-members") for x in (own, cut))

    def texts() -> DataFrame:
        """(doc_id, kind, a, b, canon) of the members of buckets with more than one text."""
        whole = docs.join(_small(own), docs["doc_id"].eqNullSafe(own["doc_id"])).select(docs["doc_id"], F.lit(0).alias("kind"), canonical(docs["text"]).alias("canon")).select("*", a.alias("a"), b.alias("b"))
        few = cut.withColumnsRenamed({"doc_id": "id", "a": "ca", "b": "cb"})
        first = docs.join(_small(few), docs["doc_id"].eqNullSafe(few["id"])).select("id", "next_id", "ca", "cb", F.col("text").alias("t"))
        both = first.join(docs, first["next_id"].eqNullSafe(docs["doc_id"])).select(F.col("id").alias("doc_id"), F.lit(1).alias("kind"), "ca", "cb", canonical(edit(F.col("t"), F.col("text"))).alias("canon"))
        return whole.unionByName(both.select("*", a.alias("a"), b.alias("b")).where("a = ca and b = cb").drop("ca", "cb"))

    compared = texts().groupBy("a", "b").agg(F.min("canon").alias("least"), F.max("canon").alias("most"))
    differ = store.table(compared.where("least != most").select("a", "b"), "fingerprint-collisions")
    if differ.count() == 0:  # equal digests, equal bytes
        rows = rows.select("*", *[F.lit(0).alias(x) for x in ("n0", "n1", "n2")])
    else:
        mixed = texts().join(_small(differ), ["a", "b"], "left_semi")
        ranks = mixed.select("a", "b", "canon").distinct().withColumn("n", F.row_number().over(W.partitionBy("a", "b").orderBy("canon")) - 1)
        numbered = store.table(mixed.join(ranks, ["a", "b", "canon"]).groupBy("doc_id", "kind", "a", "b").agg(F.min("n").alias("n")), "fingerprint-numbers")
        for n, kind, key, x, y in (("n0", 0, "doc_id", "a", "b"), ("n1", 1, "doc_id", "ea", "eb"), ("n2", 0, "next_id", "next_a", "next_b")):
            side = numbered.where(f"kind = {kind}").select(F.col("doc_id").alias("k"), F.col("a").alias("x"), F.col("b").alias("y"), F.col("n").alias(n))
            rows = rows.join(side, rows[key].eqNullSafe(side["k"]) & (rows[x] == side["x"]) & (rows[y] == side["y"]), "left").drop("k", "x", "y").fillna({n: 0})
        rows = rows.withColumn("n1", F.when((F.col("ea") == F.col("a")) & (F.col("eb") == F.col("b")) & (F.col("n_chars") < 3), F.col("n0")).otherwise(F.col("n1")))
    name = lambda x, y, n: F.concat(hexes(F.col(x), F.col(y)), F.when(F.col(n) > 0, F.concat(F.lit("-"), F.col(n).cast("string"))).otherwise(""))
    rows = rows.select("*", name("a", "b", "n0").alias("fingerprint"), name("ea", "eb", "n1").alias("edited_fingerprint"), name("next_a", "next_b", "n2").alias("next_fingerprint"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", (F.col("fingerprint") == F.col("edited_fingerprint")).cast("double").alias("near_edited"), (F.col("fingerprint") == F.col("next_fingerprint")).cast("double").alias("near_next"))

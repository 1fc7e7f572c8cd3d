"""Language ID by Bayesian fusion of evidence.

For each row and language the log-posterior adds

* the text's likelihood: byte trigrams (hashed) of a multinomial model, tempered as trigrams overlap;
* the declared language's likelihood, from a confusion table of declared and text-only languages;
* the address suffix's likelihood, from a table of suffixes and text-only languages;
* the host's prior, smoothed towards its parent domain's, and that towards the whole corpus's.

All tables come from all rows by grouped aggregation; only the trigram model is fitted on a bounded
sample of labelled rows. Texts are never shuffled: the likelihoods of a row are a few numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store, text

BUCKETS = 1 << 15
#: Values of the hash that draws the sample.
SPACE = 1 << 40
#: Labelled rows that the trigram model is fitted on, at most (about), but for EACH rows of each language.
SAMPLE = 20_000
EACH = 100
#: A language needs so many labelled rows.
LEAST = 5
#: Weight of a trigram's log-likelihood, and trigrams that count at most.
TEMPER, MOST = 0.33, 600
#: Rows that a host's (domain's) prior takes from its parent's.
STRENGTH = 20.0
#: A row is kept if its posterior is this or more and its text is more likely than by chance.
POSTERIOR = 0.5
BROADCAST_ROWS = 200_000
#: Rows whose texts are read together.
ROWS = 256
_LETTER = re.compile(r"[^\W\d_]")


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that no more texts than these become Python's."""
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            yield b.slice(i, ROWS)


def trigrams(s: str) -> np.ndarray:
    b = np.frombuffer(s.encode("utf-8", "surrogatepass").translate(text.LOWER), np.uint8).astype(np.uint32)
    if len(b) < 3:
        b = np.concatenate((b, np.full(3 - len(b), 32, np.uint32)))
    x = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
    return (x ^ (x >> np.uint32(15))) % np.uint32(BUCKETS)


def base_language(declared: Column) -> Column:
    """The primary subtag, lower-cased; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(declared, F.lit("")), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1)), F.lit(""))


def markup_language(html: Column) -> Column:
    return base_language(F.regexp_extract(html, r"""(?i)<html[^>]*\slang\s*=\s*["']?([A-Za-z_-]+)""", 1))


def markup_text(html: Column) -> Column:
    """A page's text, without comments, scripts, styles and tags."""
    s = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    return F.regexp_replace(s, r"<[^>]*>|&[a-zA-Z]+;|&#\d+;", " ")


def level(counts: list[int], sample: int) -> int:
    """The most rows of a language, so that all languages together give about sample rows, and each EACH if it has them."""
    left = sample
    for i, n in enumerate(sorted(counts)):
        share = left // (len(counts) - i)
        if n > share:
            return max(share, EACH)
        left -= n
    return max(sample, EACH)


def fit(rows: DataFrame, id_columns: list[str], sample: int) -> tuple[list[str], np.ndarray]:
    """The languages, which are all of LEAST labelled rows, and the log-probabilities (buckets x languages), from a sample of each."""
    labelled = rows.where("declared is not null and text is not null and text != ''").withColumn("at", F.pmod(F.xxhash64("text", *id_columns), F.lit(SPACE)))
    found = labelled.groupBy("declared").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).where(F.col("n") >= LEAST).collect()
    names = sorted(r["declared"] for r in found) or ["und"]
    place = {name: i for i, name in enumerate(names)}
    most = level([r["n"] for r in found], sample)
    # The row of the least hash is in any sample.
    cuts = rows.sparkSession.createDataFrame([(r["declared"], max(r["first"], SPACE * most // r["n"])) for r in found], "declared string, cut long")
    labelled = labelled.join(F.broadcast(cuts), "declared").where("at <= cut")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in parts(batches):
            for d, t in zip(b.column("declared").to_pylist(), b.column("text").to_pylist(), strict=True):
                n = np.bincount(trigrams(t), minlength=BUCKETS)
                seen[d] = seen[d] + n if d in seen else n
        for d, n in seen.items():
            j = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), place[d], np.int32)), pa.array(j.astype(np.int32)), pa.array(n[j].astype(float))], ["i", "j", "n"])

    got = labelled.select("declared", "text").mapInArrow(count, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).toPandas()
    x = np.full((BUCKETS, len(names)), 0.05)
    x[got["j"], got["i"]] += got["n"]
    return names, np.log(x / x.sum(0))


def spread(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def identify(rows: DataFrame, id_columns: list[str], sample: int = SAMPLE) -> DataFrame:
    """rows (ids, text, declared, suffix, host): ids, language, posterior, declared, kept.

    Evidence that is null says nothing. A null text is an empty one. A text without letters, or less
    likely in each language than by chance, or without a language of enough posterior, is rejected:
    kept is false, language "und". Ties go to the first language by name. Repeated rows and null ids
    keep their rows. Further columns are ignored; an empty table gives an empty table.
    """
    rows = rows.select(*id_columns, "text", base_language(F.col("declared")).alias("declared"), F.nullif(F.lower("suffix"), F.lit("")).alias("suffix"), F.nullif(F.lower("host"), F.lit("")).alias("host"))
    names, logp = fit(rows, id_columns, sample)
    n = len(names)
    model = rows.sparkSession.sparkContext.broadcast(logp.astype(np.float32))
    chance = -np.log(BUCKETS)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            sums, likely = np.zeros((b.num_rows, n)), np.zeros(b.num_rows, bool)
            for k, t in enumerate(b.column("text").to_pylist()):
                if not t or not _LETTER.search(t):
                    continue
                x, total = trigrams(t), np.zeros(n)
                for i in range(0, len(x), 1 << 14):
                    total += model.value[x[i : i + (1 << 14)]].sum(0, dtype=np.float64)
                mean = total / len(x)
                sums[k], likely[k] = mean * min(len(x), MOST) * TEMPER, mean.max() > chance
            ll = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, n, dtype=np.int32)), pa.array(sums.ravel()))
            names = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), ll, pa.array(likely)], [*names, "ll", "likely"])

    kinds = dict(rows.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in [*id_columns, "declared", "suffix", "host"])
    x = store.table(rows.mapInArrow(score, f"{fields}, ll array<double>, likely boolean"), "language-text")
    best = F.array_position("ll", F.array_max("ll")).cast("int") - 1
    x = x.withColumn("best", best).withColumn("domain", F.regexp_replace("host", r"^[^.]*\.(?=.*\.)", ""))
    sure = x.where("likely")
    order = F.sequence(F.lit(0), F.lit(n - 1))

    def counted(*by: str) -> DataFrame:
        """by and c, an array of the rows by best language; the plan does not grow with the number of languages."""
        seen = sure.where(F.col(by[0]).isNotNull()).groupBy(*by, "best").count()
        seen = seen.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("best", F.col("count").cast("double")))).alias("m"))
        return seen.select(*by, F.transform(order, lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("c"))

    whole = {r["best"]: float(r["count"]) for r in sure.groupBy("best").count().collect()}
    prior = [(whole.get(k, 0.0) + 1) / (sum(whole.values()) + n) for k in range(n)]

    def likelihood(column: str) -> DataFrame:
        """log P(value | language) as an array by value, add-one smoothed over the values seen and one more."""
        seen = store.table(counted(column), f"language-{column}-counts")
        values = seen.count()
        sums = {r["best"]: float(r["count"]) for r in sure.where(F.col(column).isNotNull()).groupBy("best").count().collect()}
        below = F.array(*[F.lit(sums.get(k, 0.0) + values + 1) for k in range(n)])
        return seen.select(column, F.zip_with("c", below, lambda a, b: F.log((a + 1) / b)).alias(f"p_{column}"))

    def smoothed(c: Column, below: Column) -> Column:
        total = F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(c, below, lambda a, b: (a + STRENGTH * b) / (total + STRENGTH))

    every = F.array(*map(F.lit, prior))
    by_domain = counted("domain").select("domain", smoothed(F.col("c"), every).alias("d"))
    by_host = counted("host", "domain").join(spread(by_domain), "domain")
    by_host = by_host.select("host", F.transform(smoothed(F.col("c"), F.col("d")), lambda p: F.log(p)).alias("p_host"))
    for side, key in ((likelihood("declared"), "declared"), (likelihood("suffix"), "suffix"), (by_host, "host")):
        x = x.join(spread(store.table(side, f"language-{key}")), key, "left")
    logs = F.coalesce("p_host", F.array(*[F.lit(float(np.log(p))) for p in prior]))
    none = F.array_repeat(F.lit(0.0), n)
    for part in (F.col("ll"), F.coalesce("p_declared", none), F.coalesce("p_suffix", none)):
        logs = F.zip_with(logs, part, lambda a, b: a + b)
    x = x.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    x = x.withColumn("posterior", 1 / F.aggregate("logs", F.lit(0.0), lambda s, y: s + F.exp(y - F.col("top"))))
    x = x.withColumn("kept", F.col("likely") & (F.col("posterior") >= POSTERIOR))
    language = F.when(F.col("kept"), F.element_at(F.array(*map(F.lit, names)), F.array_position("logs", F.col("top")).cast("int"))).otherwise("und")
    return x.select(*id_columns, language.alias("language"), "posterior", "declared", "kept")


def of_documents(docs: DataFrame) -> DataFrame:
    """Documents as rows: the declared language is lang, the host is the source."""
    return docs.select("doc_id", "text", F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"))


def of_pages(pages: DataFrame) -> DataFrame:
    """Pages as rows: the declared language is the markup's, the suffix is the host's last label."""
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#:]*)", 1)
    return pages.select("page_id", markup_text(F.col("html")).alias("text"), markup_language(F.col("html")).alias("declared"), F.element_at(F.split(host, r"\."), -1).alias("suffix"), host.alias("host"))

"""LM scoring by the lattice of subwords.

The pieces are those of an existing byte-level vocabulary. A word of a text is the byte string
b" " + word; its probability is the sum, over all ways to cut it into pieces, of the product of the
pieces' probabilities. Pieces never cross words, so a text's log-probability is the sum over its
words and one end, which is a symbol of the same distribution.
Each class of texts (by declared language) has its own probabilities of the pieces. A whole training
word is one more arc from its begin to its end, weighted by its discounted count in the class; the
mass that discounting frees goes to the pieces' arcs and, a small part, to the pooled counts. A text's
probability is the sum over the classes: all counts come from all training texts by grouped
aggregation, discounts from how many words occur once and twice.

The vocabulary's own scores are its ranks (Zipf's law), from which EM over the distinct training
words of each class starts.
"""

from __future__ import annotations

import base64
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, text

#: So many words at most, the most frequent ones, are looked up in memory, at any size of the corpus; a join counts the others.
FREQUENT = 131_072
#: Distinct words that a task holds before it passes their counts on.
HELD = 400_000
ITERATIONS = 3
#: Discount where no word occurs once or none twice.
DISCOUNT = 0.6
#: Part of the freed mass that goes to the pooled counts.
POOLED = 0.02
#: Classes of texts at most: the most frequent declared languages and the rest.
CLASSES = 8
#: Added to each piece's expected count.
ALPHA = 0.005
#: Bytes of a word from which it is scored alone.
LONG = 48
ZIPF_SHIFT = 50.0
#: Log by which a byte raises a piece's probability while sums are taken outside the logarithm, and the least sum that such sums are trusted with.
RAISED, LEAST = 3.0, 1e-200


def load_pieces(path: str) -> list[bytes]:
    """The vocabulary's pieces by rank, from lines of base64 and rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return [base64.b64decode(a) for a, _ in sorted(pairs, key=lambda x: int(x[1]))]


#: Odd multipliers: of a span's hash for each byte more, and of a hash for its slot.
ROLL, SPREAD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """Ids of pieces by rolling 64-bit hashes of their bytes: tables of slots, each holding what found its slot taken in those before."""

    def __init__(self, pieces: list[bytes]):
        size = np.array([len(p) for p in pieces], np.int64)
        buf, starts = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size
        self.hashes = np.zeros(len(pieces), np.uint64)
        for j in range(int(size.max(initial=0))):
            at = np.flatnonzero(size > j)
            self.hashes[at] = self.rolled(self.hashes[at], buf[starts[at] + j])
        self.tables = []
        bits, rest = max(4, (16 * len(pieces)).bit_length()), np.arange(len(pieces))
        while len(rest):
            table, slots = np.full(1 << bits, -1, np.int32), self.slots(self.hashes[rest], bits, len(self.tables))
            table[slots] = rest
            rest = rest[table[slots] != rest]
            self.tables.append((bits, table))

    @staticmethod
    def rolled(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The hashes of spans that go on with these bytes; the empty span's is 0."""
        return h * ROLL + (byte.astype(np.uint64) + np.uint64(1))

    @staticmethod
    def slots(h: np.ndarray, bits: int, k: int) -> np.ndarray:
        return (((h * SPREAD) << np.uint64(7 * k)) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The ids, -1 where there is no such piece."""
        out, left, flat = np.full(h.size, -1, np.int32), None, np.ravel(h)
        for k, (bits, table) in enumerate(self.tables):
            got = table[self.slots(flat, bits, k)]
            taken = np.flatnonzero(got >= 0)
            hit = self.hashes[got[taken]] == flat[taken]
            at = taken if left is None else left[taken]
            out[at[hit]] = got[taken[hit]]
            left, flat = at[~hit], flat[taken[~hit]]  # only what another piece keeps from its slot can be further on
        return out.reshape(h.shape)

    def among(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of flat hashes, the places of those that are pieces' (in no order), and their ids."""
        places, ids, left = [], [], None
        for k, (bits, table) in enumerate(self.tables):
            got = table[self.slots(h, bits, k)]
            taken = np.flatnonzero(got >= 0)
            got, at = got[taken], taken if left is None else left[taken]
            hit = self.hashes[got] == h[taken]
            places.append(at[hit])
            ids.append(got[hit])
            left, h = at[~hit], h[taken[~hit]]
        return np.concatenate(places), np.concatenate(ids)


class Lattice:
    """Forward and backward sums over the segmentations of words, for all words of one length at once.

    logp holds the pieces' log-probabilities, or a row of them for each class. The sums are of
    probabilities, each raised by its piece's length so that a word's stays in reach of a double;
    a word with a sum too small for that, and a long one, is summed in logarithms.
    """

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        logp = np.atleast_2d(logp)
        self.pieces, self.logp, self.longest = Pieces(pieces), np.hstack([logp, np.full((len(logp), 1), -np.inf)]), max(map(len, pieces))
        self.raised = np.exp(self.logp + RAISED * np.array([*map(len, pieces), 0]))

    def groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For words of one length: their places, their bytes' start in a buffer, and the buffer; long words come alone."""
        lengths = np.array([len(w) for w in words], np.int64)
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for same in np.split(order, cuts):
            n = int(lengths[same[0]]) if len(same) else 0
            step = max(1, 200_000 // max(1, n * n))
            for i in range(0, len(same), step):
                at = same[i : i + step]
                yield at, n * np.arange(len(at)), np.frombuffer(b"".join([words[k] for k in at]), np.uint8)

    def arcs(self, start: np.ndarray, n: int, buf: np.ndarray) -> dict[int, np.ndarray]:
        """For each end j: the piece ids (words x starts i from max(0, j - longest)), -1 where there is none."""
        out, h = {}, np.zeros((len(start), n), np.uint64)
        for j in range(1, n + 1):
            first = max(0, j - self.longest)
            h[:, first:j] = self.pieces.rolled(h[:, first:j], buf[start + j - 1][:, None])
            out[j] = self.pieces.find(h[:, first:j])
        return out

    def spans(self, word: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for one word, end by end: the starts and the piece ids."""
        h = np.zeros(0, np.uint64)
        for j, byte in enumerate(np.frombuffer(word, np.uint8)[:, None], 1):
            h = self.pieces.rolled(np.append(h, np.uint64(0))[-self.longest :], byte)
            yield np.arange(j - len(h), j), self.pieces.find(h)

    @staticmethod
    def forward(arcs: dict[int, np.ndarray], logp: np.ndarray, words: int) -> np.ndarray:
        """alpha[:, j]: log of the summed probability of all segmentations of the first j bytes."""
        alpha = np.zeros((words, len(arcs) + 1))
        for j, ids in arcs.items():
            alpha[:, j] = log_sum(alpha[:, j - ids.shape[1] : j] + logp[ids])
        return alpha

    def hits(self, start: np.ndarray, n: int, buf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each end: of the pieces that end there, the words, the places in a flat table of starts x words, and the ids."""
        out, size = [], len(start)
        h, word = np.zeros((n, size), np.uint64), np.tile(np.arange(size), min(n, self.longest))
        for j in range(1, n + 1):
            first = max(0, j - self.longest)
            h[first:j] = self.pieces.rolled(h[first:j], buf[start + j - 1])
            flat, ids = self.pieces.among(h[first:j].reshape(-1))
            out.append((word[flat], flat + first * size, ids))
        return out

    @staticmethod
    def sums(hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]], raised: np.ndarray, words: int) -> np.ndarray:
        """Ends x words: the summed raised probability of all segmentations of the bytes before."""
        alpha = np.zeros((len(hits) + 1, words))
        alpha[0] = 1.0
        flat = alpha.reshape(-1)
        for j, (w, at, ids) in enumerate(hits, 1):
            alpha[j] = np.bincount(w, flat[at] * raised[ids], minlength=words)
        return alpha

    def log_probs_by(self, words: list[bytes]) -> np.ndarray:
        """Words x classes."""
        out = np.zeros((len(words), len(self.logp)))
        for at, start, buf in self.groups(words):
            n = len(words[at[0]])
            if n > LONG:
                for i in at:
                    out[i] = self.log_prob_by(words[i])
                continue
            hits, weak = self.hits(start, n, buf), np.zeros(len(at), bool)
            for k, raised in enumerate(self.raised):
                alpha = self.sums(hits, raised, len(at))
                weak |= alpha.min(axis=0) < LEAST
                with np.errstate(divide="ignore"):
                    out[at, k] = np.log(alpha[-1]) - RAISED * n
            if weak.any():
                arcs = self.arcs(start[weak], n, buf)
                for k, logp in enumerate(self.logp):
                    out[at[weak], k] = self.forward(arcs, logp, int(weak.sum()))[:, -1]
        return out

    def log_probs(self, words: list[bytes]) -> np.ndarray:
        return self.log_probs_by(words)[:, 0]

    def log_prob_by(self, word: bytes) -> np.ndarray:
        """By class, the same for one word of any length, in memory that grows with it only linearly."""
        alpha = np.zeros((len(self.logp), len(word) + 1))
        for j, (i, ids) in enumerate(self.spans(word), 1):
            alpha[:, j] = log_sum(alpha[:, i] + self.logp[:, ids])
        return alpha[:, -1]

    def log_prob(self, word: bytes) -> float:
        return float(self.log_prob_by(word)[0])

    def expected(self, words: list[bytes], into: np.ndarray, k: int = 0) -> None:
        """Adds each piece's expected number of uses, by class k, in one copy of each word."""
        of = np.zeros((len(words), len(self.logp)), bool)
        of[:, k] = True
        self.expected_by(words, of, {k: into})

    def expected_by(self, words: list[bytes], of: np.ndarray, into: dict[int, np.ndarray] | np.ndarray) -> None:
        """The same for each class, into its row, in the words that are of it (words x classes)."""
        for at, start, buf in self.groups(words):
            n = len(words[at[0]])
            classes = np.flatnonzero(of[at].any(axis=0))
            if n > LONG:
                for k in classes:
                    for i in at[of[at, k]]:
                        self.expected_long(words[i], into[k], k)
                continue
            hits = self.hits(start, n, buf)
            every = np.concatenate([ids for _, _, ids in reversed(hits)])
            for k in classes:
                alpha, raised = self.sums(hits, self.raised[k], len(at)), self.raised[k]
                weak = alpha.min(axis=0) < LEAST
                for i in at[weak & of[at, k]]:
                    self.expected_long(words[i], into[k], k)
                beta = np.zeros_like(alpha)
                # A word that is not of the class, or was summed in logarithms, adds nothing.
                beta[n] = np.where(weak | ~of[at, k], 0.0, 1.0 / np.where(weak, 1.0, alpha[n]))
                before, after, uses = alpha.reshape(-1), beta.reshape(-1), []
                for j in range(n, 0, -1):
                    w, place, ids = hits[j - 1]
                    through = raised[ids] * beta[j][w]
                    uses.append(before[place] * through)
                    after[place] += through
                into[k] += np.bincount(every, np.concatenate(uses), minlength=len(into[k]))

    @staticmethod
    def tally(into: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        hit = ids >= 0
        into += np.bincount(ids[hit], x[hit], minlength=len(into))

    def expected_long(self, word: bytes, into: np.ndarray, k: int = 0) -> None:
        logp = self.logp[k]
        n = len(word)
        spans = list(self.spans(word))
        alpha, beta = np.zeros(n + 1), np.full(n + 1, -np.inf)
        for j, (i, ids) in enumerate(spans, 1):
            alpha[j] = log_sum(alpha[None, i] + logp[ids][None])[0]
        beta[n] = 0.0
        for j in range(n, 0, -1):
            i, ids = spans[j - 1]
            through = logp[ids] + beta[j]
            self.tally(into, ids, np.exp(alpha[i] + through - alpha[n]))
            beta[i] = np.logaddexp(beta[i], through)


def log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1)
    return top + np.log(np.exp(x - top[:, None]).sum(axis=1))


def word_counts(docs: DataFrame, classes: int) -> DataFrame:
    """(word binary, c training count, n count, by array: training counts by class) of all distinct words of docs (text, held_out, class)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        train: list[Counter] = [Counter() for _ in range(classes)]
        held: Counter = Counter()

        def flush() -> pd.DataFrame:
            parts = [pd.DataFrame({"word": list(x.keys()), "class": k, "x": list(x.values())}) for k, x in enumerate([*train, held])]
            for x in (*train, held):
                x.clear()
            return pd.concat(parts).astype({"class": "int32", "x": "int64"})

        for b in batches:
            for t, h, k in zip(b["text"], b["held_out"], b["class"], strict=True):
                (held if h else train[k]).update(text.words(t))
                if len(held) + sum(map(len, train)) > HELD:
                    yield flush()
        yield flush()

    found = docs.select("text", "held_out", "class").mapInPandas(count, "word binary, class int, x long")
    return found.groupBy("word").agg(
        F.sum(F.when(F.col("class") < classes, F.col("x")).otherwise(0)).alias("c"),
        F.sum("x").alias("n"),
        F.array(*[F.sum(F.when(F.col("class") == k, F.col("x")).otherwise(0)) for k in range(classes)]).alias("by"),
    )


def train(words: DataFrame, pieces: list[bytes], classes: int, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """By class, log-probabilities of the pieces and of the end, by EM over the class's distinct training words.

    Each distinct word weighs the same, as the pieces stand for words that were not seen. A class
    without words keeps the vocabulary's scores. What comes to the driver is at most one row for each
    piece and class.
    """
    sc = words.sparkSession.sparkContext
    n = len(pieces)
    p = 1.0 / (np.arange(n) + ZIPF_SHIFT)
    logp, end = np.tile(np.log(p / p.sum()), (classes, 1)), np.full(classes, math.log(0.5))
    seen = words.where("c > 0").select("word", "by")
    for _ in range(iterations):
        model = sc.broadcast((pieces, logp))

        def expect(batches: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            lattice, into = Lattice(*model.value), np.zeros((classes, n))
            for b in batches:
                spelled = [b" " + bytes(w) for w in b["word"]]
                of = np.array(b["by"].tolist()).reshape(len(b), classes) > 0
                lattice.expected_by(spelled, of, into)
            at = np.nonzero(into)
            yield pd.DataFrame({"class": at[0], "piece": at[1], "x": into[at]})

        rows = seen.mapInPandas(expect, "class long, piece long, x double").groupBy("class", "piece").agg(F.sum("x").alias("x")).toPandas()
        x = np.zeros((classes, n))
        x[rows["class"].to_numpy(int), rows["piece"].to_numpy(int)] = rows["x"].to_numpy(float)
        found = x.sum(axis=1) > 0
        total = (x + ALPHA).sum(axis=1) + 1
        logp = np.where(found[:, None], np.log((x + ALPHA) / total[:, None]), logp)
        end = np.where(found, -np.log(total), end)
        model.unpersist()
    return logp, end


def discount(once: int, twice: int) -> float:
    """What a word's count loses, by the numbers of words that occur once and twice."""
    return once / (once + 2 * twice) if once and twice else DISCOUNT


class Weights:
    """Log-probabilities (base 10) of tokens by class: discounted counts, a little of the pooled ones, and the lattice."""

    def __init__(self, pooled: tuple[int, int, float], by: list[tuple[int, int, float]]):
        """Of all classes, and by class: training tokens, distinct ones, discount."""
        self.pooled, self.by = pooled, by

    def log10(self, c: np.ndarray, by: np.ndarray, log_lattice: np.ndarray) -> np.ndarray:
        """Tokens x classes, from the tokens' counts, their counts by class and the lattice's logarithms by class."""
        n, distinct, d = self.pooled
        shared, free = (np.maximum(c - d, 0) / n, d * distinct / n) if n else (np.zeros(len(c)), 1.0)
        out = np.empty_like(log_lattice)
        for k, (n_k, distinct_k, d_k) in enumerate(self.by):
            known, left = shared, free
            if n_k:
                freed = d_k * distinct_k / n_k
                known, left = np.maximum(by[:, k] - d_k, 0) / n_k + freed * POOLED * shared, freed * (POOLED * free + 1 - POOLED)
            with np.errstate(divide="ignore"):
                out[:, k] = np.logaddexp(np.log(known), np.log(left) + log_lattice[:, k])
        return out / math.log(10)


def score(docs: DataFrame, vocabulary: str, iterations: int = ITERATIONS, frequent: int = FREQUENT, classes: int = CLASSES) -> DataFrame:
    """Scores every row of docs (doc_id, text and, if there, lang): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32(doc_id) modulo 5 is 1 are held out of training. A null text is an empty one: it
    has the end token alone. A null doc_id is trained on. Repeated rows each keep their row. Further
    columns are ignored. An empty table gives an empty table; with no training text the counts are 0
    and the pieces keep their initial scores. Words of any length are scored whole. The declared
    languages of training texts give the classes (the most frequent ones and the rest); the class of
    a scored text is summed over, never read.
    """
    spark = docs.sparkSession
    pieces = load_pieces(vocabulary)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    docs = docs.select("doc_id", "text", held.alias("held_out"), lang.alias("lang"))
    by_lang = docs.where("not held_out").groupBy("lang").count()
    names = [r["lang"] for r in by_lang.orderBy(F.desc("count"), "lang").limit(classes - 1).collect()]
    k_all = len(names) + 1
    known = F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col("lang")).cast("int"), F.lit(0)) if names else F.lit(0)
    docs = docs.withColumn("class", F.when(known > 0, known - 1).otherwise(k_all - 1).cast("int"))
    ends_by = {r["class"]: r["count"] for r in docs.where("not held_out").groupBy("class").count().collect()}
    ends = sum(ends_by.values())
    counts = store.table(word_counts(docs, k_all), "lm-counts")
    seen = lambda c: F.count(F.when(c > 0, 1))
    times = lambda c, n: F.count(F.when(c == n, 1))
    each = [x.alias(f"{name}{k}") for k, c in [("", F.col("c")), *[(k, F.col("by")[k]) for k in range(k_all)]] for name, x in (("s", F.sum(c)), ("v", seen(c)), ("once", times(c, 1)), ("twice", times(c, 2)))]
    totals = counts.agg(*each).first()
    n_train, v = (totals["s"] or 0) + ends, (totals["v"] or 0) + (ends > 0)
    logp, end_lp = train(counts, pieces, k_all, iterations)

    log_norm = math.log10(n_train + 0.5 * (v + 1))
    base_end = math.log10(ends + 0.5) - log_norm
    model = spark.sparkContext.broadcast((pieces, logp))
    by_class = [((totals[f"s{k}"] or 0) + ends_by.get(k, 0), (totals[f"v{k}"] or 0) + (ends_by.get(k, 0) > 0), discount(totals[f"once{k}"], totals[f"twice{k}"])) for k in range(k_all)]
    weights = Weights((n_train, v, discount(totals["once"], totals["twice"])), by_class)

    def word_scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(*model.value)
        for b in batches:
            c, by = b["c"].to_numpy(float), np.array(b["by"].tolist(), float).reshape(len(b), k_all)
            lp = weights.log10(c, by, lattice.log_probs_by([b" " + bytes(w) for w in b["word"]]))
            yield pd.DataFrame({"word": b["word"], "c": b["c"], "n": b["n"], "base": np.log10(c + 0.5) - log_norm, "lp": list(lp)})

    words = store.table(counts.mapInPandas(word_scores, "word binary, c long, n long, base double, lp array<double>"), "lm-words")
    prior = np.array([math.log10((ends_by.get(k, 0) + 0.5) / (ends + 0.5 * k_all)) for k in range(k_all)])
    end_counts = np.array([[ends_by.get(k, 0) for k in range(k_all)]], float)
    end_by = (weights.log10(np.array([float(ends)]), end_counts, end_lp[None])[0] + prior).tolist()

    level = F.floor(F.log2("n") * 8)  # at most 512 levels
    levels = sorted(((r["level"], r["count"]) for r in words.groupBy(level.alias("level")).count().collect()), reverse=True)
    fit = [k for k, total in zip([x[0] for x in levels], np.cumsum([x[1] for x in levels]), strict=True) if total <= frequent]
    often = level >= (fit[-1] if fit else 1 << 30)
    top = words.where(often).toPandas()
    matrix = np.column_stack([top["c"] > 0, top["base"], np.array(top["lp"].tolist(), float).reshape(len(top), k_all)]) if len(top) else np.zeros((0, 2 + k_all))
    shared = spark.sparkContext.broadcast(({bytes(w): i for i, w in enumerate(top["word"])}, matrix))

    def per_doc(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, matrix = shared.value

        def packed(rows: list, rare: list) -> pd.DataFrame:
            key, doc_id, h, n, sums = zip(*rows, strict=True) if rows else [()] * 5
            rkey, word, tf = zip(*rare, strict=True) if rare else [()] * 3
            gap = [None] * len(rare)
            ids = pd.array([*(None if pd.isna(x) else int(x) for x in doc_id), *gap], "Int64")
            return pd.DataFrame({"key": [*key, *rkey], "doc_id": ids, "held_out": pd.array([*map(bool, h), *gap], "boolean"), "word": [*[None] * len(rows), *word], "tf": [*n, *tf], "sums": [*sums, *gap]})

        for b in batches:
            rows, rare = [], []
            for key, doc_id, t, h in zip(b["key"], b["doc_id"], b["text"], b["held_out"], strict=True):
                hit, hits, n = [], [], 0
                for w, tf in Counter(text.words(t)).items():
                    n += tf
                    if (i := at.get(w)) is None:
                        rare.append((key, w, tf))
                    else:
                        hit.append(i)
                        hits.append(tf)
                rows.append((key, doc_id, h, n, np.array(hits, float) @ matrix[hit] if hit else np.zeros(2 + k_all)))
                if len(rare) > 200_000:
                    yield packed(rows, rare)
                    rows, rare = [], []
            yield packed(rows, rare)

    keyed = docs.select("doc_id", "text", "held_out").withColumn("key", F.monotonically_increasing_id())
    parts = store.table(keyed.mapInPandas(per_doc, "key long, doc_id long, held_out boolean, word binary, tf long, sums array<double>"), "lm-parts")
    rare = parts.where("word is not null").select("key", "word", "tf").join(words.where(~often), "word")
    weigh = [F.when(F.col("c") > 0, 1.0).otherwise(0.0), F.col("base"), *[F.col("lp")[k] for k in range(k_all)]]
    rare = rare.groupBy("key").agg(F.array(*[F.sum(F.col("tf") * w) for w in weigh]).alias("more"))
    whole = parts.where("word is null").select("key", "doc_id", "held_out", "tf", "sums").join(rare, "key", "left")
    part = lambda i: F.col("sums")[i] + F.coalesce(F.col("more")[i], F.lit(0.0))
    logs = F.array(*[part(2 + k) + F.lit(end_by[k]) for k in range(k_all)])
    return whole.withColumn("logs", logs).select(
        "doc_id",
        "held_out",
        (F.col("tf") + 1).alias("n_tokens"),
        (F.round(part(0)) + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (part(1) + base_end).alias("base_score"),
        (F.array_max("logs") + F.log10(F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.pow(F.lit(10.0), x - F.array_max("logs"))))).alias("score"),
    )

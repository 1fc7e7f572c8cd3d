import base64
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tactigrid.llm import lattice, text

PIECES = [bytes([i]) for i in range(256)] + [b"ab", b"bc", b"abc", b" a", b" ab"]


def brute(word, logp):
    at = {p: math.exp(x) for p, x in zip(PIECES, logp)}
    if not word:
        return 1.0
    return sum(at[word[:i]] * brute(word[i:], logp) for i in range(1, len(word) + 1) if word[:i] in at)


def test_forward_sums_all_segmentations():
    logp = np.log(np.arange(1, len(PIECES) + 1) / sum(range(1, len(PIECES) + 1)))
    words = [b" abc", b" abcabc", b"a", b" xyz", b" " + b"abc" * 4]
    x = lattice.Lattice(PIECES, logp)
    for w, got in zip(words, x.log_probs(words)):
        assert got == pytest.approx(math.log(brute(w, logp)))
        assert x.log_prob(w) == pytest.approx(got)
    into, one = np.zeros(len(PIECES)), np.zeros(len(PIECES))
    x.expected([b" abcabc"], into)
    x.expected_long(b" abcabc", one)
    assert into == pytest.approx(one)
    assert sum(n * len(p) for n, p in zip(into, PIECES)) == pytest.approx(7)  # expected pieces cover the word


def test_scores(spark):
    rows = [(i, f"The cat {i % 3} sat\ton the mat", "en") for i in range(20)] + [(20, None, None), (21, "", "x"), (None, "cat cat", "en"), (3, "The cat", "en"), (22, "z" * 3000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS key", "'q' AS word")
    got = lattice.score(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).toPandas()
    assert len(got) == len(rows)
    train, tokens = Counter(), {}
    for d, t, _ in rows:
        w = [*text.words(t), None]
        if d is None or zlib.crc32(str(d).encode()) % 5 != 1:
            train.update(w)
    n, v = sum(train.values()), len(train)
    for d, t, _ in rows:
        w = [*text.words(t), None]
        tokens.setdefault(d, []).append((len(w), sum(x in train for x in w), sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    for d, x in tokens.items():
        mine = got[got.doc_id.isna() if d is None else got.doc_id == d]
        assert sorted(zip(mine.n_tokens, mine.n_known)) == sorted(y[:2] for y in x)
        assert sorted(mine.base_score) == pytest.approx(sorted(y[2] for y in x))
    assert (got.train_tokens == n).all() and np.isfinite(got.score).all()
    assert lattice.score(df.limit(0), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).count() == 0


def cuts(word):
    """All segmentations of a word."""
    if not word:
        yield []
    for i in range(1, len(word) + 1):
        if word[:i] in PIECES:
            yield from ([word[:i], *rest] for rest in cuts(word[i:]))


def product(cut, p):
    return math.prod(p[x] for x in cut)


def test_score_is_the_mixture_of_classes(spark, tmp_path):
    """score() with one round of EM against sums over all segmentations."""
    vocabulary = tmp_path / "tiny.tiktoken"
    vocabulary.write_text("".join(f"{base64.b64encode(p).decode()} {i}\n" for i, p in enumerate(PIECES)))
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("ab abc ab", "x"), ("abc b", "y"), ("ab bcab", "x"), ("c ab", None), ("abcc ab b", "y"), ("ab", "x"), ("bc abc", "y")] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["score"] for r in lattice.score(df, str(vocabulary), iterations=1).collect()}

    train = [(t, lang) for d, t, lang in rows if zlib.crc32(str(d).encode()) % 5 != 1]
    sizes = Counter("x" if lang == "x" else "y" if lang == "y" else "" for _, lang in train)
    classes = [*sorted(sizes, key=lambda k: (-sizes[k], k)), "rest"]
    of = {k: Counter(w for t, lang in train if (lang or "") == k for w in [*(x.encode() for x in t.split()), None]) for k in classes}
    pooled = sum(of.values(), Counter())
    zipf = {p: 1 / (i + lattice.ZIPF_SHIFT) for i, p in enumerate(PIECES)}
    zipf = {p: x / sum(zipf.values()) for p, x in zipf.items()}
    model = {}
    for k in classes:
        uses = Counter()
        for w in of[k].keys() - {None}:
            total = sum(product(c, zipf) for c in cuts(b" " + w))
            for c in cuts(b" " + w):
                for piece in c:
                    uses[piece] += product(c, zipf) / total
        total = sum(uses.values()) + lattice.ALPHA * len(PIECES) + 1
        model[k] = ({p: (uses[p] + lattice.ALPHA) / total for p in PIECES}, 1 / total) if uses else (zipf, 0.5)

    def d(counts):
        seen = Counter(n for w, n in counts.items() if w is not None)
        return seen[1] / (seen[1] + 2 * seen[2]) if seen[1] and seen[2] else lattice.DISCOUNT

    def prob(w, k):
        p, end = model[k]
        low = end if w is None else sum(product(c, p) for c in cuts(b" " + w))
        n, n_k = sum(pooled.values()), sum(of[k].values())
        pool = (max(pooled[w] - d(pooled), 0) + d(pooled) * len(pooled) * low) / n
        if not n_k:
            return pool
        return (max(of[k][w] - d(of[k]), 0) + d(of[k]) * len(of[k]) * (lattice.POOLED * pool + (1 - lattice.POOLED) * low)) / n_k

    texts = Counter((lang or "") for _, lang in train)
    for doc_id, t, _ in rows:
        tokens = [*(x.encode() for x in t.split()), None]
        want = sum((texts[k] + 0.5) / (len(train) + 0.5 * len(classes)) * math.prod(prob(w, k) for w in tokens) for k in classes)
        assert got[doc_id] == pytest.approx(math.log10(want))

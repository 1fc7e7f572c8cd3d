"""Operators against brute force on small rows: nulls, empty texts, repeated rows, ties, clashing columns, empty tables."""

import base64
import hashlib
import itertools

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tactigrid.llm import bpe, chat, egrid, fingerprint, graph, language, licences, mixing, parity, text, urls

BASE = "the quick brown fox jumps over the lazy dog while seven old owls watch from a tall tree near the quiet river bank tonight"
TEXTS = [BASE, BASE, BASE + " again", BASE.upper(), "One two three", "one TWO\tthree", "", None, " \n ", BASE.replace("fox", "cat"), "Ünïcode ﬁsh  Straße", "x" * 5000, "word " * 300]
CLASH = ["'n' AS node", "1 AS key", "'z' AS a", "0 AS n", "1 AS bin", "2 AS taken", "'s' AS canon"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en", "s0"), (None, BASE, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", *CLASH)


def least(pairs, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


def shingles(t):
    w = text.words(t)
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = least(edges, {x for e in edges for x in e})
    assert got == {k: v for k, v in want.items() if k != 5}


@pytest.mark.parametrize("block", [256, 3])
def test_jaccard_classes(spark, docs, block, monkeypatch):
    monkeypatch.setattr(parity, "BLOCK", block)
    monkeypatch.setattr(parity, "TOGETHER", block)
    rows = [(i, " ".join(f"w{(i // 9) * 100 + j}" for j in range(60)) + f" end{i % 9}", "en", "s") for i in range(100, 127)]
    x = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    x = x.where("doc_id is not null").selectExpr("*", *CLASH)
    got = parity.classes(x, 5).collect()
    sets = {r["doc_id"]: shingles(r["text"]) for r in x.collect()}
    near = lambda p, q: p and q and 100 * len(p & q) >= 75 * len(p | q)
    want = least([(a, b) for a, b in itertools.combinations(sets, 2) if near(sets[a], sets[b])], sets)
    assert len(got) == x.count()
    assert all(r["component_id"] == want[r["doc_id"]] and r["n_shingles"] == len(sets[r["doc_id"]]) for r in got)
    assert parity.classes(x.limit(0)).count() == 0


def test_fingerprints(docs):
    got = fingerprint.fingerprints(docs).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r["fingerprint"] for r in got}
    assert by[0] == by[1] == by[3] == by[None] and by[4] == by[5] and by[6] == by[7] == by[8] and len({by[0], by[2], by[4], by[6], by[9]}) == 5
    # With two bits a hash, many texts share a bucket; bytes tell them apart.
    few = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(docs.where("doc_id is not null"), bits=2).collect()}
    assert all((few[a] == few[b]) == (by[a] == by[b]) for a, b in itertools.combinations(few, 2))
    assert fingerprint.fingerprints(docs.limit(0)).count() == 0


def test_mix(docs):
    got = mixing.mix(docs).collect()
    assert sorted(r["size"] for r in got) == sorted(len(text.words(r["text"])) for r in docs.collect())
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(map(str, mixing.mix(docs.repartition(3)).collect())) == sorted(map(str, got))
    total = {r["source"]: r["source_size"] for r in got}
    assert sum({r["source"]: r["target"] for r in got}.values()) == pytest.approx(min(1.5 * sum(total.values()), 2 * sum(total.values())))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_byte_bpe(docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r["doc_id"] or -1, enc.encode_ordinary(r["text"] or "")) for r in docs.collect())
    got = sorted((r["doc_id"] or -1, list(r["ids"])) for r in bpe.encoded(docs, path, public_tokenizers.PATTERN, ids=True).collect())
    assert got == want
    assert bpe.encoded(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_chat(spark):
    rows = [(1, 1, "assistant", "<|im_end|>\n<|im_start|>assistant ok"), (1, 0, "user", "a <\\| b"), (2, 0, None, None), (2, 0, "assistant", ""), (None, 0, "user", "x")]
    got = {r["conv_id"]: r for r in chat.digests(chat.format_records(chat.from_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), "conv_id")).collect()}
    digest = lambda x: hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in x).encode()).hexdigest()
    assert got[1]["turns_sha256"] == digest([("user", rows[1][3]), ("assistant", rows[0][3])])
    assert got[1]["loss_chars"] == len(rows[0][3]) and got[2]["n_turns"] == 2 and got[None]["loss_chars"] == 0
    records = [(1, '{"prompt": "p", "completion": "c"}'), (2, '{"instruction": "i", "input": "n", "output": "o"}'), (3, '{"conversations": [{"from": "human", "value": "h"}]}'), (4, "[1]"), (5, None), (6, "no json")]
    out = {r["k"]: r for r in chat.format_records(spark.createDataFrame(records, "k long, record string"), "k").collect()}
    assert chat.parse(out[2]["formatted"]) == [("user", "i\nn"), ("assistant", "o")] and chat.parse(out[3]["formatted"]) == [("user", "h")]
    assert [out[i]["mapping"] for i in range(1, 7)] == ["prompt", "instruction", "conversations", None, None, None]


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 8))
    x = np.concatenate([x, x[:20] + rng.normal(size=(20, 8)) * 0.15, x[:2]])
    rows = [(i, v.tolist()) for i, v in enumerate(x.tolist() and x)] + [(90, None), (91, [0.0] * 8), (92, [float("nan")] * 8), (93, [None] * 8), (94, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS node", "'x' AS copies")
    got = {r["vec_id"]: r for r in egrid.near(df).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    want = least(zip(*map(np.ndarray.tolist, np.nonzero(near))), range(len(u)))
    assert all(got[i]["n_links"] == near[i].sum() and got[i]["component_id"] == want[i] for i in range(len(u)))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(90, 95))
    assert egrid.near(df.limit(0)).count() == 0


def test_urls(spark):
    found = {"http://A.example.ORG/es/x?y": "example.org/es/", "https://example.org/en/12": "example.org/en/1", "http://x.com/fr/": "com/fr/", "http://com.net/fr/": None, "nothing": None, None: None, "http://org/": "org/", "http://notexample.org/es/": "org/", "http://casino-win.example.net/a": None}
    df = spark.createDataFrame(list(enumerate(found)), "page_id long, url string").selectExpr("*", "1 AS key", "'h' AS host")
    got = {found_[1]: r for found_, r in zip(enumerate(found), sorted(urls.judge(df).collect(), key=lambda r: r["page_id"]))}
    assert {k: r["rule"] for k, r in got.items()} == found
    assert got["http://casino-win.example.net/a"]["verdict"] == "block" and got["http://x.com/fr/"]["verdict"] == "allow"
    assert urls.judge(df.limit(0)).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(5000).selectExpr("cast(id AS string) AS key")
    listed = universe.where("key % 7 = 0")
    hits = universe.where(urls.Cascade.build(listed, universe).contains(universe["key"]))
    assert hits.exceptAll(listed).count() == 0 and listed.exceptAll(hits).count() == 0


def test_language_and_licences(spark, docs):
    rows = [(i, w * 20, lang, f"h{i % 2}") for i, (w, lang) in enumerate([("the owls watch the river ", "en"), ("der alte hund schläft ", "de")] * 10)]
    x = spark.createDataFrame([*rows, (50, None, "en", None), (51, "12 34", "en", "h0")], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in language.identify(language.of_documents(x), ["doc_id"]).collect()}
    assert all(got[i]["language"] == rows[i][2] and got[i]["kept"] for i in range(20)) and not got[50]["kept"] and not got[51]["kept"]
    assert language.identify(language.of_documents(x.limit(0)), ["doc_id"]).count() == 0
    notice = docs.limit(1).selectExpr("doc_id", "text || '\n\nReleased under the MIT License.' AS text").unionByName(docs.select("doc_id", "text"))
    found = licences.scan(notice).collect()
    assert any(r["family"] == "mit" and r["confirmed"] for r in found)
    assert licences.scan(docs.limit(0)).count() == 0

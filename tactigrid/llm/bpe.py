"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier 1 is a minimal perfect hash of the vocabulary (buckets with displacements): it gives a whole
pre-token's id, after its 64-bit hash is compared with the slot's. Tier 2 merges the bytes of what
is not in the vocabulary: neighbours are linked, and a heap gives the pair of lowest rank next.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from . import text

#: Keys of a bucket of the perfect hash, on average.
PER_BUCKET = 3
#: Results of tier 2 that a worker keeps (about 200 bytes each).
KEPT = 1_000_000
#: Code points that are encoded at once.
STEP = 200_000


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return [base64.b64decode(a) for a, _ in sorted(pairs, key=lambda x: int(x[1]))]


class PerfectHash:
    """A minimal perfect hash of n different 64-bit values: slot = (hash under the bucket's displacement) mod n."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.n, self.buckets = n, max(1, n // PER_BUCKET)
        bucket = self.bucket(hashes)
        order = np.argsort(bucket, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
        self.shift, self.ids, free = np.zeros(self.buckets, np.uint64), np.full(n, -1, np.int32), np.ones(n, bool)
        for g in sorted(groups, key=len, reverse=True):
            for first in range(1, 1 << 30, 64):
                tried = self.place(hashes[g][None], np.arange(first, first + 64, dtype=np.uint64)[:, None])
                good = free[tried].all(axis=1) & (np.array([len(set(r)) for r in tried.tolist()]) == len(g))
                if good.any():
                    k = int(good.argmax())
                    self.shift[bucket[g[0]]], self.ids[tried[k]], free[tried[k]] = first + k, g, False
                    break
        self.keys = hashes[self.ids]

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)

    def place(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        x = (h ^ (shift * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(self.n)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The ids, -1 for values that are not among the keys."""
        slot = self.place(h, self.shift[self.bucket(h)])
        return np.where(self.keys[slot] == h, self.ids[slot], -1)


def merge(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a pre-token: pairs are merged by rank, the leftmost first among equals."""
    n = len(token)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at i
    live = bytearray(b"\1") * n
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(token[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not live[i] or (j := end[i]) == n or end[j] != stop:
            continue  # one of its parts was merged since
        live[j] = 0
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := get(token[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := get(token[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    return [ranks[token[i : end[i]]] for i in range(n) if live[i]]


class Encoder:
    """Encodes texts; words are found by their hashes, which the texts' prefix sums give for all pre-tokens at once."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.ranks, self.pattern = tokens, {t: i for i, t in enumerate(tokens)}, regex.compile(pattern)
        ends = np.cumsum([len(t) for t in tokens])
        self.table = PerfectHash(text.span_hashes(np.frombuffer(b"".join(tokens), np.uint8), np.concatenate(([0], ends[:-1])), ends))
        self.bytes_of = np.array([*tokens, None], object)[:-1]
        self.kept: dict[bytes, bytes] = {}

    def missed(self, token: bytes) -> bytes:
        """The ids of a pre-token that is no entry of the vocabulary, as 32-bit integers."""
        if len(self.kept) >= KEPT:
            self.kept.clear()
        ids = np.array(merge(token, self.ranks), np.int32).tobytes()
        if len(token) < 64:
            self.kept[token] = ids
        return ids

    def pieces(self, s: str) -> Iterator[tuple[list[str], bytes]]:
        """Runs of pre-tokens and their bytes; a text without a match of the pattern for some characters leaves those out."""
        if len(s) <= STEP:
            found = self.pattern.findall(s)
            yield found, "".join(found).encode("utf-8", "surrogatepass")
            return
        found, size = [], 0
        for m in self.pattern.finditer(s):
            found.append(m.group())
            size += len(found[-1])
            if size >= STEP:
                yield found, "".join(found).encode("utf-8", "surrogatepass")
                found, size = [], 0
        yield found, "".join(found).encode("utf-8", "surrogatepass")

    def encode(self, s: str) -> np.ndarray:
        return np.concatenate([self.run(found, data) for found, data in self.pieces(s)])

    def run(self, found: list[str], data: bytes) -> np.ndarray:
        if not found:
            return np.zeros(0, np.int32)
        buf = np.frombuffer(data, np.uint8)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        if len(data) != ends[-1]:  # code points to bytes
            ends = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))[ends]
        starts = np.concatenate(([0], ends[:-1]))
        ids = self.table.find(text.span_hashes(buf, starts, ends))
        miss = np.flatnonzero(ids < 0)
        if not len(miss):
            return ids
        kept, missed = self.kept.get, self.missed
        more = [kept(t := data[i:j]) or missed(t) for i, j in zip(starts[miss].tolist(), ends[miss].tolist(), strict=True)]
        count = np.ones(len(ids), np.int64)
        count[miss] = np.fromiter(map(len, more), np.int64, len(more)) // 4
        out = np.repeat(ids, count)
        out[np.repeat(ids < 0, count)] = np.frombuffer(b"".join(more), np.int32)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.bytes_of[ids].tolist())


@lru_cache(maxsize=1)
def encoder_of(tokens: tuple[bytes, ...], pattern: str) -> Encoder:
    """A worker's encoder; a task finds what tier 2 gave in the worker's tasks before."""
    return Encoder(list(tokens), pattern)


def encoded(docs: DataFrame, ranks: str, pattern: str, ids: bool = False) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256, and ids (array<int>) if asked for.

    A null text is an empty one, with no tokens. Texts are encoded whole, also very long ones, in
    runs of pre-tokens. Repeated rows and null ids keep their rows. Further columns are ignored; an
    empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast((tuple(load_ranks(ranks)), pattern))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(*shared.value)
        names = np.array([str(i) for i in range(len(encoder.tokens))] + [None], object)[:-1]
        for b in batches:
            for first in range(0, len(b), 1000):
                part, rows, lists = b.iloc[first : first + 1000], [], []
                for s in part["text"]:
                    x = encoder.encode(s if isinstance(s, str) else "")
                    rows.append((len(x), hashlib.sha256(",".join(names[x].tolist()).encode()).hexdigest(), hashlib.sha256(encoder.decode(x)).hexdigest()))
                    if ids:
                        lists.append(x)
                out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
                out.insert(0, "doc_id", part["doc_id"].array)
                yield out.assign(ids=lists) if ids else out

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInPandas(work, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)

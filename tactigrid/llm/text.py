"""Words of raw text, and 64-bit hashes of words and shingles, for blocks of texts at once.

A word is a run of bytes other than 0x20 and 0x09-0x0D after A-Z have been lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bytes of text that are hashed together; small enough for the CPU's cache.
CHUNK = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: The first n of eight bytes.
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
#: Odd multipliers of a shingle's words, by place.
_PLACES = np.array([pow(0xA24BAED4963EE407, i, 2**64) for i in range(64)], np.uint64)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x + np.uint64((seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of buf, whatever its place: eight bytes after another go through the finaliser."""
    size = np.asarray(ends - starts, np.int64)
    lanes = np.ndarray((len(buf) + 1,), "<u8", np.concatenate((buf, np.zeros(8, np.uint8))), strides=(1,))
    h = mix(size.astype(np.uint64), 1)
    at, begins, left = slice(None), starts, size
    while len(left):
        h[at] = mix(h[at] ^ (lanes[begins] & _KEEP[np.minimum(left, 8)]))
        longer = np.flatnonzero(left > 8)
        at = longer if isinstance(at, slice) else at[longer]
        begins, left = begins[longer] + 8, left[longer] - 8
    return h


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Runs of texts (first, last + 1), their lower-cased bytes each followed by a line end, and where each text starts."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    i = 0
    while i < len(raw):
        j, size = i, 0
        while j < len(raw) and (j == i or size + len(raw[j]) < CHUNK):
            size += len(raw[j]) + 1
            j += 1
        offsets = np.cumsum([0, *(len(x) + 1 for x in raw[i:j])])
        yield i, j, (b"\n".join(raw[i:j]) + b"\n").translate(LOWER), offsets
        i = j


def word_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text the hashes of its words, in order."""
    for i, j, data, offsets in chunks(texts):
        buf = np.frombuffer(data, np.uint8)
        space = _SPACE[buf]
        before = np.concatenate(([True], space[:-1]))
        starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
        h = span_hashes(buf, starts, ends)
        at = np.searchsorted(starts, offsets)
        for k in range(j - i):
            yield h[at[k] : at[k + 1]]


def shingle_sets(texts: list[str | None], k: int = 5) -> Iterator[np.ndarray]:
    """For each text its distinct k-word shingles as sorted hashes; fewer words make one shingle, none the empty set."""
    for h in word_hashes(texts):
        if len(h) == 0:
            yield h
            continue
        m = min(k, len(h))
        s = h[: len(h) - m + 1] * _PLACES[0]
        for i in range(1, m):
            s = s + h[i : len(h) - m + 1 + i] * _PLACES[i]
        yield np.unique(mix(s, m))

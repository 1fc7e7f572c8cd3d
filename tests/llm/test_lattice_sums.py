"""Sums outside the logarithm: the same results, and logarithms only for words whose sums are too small."""

import numpy as np
import pytest

from tactigrid.llm import lattice

PIECES = [bytes([i]) for i in range(256)] + [b"ab", b"bc", b"abc", b" a", b" ab"]
WORDS = [b" abcabc", b" abcabd", b" a", b" xyz", b" cabbab", b" " + b"q" * 40, b" " + b"ab" * 20, b" " + b"z" * 60]


def model(low):
    logp = np.log(np.random.default_rng(1).random((3, len(PIECES))) / 200)
    logp[:, ord("q")] = low
    return lattice.Lattice(PIECES, logp)


@pytest.mark.parametrize("low", [-5.0, -40.0])
def test_same_as_logarithms(low):
    x = model(low)
    assert np.allclose(x.log_probs_by(WORDS), [x.log_prob_by(w) for w in WORDS], rtol=1e-12, atol=0)
    of = np.random.default_rng(2).random((len(WORDS), 3)) < 0.6
    got, want = np.zeros((3, len(PIECES))), np.zeros((3, len(PIECES)))
    x.expected_by(WORDS, of, got)
    for i, k in np.argwhere(of):
        x.expected_long(WORDS[i], want[k], k)
    assert np.allclose(got, want, rtol=1e-9, atol=1e-12)


def test_logarithms_are_for_small_sums_alone(monkeypatch):
    seen = []
    was = lattice.Lattice.forward
    monkeypatch.setattr(lattice.Lattice, "forward", staticmethod(lambda arcs, logp, words: seen.append(words) or was(arcs, logp, words)))
    model(-5.0).log_probs_by(WORDS)
    assert seen == []
    model(-40.0).log_probs_by(WORDS)
    assert seen == [1, 1, 1]


def test_a_word_that_no_pieces_make():
    x = lattice.Lattice([b" ", b"a"], np.log([0.5, 0.5]))
    with np.errstate(invalid="ignore", divide="ignore"):
        assert x.log_probs([b" a", b" b"])[0] == pytest.approx(np.log(0.25))

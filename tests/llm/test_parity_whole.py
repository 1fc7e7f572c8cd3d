"""Jaccard classes where keys are in many sets, against brute force."""

import itertools
import random

import pytest

from tactigrid.llm import parity
from tests.llm.test_operators import least, shingles


def wrong(spark, rows):
    got = {r["doc_id"]: r["component_id"] for r in parity.classes(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()}
    sets = {i: shingles(t) for i, t in rows}
    want = least([(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])], sets)
    return {i: (got[i], want[i]) for i in sets if got[i] != want[i]}


def test_a_set_that_goes_past_the_first_deal_keeps_its_heavy_keys(spark):
    # All shingles of these seven words fall into one part of the first deal.
    short = " ".join(f"g130w{j}" for j in range(7))
    assert not wrong(spark, [(0, short)] + [(1 + i, f"{short} e{i}") for i in range(18)])


@pytest.mark.parametrize("block", [256, 3])
def test_sets_linked_to_different_pivots_meet(spark, block, monkeypatch):
    monkeypatch.setattr(parity, "BLOCK", block)
    monkeypatch.setattr(parity, "TOGETHER", block)
    rows = []
    for f in (6, 122, 140):
        r = random.Random(f)
        size = r.choice((9, 12, 16, 24))
        for i in range(24):
            t = [f"f{f}w{j}" for j in range(size)] + [f"f{f}{c}{r.randint(0, 2)}" for c in "abc"[: r.randint(0, 3)]]
            if r.random() < 0.5:
                t = [f"f{f}h{r.randint(0, 2)}", *t]
            rows.append((f * 100 + i, " ".join(t)))
    assert not wrong(spark, rows)


def test_words_of_equal_sums_differ(spark):
    # Thue-Morse words have equal polynomial hashes modulo 2**64.
    one = "0"
    for _ in range(11):
        one += one.translate(str.maketrans("01", "10"))
    assert not wrong(spark, [(0, one), (1, one.translate(str.maketrans("01", "10")))])


def test_near_copies_of_one_text(spark):
    r, rows = random.Random(3), []
    words = [f"w{i}" for i in range(150)]
    for i in range(120):
        t = list(words)
        for _ in range(r.randint(0, 9)):
            t[r.randrange(150)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    assert not wrong(spark, rows)


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (None, text + " end"), (None, "other words"), (7, text + " more"), (7, "nothing like it"), (7, None), (8, "")]
    got = parity.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["component_id"] or -1, r["n_shingles"]) for r in got) == sorted([(7, 36), (7, 37), (-1, 1), (7, 37), (7, 1), (7, 0), (8, 0)])

"""The pipeline's stages act on rows, whatever their doc_id."""

import corpus_pipeline
import pytest

OWLS = "seven old owls watch the quiet river bank from a tall tree tonight while the lazy dog sleeps near the house of stone"
HILLS = "green hills and white clouds stand over the wide valley where farmers bring home the corn before the cold autumn rain"


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def texts(df):
    return sorted(r["text"] for r in df.collect())


@pytest.mark.parametrize("key", [None, 7])
def test_rejecting_acts_on_the_row(spark, make, key):
    rows = [(i, f"{OWLS} {i}") for i in range(20, 40)]
    got = texts(corpus_pipeline.language_id(spark, make([*rows, (key, OWLS), (key, "12 34"), (key, "")]), ""))
    assert got == sorted([OWLS, *(t for _, t in rows)])


def test_of_near_copies_one_row_stays(spark, make):
    rows = [(1, OWLS), (None, OWLS + " again"), (None, HILLS), (None, HILLS + " again"), (5, "another clean text of a few words"), (5, OWLS + " too")]
    got = texts(corpus_pipeline.near_duplicates(spark, make(rows), ""))
    assert len(got) == 3 and got[0] == rows[4][1] and got[1] in (HILLS, HILLS + " again") and got[2] == OWLS


def test_the_mix_takes_each_row_for_itself(spark, make):
    rows = [(key, f"{a}{i}") for key in (None, 3) for i, a in enumerate("abcdef")]
    docs = make(rows * 30)
    taken = corpus_pipeline.mixing.mix(docs).agg({"taken": "sum"}).first()[0]
    assert sum(len(t.split()) for t in texts(corpus_pipeline.source_mix(spark, docs, ""))) == taken

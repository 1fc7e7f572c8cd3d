"""Documents in files, package imports and publishing."""

import pytest
from pyspark.sql import functions as F

from tactigrid.sources import documents as D
from tactigrid.sources import tables as T

FILES = {"a/summary.json": '{"id": "a", "n": 1, "date": "2024-01-02"}', "b/summary.json": "[1, 2]", "c/summary.json": '{"id": "c", "n": ', "d/summary.json": '﻿\n {"id": "d"}\n', "e/summary.json": "", "f/summary.json": '{"id": "f", "n": "x"}'}


def put(folder, files):
    for name, text in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


def test_objects(spark, tmp_path):
    x = D.objects(spark, put(tmp_path, FILES), "id string, n long, date string, created string")
    got = {r["file"].split("/")[-2]: (r["error"], r["document"] and r["document"]["n"]) for r in x.collect()}
    assert got == {"a": (None, 1), "b": ("not an object", None), "c": ("malformed", None), "d": (None, None), "f": ("malformed", None)}
    assert [r["id"] for r in D.latest_first(x, "date", "created").orderBy("place").collect()] == ["a", "d"]
    with pytest.raises(ValueError, match="b/summary.json: not an object"):
        D.required(x)
    assert D.required(x.where("error is null")).count() == 2


def test_tracks(spark, tmp_path):
    x = D.tracks(spark, put(tmp_path, {"1.json": '[{"track_id": 1, "positions": [{"frame": 2, "x": 1.5}, {"frame": 3}]}, {"track_id": 2, "positions": []}]', "2.json": '{"track_id": 3}', "3.json": "[]"}))
    assert sorted(((r["track_id"], r["frame"], r["x"]) for r in x.collect()), key=str) == [(1, 2, 1.5), (1, 3, None), (2, None, None)]


def test_packages(spark, tmp_path):
    p = D.Packages(spark, str(tmp_path), "id")
    heads = lambda *ids: spark.createDataFrame([(i, f"m{i}") for i in ids], "id int, title string")
    kids = lambda *rows: spark.createDataFrame(list(rows), "id int, player string")
    with pytest.raises(ValueError):
        p.read("matches")
    p.put({"matches": heads(1, 2), "players": kids((1, "a"), (1, "b"), (2, "c"), (9, "of no match"))})
    with pytest.raises(FileExistsError, match="2 is there"):
        p.put({"matches": heads(2, 3), "players": kids((2, "x"))})
    assert p.read("matches").count() == 2 and p.read("players").count() == 3
    p.put({"matches": heads(2, 3), "players": kids((2, "x"))}, replace=True)
    players = lambda: sorted((r["id"], r["player"]) for r in p.read("players").collect())
    assert players() == [(1, "a"), (1, "b"), (2, "x")] and p.one("matches", 3).first()["title"] == "m3"
    p.delete(heads(1))
    assert players() == [(2, "x")] and p.one("matches", 1).count() == 0
    p.put({"matches": heads(1), "players": kids((1, "new"))})  # what was deleted can come again
    assert players() == [(1, "new"), (2, "x")]
    for bad in (heads(4, 4), heads(None)):
        with pytest.raises(ValueError, match="each package"):
            p.put({"matches": bad})


def test_publish_is_all_or_nothing(spark, tmp_path):
    one = spark.range(3)
    T.publish({"x": one, "y": one}, str(tmp_path))
    with pytest.raises(Exception, match="no such luck"):
        T.publish({"x": spark.range(9), "y": one.withColumn("z", F.raise_error(F.lit("no such luck")))}, str(tmp_path))
    assert T.published(spark, str(tmp_path), "x").count() == 3 and len(list((tmp_path / "versions").iterdir())) == 1
    T.publish({"x": spark.range(5), "y": one}, str(tmp_path))
    assert T.published(spark, str(tmp_path), "x").count() == 5


def test_assembled(spark):
    base = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    part = lambda *rows: spark.createDataFrame(list(rows), "k int, v int")
    x = D.assembled(base, ["k"], {"a": part((1, 5), (1, 7), (2, 1)), "b": part((1, 1))}, ["a"])
    assert sorted((r["k"], r["state"], r["a"] and r["a"]["v"]) for r in x.collect()) == [(1, "ready", 7), (2, "warnings", 1), (3, "blocked", None)]


def test_documents_are_written_by_key(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    D.write_documents(df, str(tmp_path / "out"), "k", F.struct("k", "v"))
    x = D.required(D.objects(spark, str(tmp_path / "out"), "k int, v string"))
    assert sorted((r["k"], r["v"]) for r in x.collect()) == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="already exists"):
        D.write_documents(df, str(tmp_path / "out"), "k", F.struct("k", "v"))

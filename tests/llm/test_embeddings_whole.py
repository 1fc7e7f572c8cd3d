import glob
import os

import numpy as np
from pyspark.sql import functions as F

from tactigrid.llm import egrid, store


def test_vectors_of_each_length_link(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.1, 0.0]), (5, [1.0, 0.0, 0.0]), (6, [0.0, 0.0, 1.0, 0.0]), (7, [0.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in egrid.near(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (0, 2), 3: (2, 3), 4: (2, 3), 5: (2, 3), 6: (0, 6), 7: (0, 7)}


def test_a_vector_is_sent_once_for_each_interval(spark, monkeypatch):
    r = np.random.default_rng(3)
    v = r.normal(size=(900, 16)).astype(np.float32)
    v[300:420] = v[0] + r.normal(size=(120, 16)) * 0.05  # near copies, in several intervals and pages
    v[500:540] = v[499]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    component = np.arange(len(v))
    while (least := np.where(near, component[None, :], component[:, None]).min(1)).tolist() != component.tolist():
        component = np.minimum(component, least)
    for sizes in ({"INTERVAL": 65_536, "LEAST": 4096, "PAGE": 2048}, {"INTERVAL": 150, "LEAST": 10, "PAGE": 32}):
        for name, size in sizes.items():
            monkeypatch.setattr(egrid, name, size)
        got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in egrid.near(df).collect()}
        assert got == {i: (int(near[i].sum()), int(component[i])) for i in range(len(v))}
        sent = {}
        for at in ("egrid-pages", "egrid-pairs"):
            last = max(glob.glob(f"{store.shared_dir(spark)}/{at}-*"), key=os.path.getmtime)
            sent[at] = spark.read.parquet(last)
        # A page goes to the pairs of its interval, at most as many as there are intervals.
        assert sent["egrid-pairs"].count() <= 300 and sent["egrid-pages"].agg(F.countDistinct("part")).first()[0] <= (7 if sizes["PAGE"] == 32 else 1)

"""k9 asks for every vector, not for some."""

from tactigrid.plans import catalog
from tactigrid.sources.tables import table


def test_every_vector_is_a_query(spark):
    d = "/root/testdata/sf0.001"
    e = table(spark, d, "embeddings").select("vec_id", "label").where("label is not null").collect()
    n = {}
    for r in e:
        n[r["label"]] = n.get(r["label"], 0) + 1
    got = {}
    for r in catalog.queries()["k9_similar"](spark, d).collect():
        got.setdefault(r["query_id"], []).append(r["rank"])
    assert {i: sorted(ranks) for i, ranks in got.items()} == {r["vec_id"]: list(range(1, min(5, n[r["label"]] - 1) + 1)) for r in e if n[r["label"]] > 1}

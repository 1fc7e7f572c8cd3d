"""Large components are matched and accepted whole, and groups stay together."""

import itertools
import random

from pyspark.sql import functions as F

from tactigrid.operators import assignment, grouped


def test_groups_are_dealt_after_a_join_on_their_key(spark):
    """Spark must not leave the deal out, for the join's own may become a broadcast while it runs, which scatters the groups."""
    x = spark.range(0, 4000, 1, 4).select((F.col("id") % 50).alias("k"), "id")
    y = x.hint("merge").join(x.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k")
    got = grouped.together(y, ["k"], ["id"], ["id", "n"], lambda rows: [(len(rows),)], "m long")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan[plan.index("MapInPandas") : plan.index("SortMergeJoin")]
    assert sorted((r["k"], r["m"]) for r in got.collect()) == [(k, 80) for k in range(50)]


def path_of(n, seed):
    """Pairs 0>0, 0>1, 1>1, 1>2, ... of a path, costs in millionths, and its best sum of gains by going along it."""
    r = random.Random(seed)
    costs = [r.randrange(1_000_000) for _ in range(n)]
    pairs = [(k // 2, (k + 1) // 2, c / 1e6) for k, c in enumerate(costs)]
    best = [0, 0]
    for c in costs:
        best.append(max(best[-1], best[-2] + max(0, 750_000 - c)))
    return pairs, best[-1]


def test_a_component_beyond_5000_pairs_is_matched(spark):
    pairs, best = path_of(6001, 1)
    rows = [(a, b, c, f"{a}>{b}") for a, b, c in pairs]
    df = spark.createDataFrame(rows, "source int, target int, cost double, key string").repartition(3)
    for task in (100_000, 40):  # in one task, and cut in pieces first
        got = assignment.linked(df, "source", "target", "cost", "key", task=task).collect()
        taken = [r for r in got if r["selected"]]
        assert len(got) == 6001 and {r["state"] for r in got} == {"matched"} and len({r["component"] for r in got}) == 1
        assert len({r["source"] for r in taken}) == len({r["target"] for r in taken}) == len(taken)
        assert sum(750_000 - round(r["cost"] * 1e6) for r in taken) == best


def test_pieces_keep_the_ties(spark):
    """Cutting gives the very pairs that matching a component at once gives, also where sums are equal."""
    r = random.Random(2)
    pairs = sorted({(a, a + r.randrange(3)) for a in range(150) for _ in range(2)})
    rows = [(a, b, r.choice([0.05, 0.1, 0.4, 0.5, 0.7, 0.75, 0.9]), f"{a}>{b}") for a, b in pairs]
    df = spark.createDataFrame(rows, "source int, target int, cost double, key string").repartition(3)
    want = {rows[k][3] for k in assignment.least_cost([x[:3] for x in rows], 0.75)}
    assert {x["key"] for x in assignment.linked(df, "source", "target", "cost", "key", task=3).where("selected").collect()} == want


def test_ties_of_a_large_component():
    """All assignments of equal cost: the last pairs are given up first."""
    rows = [(a, b, 0.5) for a, b in itertools.product(range(70), range(70)) if abs(a - b) < 3]
    assert [rows[k][:2] for k in assignment.least_cost(rows, 0.75)] == plain_last_given_up(rows)


def plain_last_given_up(rows):
    """Pairs without a cost of their own, given up from the last on while as many can be matched."""

    def most(pairs):
        of, owner = {}, {}
        for a, b in pairs:
            of.setdefault(a, []).append(b)

        def put(a, seen):
            for b in of[a]:
                if b not in seen:
                    seen.add(b)
                    if b not in owner or put(owner[b], seen):
                        owner[b] = a
                        return True
            return False

        return sum(put(a, set()) for a in of)

    left = sorted(r[:2] for r in rows)
    n = most(left)
    for p in left[::-1]:
        if most(fewer := [q for q in left if q != p]) == n:
            left = fewer
    return left


def accepted_by_turn(links, spans):
    """Reasons of links (key, source, target, cost) by cost and key, from sets of chains."""
    chain, after, before, out = {t: {t} for t in spans}, set(), set(), {}
    for key, a, b, _ in sorted(links, key=lambda x: (x[3], x[0])):
        out[key] = "source_successor_already_assigned" if a in after else "target_predecessor_already_assigned" if b in before else "cycle_or_duplicate_link" if chain[a] is chain[b] else None
        if out[key] is None and any(spans[x][0] <= spans[y][1] and spans[y][0] <= spans[x][1] for x in chain[a] for y in chain[b]):
            out[key] = "component_temporal_conflict"
        if out[key] is None:
            after.add(a)
            before.add(b)
            both = chain[a] | chain[b]
            chain.update(dict.fromkeys(both, both))
    return out


def test_a_component_beyond_20000_links_is_accepted_by_turn(spark):
    from tactigrid.operators import linking

    r = random.Random(3)
    spans = {i: (i * 1.0, i + r.choice([0.0, 0.5, 3.0])) for i in range(1500)}
    for odd in (False, True):
        if odd:  # tracklets that end before they begin can make overlaps and cycles
            spans |= {i: (i + 2.0, i - 40.0) for i in range(0, 1500, 25)}
        links = [(f"{a}>{b}", a, b, round(r.random(), 2)) for a in spans for b in range(max(0, a - 30), a + 31) if a != b and b in spans and 0 < spans[b][0] - spans[a][1] <= 25]
        t = spark.createDataFrame([(i, *s, "U") for i, s in spans.items()], "id int, start double, stop double, team string")
        df = spark.createDataFrame(links, "key string, source int, target int, cost double").repartition(4)
        want = accepted_by_turn(links, spans)
        for most in (20_000, 100):
            got = {x["key"]: x["reason"] for x in linking.accepted(df, t, gap=25.0, most=most).collect()}
            assert len(links) > 20_000 and {k: (got.get(k, "?"), v) for k, v in want.items() if got.get(k, "?") != v} == {}
        assert ("component_temporal_conflict" in want.values()) == odd

"""One-to-one assignments: of least cost with abstention, and greedy within a tolerance."""

from __future__ import annotations

import bisect
import heapq
import uuid
from collections import deque
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tactigrid.sources.tables import shared_dir, written

from .components import components
from .grouped import together
from .sequence import sessionize

#: Costs are compared in millionths.
UNIT = 1_000_000


def least_cost(pairs: list[tuple], limit: float) -> list[int]:
    """Indices of the pairs (row, column, cost) that make the best one-to-one assignment, in order.

    Best: the least sum of cost - limit, so a pair at or above the limit is never taken and leaving both
    ends free is always open. Of equal sums the one that lacks the last of the pairs (by row, column) in
    which they differ.
    """
    order = [k for k in sorted(range(len(pairs)), key=lambda k: pairs[k][:2]) if pairs[k][2] < limit]
    return most_gain([(pairs[k][0], pairs[k][1], -round((pairs[k][2] - limit) * UNIT), k) for k in order])


def most_gain(pairs: list[tuple]) -> list:
    """Marks, sorted, of the pairs (row, column, gain, mark), given in order of row and column, that make the one-to-one assignment of the largest sum of gains (integers; pairs without gain are never taken); of equal sums as least_cost().

    Rows come in one after another, each along the cheapest path to a free column or to a row that is
    better left free; prices keep what is known, so a search ends near its row. Work and room grow with
    the pairs that searches meet, not with powers of two.
    """
    row_at: dict[object, int] = {}
    column_at: dict[object, int] = {}
    of: list[list[tuple[int, int, int]]] = []  # of a row: column, gain, place of the pair
    for place, (r, c, gain, _) in enumerate(pairs):
        if gain > 0:
            if r not in row_at:
                row_at[r] = len(of)
                of.append([])
            of[row_at[r]].append((column_at.setdefault(c, len(column_at)), gain, place))
    profit, price = [0] * len(of), [0] * len(column_at)
    taken = [-1] * len(of)  # a row's column
    owner = [-1] * len(column_at)
    for start in range(len(of)):
        profit[start] = max(0, max(g - price[c] for c, g, _ in of[start]))
        far, reach, came, done = {start: 0}, {}, {}, []
        heap: list[tuple[int, int]] = []
        best, last, row = profit[start], None, start  # cheapest end: leave `row` free, or else take the free column `last`
        end = start
        while True:
            d = far[row]
            if d + profit[row] < best:
                best, last, end = d + profit[row], None, row
            for c, g, _ in of[row]:
                to = d + profit[row] - g + price[c]
                if to < best and to < reach.get(c, best):
                    reach[c], came[c] = to, row
                    if owner[c] < 0:
                        best, last = to, c
                    else:
                        heapq.heappush(heap, (to, c))
            while heap and (heap[0][0] > reach[heap[0][1]] or owner[heap[0][1]] in far):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= best:
                break
            d, c = heapq.heappop(heap)
            done.append(c)
            row = owner[c]
            far[row] = d
        for r, d in far.items():
            profit[r] -= best - d
        for c in done:
            price[c] += best - reach[c]
        if last is None:  # `end` is left free, its column is the path's last
            last, taken[end] = taken[end], -1
        while last is not None and last >= 0:
            r = came[last]
            owner[last] = r
            last, taken[r] = taken[r], last
    _settle_ties(of, profit, price, taken, owner)
    return sorted(pairs[place][3] for r, c in enumerate(taken) for other, _, place in of[r] if other == c)


def _settle_ties(of: list[list[tuple[int, int, int]]], profit: list[int], price: list[int], taken: list[int], owner: list[int]) -> None:
    """Turns a best assignment into that one of the best which lacks the last pairs.

    A pair may be in a best assignment if its gain is its ends' profit and price; ends with a profit or a
    price must be taken. So one best assignment becomes another along cycles from rows to columns by pairs
    that are not taken and back by pairs that are, also through one node more that stands for being free.
    Pairs are given up from the last on, where a cycle leads round them; else they stay for good. Only
    strongly connected parts are searched, which are single nodes where nothing is tied.
    """
    n, m = len(of), len(owner)
    free = n + m  # rows are 0.., columns n..
    tight = [[(c, place) for c, g, place in of[r] if g == profit[r] + price[c]] for r in range(n)]
    if not any(c != taken[r] for r in range(n) for c, _ in tight[r]):
        return
    gone: set[int] = set()  # places given up
    held: set[int] = set()  # nodes of pairs that stay
    zero_rows, zero_columns = [r for r in range(n) if not profit[r]], [c for c in range(m) if not price[c]]

    def after(x: int) -> list[int]:
        if x == free:
            return [r for r in zero_rows if taken[r] < 0] + [n + c for c in zero_columns if owner[c] >= 0]
        if x >= n:
            return [owner[x - n] if owner[x - n] >= 0 else free]
        out = [n + c for c, place in tight[x] if c != taken[x] and place not in gone]
        return out + [free] if not profit[x] and taken[x] >= 0 else out

    def parts(nodes: list[int]) -> dict[int, int]:
        """The strongly connected part of each node, if it has more than one (Tarjan's way, without recursion)."""
        number: dict[int, int] = {}
        low: dict[int, int] = {}
        part: dict[int, int] = {}
        stack: list[int] = []
        inside = set(nodes)
        open_: set[int] = set()
        for first in nodes:
            if first in number:
                continue
            calls = [(first, iter(after(first)))]
            number[first] = low[first] = len(number)
            stack.append(first)
            open_.add(first)
            while calls:
                x, rest = calls[-1]
                for y in rest:
                    if y not in inside or y in held:
                        continue
                    if y not in number:
                        number[y] = low[y] = len(number)
                        stack.append(y)
                        open_.add(y)
                        calls.append((y, iter(after(y))))
                        break
                    if y in open_:
                        low[x] = min(low[x], number[y])
                else:
                    calls.pop()
                    if calls:
                        low[calls[-1][0]] = min(low[calls[-1][0]], low[x])
                    if low[x] == number[x]:
                        members = [stack.pop()]
                        while members[-1] != x:
                            members.append(stack.pop())
                        open_.difference_update(members)
                        if len(members) > 1:
                            part.update(dict.fromkeys(members, number[x]))
        return part

    def way(a: int, b: int, part: dict[int, int]) -> tuple[dict[int, int], int]:
        """From where each node on the way from a to b was reached, if there is one, and the nodes seen."""
        came, line = {a: a}, deque([a])
        while line:
            x = line.popleft()
            for y in after(x):
                if y not in came and y not in held and part.get(y) == part[a]:
                    came[y] = x
                    if y == b:
                        return came, len(came)
                    line.append(y)
        return {}, len(came)

    part = parts([*range(n + m), free])
    steps, renewed = 0, len(part)
    zero_rows, zero_columns = [r for r in zero_rows if r in part], [c for c in zero_columns if n + c in part]
    for place, r, c in sorted(((place, r, c) for r in range(n) if r in part for c, place in tight[r] if part.get(n + c) == part[r]), reverse=True):
        if taken[r] != c:
            gone.add(place)
            continue
        came, seen = way(r, n + c, part) if r in part and part.get(n + c) == part[r] else ({}, 0)
        steps += seen
        if not came:
            held |= {r, n + c}
        else:
            path = [n + c]
            while path[-1] != r:
                path.append(came[path[-1]])
            path.reverse()
            new = [(x, y - n) for x, y in zip(path, path[1:], strict=False) if x < n <= y < free]
            for x in path:
                if x < n:
                    taken[x] = -1
                elif x < free:
                    owner[x - n] = -1
            for x, y in new:
                taken[x], owner[y] = y, x
            gone.add(place)
        if steps > 8 * renewed + 64:  # what was given up and held may have cut the parts
            part = parts([x for x in part if x not in held])
            steps, renewed = 0, len(part)


def cost(distance: Column, dt: Column, confidence: Column, other_team: Column, unknown_team: Column, known_tracklet: Column, known_track: Column, extra: Column | None = None, speed: float = 9.5, farthest: float = 12.0, memory: float = 2.0) -> Column:
    """What it costs to give a slot an observation, null if it can't be: too far, too fast, or of another team without a known tracklet.

    distance from the slot's predicted place, dt since it was seen; extra: penalties of shape,
    appearance and play area. speed, farthest and memory (the longest prediction, seconds) are limits.
    """
    dt = F.greatest(dt, F.lit(0.001))
    often = F.greatest(dt, F.lit(0.3))
    gate = F.least(F.lit(farthest), F.greatest(F.lit(3.0), speed * often * 1.25))
    team = F.when(other_team, 4.0).when(unknown_team, 2.0).otherwise(0.0)
    discount = F.when(known_tracklet, 4.0).otherwise(0.0) + F.when(known_track, 1.0).otherwise(0.0)
    total = distance * 4.0 + F.greatest(F.lit(0.0), 1.0 - confidence) * 2.0 + team + F.least(F.lit(4.0), dt / memory) - discount
    able = (distance <= gate) & (distance / often <= speed) & (~other_team | known_tracklet)
    return F.when(able, F.greatest(F.lit(0.0), total if extra is None else total + extra))


def assigned(pairs: DataFrame, keys: list[str], row: str, column: str, by: str, limit: float = 999.0) -> DataFrame:
    """keys, row, column, cost of the least-cost assignment of each group of pairs, see least_cost(); pairs of null or NaN cost are none, of repeated pairs the cheapest counts.

    A group is a frame of play: rows and columns are the players of a pitch, so a group is small; groups
    are independent and share tasks.
    """
    kinds = dict(pairs.dtypes)

    def work(rows: list[tuple]) -> list[tuple]:
        return [rows[k] for k in least_cost(rows, limit)]

    able = pairs.where(F.col(by).isNotNull() & ~F.isnan(by) & F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(*keys, row, column).agg(F.min(by).cast("double").alias(by))
    return together(able, keys, [row, column], [row, column, by], work, f"{row} {kinds[row]}, {column} {kinds[column]}, {by} double")


def _side(name: str, c: str) -> Column:
    return F.concat(F.lit(name), F.col(c).cast("string"))


def _pieces(pairs: DataFrame, source: str, target: str, key: str, task: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of gain_ with their piece, each to be matched by itself, and the keys of pairs that are taken for certain.

    Pieces are connected by pairs that gain. In those of more than `task` pairs, a pair that gains more
    than the best other pairs of its two ends together is in every best matching; it is taken, and the
    pairs at its ends go, which cuts the piece further. That ends when hardly any is found: what is left
    stays whole, whatever its size.
    """
    spark = pairs.sparkSession
    folder = f"{shared_dir(spark)}/pieces-{uuid.uuid4().hex}"
    live, whole, sure, n = written(pairs.where("gain_ > 0").select(source, target, "gain_", key), f"{folder}/live"), [], [], 0
    other = lambda c: F.coalesce(F.lead("gain_").over(W.partitionBy(c).orderBy(F.desc("gain_"))), F.lit(0))
    place = lambda c: F.row_number().over(W.partitionBy(c).orderBy(F.desc("gain_")))
    while True:
        of = components(live.select(_side("> ", source).alias("a"), _side("< ", target).alias("b"))).withColumnRenamed("component", "piece")
        live = live.withColumn("node", _side("> ", source)).join(of, "node").drop("node")
        live = written(live.join(live.groupBy("piece").agg(F.count(F.lit(1)).alias("size_")), "piece"), f"{folder}/sized-{n}")
        whole.append(live.where(F.col("size_") <= task).drop("size_"))
        live = live.where(F.col("size_") > task).drop("size_")
        best = live.withColumns({"s_": other(source), "t_": other(target), "i_": place(source), "j_": place(target)})
        best = written(best.where("i_ = 1 and j_ = 1 and gain_ > s_ + t_").select(source, target, key), f"{folder}/sure-{n}")
        found, n = best.count(), n + 1
        if found * 100 <= live.count():  # also where none is left
            whole.append(live)
            break
        sure.append(best.select(key))
        live = live.drop("piece").join(best.select(source), source, "left_anti").join(best.select(target), target, "left_anti")
        live = written(live, f"{folder}/live-{n}")
    return reduce(DataFrame.unionByName, whole), reduce(DataFrame.unionByName, sure, best.select(key).limit(0))


def linked(edges: DataFrame, source: str, target: str, by: str, key: str, unmatched: float = 0.75, most: int | None = None, task: int = 100_000) -> DataFrame:
    """edges with component, selected and state: in each component of edges that share a source or a target, the one-to-one links of least cost, each against `unmatched` for leaving both ends free.

    Of repeated pairs the cheapest edge counts, then the smaller key; the others are not selected.
    Every component is matched. Those of more than `task` pairs are first cut in pieces, see _pieces();
    a piece is one task's. Only where a caller sets `most`, components of more pairs are refused: their
    edges have the state too_large.
    """
    kinds = dict(edges.dtypes)
    able = edges.where(F.col(source).isNotNull() & F.col(target).isNotNull() & F.col(by).isNotNull() & ~F.isnan(by))
    best = able.groupBy(source, target).agg(F.min(F.struct(F.col(by).cast("double").alias("c"), F.col(key).alias("k"))).alias("r")).select(source, target, F.col("r.c").alias("cost_"), F.col("r.k").alias(key))
    of = components(best.select(_side("> ", source).alias("a"), _side("< ", target).alias("b")))
    best = best.withColumn("node", _side("> ", source)).join(of, "node").drop("node")
    best = best.join(best.groupBy("component").agg(F.count(F.lit(1)).alias("pairs_")), "component")
    gain = F.when(F.col("cost_") < unmatched, -F.rint((F.col("cost_") - unmatched) * UNIT)).otherwise(0).cast("long")
    best = best.withColumn("state", F.lit("matched") if most is None else F.when(F.col("pairs_") > most, "too_large").otherwise("matched"))
    best = written(best.withColumn("gain_", gain), f"{shared_dir(edges.sparkSession)}/linked-{uuid.uuid4().hex}")

    def work(rows: list[tuple]) -> list[tuple]:
        return [(k,) for k in most_gain(sorted(rows, key=lambda r: r[:2]))]

    taken = best.where("state = 'matched' and gain_ > 0")
    given, sure = taken.where(F.col("pairs_") <= task).select(F.col("component").alias("piece"), source, target, "gain_", key), None
    if not best.where((F.col("pairs_") > task) & (F.col("state") == "matched")).isEmpty():
        pieces, sure = _pieces(taken.where(F.col("pairs_") > task), source, target, key, task)
        given = given.unionByName(pieces)
    found = together(given, ["piece"], [source, target], [source, target, "gain_", key], work, f"{key} {kinds[key]}").select(key)
    found = found if sure is None else found.unionByName(sure)
    x = edges.join(best.select("component", key, "state"), key, "left").join(found.withColumn("selected", F.lit(True)), key, "left")
    return x.withColumn("selected", F.coalesce("selected", F.lit(False))).withColumn("state", F.coalesce("state", F.lit("not_considered"))).select(key, *[c for c in edges.columns if c != key], "component", "selected", "state")


def greedy_match(gold: DataFrame, found: DataFrame, key: list[str], frame: str, id_: str, tolerance: int = 45, order: str | None = None) -> DataFrame:
    """key, gold_id, found_id, frame_delta: each gold event, in turn, with the free found event of its key nearest in frames, up to tolerance; then the smaller id.

    Gold events take turns by order (frame if None), then id. A gold event without a match has no
    found_id (missed), a found event without one no gold_id (false positive). A key's events are cut
    where more than tolerance frames hold none, since nothing matches across; the pieces are matched
    apart. Events without a frame match nothing.
    """
    kinds = dict(gold.dtypes)
    side = lambda df, mine, turn: df.select(*key, F.col(frame).cast("long").alias("f_"), F.col(id_).alias("id_"), F.lit(mine).alias("gold_"), turn.cast("double").alias("turn_"))
    both = side(gold, True, F.col(order or frame)).unionByName(side(found, False, F.lit(0)))
    cut = sessionize(both.where("f_ is not null"), key, "f_", "id_", tolerance)

    def work(rows: list[tuple]) -> list[tuple]:
        golds = sorted(((turn, i, f) for f, i, gold, turn in rows if gold), key=lambda x: (x[0] is None, x[0], x[1] is None, x[1]))
        free = sorted(((f, i) for f, i, gold, _ in rows if not gold), key=lambda x: (x[0], x[1] is None, x[1]))
        out: list[tuple] = []
        for _, i, f in golds:
            a = bisect.bisect_left(free, (f - tolerance,))
            best = None
            while a < len(free) and free[a][0] <= f + tolerance:
                best = min(best or (tolerance + 1, None, None), (abs(free[a][0] - f), free[a][1], a), key=lambda x: (x[0], x[1] is None, x[1]))
                a += 1
            if best is None:
                out.append((i, None, None))
            else:
                at = free.pop(best[2])
                out.append((i, at[1], int(at[0] - f)))
        return out + [(None, i, None) for _, i in free]

    matched = together(cut, [*key, "session"], ["f_", "id_"], ["f_", "id_", "gold_", "turn_"], work, f"gold_id {kinds[id_]}, found_id {kinds[id_]}, frame_delta long").drop("session")
    lost = both.where("f_ is null").select(*key, F.when(F.col("gold_"), F.col("id_")).alias("gold_id"), F.when(~F.col("gold_"), F.col("id_")).alias("found_id"), F.lit(None).cast("long").alias("frame_delta"))
    return matched.unionByName(lost)


def scores(matched: DataFrame, key: list[str]) -> DataFrame:
    """Per key: true_positives, missed, false_positives, precision and recall (null without events)."""
    hit, gold, found = F.col("frame_delta").isNotNull(), F.col("gold_id").isNotNull(), F.col("found_id").isNotNull()
    n = lambda c: F.count(F.when(c, 1))
    x = matched.groupBy(*key).agg(n(hit).alias("true_positives"), n(gold & ~found).alias("missed"), n(found & ~gold).alias("false_positives"))
    share = lambda c: F.try_divide(F.col("true_positives"), F.col("true_positives") + F.col(c))
    return x.withColumns({"precision": share("false_positives"), "recall": share("missed")})

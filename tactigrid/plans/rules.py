"""Queries of rules over evidence, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tactigrid.functions import labels as L
from tactigrid.operators import aggregates as A
from tactigrid.operators import evidence as V
from tactigrid.operators import possession as P
from tactigrid.plans.registry import query
from tactigrid.plans.tracking import DAY, EVENTS, FRAMES, contacts, events, frames, players
from tactigrid.sources.tables import table


@query("e3_contact_review", FRAMES + """SELECT match, start_frame, CASE WHEN least_m > 1.6 OR frames < 1 THEN 'rejected'
WHEN (least_m <= 1.2)::INT + (detected_frames >= 1)::INT + (frames >= 2)::INT >= 2 THEN 'accepted' WHEN (least_m > 1.2)::INT + (frames = 1)::INT >= 2 THEN 'uncertain' ELSE 'needs_review' END AS state FROM contacts""")
def e3(spark, d):
    c = F.col
    state = V.by_reasons([c("least_m") > 1.6, c("frames") < 1], [c("least_m") <= 1.2, c("detected_frames") >= 1, c("frames") >= 2], [c("least_m") > 1.2, c("frames") == 1], 2, 2)
    return contacts(spark, d).select("match", "start_frame", state.alias("state"))


@query("e4_events", FRAMES + """SELECT match, start_frame, CASE WHEN least_m > 1.6 THEN 'rejected' ELSE 'accepted' END AS state,
round(least(0.95, (1 - least_m / 3.6) * CASE WHEN least_m > 1.6 THEN 0.35 WHEN detected_frames < frames THEN 0.65 ELSE 1 END), 4) AS confidence FROM contacts""")
def e4(spark, d):
    far = F.col("least_m") > 1.6
    factor = F.when(far, 0.35).when(F.col("detected_frames") < F.col("frames"), 0.65).otherwise(1.0)
    confidence = F.least(F.lit(0.95), (1 - F.col("least_m") / 3.6) * factor)
    return contacts(spark, d).select("match", "start_frame", F.when(far, "rejected").otherwise("accepted").alias("state"), F.round(confidence, 4).alias("confidence"))


@query("e5_pass_outcomes", FRAMES + """, q AS (SELECT passes.*, sqrt((b.bx - a.bx) * (b.bx - a.bx) + (b.bz - a.bz) * (b.bz - a.bz)) AS far FROM passes JOIN frames a ON a.f = passes.start_frame JOIN frames b ON b.f = passes.next_start_frame WHERE reason IS NULL)
SELECT match, start_frame, CASE WHEN far < 0.85 THEN 'excluded_non_pass' WHEN pass_type = 'same_team_pass' THEN 'completed_pass' ELSE 'failed_pass' END AS outcome, CASE WHEN far < 0.85 THEN 'displacement_too_short' WHEN gap < 0.12 THEN 'duration_short' END AS note FROM q""")
def e5(spark, d):
    x = P.pass_pairs(contacts(spark, d), ["match"], "start_t", "stop_t", "start_frame").where("reason is null")
    at = frames(spark, d).select("f", "bx", "by")
    x = x.join(at.select(F.col("f").alias("start_frame"), F.col("bx").alias("ax"), F.col("by").alias("ay")), "start_frame").join(at.select(F.col("f").alias("next_start_frame"), F.col("bx").alias("cx"), F.col("by").alias("cy")), "next_start_frame")
    far = L.euclid([F.col("cx"), F.col("cy")], [F.col("ax"), F.col("ay")])
    outcome = F.when(far < 0.85, "excluded_non_pass").when(F.col("pass_type") == "same_team_pass", "completed_pass").otherwise("failed_pass")
    note = F.when(far < 0.85, "displacement_too_short").when(F.col("gap") < 0.12, "duration_short")
    return x.select("match", "start_frame", outcome.alias("outcome"), note.alias("note"))


@query("a14_shape_quality", FRAMES + """, n AS (SELECT f, count(*) AS n FROM players GROUP BY f), m AS (SELECT match, count(n.n) / count(*) AS coverage, median(n.n) AS players FROM ball LEFT JOIN n ON ball.f = n.f GROUP BY match)
SELECT match, round(coverage, 6) AS coverage, CASE WHEN coverage >= 0.8 AND players >= 3 THEN 'ready' WHEN coverage >= 0.6 AND players >= 2 THEN 'experimental' ELSE 'not_ready' END AS state FROM m""")
def a14(spark, d):
    x = P.nearest_players(frames(spark, d).select("match", "f", "bx", "by"), players(spark, d), ["f"])
    x = x.groupBy("match").agg((F.count("nearest") / F.count(F.lit(1))).alias("coverage"), F.median(F.size("nearest")).alias("players"))
    state = F.when((F.col("coverage") >= 0.8) & (F.col("players") >= 3), "ready").when((F.col("coverage") >= 0.6) & (F.col("players") >= 2), "experimental").otherwise("not_ready")
    return x.select("match", F.round("coverage", 6).alias("coverage"), state.alias("state"))


@query("a19_ratings", EVENTS + ", m AS (SELECT user_id, avg(value) AS v FROM e GROUP BY user_id) SELECT user_id, CASE WHEN v >= 55 THEN 'good' WHEN v >= 45 THEN 'fair' ELSE 'poor' END AS rating FROM m")
def a19(spark, d):
    x = events(spark, d).groupBy("user_id").agg(F.avg("value").alias("v"))
    return x.select("user_id", L.ordered_label(F.col("v"), [(55.0, "good"), (45.0, "fair")], "poor").alias("rating"))


@query("a28_distinct_status", "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus")
def a28(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("a30_majority", EVENTS + """, b AS (SELECT user_id, CAST(floor(t / 172800) AS BIGINT) AS episode, max({'s': value, 't': event_id, 'v': event_type}) AS r FROM e GROUP BY ALL), v AS (SELECT user_id, r.v AS event_type, count(*) AS votes, avg(r.s / 500) AS mean FROM b GROUP BY ALL),
t AS (SELECT *, max(votes) OVER (PARTITION BY user_id) AS top FROM v), u AS (SELECT user_id, min(event_type) AS event_type, max(votes) AS votes, count(*) AS tops, max(mean) AS mean FROM t WHERE votes = top GROUP BY user_id)
SELECT user_id, CASE WHEN tops = 1 THEN event_type END AS event_type, votes, CASE WHEN tops > 1 THEN 'conflict' WHEN votes < 3 THEN 'weak' ELSE 'confirmed' END AS state, round(least(0.75, mean * least(1, votes / 3)), 6) AS confidence FROM u""")
def a30(spark, d):
    x = events(spark, d).withColumn("episode", F.floor(F.col("t") / (2 * DAY)).cast("long")).withColumn("score", F.col("value") / 500)
    return V.majority(x, ["user_id"], "episode", "event_type", "score", "event_id").withColumn("confidence", F.round("confidence", 6))


@query("a32_quality", """WITH m AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS bad, avg(l_quantity) AS q FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, round(100 - 40 * bad / n - CASE WHEN q < 25 THEN 10 ELSE 0 END, 6) AS score, CASE WHEN 100 - 40 * bad / n - CASE WHEN q < 25 THEN 10 ELSE 0 END >= 85 THEN 'good' WHEN 100 - 40 * bad / n - CASE WHEN q < 25 THEN 10 ELSE 0 END >= 60 THEN 'fair' ELSE 'poor' END AS label FROM m""")
def a32(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("bad"), F.avg("l_quantity").alias("q"))
    x = x.withColumn("score", 100 - 40 * F.col("bad") / F.col("n") - F.when(F.col("q") < 25, 10).otherwise(0))
    return x.select("l_suppkey", F.round("score", 6).alias("score"), L.ordered_label(F.col("score"), [(85.0, "good"), (60.0, "fair")], "poor").alias("label"))


@query("a34_slots_to_teams", """WITH p AS (SELECT l_suppkey, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(28,2))) AS DOUBLE) AS metres, max(l_discount) AS top FROM lineitem GROUP BY l_suppkey)
SELECT s_nationkey AS team, count(*) AS players, CAST(sum(n) AS BIGINT) AS n, sum(metres) AS metres, max(top) AS top FROM p JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey""")
def a34(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"), A.exact_sum("l_quantity").alias("metres"), F.max("l_discount").alias("top"))
    x = p.join(table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("team")), "s_suppkey")
    return x.groupBy("team").agg(F.count(F.lit(1)).alias("players"), F.sum("n").alias("n"), F.sum("metres").alias("metres"), F.max("top").alias("top"))


@query("j10_setup_player", FRAMES + """, c AS (SELECT b.match, p.player, round(min(sqrt((x - 3) * (x - 3) + (y - 3) * (y - 3))), 3) AS far FROM players p JOIN ball b ON b.f = p.f GROUP BY ALL)
SELECT match, arg_min(player, (far, player)) AS player, min(far) AS far FROM c WHERE far <= 2.6 GROUP BY match""")
def j10(spark, d):
    x = players(spark, d).join(frames(spark, d).select("f", "match"), "f")
    far = F.round(F.min(L.euclid([F.col("x"), F.col("y")], [F.lit(3.0), F.lit(3.0)])), 3)
    x = x.groupBy("match", "player").agg(far.alias("far")).where("far <= 2.6")
    return x.groupBy("match").agg(F.min(F.struct("far", "player")).alias("r")).select("match", "r.player", "r.far")


@query("j14_successors", EVENTS + """, p AS (SELECT a.event_id, b.event_id AS next, round(0.4 * (b.t - a.t) / 86400 + 0.6 * abs(b.value - a.value) / 50, 6) AS cost FROM e a JOIN e b ON a.user_id = b.user_id AND b.t > a.t AND b.t <= a.t + 86400 AND abs(b.value - a.value) <= 50)
SELECT event_id, r.next AS next, r.cost AS cost, CASE WHEN r.cost <= 0.48 THEN 'recommended' ELSE 'alternative' END AS state FROM (SELECT event_id, min({'cost': cost, 'next': next}) AS r FROM p GROUP BY event_id)""")
def j14(spark, d):
    return V.successors(events(spark, d), ["user_id"], "t", "event_id", "value", DAY, 50.0).drop("user_id")


CHUNKS = EVENTS + ", c AS (SELECT event_id, t - 1704067200 AS s FROM e), k AS (SELECT event_id, s, CAST(floor(s / 86400) AS BIGINT) AS chunk FROM c UNION ALL SELECT event_id, s, CAST(floor(s / 86400) AS BIGINT) - 1 FROM c WHERE floor(s / 86400) > 0 AND s - floor(s / 86400) * 86400 <= 3600)"


@query("t1_chunks", CHUNKS + " SELECT chunk, count(*) AS n, min(s) AS first FROM k GROUP BY chunk")
def t1(spark, d):
    x = V.chunked(events(spark, d).select("event_id", (F.col("t") - 1_704_067_200).alias("s")), "s", DAY, 3600.0)
    return x.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("first"))


@query("s14_merged_chunks", CHUNKS + " SELECT event_id, chunk FROM k WHERE chunk = 0 OR s > chunk * 86400 + 3600")
def s14(spark, d):
    x = V.chunked(events(spark, d).select("event_id", (F.col("t") - 1_704_067_200).alias("s")), "s", DAY, 3600.0)
    return V.merged_chunks(x, "s", DAY, 3600.0).select("event_id", "chunk")


@query("w20_long_segments", EVENTS + """, m AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 43200 THEN 1 ELSE 0 END AS s FROM e), z AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY t, event_id) AS g FROM m),
n AS (SELECT *, count(*) OVER (PARTITION BY user_id, g) AS n, max(t) OVER (PARTITION BY user_id, g) - min(t) OVER (PARTITION BY user_id, g) AS long FROM z) SELECT event_id, user_id FROM n WHERE n >= 3 AND long >= 3600""")
def w20(spark, d):
    return V.long_segments(events(spark, d), ["user_id"], "t", "event_id", DAY / 2, 3, 3600.0).select("event_id", "user_id")


@query("w27_roster", "SELECT c_nationkey, c_mktsegment, c_custkey, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 7")
def w27(spark, d):
    return A.top_per_group(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], [F.desc("c_acctbal"), "c_custkey"], 7).select("c_nationkey", "c_mktsegment", "c_custkey", "rank")


@query("r6_owner_runs", EVENTS + """, m AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type AND t - lag(t) OVER w <= 43200 THEN 0 ELSE 1 END AS s FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
z AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM m) SELECT user_id, event_type, min(t) AS start, max(t) AS stop, count(*) AS n FROM z GROUP BY user_id, run, event_type""")
def r6(spark, d):
    return V.owner_runs(events(spark, d), ["user_id"], "t", "event_id", "event_type", DAY / 2)


@query("p10_allow_list", "SELECT n_nationkey, n_name FROM nation")
def p10(spark, d):
    x = table(spark, d, "nation")
    return x.select([c for c in ("n_nationkey", "n_name", "n_secret") if c in x.columns])


@query("f5_confidence", EVENTS + " SELECT event_id, round(least(CASE event_type WHEN 'purchase' THEN 0.95 WHEN 'view' THEN 0.9 ELSE 0.85 END, value / 100 * CASE WHEN event_type = 'error' THEN 0.65 ELSE 1 END), 6) AS confidence FROM e")
def f5(spark, d):
    kind = F.col("event_type")
    cap = F.when(kind == "purchase", 0.95).when(kind == "view", 0.9).otherwise(0.85)
    return events(spark, d).select("event_id", F.round(F.least(cap, F.col("value") / 100 * F.when(kind == "error", 0.65).otherwise(1.0)), 6).alias("confidence"))


@query("f13_throughput", "SELECT o_custkey, round(count(*) / greatest(sum(o_totalprice) / 1000, 0.001), 4) AS per_second, round(2400 * (sum(o_totalprice) / 1000) / count(*), 4) AS estimate FROM orders GROUP BY o_custkey")
def f13(spark, d):
    wall, n = F.sum("o_totalprice") / 1000, F.count(F.lit(1))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.round(n / F.greatest(wall, F.lit(0.001)), 4).alias("per_second"), F.round(2400 * wall / n, 4).alias("estimate"))

"""Queries of possession, passes, range joins, smoothing and summaries, with their DuckDB counterparts.

The tables hold no matches, so lineitem's orders are frames with a few players each and orders is the
ball's track: 300 frames make a match.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tactigrid.operators import aggregates as A
from tactigrid.operators import possession as P
from tactigrid.operators import ranges as R
from tactigrid.operators import smoothing as M
from tactigrid.operators import sequence as S
from tactigrid.operators import summary as U
from tactigrid.plans.registry import query
from tactigrid.sources.tables import table

DAY = 86_400.0


def players(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("f"), (F.col("l_suppkey") % 4).alias("player"))
    x = x.agg((F.min("l_quantity") % 7).alias("x"), (F.min("l_partkey") % 7).cast("double").alias("y"))
    return x.withColumn("team", F.when(F.col("player") < 2, "A").otherwise("B"))


def ball(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        F.floor(F.col("o_orderkey") / 300).alias("match"), F.col("o_orderkey").alias("f"), (F.col("o_orderkey") / 30.0).alias("t"),
        ((F.col("o_custkey") % 13) / 2.0).alias("bx"), ((F.col("o_orderkey") * 7 % 13) / 2.0).alias("by"), (F.col("o_orderstatus") == "F").alias("detected"),
    )


def frames(spark, d):
    return P.possession(P.nearest_players(ball(spark, d), players(spark, d), ["f"]))


def segments(spark, d):
    return P.segments(frames(spark, d), ["match"], "f", "t")


def contacts(spark, d):
    s = P.fly_through(segments(spark, d)).where("status = 'controlled' AND detected_frames > 0")
    return s.select("match", "start_frame", "player", "team", (F.col("start_frame") / 30.0).alias("start_t"), (F.col("stop_frame") / 30.0).alias("stop_t"), "frames", "detected_frames", "least_m", "x0", "y0", "x1", "y1")


FRAMES = """
WITH players AS (
  SELECT l_orderkey AS f, l_suppkey % 4 AS player, min(l_quantity) % 7 AS x, CAST(min(l_partkey) % 7 AS DOUBLE) AS y,
         CASE WHEN l_suppkey % 4 < 2 THEN 'A' ELSE 'B' END AS team
  FROM lineitem GROUP BY l_orderkey, l_suppkey % 4),
ball AS (
  SELECT o_orderkey // 300 AS match, o_orderkey AS f, CAST(o_orderkey AS DOUBLE) / 30 AS t, CAST(o_custkey % 13 AS DOUBLE) / 2 AS bx,
         CAST(o_orderkey * 7 % 13 AS DOUBLE) / 2 AS bz, o_orderstatus = 'F' AS detected FROM orders),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY f ORDER BY m, player) AS r
  FROM (SELECT ball.f, player, team, round(sqrt((x - bx) * (x - bx) + (y - bz) * (y - bz)), 3) AS m FROM ball JOIN players ON ball.f = players.f)),
near AS (
  SELECT ball.*, a.m AS first_m, b.m AS second_m, a.player AS p1, a.team AS t1
  FROM ball LEFT JOIN ranked a ON ball.f = a.f AND a.r = 1 LEFT JOIN ranked b ON ball.f = b.f AND b.r = 2),
frames AS (
  SELECT match, f, t, bx, bz, detected, first_m, second_m, status,
         CASE WHEN status = 'controlled' THEN p1 END AS player, CASE WHEN status = 'controlled' THEN t1 END AS team
  FROM (SELECT *, CASE WHEN first_m IS NULL THEN 'unknown' WHEN first_m <= 2.4 AND second_m <= 2.4 AND second_m - first_m <= 0.8 THEN 'contested'
                       WHEN first_m <= 1.8 THEN 'controlled' ELSE 'free' END AS status FROM near)),
marked AS (
  SELECT *, CASE WHEN lag(f) OVER w IS NULL OR (lag(status) OVER w IS NOT DISTINCT FROM status AND lag(player) OVER w IS NOT DISTINCT FROM player) THEN 0 ELSE 1 END AS s,
         sqrt((bx - lag(bx) OVER w) * (bx - lag(bx) OVER w) + (bz - lag(bz) OVER w) * (bz - lag(bz) OVER w)) AS step
  FROM frames WINDOW w AS (PARTITION BY match ORDER BY f)),
numbered AS (SELECT *, sum(s) OVER (PARTITION BY match ORDER BY f) AS island FROM marked),
stepped AS (SELECT *, CASE WHEN lag(island) OVER (PARTITION BY match ORDER BY f) = island THEN step END AS own FROM numbered),
segments0 AS (
  SELECT match, CAST(island AS BIGINT) AS island, status, player, team, min(f) AS start_frame, max(f) AS stop_frame, count(*) AS frames,
         count(*) FILTER (detected) AS detected_frames, avg(first_m) AS mean_m, min(first_m) AS least_m, coalesce(sum(own), 0) AS path_m,
         max(t) - min(t) AS span, count(*) / 30.0 AS seconds, arg_min(bx, f) AS x0, arg_min(bz, f) AS y0, arg_max(bx, f) AS x1, arg_max(bz, f) AS y1
  FROM stepped GROUP BY ALL),
segments AS (
  SELECT *, path_m / greatest(span, 0.001) AS speed,
         sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) / greatest(path_m, 0.001) AS straightness FROM segments0),
flown AS (
  SELECT * REPLACE (CASE WHEN flies THEN 'free' ELSE status END AS status, CASE WHEN NOT flies THEN player END AS player, CASE WHEN NOT flies THEN team END AS team)
  FROM (SELECT *, status = 'controlled' AND frames >= 3 AND least_m > 0.95 AND path_m >= 1.5 AND speed >= 7.5 AND straightness >= 0.85 AS flies FROM segments)),
contacts AS (
  SELECT match, start_frame, player, team, start_frame / 30.0::DOUBLE AS start_t, stop_frame / 30.0::DOUBLE AS stop_t, frames, detected_frames, least_m, x0, y0, x1, y1
  FROM flown WHERE status = 'controlled' AND detected_frames > 0),
paired AS (
  SELECT *, lead(start_frame) OVER w AS next_start_frame, lead(player) OVER w AS next_player, lead(team) OVER w AS next_team, lead(start_t) OVER w - stop_t AS gap
  FROM contacts WINDOW w AS (PARTITION BY match ORDER BY start_t, start_frame)),
passes AS (
  SELECT match, start_frame, next_start_frame, player, next_player, team, next_team, gap, reason,
         CASE WHEN reason IS NULL THEN CASE WHEN team = next_team THEN 'same_team_pass' ELSE 'turnover_or_interception' END END AS pass_type
  FROM (SELECT *, CASE WHEN player = next_player THEN 'same_player' WHEN gap < 0.05 THEN 'gap_too_short' WHEN gap > 5 THEN 'gap_too_long' END AS reason
        FROM paired WHERE next_start_frame IS NOT NULL))
"""
EVENTS = "WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS t FROM events)"


def events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", S.seconds("ts").alias("t"))


@query("j1_frame_players", FRAMES + "SELECT ball.f, count(players.player) AS n_players FROM ball LEFT JOIN players ON ball.f = players.f GROUP BY ball.f")
def j1(spark, d):
    x = P.nearest_players(ball(spark, d), players(spark, d), ["f"])
    return x.select("f", F.coalesce(F.size("nearest"), F.lit(0)).cast("long").alias("n_players"))


@query("j2_nearest_players", FRAMES + "SELECT f, p1 AS player, first_m, second_m FROM near")
def j2(spark, d):
    x = P.nearest_players(ball(spark, d), players(spark, d), ["f"])
    one, two = F.try_element_at("nearest", F.lit(1)), F.try_element_at("nearest", F.lit(2))
    return x.select("f", one["player"].alias("player"), one["distance"].alias("first_m"), two["distance"].alias("second_m"))


@query("e1_possession", FRAMES + "SELECT match, f, status, player, team FROM frames")
def e1(spark, d):
    return frames(spark, d).select("match", "f", "status", "player", "team")


@query("a1_coverage", FRAMES + """, c AS (SELECT match, count(*) AS frames, count(*) FILTER (status = 'controlled') AS controlled, count(*) FILTER (status = 'contested') AS contested,
  count(*) FILTER (status = 'free') AS free, count(*) FILTER (status = 'unknown') AS unknown FROM frames GROUP BY match)
SELECT match, frames, controlled, contested, free, unknown, round(controlled / frames, 4) AS controlled_share, round(unknown / frames, 4) AS unknown_share FROM c""")
def a1(spark, d):
    x = U.shares(frames(spark, d), ["match"], "status", ["controlled", "contested", "free", "unknown"], "frames")
    return x.withColumn("controlled_share", F.round(F.col("controlled") / F.col("frames"), 4)).withColumn("unknown_share", F.round(F.col("unknown") / F.col("frames"), 4))


@query("w12_longest_free", FRAMES + """, m AS (SELECT match, f, status, CASE WHEN lag(status) OVER (PARTITION BY match ORDER BY f) IS NOT DISTINCT FROM status THEN 0 ELSE 1 END AS s FROM frames),
z AS (SELECT *, sum(s) OVER (PARTITION BY match ORDER BY f) AS run FROM m), g AS (SELECT match, run, count(*) FILTER (status = 'free') AS n FROM z GROUP BY match, run)
SELECT match, max(n) AS longest FROM g GROUP BY match""")
def w12(spark, d):
    return P.longest_run(frames(spark, d), ["match"], "f", "status", "free")


@query("a3_segments", FRAMES + "SELECT match, start_frame, stop_frame, status, player, frames, detected_frames, round(mean_m, 6) AS mean_m, least_m, round(path_m, 6) AS path_m, round(seconds, 6) AS seconds FROM segments")
def a3(spark, d):
    return segments(spark, d).select("match", "start_frame", "stop_frame", "status", "player", "frames", "detected_frames", F.round("mean_m", 6).alias("mean_m"), "least_m", F.round("path_m", 6).alias("path_m"), F.round("seconds", 6).alias("seconds"))


@query("w4_fly_through", FRAMES + "SELECT match, start_frame, status, player, team, flies FROM flown")
def w4(spark, d):
    return P.fly_through(segments(spark, d)).select("match", "start_frame", "status", "player", "team", "flies")


@query("e2_contacts", FRAMES + "SELECT match, start_frame, player, team, frames, detected_frames, least_m, x0, y0, x1, y1 FROM contacts")
def e2(spark, d):
    return contacts(spark, d).drop("start_t", "stop_t")


@query("w1_pass_pairs", FRAMES + "SELECT match, start_frame, next_start_frame, player, next_player, round(gap, 6) AS gap, reason, pass_type FROM passes")
def w1(spark, d):
    x = P.pass_pairs(contacts(spark, d), ["match"], "start_t", "stop_t", "start_frame")
    return x.select("match", "start_frame", "next_start_frame", "player", "next_player", F.round("gap", 6).alias("gap"), "reason", "pass_type")


@query("a9_pass_counts", FRAMES + """, c AS (SELECT match, team, count(*) AS pairs, count(*) FILTER (pass_type = 'same_team_pass') AS completed,
  count(*) FILTER (pass_type = 'turnover_or_interception') AS failed, count(*) FILTER (reason IS NOT NULL) AS skipped FROM passes GROUP BY match, team)
SELECT *, round(CASE WHEN completed + failed > 0 THEN completed / (completed + failed) END, 4) AS accuracy FROM c""")
def a9(spark, d):
    x = P.pass_pairs(contacts(spark, d), ["match"], "start_t", "stop_t", "start_frame")
    n = lambda c: F.count(F.when(c, 1))
    x = x.groupBy("match", "team").agg(F.count(F.lit(1)).alias("pairs"), n(F.col("pass_type") == "same_team_pass").alias("completed"), n(F.col("pass_type") == "turnover_or_interception").alias("failed"), n(F.col("reason").isNotNull()).alias("skipped"))
    return x.withColumn("accuracy", F.round(F.try_divide(F.col("completed"), F.col("completed") + F.col("failed")), 4))


@query("w10_running_counts", FRAMES + """SELECT match, f, count(*) FILTER (team = 'A') OVER w AS "n_A", count(*) FILTER (team = 'B') OVER w AS "n_B", count(*) FILTER (team IS NULL) OVER w AS n_skipped
FROM frames WINDOW w AS (PARTITION BY match ORDER BY f)""")
def w10(spark, d):
    return P.running_counts(frames(spark, d), ["match"], "f", "team", ["A", "B"]).select("match", "f", "n_A", "n_B", "n_skipped")


@query("j11_gap_path", FRAMES + """, g AS (SELECT * FROM paired WHERE next_start_frame IS NOT NULL AND next_start_frame - start_frame <= 150)
SELECT g.match, g.start_frame, count(*) AS frames, count(*) FILTER (b.status = 'free') AS free, round(avg(b.bx), 6) AS mean_x
FROM g JOIN frames b ON g.match = b.match AND b.f BETWEEN g.start_frame AND g.next_start_frame GROUP BY ALL""")
def j11(spark, d):
    x = P.pass_pairs(contacts(spark, d), ["match"], "start_t", "stop_t", "start_frame").select("match", "start_frame", "next_start_frame").where("next_start_frame - start_frame <= 150")
    y = R.points_in(frames(spark, d).select("match", "f", "status", "bx"), x, ["match"], "f", "start_frame", "next_start_frame", 50)
    return y.groupBy("match", "start_frame").agg(F.count(F.lit(1)).alias("frames"), F.count(F.when(F.col("status") == "free", 1)).alias("free"), F.round(F.avg("bx"), 6).alias("mean_x"))


@query("j5_frame_segments", FRAMES + "SELECT b.match, b.f, s.start_frame FROM frames b JOIN segments s ON b.match = s.match AND b.f BETWEEN s.start_frame AND s.stop_frame WHERE s.status = 'controlled'")
def j5(spark, d):
    s = segments(spark, d).where("status = 'controlled'").select("match", "start_frame", "stop_frame")
    return R.points_in(frames(spark, d).select("match", "f"), s, ["match"], "f", "start_frame", "stop_frame", 30).select("match", "f", "start_frame")


@query("j6_events_after", EVENTS + " SELECT a.event_id, count(*) AS n, round(avg(b.value), 6) AS mean FROM e a JOIN e b ON a.user_id = b.user_id AND b.event_type = 'view' AND b.t BETWEEN a.t AND a.t + 86400 WHERE a.event_type = 'purchase' GROUP BY a.event_id")
def j6(spark, d):
    e = events(spark, d)
    spans = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("t").alias("from_"), (F.col("t") + DAY).alias("to_"))
    x = R.points_in(e.where("event_type = 'view'").select("user_id", "t", "value"), spans, ["user_id"], "t", "from_", "to_", DAY)
    return x.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


SPANS = "WITH i AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) / 1e6 AS start, max(epoch_us(l_shipdate)) / 1e6 AS stop FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"


def spans(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", S.seconds("o_orderdate").alias("start"))
    last = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max(S.seconds("l_shipdate")).alias("stop"))
    return o.join(last, "l_orderkey").select("o_custkey", F.col("l_orderkey").alias("o_orderkey"), "start", "stop")


@query("j20_overlap_anti", SPANS + " SELECT o_custkey, o_orderkey FROM i a WHERE start < stop AND NOT EXISTS (SELECT 1 FROM i b WHERE a.o_custkey = b.o_custkey AND a.o_orderkey != b.o_orderkey AND b.start < b.stop AND a.start < b.stop AND b.start < a.stop)")
def j20(spark, d):
    x = spans(spark, d).where("start < stop")
    taken = R.overlaps(x, x, ["o_custkey"], "start", "stop", 60 * DAY).where("o_orderkey != other_o_orderkey").select("o_orderkey").distinct()
    return x.join(taken, "o_orderkey", "left_anti").select("o_custkey", "o_orderkey")


@query("j16_gap_candidates", SPANS + """, p AS (SELECT a.o_custkey, b.o_orderkey, a.o_orderkey AS prior, b.start - a.stop AS gap FROM i a JOIN i b ON a.o_custkey = b.o_custkey AND a.o_orderkey != b.o_orderkey AND b.start BETWEEN a.stop + 86400 AND a.stop + 15552000)
SELECT o_custkey, o_orderkey, prior, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderkey ORDER BY gap, prior) AS rank FROM p) WHERE rank <= 5""")
def j16(spark, d):
    x = spans(spark, d)
    prior = x.select("o_custkey", F.col("o_orderkey").alias("prior"), (F.col("stop") + DAY).alias("from_"), (F.col("stop") + 180 * DAY).alias("to_"), F.col("stop").alias("prior_stop"))
    y = R.points_in(x.select("o_custkey", "o_orderkey", "start"), prior, ["o_custkey"], "start", "from_", "to_", 180 * DAY).where("prior != o_orderkey")
    return A.top_per_group(y.withColumn("gap", F.col("start") - F.col("prior_stop")), ["o_custkey", "o_orderkey"], ["gap", "prior"], 5).select("o_custkey", "o_orderkey", "prior", "rank")


@query("a36_unique_fraction", SPANS + """SELECT o_custkey, o_orderkey, round(CASE WHEN stop != start THEN greatest(0, stop - greatest(start, before)) / (stop - start) END, 6) AS unique_fraction FROM
(SELECT *, coalesce(max(stop) OVER (PARTITION BY o_custkey ORDER BY start, stop, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start) AS before FROM i)""")
def a36(spark, d):
    return R.unique_fraction(spans(spark, d), ["o_custkey"], "start", "stop", "o_orderkey").select("o_custkey", "o_orderkey", F.round("unique_fraction", 6).alias("unique_fraction"))


@query("w7_moving_average", EVENTS + " SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM e")
def w7(spark, d):
    return M.moving_average(events(spark, d), ["user_id"], "t", "event_id", "value", 2, 2).select("event_id", F.round("smooth", 6).alias("smooth"))


@query("w22_trailing_mean", EVENTS + " SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 44 PRECEDING AND CURRENT ROW), 8) AS smooth FROM e")
def w22(spark, d):
    return M.moving_average(events(spark, d), ["user_id"], "t", "event_id", "value", 44, 0).select("event_id", F.round("smooth", 8).alias("smooth"))


@query("w8_ema", EVENTS + """, m AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) >= 172800 THEN 1 ELSE 0 END AS s FROM e)),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY t, event_id) AS i FROM m)
SELECT a.event_id, round(sum(b.value * power(2.0 / 3, a.i - b.i) * CASE WHEN b.i = 1 THEN 1 ELSE 1.0 / 3 END), 6) AS ema FROM n a JOIN n b ON a.user_id = b.user_id AND a.run = b.run AND b.i <= a.i GROUP BY a.event_id""")
def w8(spark, d):
    return M.ema(events(spark, d), ["user_id"], "t", "event_id", "value", 5, 2 * DAY).select("event_id", F.round("ema", 6).alias("ema"))


@query("w9_cumulative", EVENTS + """, c AS (SELECT event_id, CAST(sum(CAST(value AS DECIMAL(28,2))) OVER (PARTITION BY user_id ORDER BY t, event_id) AS DOUBLE) AS so_far, CAST(sum(CAST(value AS DECIMAL(28,2))) OVER (PARTITION BY user_id) AS DOUBLE) AS total FROM e)
SELECT event_id, so_far, round(so_far / total, 6) AS share FROM c""")
def w9(spark, d):
    return M.cumulative_share(events(spark, d), ["user_id"], "t", "event_id", F.col("value")).select("event_id", "so_far", F.round("share", 6).alias("share"))


@query("w11_speed_ahead", EVENTS + """, g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM (SELECT *, CASE WHEN t - lag(t) OVER w > 43200 OR abs(value - lag(value) OVER w) / greatest(t - lag(t) OVER w, 0.001) > 0.005 THEN 1 ELSE 0 END AS s FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)))
SELECT a.event_id, round(max(abs(b.value - a.value) / (b.t - a.t)), 9) AS top FROM g a JOIN g b ON a.user_id = b.user_id AND a.run = b.run AND b.t BETWEEN a.t + 3600 AND a.t + 86400 AND abs(b.value - a.value) / (b.t - a.t) <= 0.005 GROUP BY a.event_id""")
def w11(spark, d):
    return M.speed_ahead(events(spark, d), ["user_id"], "t", "event_id", "value", 3600.0, DAY, DAY / 2, 0.005).select("event_id", F.round("top", 9).alias("top"))


@query("w23_speed_behind", EVENTS + " SELECT a.event_id, round(arg_max(abs(b.value - a.value) / (a.t - b.t), (b.t, b.event_id)), 9) AS speed FROM e a JOIN e b ON a.user_id = b.user_id AND b.t BETWEEN a.t - 86400 AND a.t - 3600 AND abs(b.value - a.value) / (a.t - b.t) <= 0.002 GROUP BY a.event_id")
def w23(spark, d):
    return M.speed_behind(events(spark, d), ["user_id"], "t", "event_id", "value", 3600.0, DAY, 0.002).select("event_id", F.round("speed", 9).alias("speed"))


@query("w26_three_taps", EVENTS + """, x AS (SELECT *, event_type != 'error' AS ok FROM e), y AS (SELECT event_id, value, ok, CASE WHEN lag(ok) OVER w THEN 0.25::DOUBLE ELSE 0 END AS a, CASE WHEN lead(ok) OVER w THEN 0.25::DOUBLE ELSE 0 END AS c,
coalesce(lag(value) OVER w, 0) AS before, coalesce(lead(value) OVER w, 0) AS after FROM x WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, round(CASE WHEN ok THEN (before * a + value * 0.5::DOUBLE + after * c) / (a + 0.5::DOUBLE + c) ELSE value END, 6) AS smooth FROM y""")
def w26(spark, d):
    return M.kernel(events(spark, d), ["user_id"], "t", "event_id", "value", F.col("event_type") != "error").select("event_id", F.round("smooth", 6).alias("smooth"))


@query("w18_gap_islands", EVENTS + """, m AS (SELECT *, CASE WHEN t - lag(t) OVER w > 43200 THEN 1 ELSE 0 END AS a, CASE WHEN t - lag(t) OVER w > 86400 THEN 1 ELSE 0 END AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, CAST(1 + sum(a) AS BIGINT) AS half_day, CAST(1 + sum(b) AS BIGINT) AS day FROM m GROUP BY user_id""")
def w18(spark, d):
    x = events(spark, d)
    n = lambda gap, name: S.sessionize(x, ["user_id"], "t", "event_id", gap).groupBy("user_id").agg((F.max("session") + 1).alias(name))
    return n(DAY / 2, "half_day").join(n(DAY, "day"), "user_id")


@query("w21_moves", EVENTS + """, s AS (SELECT user_id, abs(value - lag(value) OVER w) AS far, t - lag(t) OVER w AS dt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, count(*) FILTER (far > 0.01 AND dt > 0 AND far / dt <= 0.01 AND dt <= 86400) AS moves FROM s GROUP BY user_id""")
def w21(spark, d):
    w = S.ordered(["user_id"], "t", "event_id")
    x = events(spark, d).select("user_id", F.abs(F.col("value") - F.lag("value").over(w)).alias("far"), (F.col("t") - F.lag("t").over(w)).alias("dt"))
    return x.groupBy("user_id").agg(F.count(F.when((F.col("far") > 0.01) & (F.col("dt") > 0) & (F.try_divide("far", "dt") <= 0.01) & (F.col("dt") <= DAY), 1)).alias("moves"))


@query("w24_ranks", "SELECT s_suppkey, CAST(rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS INTEGER) AS in_nation, CAST(dense_rank() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 1000)) AS INTEGER) AS band FROM supplier")
def w24(spark, d):
    x = table(spark, d, "supplier").withColumn("thousand", F.floor(F.col("s_acctbal") / 1000))
    return x.select("s_suppkey", F.rank().over(S.ordered(["s_nationkey"], "s_acctbal")).alias("in_nation"), F.dense_rank().over(S.ordered(["s_nationkey"], "thousand")).alias("band"))


@query("a6_cross_match", """SELECT c_nationkey, c_mktsegment, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(28,2))) AS DOUBLE) AS total, max(c_acctbal) AS most,
array_to_string(list_sort(list(DISTINCT c_custkey % 5)), ',') AS kinds FROM customer GROUP BY ALL""")
def a6(spark, d):
    x = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment")
    kinds = F.array_join(F.transform(F.array_sort(F.collect_set(F.col("c_custkey") % 5)), lambda k: k.cast("string")), ",")
    return x.agg(F.count(F.lit(1)).alias("n"), A.exact_sum("c_acctbal").alias("total"), F.max("c_acctbal").alias("most"), kinds.alias("kinds"))


@query("a7_career", """SELECT l_suppkey, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(28,2))) AS DOUBLE) AS distance, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(28,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(28,2))) AS DOUBLE), 6) AS mean_speed,
CASE max(CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END) WHEN 2 THEN 'poor' WHEN 1 THEN 'fair' ELSE 'good' END AS worst FROM lineitem GROUP BY l_suppkey""")
def a7(spark, d):
    rank = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    x = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), A.exact_sum("l_extendedprice").alias("distance"), A.exact_sum("l_quantity").alias("time"), F.max(rank).alias("rank"))
    worst = F.when(F.col("rank") == 2, "poor").when(F.col("rank") == 1, "fair").otherwise("good")
    return x.select("l_suppkey", "n", "distance", F.round(F.try_divide("distance", "time"), 6).alias("mean_speed"), worst.alias("worst"))


@query("a8_best", "SELECT l_suppkey, r.p AS price, r.q AS quantity, r.o AS orderkey FROM (SELECT l_suppkey, max({'p': l_extendedprice, 'q': l_quantity, 'o': l_orderkey}) AS r FROM lineitem GROUP BY l_suppkey)")
def a8(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.max(F.struct("l_extendedprice", "l_quantity", "l_orderkey")).alias("r"))
    return x.select("l_suppkey", F.col("r.l_extendedprice").alias("price"), F.col("r.l_quantity").alias("quantity"), F.col("r.l_orderkey").alias("orderkey"))


@query("a10_tallies", "SELECT c_nationkey, count(*) AS n, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, count(*) FILTER (c_mktsegment = 'MACHINERY') AS machinery, count(*) FILTER (c_mktsegment = 'NONE') AS none FROM customer GROUP BY c_nationkey")
def a10(spark, d):
    x = table(spark, d, "customer").withColumn("status", F.lower("c_mktsegment"))
    return U.shares(x, ["c_nationkey"], "status", ["building", "machinery", "none"], "n")


@query("a11_shape", FRAMES + """SELECT f, count(*) AS n, max(x) - min(x) AS width, max(y) - min(y) AS depth, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(sqrt((x - mx) * (x - mx) + (y - my) * (y - my))), 6) AS compactness
FROM (SELECT *, avg(x) OVER (PARTITION BY f) AS mx, avg(y) OVER (PARTITION BY f) AS my FROM players) GROUP BY f HAVING count(*) BETWEEN 3 AND 7""")
def a11(spark, d):
    x = U.shape(players(spark, d), ["f"], "x", "y", 3, 7)
    return x.withColumns({c: F.round(c, 6) for c in ("cx", "cy", "compactness")})


@query("a13_minutes", FRAMES + "SELECT match, CAST(floor(t / 2) AS BIGINT) AS bucket, count(first_m) AS n, round(CASE WHEN count(first_m) >= 30 THEN avg(first_m) END, 6) AS mean FROM frames GROUP BY ALL")
def a13(spark, d):
    return U.covered_means(frames(spark, d), ["match"], "t", "first_m", 2.0, 60, 0.5).withColumn("mean", F.round("mean", 6))


@query("a15_median_step", EVENTS + ", s AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS step FROM (SELECT DISTINCT user_id, t FROM e)) SELECT user_id, round(median(step), 6) AS step FROM s WHERE step > 0 GROUP BY user_id")
def a15(spark, d):
    return U.median_step(events(spark, d), ["user_id"], "t").withColumn("step", F.round("step", 6))


@query("a16_dense_counts", FRAMES + ", n AS (SELECT f, count(*) AS n FROM players GROUP BY f) SELECT CAST(r.f AS BIGINT) AS f, coalesce(n.n, 0) AS n, greatest(0, 14 - coalesce(n.n, 0)) AS missing FROM range((SELECT max(f) + 1 FROM players)) r(f) LEFT JOIN n ON r.f = n.f")
def a16(spark, d):
    return U.dense_counts(players(spark, d), "f").withColumn("missing", F.greatest(F.lit(0).cast("long"), F.lit(14) - F.col("n")))


@query("a17_team_counts", FRAMES + "SELECT f, team, count(*) AS n, count(*) > 1 AS over FROM players GROUP BY f, team")
def a17(spark, d):
    return players(spark, d).groupBy("f", "team").agg(F.count(F.lit(1)).alias("n")).withColumn("over", F.col("n") > 1)


@query("a22_scale", EVENTS + " SELECT user_id, round(greatest(0.15, coalesce(quantile_cont(abs(value), 0.95), 0)), 6) AS scale FROM e WHERE value != 0 GROUP BY user_id")
def a22(spark, d):
    x = events(spark, d).where("value != 0").groupBy("user_id").agg(F.percentile(F.abs("value"), 0.95).alias("p"))
    return x.select("user_id", F.round(F.greatest(F.lit(0.15), F.coalesce("p", F.lit(0.0))), 6).alias("scale"))


@query("a23_mode", EVENTS + ", c AS (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY ALL) SELECT user_id, max({'n': n, 'k': event_type}).k AS mode FROM c GROUP BY user_id")
def a23(spark, d):
    x = events(spark, d).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return x.groupBy("user_id").agg(F.max(F.struct("n", "event_type"))["event_type"].alias("mode"))


@query("a24_percentiles", EVENTS + " SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM e GROUP BY event_type")
def a24(spark, d):
    return events(spark, d).groupBy("event_type").agg(*[F.round(F.percentile("value", p / 100), 6).alias(f"p{p}") for p in (10, 50, 90)])


@query("a25_channel_medians", "SELECT label, CAST(i AS INTEGER) AS i, round(median(x::DOUBLE), 6) AS median FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL")
def a25(spark, d):
    x = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return x.groupBy("label", "i").agg(F.round(F.median(F.col("x").cast("double")), 6).alias("median"))


MEDOID = """WITH u AS (SELECT vec_id // 20 AS g, vec_id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
p AS (SELECT a.g, a.vec_id, round(1 - greatest(-1, least(1, list_inner_product(a.v, b.v) / (a.n * b.n))), 6) AS d FROM u a JOIN u b ON a.g = b.g AND a.vec_id != b.vec_id),
m AS (SELECT g, vec_id, median(d) AS spread FROM p GROUP BY ALL)
SELECT g, min({'s': spread, 'i': vec_id}).i AS vec_id, round(min(spread), 6) AS dispersion FROM m GROUP BY g"""


@query("a26_medoid", MEDOID)
def a26(spark, d):
    x = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("g"), "vec_id", "embedding")
    return U.medoids(x, "g", "vec_id", "embedding").withColumn("dispersion", F.round("dispersion", 6))


@query("a27_distinct_first", EVENTS + " SELECT event_type, count(*) AS n FROM (SELECT event_type, row_number() OVER (PARTITION BY user_id, CAST(floor(t / 86400) AS BIGINT) ORDER BY t, event_id) AS r FROM e) WHERE r = 1 GROUP BY event_type")
def a27(spark, d):
    x = events(spark, d).withColumn("day", F.floor(F.col("t") / DAY).cast("long"))
    return A.top_per_group(x, ["user_id", "day"], ["t", "event_id"], 1).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("a29_largest_gap", EVENTS + ", g AS (SELECT user_id, event_type, t - lag(t) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS gap FROM e), m AS (SELECT user_id, event_type, count(*) AS n, max(gap) AS gap FROM g GROUP BY ALL) SELECT user_id, CAST(sum(n) AS BIGINT) AS n, max(n) AS most, round(max(gap), 6) AS gap FROM m GROUP BY user_id")
def a29(spark, d):
    x = events(spark, d).withColumn("gap", F.col("t") - F.lag("t").over(S.ordered(["user_id", "event_type"], "t", "event_id")))
    x = x.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("gap"))
    return x.groupBy("user_id").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.round(F.max("gap"), 6).alias("gap"))


@query("a31_switches", EVENTS + " SELECT user_id, count(*) FILTER (k != before) AS switches, count(DISTINCT k) AS states FROM (SELECT user_id, event_type AS k, lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS before FROM e) GROUP BY user_id")
def a31(spark, d):
    return U.switches(events(spark, d), ["user_id"], "t", "event_id", "event_type")


@query("a33_tracks", EVENTS + " SELECT user_id, min(t) AS first_t, max(t) AS last_t, max(t) - min(t) AS seconds, count(*) AS n, round(avg(value), 6) AS mean FROM e GROUP BY user_id")
def a33(spark, d):
    x = events(spark, d).groupBy("user_id").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return x.withColumn("seconds", F.col("last_t") - F.col("first_t"))


@query("a37_possession_shares", FRAMES + """, c AS (SELECT match, team, count(*) AS n FROM frames WHERE team IS NOT NULL GROUP BY ALL) SELECT match, team, n, round(n / sum(n) OVER (PARTITION BY match), 4) AS share FROM c""")
def a37(spark, d):
    x = frames(spark, d).where("team is not null").groupBy("match", "team").agg(F.count(F.lit(1)).alias("n"))
    total = x.groupBy("match").agg(F.sum("n").alias("all"))
    return x.join(total, "match").select("match", "team", "n", F.round(F.col("n") / F.col("all"), 4).alias("share"))


@query("a38_tracklets", EVENTS + """, g AS (SELECT user_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM e), m AS (SELECT user_id, count(*) AS n, max(t) - min(t) AS seconds, sum(CASE WHEN gap IS NOT NULL THEN greatest(0, floor(gap / 86400) - 1) END) AS missing FROM g GROUP BY user_id)
SELECT user_id % 3 AS team, count(*) AS tracks, CAST(sum(n) AS BIGINT) AS positions, CAST(sum(missing) AS BIGINT) AS missing, round(avg(seconds), 3) AS mean_s, round(median(seconds), 3) AS median_s FROM m GROUP BY user_id % 3""")
def a38(spark, d):
    gap = F.col("t") - F.lag("t").over(S.ordered(["user_id"], "t", "event_id"))
    x = events(spark, d).withColumn("hole", F.when(gap.isNotNull(), F.greatest(F.lit(0), F.floor(gap / DAY) - 1)))
    m = x.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).alias("seconds"), F.sum("hole").alias("missing"))
    return m.groupBy((F.col("user_id") % 3).alias("team")).agg(F.count(F.lit(1)).alias("tracks"), F.sum("n").alias("positions"), F.sum("missing").cast("long").alias("missing"), F.round(F.avg("seconds"), 3).alias("mean_s"), F.round(F.median("seconds"), 3).alias("median_s"))

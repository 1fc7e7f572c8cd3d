"""Queries of tracking, assignment, the ball's path, restarts, coverage, views, timelines and presence.

events are the detections: a type is a match, ten minutes are a frame, value and user are the place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactigrid.operators import assignment, ballpath, coverage, lineage, linking, momentum, presence, resolved, restarts, selection, teams, timeline, tracker
from tactigrid.operators import possession as P
from tactigrid.operators import sequence as S
from tactigrid.operators.components import components
from tactigrid.plans.registry import query
from tactigrid.sources.tables import shared_dir, table

START = 1_704_067_200  # 2024-01-01 UTC


def events(spark: SparkSession, d: str, seconds: int) -> DataFrame:
    e = table(spark, d, "events").withColumn("t", S.seconds("ts"))
    return e.withColumn("frame", F.floor((F.col("t") - START) / seconds).cast("long"))


def detections(e: DataFrame) -> DataFrame:
    return e.select(F.col("event_type").alias("match"), "frame", F.col("event_id").alias("id"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"))


@query("t6_tracker")
def t6(spark, d):
    """J24 and T6 as a batch: greedy nearest assignment of detections to live tracks."""
    return tracker.track(detections(events(spark, d, 600)), ["match"], "frame", "id", "x", "y")


@query("t2_tracker_stream")
def t2(spark, d):
    """The same as a stream over the file (a pattern names it, for a stream's path is a folder or a pattern), with late and repeated rows marked; the stream ends when the file is read."""
    raw = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")
    raw = raw.withColumn("frame", F.floor((S.seconds("ts") - START) / 600).cast("long"))
    out = tracker.track_stream(detections(raw), ["match"], "frame", "id", "x", "y")
    folder = f"{shared_dir(spark)}/tracker-{uuid.uuid4().hex}"
    out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")


def slot_pairs(spark, d):
    """Views as slots and clicks as observations of the same half-hour and fifty users, with what it costs to assign them."""
    e = events(spark, d, 1800).withColumn("cohort", F.floor(F.col("user_id") / 50).cast("long"))
    s = e.where("event_type = 'view'").select("frame", "cohort", F.col("event_id").alias("slot"), F.col("value").alias("v"), F.col("t").alias("s_t"), F.col("user_id").alias("u"))
    o = e.where("event_type = 'click'").select("frame", "cohort", F.col("event_id").alias("obs"), "value", "t", "user_id")
    x = s.join(o, ["frame", "cohort"])
    c = assignment.cost(F.abs(F.col("value") - F.col("v")) / 10, F.abs(F.col("t") - F.col("s_t")) / 600, F.lit(0.9), F.col("u") % 2 != F.col("user_id") % 2, F.lit(False), F.col("u") == F.col("user_id"), F.lit(False))
    return x.select("frame", "cohort", "slot", "obs", c.alias("cost"))


@query("j22_assignment")
def j22(spark, d):
    """The least-cost one-to-one assignment of each frame."""
    return assignment.assigned(slot_pairs(spark, d), ["frame", "cohort"], "slot", "obs", "cost")


def tracklets(spark, d):
    """Runs of a user's events at most six hours apart: id, user, start, stop, first and last value."""
    x = S.sessionize(events(spark, d, 600), ["user_id"], "t", "event_id", 6 * 3600.0)
    at = lambda f: f(F.struct("t", "event_id", "value"))["value"]
    return x.groupBy("user_id", "session").agg(F.min("event_id").alias("id"), F.min("t").alias("start"), F.max("t").alias("stop"), at(F.min).alias("v0"), at(F.max).alias("v1"))


@query("g4_components", """WITH e AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events),
s AS (SELECT *, sum(n) OVER w AS session, sum(m) OVER w AS chain FROM (SELECT *, CASE WHEN t - lag(t) OVER w > 21600 THEN 1 ELSE 0 END AS n, CASE WHEN t - lag(t) OVER w > 86400 THEN 1 ELSE 0 END AS m FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
f AS (SELECT user_id, chain, session, min(event_id) AS node FROM s GROUP BY ALL)
SELECT node, component FROM (SELECT node, min(node) OVER w AS component, count(*) OVER w AS n FROM f WINDOW w AS (PARTITION BY user_id, chain)) WHERE n > 1""")
def g4(spark, d):
    """Tracklets of a user that a gap of at most a day joins."""
    w = S.ordered(["user_id"], "start", "id")
    edges = tracklets(spark, d).select(F.col("id").alias("a"), F.lead("id").over(w).alias("b"), (F.lead("start").over(w) - F.col("stop")).alias("gap"))
    return components(edges.where("gap <= 86400").select("a", "b"))


def links(spark, d):
    """Candidate links of tracklets of eight users: the end of one to a start within six hours after, with a cost."""
    x = tracklets(spark, d).withColumn("cohort", F.floor(F.col("user_id") / 8).cast("long"))
    a = x.select("cohort", F.col("id").alias("source"), F.col("stop").alias("t0"), F.col("v1").alias("a"), F.explode(F.array(F.floor(F.col("stop") / 21600), F.floor(F.col("stop") / 21600) + 1)).alias("block"))
    b = x.select("cohort", F.col("id").alias("target"), F.col("start").alias("t1"), F.col("v0").alias("b"), F.floor(F.col("start") / 21600).alias("block"))
    x = a.join(b, ["cohort", "block"]).where("t1 > t0 and t1 - t0 <= 21600")
    cost = F.round(0.4 * (F.col("t1") - F.col("t0")) / 21600 + F.abs(F.col("a") - F.col("b")) / 100, 6)
    return x.select("source", "target", cost.alias("cost"), F.concat_ws(">", "source", "target").alias("key"))


@query("g3_matching")
def g3(spark, d):
    """The links of least cost in each connected component, each against 0.75 for none."""
    return assignment.linked(links(spark, d), "source", "target", "cost", "key").drop("component")


def fragments(spark, d):
    """tracklets() of eight users as those of a match: an hour is a second, values and users are places."""
    x = tracklets(spark, d)
    return x.select(
        F.floor(F.col("user_id") / 8).cast("long").alias("match"), "id", ((F.col("start") - START) / 3600).alias("start"), ((F.col("stop") - START) / 3600).alias("stop"), (F.col("v0") / 20).alias("x0"), (F.col("user_id") % 8).cast("double").alias("y0"),
        (F.col("v1") / 20).alias("x1"), (F.col("user_id") % 8).cast("double").alias("y1"), F.element_at(F.array(*map(F.lit, "ABU")), (F.col("id") % 3 + 1).cast("int")).alias("team"), *[(F.col("id") * k % 256).cast("double").alias(c) for k, c in ((1, "red"), (7, "green"), (13, "blue"))],
    )


@query("j23_chains")
def j23(spark, d):
    """Tracklets chained to players in order of time."""
    return linking.chained(fragments(spark, d), ["match"])


@query("g6_accepted_links")
def g6(spark, d):
    """Candidate links accepted in order of cost under the constraints of chains."""
    t = fragments(spark, d).select("id", "start", "stop", "team")
    return linking.accepted(links(spark, d), t, gap=6.0).select("key", "reason")


@query("k5_diverse_frames")
def k5(spark, d):
    """K5: each match's most useful frames of ten minutes, apart from each other."""
    e = events(spark, d, 600)
    x = e.groupBy(F.col("event_type").alias("match"), "frame").agg((F.max("event_id") % 100 / 100).alias("quality"), (F.max("user_id") % 5).alias("domain"), F.collect_set("user_id").alias("subjects"))
    return selection.diverse(x.withColumn("t", F.col("frame") * 600.0), ["match"], 30 * 86400.0, 40, 7200.0, 0.3)


@query("k6_spaced_sample")
def k6(spark, d):
    """K6: a seeded sample of each match's frames, a day's eighth apart."""
    return selection.spaced_sample(events(spark, d, 600).select(F.col("event_type").alias("match"), "frame"), ["match"], 100, 18, "review")


def candidates(spark, d):
    e = events(spark, d, 600)
    return e.select(F.col("event_type").alias("match"), "frame", F.col("event_id").alias("id"), (F.col("value") / 10).alias("x"), (F.col("user_id") % 30).cast("double").alias("y"), (F.col("event_id") % 100 / 100).alias("confidence"))


@query("w19_ball_path")
def w19(spark, d):
    """One candidate a frame, by speed gate and look-ahead."""
    return ballpath.select_path(candidates(spark, d), ["match"], "frame", "id", "x", "y", "confidence", fps=4.0)


@query("j26_covered_ball")
def j26(spark, d):
    """The path without unsure detections inside another detection's box."""
    c = candidates(spark, d)
    path = ballpath.select_path(c, ["match"], "frame", "id", "x", "y", "confidence", fps=4.0)
    balls = path.join(c, ["match", "frame", "id"])
    boxes = c.select("match", "frame", (F.col("x") - 2).alias("x1"), (F.col("y") - 4).alias("y1"), (F.col("x") + 2).alias("x2"), (F.col("y") + 4).alias("y2"), F.col("id").alias("player"))
    hit = ballpath.covering_box(balls, boxes, ["match", "frame"], "id", "x", "y")
    return ballpath.without_covered(hit, ["match"], "frame", "id", "x", "y", "confidence", F.col("box.player") != F.col("id"), fps=4.0, reason="reason")


def still_ball(spark, d):
    """Orders as frames of a ball that rests for twelve frames and then moves on, also outside the pitch or unseen."""
    k, block = F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 12)
    x = (block * 7 % 13) * 2.5 + F.col("o_custkey") % 3 * 0.005
    y = (block * 5 % 20) * 2.5 - 0.1
    seen = (F.col("o_custkey") % 17) != 0
    o = table(spark, d, "orders")
    return o.select(
        F.floor(k / 3000).cast("long").alias("match"), k.alias("frame"), (k / 30.0).alias("t"), F.when(seen, x).alias("x"), F.when(seen, y).alias("y"),
        (F.col("o_custkey") % 10 / 10).alias("confidence"), (F.col("o_orderstatus") == "F").alias("detected"),
    )


def pitch_players(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("frame"), (F.col("l_suppkey") % 4).alias("player"))
    x = x.agg((F.min("l_quantity") % 30).alias("x"), (F.min("l_partkey") % 48).cast("double").alias("y"))
    return x.withColumn("team", F.when(F.col("player") < 2, "A").otherwise("B"))


@query("w17_static_windows")
def w17(spark, d):
    """Where the ball lies still at a boundary."""
    return restarts.static_windows(still_ball(spark, d), ["match"], 30.0, 47.4)


@query("e6_restarts")
def e6(spark, d):
    """E6 with J8 to J10: restarts, each of which uses up the frames to its receiver."""
    ball = still_ball(spark, d)
    near = ball.select("match", "frame", F.col("x").alias("bx"), F.col("y").alias("by"), "confidence")
    players = pitch_players(spark, d).withColumn("match", F.floor(F.col("frame") / 3000).cast("long"))
    held = P.possession(P.nearest_players(near, players, ["match", "frame"]))
    return restarts.restarts(ball, held, players, ["match"], 30.0, 47.4)


def pressed(spark, d):
    """Minutes of a day are seconds of a match of eight users' events: purchases and clicks are control by a team, views passes, signups restarts."""
    e = table(spark, d, "events").withColumn("s", (S.seconds("ts") - START) / 60)
    e = e.withColumn("match", F.concat_ws("/", F.floor(F.col("user_id") / 8), F.floor(F.col("s") / 1440))).withColumn("t", F.col("s") % 1440)
    team, sure = F.when(F.col("user_id") % 2 == 0, "A").otherwise("B"), F.col("event_id") % 100 / 100
    e = e.withColumn("team", team).withColumn("confidence", sure)
    status = F.when(F.col("event_type").isin("purchase", "click"), "controlled").when(F.col("event_type") == "error", "unknown").otherwise("free")
    period, late = F.when(F.col("t") < 720, "first").otherwise("second"), F.col("t") >= 720
    up = F.when((F.col("team") == "A") != late, "towards_y_max").otherwise("towards_y_min")
    frames = e.select("match", F.col("event_id").alias("frame"), "t", status.alias("status"), "team", period.alias("period"), up.alias("direction"), "confidence", (F.col("value") / 10).alias("bx"), F.when(F.col("event_id") % 11 > 0, F.col("event_id") * 7 % 50).cast("double").alias("by"))
    review = F.element_at(F.array(*[F.lit(x) for x in momentum.PASS_REVIEW]), (F.col("event_id") % 4 + 1).cast("int"))
    passes = e.where("event_type = 'view'").select("match", "t", "team", F.when(F.col("event_id") % 3 == 0, "failed_pass").otherwise("completed_pass").alias("outcome"), review.alias("review_status"), "confidence", (F.col("value") / 10 - 4).alias("forward_m"), F.when(F.col("event_id") % 5 == 0, F.col("event_id") - 1).alias("restart"))
    restarts_ = e.where("event_type = 'signup'").select("match", F.col("event_id").alias("restart"), "t", "team", F.lit("corner").alias("restart_type"), review.alias("review_status"), "confidence")
    return frames, passes, restarts_, e.select("match", F.lit(1440.0).alias("duration")).distinct()


@query("e7_momentum")
def e7(spark, d):
    """E7 with A21 and W8: bins of pressure, smoothed, scored within each match."""
    x = momentum.momentum(*pressed(spark, d), ["match"], 30.0, 50.0)
    return x.withColumns({c: F.round(c, 6) for c in ("a_raw", "b_raw", "signed", "confidence", "smooth", "score")})


BINS = """WITH e AS (SELECT *, (epoch_us(ts) / 1e6 - 1704067200) / 60 AS s FROM events),
m AS (SELECT *, (user_id // 8) || '/' || CAST(floor(s / 1440) AS BIGINT) AS match, s % 1440 AS t, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS team, event_id % 100 / 100.0 AS c FROM e),
f AS (SELECT match, t, CAST(least(287, floor(t / 5)) AS INTEGER) AS bin, event_type IN ('purchase', 'click') AS held, team FROM m),
every AS (SELECT match, CAST(unnest(range(288)) AS INTEGER) AS bin FROM (SELECT DISTINCT match FROM m)),
n AS (SELECT match, bin, count(*) AS samples, count(*) FILTER (held AND team = 'A') AS a_samples, count(*) FILTER (held AND team = 'B') AS b_samples, max(CASE WHEN held THEN CASE WHEN t < 720 THEN 'first' ELSE 'second' END END) AS period FROM f GROUP BY ALL)
SELECT every.match, every.bin, coalesce(samples, 0) AS samples, coalesce(a_samples, 0) AS a_samples, coalesce(b_samples, 0) AS b_samples, period FROM every LEFT JOIN n ON every.match = n.match AND every.bin = n.bin"""


@query("a21_bins", BINS)
def a21(spark, d):
    """The bins' samples and control, empty bins too."""
    frames, passes, r, matches = pressed(spark, d)
    x = momentum.bins(momentum.pressure(frames, ["match"], 30.0, 50.0), momentum.event_bonuses(passes, r, ["match"]), matches, ["match"])
    return x.select("match", "bin", "samples", "a_samples", "b_samples", "period")


@query("k4_greedy_coverage")
def k4(spark, d):
    """K4: users ranked by the hours and types that they add to what the users before cover."""
    e = events(spark, d, 3600).withColumn("team", (F.col("user_id") % 8).cast("long"))
    units = e.groupBy("team", "user_id").agg((F.count(F.lit(1)) / 30).alias("detected_sec"), F.min("frame").alias("start_frame"))
    return coverage.ranked(e, units, ["team"], "user_id", ["event_type", "frame"])


@query("j12_tolerance_match")
def j12(spark, d):
    """Purchases as gold, clicks as found events of the same user parity and hundred users, in frames of a minute."""
    e = events(spark, d, 60).withColumn("outcome", (F.col("user_id") % 2).cast("long")).withColumn("match", F.floor(F.col("user_id") / 100).cast("long"))
    side = lambda kind: e.where(F.col("event_type") == kind).select("match", "outcome", "frame", "event_id")
    return assignment.greedy_match(side("purchase"), side("click"), ["match", "outcome"], "frame", "event_id")


@query("j12_scores")
def j12_scores(spark, d):
    return assignment.scores(j12(spark, d), ["match", "outcome"])


def views(spark: SparkSession) -> lineage.Views:
    daily = lineage.View("daily", ["events"], lambda i: i["events"].groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(28,2)")).alias("total")), ["user_id"])
    users = lineage.View("users", ["daily"], lambda i: i["daily"].groupBy("user_id").agg(F.sum("n").alias("n"), F.max("total").alias("best")))
    busy = lineage.View("busy", ["users"], lambda i: i["users"].groupBy("n").agg(F.count(F.lit(1)).alias("users")))
    return lineage.Views(spark, f"{shared_dir(spark)}/views-{uuid.uuid4().hex}", [daily, users, busy])


def revised(spark, d) -> tuple[DataFrame, DataFrame]:
    """events by day, and the same with the values of user 7 raised by one."""
    e = table(spark, d, "events").select("event_id", "user_id", "value", F.to_date("ts").alias("day"))
    return e, e.withColumn("value", F.when(F.col("user_id") == 7, F.col("value") + 1).otherwise(F.col("value")))


@query("t7_view_status")
def t7(spark, d):
    """The views' status before a build, after it, after a change of the source, and after the rebuild; rebuilt tells which were made anew."""
    v, (e, changed) = views(spark), revised(spark, d)
    rows = []
    for step, sources in enumerate([{"events": e}, {"events": changed}]):
        before, done = v.status(sources), v.refresh(sources)
        after = v.status(sources)
        rows += [(step, name, before[name], name in done, after[name]) for name in v.views]
    return spark.createDataFrame(rows, "step int, name string, before string, rebuilt boolean, after string")


@query("t8_view_of_changed_unit", "SELECT user_id, CAST(sum(n) AS BIGINT) AS n, CAST(max(total) AS DOUBLE) AS best FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, sum(CAST(value + CASE WHEN user_id = 7 THEN 1 ELSE 0 END AS DECIMAL(28,2))) AS total FROM events GROUP BY ALL) GROUP BY user_id")
def t8(spark, d):
    """The view of users after one user's events have changed; only that user's rows of `daily` are made anew."""
    v, (e, changed) = views(spark), revised(spark, d)
    v.refresh({"events": e})
    v.refresh({"events": changed})
    x = v.read("users", {})
    return x.select("user_id", "n", F.col("best").cast("double").alias("best"))


def observations(spark, d):
    """A user is a subject, two hours are a frame, a user's events of a type a tracklet."""
    e = events(spark, d, 7200).withColumn("tracklet", F.concat_ws(":", "event_type", "user_id"))
    o = e.groupBy(F.col("user_id").alias("subject"), "frame", "tracklet").agg(F.max(F.col("value") / 10).alias("x"), F.max(F.col("event_id") % 30).cast("double").alias("y"), F.max(F.col("event_id") % 100 / 100).alias("confidence"), (F.max("event_id") % 9 > 0).alias("inside"))
    unreliable = e.where("value >= 100").select("tracklet", F.col("frame").alias("start"), (F.col("frame") + 1).alias("stop"))
    occlusions = e.where("value between 60 and 100").select("tracklet", (F.col("frame") + 1).alias("start"), (F.col("frame") + 3).alias("stop"))
    a = e.select("user_id", "event_type", "tracklet")
    edges = a.where("event_type = 'view'").select("user_id", F.col("tracklet").alias("source")).distinct().join(a.where("event_type = 'click'").select("user_id", F.col("tracklet").alias("target")).distinct(), "user_id").drop("user_id")
    return o, unreliable, edges, occlusions


TIMELINE = """WITH e AS (SELECT *, CAST(floor((epoch_us(ts) / 1e6 - 1704067200) / 7200) AS BIGINT) AS frame, event_type || ':' || user_id AS tracklet FROM events),
o AS (SELECT user_id AS subject, frame, tracklet, max(value / 10) AS x, CAST(max(event_id % 30) AS DOUBLE) AS y, max((event_id % 100) / 100.0) AS confidence, max(event_id) % 9 > 0 AS inside FROM e GROUP BY ALL),
r AS (SELECT o.*, NOT EXISTS (SELECT 1 FROM e WHERE e.value >= 100 AND e.tracklet = o.tracklet AND o.frame BETWEEN e.frame AND e.frame + 1) AS reliable FROM o),
one AS (SELECT *, reliable AND inside AS eligible FROM r QUALIFY row_number() OVER (PARTITION BY subject, frame ORDER BY reliable DESC, confidence DESC, tracklet) = 1),
n AS (SELECT *, lead(frame) OVER w AS f2, lead(tracklet) OVER w AS t2, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(reliable) OVER w AS r2 FROM one WINDOW w AS (PARTITION BY subject ORDER BY frame)),
g AS (SELECT *, frame + 1 AS a, f2 - 1 AS b, (f2 - frame - 1) / 4.0 AS s FROM n WHERE f2 > frame + 1),
h AS (SELECT *, EXISTS (SELECT 1 FROM e WHERE e.value BETWEEN 60 AND 100 AND e.tracklet IN (g.tracklet, g.t2) AND e.frame + 1 <= g.b + 2 AND e.frame + 3 >= g.a - 2) AS held, tracklet LIKE 'view:%' AND t2 LIKE 'click:%' AS edge FROM g),
m AS (SELECT *, CASE WHEN held AND s <= 1.5 THEN 'occluded' WHEN sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) / s <= 15 AND ((reliable AND r2) OR (edge AND (reliable OR r2) AND s <= 0.5) OR tracklet = t2) AND s <= 0.6 THEN 'predicted' ELSE 'missing' END AS status FROM h),
i AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY subject ORDER BY frame) AS run FROM (SELECT *, lag(frame) OVER w = frame - 1 AND lag(tracklet) OVER w = tracklet AND lag(reliable) OVER w = reliable AND lag(eligible) OVER w = eligible AS same FROM one WINDOW w AS (PARTITION BY subject ORDER BY frame)))
SELECT subject, 'detected' AS status, tracklet, reliable, eligible, min(frame) AS start, max(frame) AS stop FROM i GROUP BY subject, run, tracklet, reliable, eligible
UNION ALL SELECT subject, status, NULL, false, false, a, b FROM m"""


@query("e11_timeline", TIMELINE)
def e11(spark, d):
    """Runs of detected, predicted, occluded and missing frames."""
    return timeline.timeline(*observations(spark, d), fps=4.0)


def appearances(spark, d):
    """Two users share a subject; a user's runs of events within 30 hours are the fragments; an hour is a frame."""
    e = events(spark, d, 3600).withColumn("subject", F.floor(F.col("user_id") / 2).cast("long"))
    x = S.sessionize(e, ["user_id"], "frame", "event_id", 30).withColumnsRenamed({"user_id": "player", "session": "fragment"})
    source = F.when(F.col("event_type") == "error", "ambiguous").when(F.col("event_type") == "signup", "missing").otherwise("detected")
    x = x.withColumn("source", source)
    r = x.groupBy("player", "subject", "fragment", "frame").agg(F.max(F.struct("event_id", "source", (F.col("value") / 10).alias("x"))).alias("e"))
    rows = r.select("player", "subject", "fragment", "frame", "e.source", "e.x", (F.col("e.event_id") % 30).cast("double").alias("y"), (F.col("e.event_id") % 100 / 100).alias("confidence"))
    fragments = x.groupBy("player", "subject", "fragment").agg(F.min("frame").alias("start"), F.max("frame").alias("stop"))
    teams_ = x.select("player", (F.col("player") % 3).cast("string").alias("team")).distinct()
    return fragments, rows, rows.select("subject", "frame"), teams_


PRESENCE = """WITH e AS (SELECT *, CAST(floor((epoch_us(ts) / 1e6 - 1704067200) / 3600) AS BIGINT) AS frame, user_id // 2 AS subject FROM events),
z AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY frame, event_id) AS fragment FROM (SELECT *, CASE WHEN frame - lag(frame) OVER w > 30 THEN 1 ELSE 0 END AS s FROM e WINDOW w AS (PARTITION BY user_id ORDER BY frame, event_id))),
seen AS (SELECT user_id AS player, subject, fragment, frame, max(event_id) AS id, arg_max(event_type, event_id) AS kind, arg_max(value, event_id) / 10 AS x, CAST(max(event_id) % 30 AS DOUBLE) AS y, (max(event_id) % 100) / 100.0 AS confidence FROM z GROUP BY ALL),
f AS (SELECT player, subject, fragment, min(frame) AS a, max(frame) AS b, arg_max(x, frame) AS lx, arg_max(y, frame) AS ly, arg_min(x, frame) AS fx, arg_min(y, frame) AS fy FROM seen GROUP BY ALL),
observed AS (SELECT player, subject, frame, CASE kind WHEN 'error' THEN 'assigned_ambiguous' WHEN 'signup' THEN 'assigned_missing' ELSE 'assigned_detected' END AS kind, confidence FROM seen),
h AS (SELECT player, subject, frame, n FROM (SELECT *, lead(frame) OVER w AS n, sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2) AS far FROM seen WINDOW w AS (PARTITION BY player, subject, fragment ORDER BY frame)) WHERE n - frame - 1 BETWEEN 1 AND 4 AND far <= greatest(3.0, 10.0 * (n - frame) / 2)),
holes AS (SELECT player, subject, frame, 'assignment_short_gap' AS kind, 0.0 AS confidence FROM (SELECT player, subject, unnest(range(frame + 1, n)) AS frame FROM h) q WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.subject = q.subject AND f.player <> q.player AND q.frame BETWEEN f.a AND f.b)),
b AS (SELECT player, subject, b + 1 AS a, lead(a) OVER w - 1 AS b, sqrt((lead(fx) OVER w - lx) ** 2 + (lead(fy) OVER w - ly) ** 2) AS far FROM f WINDOW w AS (PARTITION BY player, subject ORDER BY a, b, fragment)),
g AS (SELECT *, b - a + 1 AS n FROM b WHERE b - a + 1 BETWEEN 1 AND 40 AND far <= greatest(3.0, 10.0 * (b - a + 2) / 2) AND NOT EXISTS (SELECT 1 FROM f WHERE f.subject = b.subject AND f.player <> b.player AND f.a <= b.b AND b.a <= f.b)),
c AS (SELECT g.*, (SELECT count(DISTINCT s.frame) FROM seen s WHERE s.subject = g.subject AND s.frame BETWEEN g.a AND g.b) / n AS share FROM g),
bridges AS (SELECT player, subject, unnest(range(a, b + 1)) AS frame, CASE WHEN n <= 10 THEN 'same_subject_bridge' ELSE 'same_subject_long_bridge' END AS kind, 0.0 AS confidence FROM c WHERE share >= CASE WHEN n <= 10 THEN 0.5 ELSE 0.85 END),
every AS (SELECT *, CASE kind WHEN 'assigned_detected' THEN 5 WHEN 'assigned_ambiguous' THEN 4 WHEN 'assigned_missing' THEN 3 WHEN 'assignment_short_gap' THEN 2 ELSE 1 END AS rank FROM (FROM observed UNION ALL FROM holes UNION ALL FROM bridges)),
p AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY player, frame ORDER BY rank DESC, confidence DESC, subject DESC) = 1),
q AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY subject, frame ORDER BY rank DESC, confidence DESC, player DESC) = 1)
SELECT player, frame, subject, kind FROM q QUALIFY row_number() OVER (PARTITION BY player % 3, frame ORDER BY rank DESC, confidence DESC, player DESC) <= 7"""


@query("w14_presence", PRESENCE)
def w14(spark, d):
    """The frames in which each player counts as present."""
    return presence.presence(*appearances(spark, d), fps=2.0)


@query("w14_playing_time", f"SELECT player, count(*) AS frames, count(*) / 2.0 AS seconds, count(*) FILTER (kind = 'assigned_detected') AS detected, count(*) FILTER (kind = 'assigned_ambiguous') AS ambiguous, count(*) FILTER (kind = 'assignment_short_gap') AS short_gap, count(*) FILTER (kind = 'same_subject_bridge') AS bridge, count(*) FILTER (kind = 'same_subject_long_bridge') AS long_bridge FROM ({PRESENCE}) GROUP BY player")
def w14_time(spark, d):
    return presence.playing_time(w14(spark, d), 2.0)


def claimed(spark, d):
    """Users of a pair share a subject; runs of events within 30 hours are assignments, some of them too long."""
    fragments_, rows, _, _ = appearances(spark, d)
    a = fragments_.select(F.concat_ws("-", "player", "fragment").alias("assignment"), "subject", "player", (F.col("player") % 3).cast("string").alias("team"), (F.col("player") * 7 % 10 / 10).alias("sure"), "start", (F.col("stop") + F.col("player") % 5 * 12).alias("stop"))
    r = rows.groupBy("subject", "frame").agg(F.max(F.struct("confidence", "source", "x", "y")).alias("e"))
    return a, r.select("subject", "frame", "e.source", F.lit(True).alias("inside"), F.col("e.y").cast("int") % 4 > 0, "e.confidence", "e.x", "e.y").toDF("subject", "frame", "source", "inside", "trusted", "confidence", "x", "y")


@query("j19_resolved_rows")
def j19(spark, d):
    """Each player's rows from the slots assigned to them."""
    return resolved.resolved_rows(*claimed(spark, d))


CARRIED = """WITH c AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN user_id END AS k1, event_type AS k2, user_id % 50 AS k3 FROM events WHERE event_type <> 'error'),
r AS (SELECT user_id AS k1, event_type AS k2, event_id % 50 AS k3, CASE WHEN value > 50 THEN 'accepted' ELSE 'rejected' END AS status FROM events WHERE event_type = 'error' OR value > 200),
r1 AS (SELECT k1, count(*) AS n, max(status) AS s FROM r GROUP BY k1), r2 AS (SELECT k2, k3, count(*) AS n, max(status) AS s FROM r GROUP BY k2, k3)
SELECT event_id, CASE WHEN r1.n IS NOT NULL THEN CASE WHEN r1.n = 1 THEN r1.s END WHEN r2.n = 1 THEN r2.s END AS status, CASE WHEN coalesce(r1.n, r2.n) = 1 THEN 'restored' WHEN coalesce(r1.n, r2.n) > 1 THEN 'ambiguous_existing_review' END AS migration, CASE WHEN r1.n IS NOT NULL THEN 'k1' WHEN r2.n IS NOT NULL THEN 'k2+k3' END AS matched_by
FROM c LEFT JOIN r1 ON c.k1 = r1.k1 LEFT JOIN r2 ON c.k2 = r2.k2 AND c.k3 = r2.k3"""


@query("r2_carried_reviews", CARRIED)
def r2(spark, d):
    """R2: reviews carried over by the first key that matches."""
    e = table(spark, d, "events")
    c = e.where("event_type != 'error'").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("k1"), F.col("event_type").alias("k2"), (F.col("user_id") % 50).alias("k3"))
    r = e.where("event_type = 'error' or value > 200").select(F.col("user_id").alias("k1"), F.col("event_type").alias("k2"), (F.col("event_id") % 50).alias("k3"), F.when(F.col("value") > 50, "accepted").otherwise("rejected").alias("status"))
    return resolved.carried_over(c, r, "event_id", [("k1",), ("k2", "k3")], ["status"]).drop("k1", "k2", "k3")


@query("r4_point_in_time", "WITH v AS (SELECT user_id, ts, max(value) AS price FROM events WHERE event_type = 'signup' GROUP BY ALL) SELECT e.event_id, v.price FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts")
def r4(spark, d):
    """What held for a user at the time of each purchase."""
    e = table(spark, d, "events")
    points = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    versions = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("since"), F.col("value").alias("price"))
    return resolved.as_of(points, versions, ["user_id"], "ts", "since", ["price"]).select("event_id", "price")


@query("r4_changed_rows", "SELECT user_id, day, 'changed' AS change FROM (SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE user_id = 7)")
def r4_changed(spark, d):
    """The rows of a snapshot whose meaning a change of the source has changed."""
    sums = lambda x: x.groupBy("user_id", "day").agg(F.sum(F.col("value").cast("decimal(28,2)")).alias("total"), F.max("event_id").alias("note"))
    old, new = (resolved.snapshot(sums(x), ["user_id", "day"], ["total"]) for x in revised(spark, d))
    return resolved.changed(old, new.withColumn("note", F.lit(0)), ["user_id", "day"]).withColumn("day", F.col("day").cast("string"))


@query("g1_two_means")
def g1(spark, d):
    """G1: embeddings in two groups, heavier labels counting more."""
    x = table(spark, d, "embeddings").withColumn("weight", F.col("label") + 1)
    return teams.two_means(x, "vec_id", "embedding", "weight", tolerance=0.001)[0].select("vec_id", "cluster", F.round("margin", 6).alias("margin"))

"""All queries of the match-analytics operators, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactigrid.functions import geometry as G
from tactigrid.operators import aggregates as A
from tactigrid.operators import motion, review
from tactigrid.operators import sequence as S
from tactigrid.plans import play, rules, scalars, stores, tracking  # noqa: F401  they register their queries
from tactigrid.plans.registry import ORACLE, QUERIES, query
from tactigrid.sources.tables import table
from tactigrid.streaming import windows

HOUR = 3600.0
START = 1_704_067_200  # 2024-01-01 UTC


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "ts", S.seconds("ts").alias("t"))


EV = "WITH e AS (SELECT event_id, user_id, event_type, value, ts, epoch_us(ts) / 1e6 AS t FROM events)"
SESSION = EV + ", m AS (SELECT *, CASE WHEN {split} THEN 1 ELSE 0 END AS s FROM (SELECT *, t - lag(t) OVER w AS dt, abs(value - lag(value) OVER w) AS dv FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))), z AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session FROM m) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(event_id) AS first_id, max(ts) AS last_ts FROM z GROUP BY ALL"


def by_session(x: DataFrame) -> DataFrame:
    return x.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("ts").alias("last_ts"))


@query("w2_sessions", SESSION.format(split="dt > 21600"))
def w2(spark, d):
    return by_session(S.sessionize(events(spark, d), ["user_id"], "t", "event_id", 6 * HOUR))


@query("w2_tracklets", SESSION.format(split="dt > 86400 OR dv / greatest(dt, 60) > 0.05"))
def w2_speed(spark, d):
    return by_session(S.sessionize(events(spark, d), ["user_id"], "t", "event_id", 24 * HOUR, 0.05, "value", 60.0))


@query("w3_islands", EV + ", m AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS s FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), z AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY t, event_id) AS island FROM m) SELECT user_id, CAST(island AS BIGINT) AS island, event_type, count(*) AS n, min(t) AS start, max(t) AS stop FROM z GROUP BY ALL")
def w3(spark, d):
    x = S.islands(events(spark, d), ["user_id"], "t", "event_id", ["event_type"])
    return x.groupBy("user_id", "island", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("start"), F.max("t").alias("stop"))


@query("w5_interpolation", EV + ", x AS (SELECT *, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v FROM e), y AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0, last_value(v IGNORE NULLS) OVER b AS v0, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t1, first_value(v IGNORE NULLS) OVER a AS v1 FROM x WINDOW b AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN t1 - t0 <= 86400 AND t1 > t0 AND abs(v1 - v0) / (t1 - t0) <= 0.002 THEN v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 6) AS filled, CASE WHEN v IS NOT NULL THEN 'detected' WHEN t1 - t0 <= 86400 AND t1 > t0 AND abs(v1 - v0) / (t1 - t0) <= 0.002 THEN 'interpolated' ELSE 'unknown' END AS source FROM y")
def w5(spark, d):
    x = events(spark, d).withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    return S.interpolate(x, ["user_id"], "t", "event_id", "v", 24 * HOUR, 0.002).select("event_id", F.round("filled", 6).alias("filled"), "source")


@query("j3_period_half_open", "SELECT event_id, CASE WHEN epoch_us(ts) / 1e6 >= 1704067200 AND epoch_us(ts) / 1e6 < 1704931200 THEN 'first' WHEN epoch_us(ts) / 1e6 >= 1704931200 AND epoch_us(ts) / 1e6 < 1705795200 THEN 'second' WHEN epoch_us(ts) / 1e6 >= 1705795200 THEN 'third' END AS period FROM events")
def j3(spark, d):
    p = spark.createDataFrame([("first", START, START + 864_000), ("second", START + 864_000, START + 1_728_000), ("third", START + 1_728_000, None)], "period string, start long, stop long")
    return S.periods_of(events(spark, d), p, "t").select("event_id", "period")


@query("j4_period_closed", "SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1992-01-01' AND o_orderdate <= TIMESTAMP '1995-01-01' THEN 'early' WHEN o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '2030-01-01' THEN 'late' END AS period FROM orders")
def j4(spark, d):
    p = spark.sql("SELECT * FROM VALUES ('early', TIMESTAMP '1992-01-01', TIMESTAMP '1995-01-01'), ('late', TIMESTAMP '1995-01-01', TIMESTAMP '2030-01-01') AS p(period, start, stop)")
    return S.periods_of(table(spark, d, "orders"), p, "o_orderdate", closed=True).select("o_orderkey", "period")


@query("j7_asof_lagged", EV + ", c AS (SELECT a.event_id, b.value, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.t - b.t - 43200), b.t, b.event_id) AS r FROM e a JOIN e b ON a.user_id = b.user_id AND b.t < a.t AND b.t >= a.t - 86400 AND abs(a.t - b.t - 43200) <= 21600) SELECT e.event_id, c.value AS lagged_value FROM e LEFT JOIN c ON e.event_id = c.event_id AND c.r = 1")
def j7(spark, d):
    return S.asof_lagged(events(spark, d), ["user_id"], "t", "event_id", "value", 12 * HOUR, 24 * HOUR, 6 * HOUR).select("event_id", "lagged_value")


@query("j8_asof_forward", EV + " SELECT a.event_id, (SELECT min(b.t) FROM e b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.t > a.t AND b.t <= a.t + 86400) AS next_t FROM e a")
def j8(spark, d):
    return S.next_where(events(spark, d), ["user_id"], "t", "event_id", F.col("event_type") == "purchase", 24 * HOUR).select("event_id", "next_t")


@query("j9_asof_backward", EV + ", p AS (SELECT * FROM e WHERE event_type = 'purchase'), v AS (SELECT user_id, t, max_by(value, event_id) AS value FROM e WHERE event_type = 'view' GROUP BY ALL) SELECT p.event_id, CASE WHEN p.t - v.t <= 172800 THEN v.t END AS matched_t, CASE WHEN p.t - v.t <= 172800 THEN v.value END AS matched_value FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.t >= v.t")
def j9(spark, d):
    e = events(spark, d).select("event_id", "user_id", "event_type", "value", "t")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    return S.asof_backward(left, e.where("event_type = 'view'").select("event_id", "user_id", "t", "value"), ["user_id"], "t", "event_id", "value", 48 * HOUR).select("event_id", "matched_t", "matched_value")


@query("j13_bounded_pairs", EV + ", r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM e) SELECT a.user_id, a.event_id AS a, b.event_id AS b, CAST(b.n - a.n AS INTEGER) AS rank, b.t - a.t AS gap FROM r a JOIN r b ON a.user_id = b.user_id AND b.n - a.n BETWEEN 1 AND 4")
def j13(spark, d):
    return S.bounded_pairs(events(spark, d), ["user_id"], "t", "event_id", 4)


STEPS = EV + ", s0 AS (SELECT user_id, event_id, t, t - lag(t) OVER w AS dt, abs(value - lag(value) OVER w) AS distance FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), s AS (SELECT *, distance / dt AS speed, CASE WHEN distance / dt > 0.1 THEN 'outlier' WHEN dt <= 21600 THEN 'observed' WHEN dt <= 86400 THEN 'estimated' ELSE 'long_gap' END AS kind FROM s0 WHERE dt > 0)"


@query("a4_steps", STEPS + " SELECT event_id, dt, distance, speed, kind FROM s")
def a4(spark, d):
    return motion.steps(events(spark, d), ["user_id"], "t", "event_id", "value", 0.1, 6 * HOUR, 24 * HOUR).select("event_id", "dt", "distance", "speed", "kind")


MOVE_COLUMNS = ("observed_m", "estimated_m", "observed_s", "estimated_s", "max_speed", "mean_speed", "estimated_ratio")


@query("a18_movement", STEPS + ", m AS (SELECT user_id, count(*) FILTER (kind = 'observed') AS n_observed, count(*) FILTER (kind = 'estimated') AS n_estimated, count(*) FILTER (kind = 'outlier') AS n_outlier, count(*) FILTER (kind = 'long_gap') AS n_long_gap, coalesce(sum(distance) FILTER (kind = 'observed'), 0) AS om, coalesce(sum(distance) FILTER (kind = 'estimated'), 0) AS em, coalesce(sum(dt) FILTER (kind = 'observed'), 0) AS os, coalesce(sum(dt) FILTER (kind = 'estimated'), 0) AS es, max(speed) FILTER (kind IN ('observed', 'estimated')) AS ms FROM s GROUP BY user_id) SELECT user_id, n_observed, n_estimated, n_outlier, n_long_gap, round(om, 3) AS observed_m, round(em, 3) AS estimated_m, round(os, 3) AS observed_s, round(es, 3) AS estimated_s, round(ms, 3) AS max_speed, round(CASE WHEN os + es > 0 THEN (om + em) / (os + es) END, 3) AS mean_speed, round(CASE WHEN os + es > 0 THEN es / (os + es) ELSE 0 END, 3) AS estimated_ratio, CASE WHEN os + es = 0 THEN 'none' WHEN es / (os + es) <= 0.25 THEN 'good' WHEN es / (os + es) <= 0.6 THEN 'fair' ELSE 'poor' END AS quality FROM m")
def a18(spark, d):
    m = motion.movement(events(spark, d), ["user_id"], "t", "event_id", "value", 0.1, 6 * HOUR, 24 * HOUR)
    return m.withColumns({c: F.round(c, 3) for c in MOVE_COLUMNS})


@query("a20_sprints", EV + ", s0 AS (SELECT user_id, event_id, t AS stop, lag(t) OVER w AS start, abs(value - lag(value) OVER w) AS distance FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), s AS (SELECT *, distance / (stop - start) AS speed, distance / (stop - start) >= 0.002 AND stop - start <= 86400 AS fast FROM s0 WHERE start IS NOT NULL AND stop > start), r AS (SELECT *, sum(CASE WHEN fast THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY stop, event_id) AS run FROM s), g AS (SELECT user_id, run, min(start) AS start, max(stop) AS stop, round(sum(distance), 4) AS distance, max(speed) AS top_speed FROM r WHERE fast GROUP BY ALL) SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY start) AS INTEGER) AS run, start, stop, distance, top_speed FROM g WHERE stop - start >= 3600")
def a20(spark, d):
    r = motion.sprints(events(spark, d), ["user_id"], "t", "event_id", "value", 0.002, 24 * HOUR, HOUR)
    return r.withColumn("distance", F.round("distance", 4))


@query("a2_timeline", "WITH x AS (SELECT user_id, CAST(floor((epoch_us(ts) / 1e6 - 1704067200) / 86400) AS BIGINT) AS bucket, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(28,2))) AS DOUBLE) AS total FROM events GROUP BY ALL), f AS (SELECT user_id, CAST(unnest(range(31)) AS BIGINT) AS bucket FROM (SELECT DISTINCT user_id FROM events)) SELECT f.user_id, f.bucket, coalesce(x.n, 0) AS n, coalesce(x.total, 0.0) AS total FROM f LEFT JOIN x ON f.user_id = x.user_id AND f.bucket = x.bucket")
def a2(spark, d):
    return A.timeline(events(spark, d), ["user_id"], "t", 24 * HOUR, "value", START, 31)


@query("a12_density_grid", "SELECT CAST(least(11, greatest(0, floor(l_quantity / 50.0 * 12))) AS BIGINT) AS cell_x, CAST(least(7, greatest(0, floor(l_discount / 0.1 * 8))) AS BIGINT) AS cell_y, count(*) AS n FROM lineitem GROUP BY ALL")
def a12(spark, d):
    return A.grid(table(spark, d, "lineitem"), F.col("l_quantity"), F.col("l_discount"), 50.0, 0.1, 12, 8)


SPANS = "WITH i AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) AS start, max(epoch_us(l_shipdate)) AS stop FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"


def spans(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", S.micros("o_orderdate").alias("start"))
    last = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max(S.micros("l_shipdate")).alias("stop"))
    return o.join(last, o["o_orderkey"] == last["l_orderkey"]).select("o_custkey", "o_orderkey", "start", "stop")


@query("a35_interval_union", SPANS + ", m AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY o_custkey ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS s FROM i), p AS (SELECT *, sum(s) OVER (PARTITION BY o_custkey ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS piece FROM m) SELECT o_custkey, start, stop FROM (SELECT o_custkey, piece, min(start) AS start, max(stop) AS stop FROM p GROUP BY ALL)")
def a35(spark, d):
    return S.interval_union(spans(spark, d), ["o_custkey"], "start", "stop")


@query("r14_overlaps", SPANS + ", n AS (SELECT *, lead(start) OVER w AS s2, lead(stop) OVER w AS e2, lead(o_orderkey) OVER w AS next_id FROM i WINDOW w AS (PARTITION BY o_custkey ORDER BY start, o_orderkey)) SELECT o_custkey, o_orderkey, next_id, least(stop, e2) - s2 AS overlap FROM n WHERE least(stop, e2) - s2 > 500000")
def r14(spark, d):
    return S.adjacent_overlaps(spans(spark, d), ["o_custkey"], "start", "stop", "o_orderkey", 500_000)


@query("a5_rollup", "SELECT r_name, n_name, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(28,2))) AS DOUBLE) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def a5(spark, d):
    x = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), A.exact_sum("c_acctbal").alias("balance"))


@query("k1_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def k1(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(30)


@query("w13_top_per_group", "SELECT c_nationkey, c_custkey, rank FROM (SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank FROM customer) WHERE rank <= 3")
def w13(spark, d):
    return A.top_per_group(table(spark, d, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), "c_custkey"], 3).select("c_nationkey", "c_custkey", "rank")


@query("k2_capped_top", "SELECT s_suppkey, s_nationkey FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) > 2 THEN 1 ELSE 0 END AS filler FROM supplier) ORDER BY filler, s_acctbal DESC, s_suppkey LIMIT 14")
def k2(spark, d):
    return A.capped_top(table(spark, d, "supplier"), ["s_nationkey"], [F.desc("s_acctbal"), "s_suppkey"], 14, 2).select("s_suppkey", "s_nationkey")


@query("k3_page", "SELECT p_partkey, p_brand FROM part WHERE p_size > 20 ORDER BY p_partkey LIMIT 25 OFFSET 50")
def k3(spark, d):
    return table(spark, d, "part").where("p_size > 20").select("p_partkey", "p_brand").orderBy("p_partkey").offset(50).limit(25)


@query("k9_similar", "WITH q AS (SELECT * FROM embeddings), x AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(1 - least(1.0, greatest(-1.0, list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])))), 6) AS distance FROM q JOIN embeddings v ON q.label = v.label AND q.vec_id != v.vec_id) SELECT query_id, id, rank, distance FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM x) WHERE rank <= 5")
def k9(spark, d):
    e = table(spark, d, "embeddings")
    queries = e.select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("q"))
    return A.nearest(queries, e.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v")), "label", 5)


@query("a26_centroids", "SELECT label, CAST(i AS INTEGER) AS i, round(avg(x::DOUBLE), 6) AS mean, count(*) AS n FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL")
def a26(spark, d):
    return A.centroids(table(spark, d, "embeddings"), "label", "embedding")


@query("g8_medoid", """WITH u AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
c AS (SELECT label, i, avg(x / n) AS c FROM (SELECT label, n, unnest(v) AS x, unnest(range(len(v))) AS i FROM u) GROUP BY label, i), m AS (SELECT label, list(c ORDER BY i) AS m FROM c GROUP BY label),
y AS (SELECT u.label, vec_id, round(list_inner_product(v, m) / n, 6) AS likeness FROM u JOIN m ON u.label = m.label)
SELECT label, vec_id, likeness FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY likeness DESC, vec_id) AS r FROM y) WHERE r = 1""")
def g8(spark, d):
    return A.medoid(table(spark, d, "embeddings"), "label", "vec_id", "embedding")


@query("p1_homography", "SELECT l_orderkey, l_linenumber, round((1.2 * l_quantity + 0.1 * l_tax + 3) / (0.001 * l_quantity + 0.002 * l_tax + 1), 6) AS px, round((0.2 * l_quantity + 0.9 * l_tax + 1) / (0.001 * l_quantity + 0.002 * l_tax + 1), 6) AS py FROM lineitem")
def p1(spark, d):
    x, y = G.project(F.col("l_quantity"), F.col("l_tax"), [1.2, 0.1, 3.0, 0.2, 0.9, 1.0, 0.001, 0.002, 1.0])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(x, 6).alias("px"), F.round(y, 6).alias("py"))


@query("p2_polygon", "SELECT p_partkey, (CASE WHEN p_size < 10 OR p_size > 40 THEN false ELSE p_retailprice >= 950 AND p_retailprice <= 1500 END) AS inside FROM part")
def p2(spark, d):
    corners = [(950.0, 10.0), (1500.0, 10.0), (1500.0, 40.0), (950.0, 40.0)]
    return table(spark, d, "part").select("p_partkey", G.in_polygon(F.col("p_retailprice"), F.col("p_size").cast("double"), corners).alias("inside"))


@query("p4_play_area", "WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity * 0.7 - 2 AS x, l_discount * 500 - 1 AS y FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN least(x, 30 - x, y, 47.4 - y) >= 0.35 THEN 'inside_play' WHEN sqrt(power(x - greatest(0, least(30, x)), 2) + power(y - greatest(0, least(47.4, y)), 2)) <= 1.25 THEN 'boundary_transient' ELSE 'outside_play' END AS area FROM p")
def p4(spark, d):
    x, y = F.col("l_quantity") * 0.7 - 2, F.col("l_discount") * 500 - 1
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", G.play_area(x, y, 30.0, 47.4).alias("area"))


@query("p7_direction", "WITH e AS (SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events) SELECT event_id, CASE WHEN f IS NULL THEN 'unknown' WHEN f >= 1.5 THEN 'forward' WHEN f <= -1.5 THEN 'backward' ELSE 'lateral' END AS direction FROM e")
def p7(spark, d):
    step = F.col("value") - F.lag("value").over(S.ordered(["user_id"], "ts", "event_id"))
    return table(spark, d, "events").select("event_id", G.direction(step).alias("direction"))


@query("p8_reject_reasons", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l_quantity < 5 THEN 'too_small' WHEN l_quantity > 45 THEN 'too_large' WHEN l_discount = 0 THEN 'missing' ELSE 'accepted' END AS reason FROM lineitem) GROUP BY reason")
def p8(spark, d):
    reason = review.first_reason([("too_small", F.col("l_quantity") < 5), ("too_large", F.col("l_quantity") > 45), ("missing", F.col("l_discount") == 0)], "accepted")
    return table(spark, d, "lineitem").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("p9_downsample", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id FROM r WHERE n <= 10 OR floor(floor(i * 9 / (n - 1) + 0.5) * (n - 1) / 9 + 0.5) = i")
def p9(spark, d):
    return S.downsample(table(spark, d, "events"), ["user_id"], "ts", "event_id", 10).select("user_id", "event_id")


@query("p14_box_overlap", "WITH b AS (SELECT event_id, value AS x1, value + user_id % 3 * 10 AS x2, greatest(1, user_id % 3 * 10) * 10 AS s, lead(value) OVER w AS a1, lead(value) OVER w + 30 AS a2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), c AS (SELECT *, greatest(0, least(x2, a2) - greatest(x1, a1)) * 10 AS k FROM b WHERE a1 IS NOT NULL) SELECT event_id, round(k / (s + 300 - k), 6) AS iou, round(k / least(s, 300), 6) AS containment FROM c")
def p14(spark, d):
    ahead = F.lead("value").over(S.ordered(["user_id"], "ts", "event_id"))
    x = table(spark, d, "events").select("event_id", "value", (F.col("user_id") % 3 * 10).alias("wide"), ahead.alias("other")).where("other is not null")
    zero, ten = F.lit(0.0), F.lit(10.0)
    iou, inside = G.box_overlap([F.col("value"), zero, F.col("value") + F.col("wide"), ten], [F.col("other"), zero, F.col("other") + 30, ten])
    return x.select("event_id", F.round(iou, 6).alias("iou"), F.round(inside, 6).alias("containment"))


@query("u2_membership_difference", "SELECT nation, side FROM ((SELECT DISTINCT c_nationkey AS nation, 'left' AS side FROM customer WHERE c_acctbal > 9900 AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)) UNION ALL (SELECT DISTINCT s_nationkey, 'right' FROM supplier WHERE s_acctbal > 9000 AND s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)))")
def u2(spark, d):
    a = table(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("nation"))
    return review.difference(a, table(spark, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("nation")))


@query("u3_owner_conflicts", "SELECT l_partkey, count(DISTINCT l_suppkey) AS n_owners, min(l_suppkey) AS least_owner FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def u3(spark, d):
    return review.owners(table(spark, d, "lineitem"), ["l_partkey"], "l_suppkey")


@query("u4_distinct_last", "SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def u4(spark, d):
    return review.latest(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("r3_layered_override", "SELECT d.doc_id, CASE WHEN l2.doc_id IS NOT NULL THEN l2.v WHEN l1.doc_id IS NOT NULL THEN l1.v ELSE d.source END AS status FROM documents d LEFT JOIN (SELECT doc_id, 'quality' || quality AS v FROM labels) l1 ON d.doc_id = l1.doc_id LEFT JOIN (SELECT doc_id, CASE WHEN quality = 1 THEN 'toxic' END AS v FROM labels WHERE toxic = 1) l2 ON d.doc_id = l2.doc_id")
def r3(spark, d):
    labels = table(spark, d, "labels")
    base = table(spark, d, "documents").select("doc_id", F.col("source").alias("status"))
    first = labels.select("doc_id", F.concat(F.lit("quality"), F.col("quality").cast("string")).alias("status"))
    second = labels.where("toxic = 1").select("doc_id", F.when(F.col("quality") == 1, "toxic").alias("status"))
    return review.overlay(base, [first, second], ["doc_id"], ["status"])


@query("r11_required", "SELECT user_id, CAST(ceil(CAST(count(*) AS DECIMAL(20,0)) * CAST('0.35' AS DECIMAL(10,6))) AS BIGINT) AS required FROM events GROUP BY user_id")
def r11(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", review.required(F.col("n"), "0.35").alias("required"))


@query("f2_json_number", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def f2(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("f8_clock", "SELECT event_id, CAST(CAST(floor(value) AS BIGINT) // 60 AS VARCHAR) || ':' || lpad(CAST(CAST(floor(value) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS clock FROM events")
def f8(spark, d):
    s = F.floor("value")
    return table(spark, d, "events").select("event_id", F.concat((F.floor(s / 60)).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0")).alias("clock"))


@query("s6_scan_order", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F'")
def s6(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey")


@query("s15_time_window", "SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' GROUP BY user_id")
def s15(spark, d):
    x = table(spark, d, "events").where("ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'")
    return x.groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))


@query("t3_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(28,2))) AS DOUBLE) AS total FROM events GROUP BY ALL")
def t3(spark, d):
    return windows.tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"], "value").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("t4_sliding", "SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k) AS start, event_type, count(*) AS n FROM events, range(3) r(k) GROUP BY ALL")
def t4(spark, d):
    return windows.sliding(table(spark, d, "events"), "ts", "3 hours", "1 hour", ["event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("t5_session_windows", "WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), z AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM m) SELECT start, user_id, n FROM (SELECT user_id, session, min(ts) AS start, count(*) AS n FROM z GROUP BY ALL)")
def t5(spark, d):
    return windows.sessions(table(spark, d, "events"), "ts", "6 hours", ["user_id"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE

"""Queries of scalar functions, lookups, conflicts, rankings and pages, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tactigrid.functions import geometry as G
from tactigrid.functions import labels as L
from tactigrid.operators import matching as J
from tactigrid.operators import sequence as S
from tactigrid.plans.registry import query
from tactigrid.sources.tables import table


@query("p5_eligible", "SELECT l_orderkey, count(*) FILTER (l_returnflag = 'N' AND l_linestatus IN ('O', 'F') AND l_discount > 0 AND isfinite(l_tax)) AS eligible FROM lineitem GROUP BY l_orderkey")
def p5(spark, d):
    ok = (F.col("l_returnflag") == "N") & F.col("l_linestatus").isin("O", "F") & (F.col("l_discount") > 0) & ~F.isnan("l_tax") & (F.abs("l_tax") < float("inf"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.when(ok, 1)).alias("eligible"))


ATTACK = "WITH a AS (SELECT o_orderkey, CAST(o_custkey % 30 AS DOUBLE) AS x, CAST(o_orderkey % 47 AS DOUBLE) AS y, CASE o_orderkey % 5 WHEN 0 THEN 'x+' WHEN 1 THEN 'x-' WHEN 2 THEN 'y+' WHEN 3 THEN 'y-' END AS attack FROM orders)"


def attacks(spark, d):
    k = F.col("o_orderkey") % 5
    attack = F.when(k == 0, "x+").when(k == 1, "x-").when(k == 2, "y+").when(k == 3, "y-")
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 30).cast("double").alias("x"), (F.col("o_orderkey") % 47).cast("double").alias("y"), attack.alias("attack"))


@query("p6_oriented", ATTACK + " SELECT o_orderkey, CASE attack WHEN 'x+' THEN 10 - x WHEN 'x-' THEN x - 10 WHEN 'y+' THEN 20 - y WHEN 'y-' THEN y - 20 END AS forward, round(CASE attack WHEN 'x+' THEN greatest(0, least(1, x / 25)) WHEN 'x-' THEN greatest(0, least(1, 1 - x / 25)) WHEN 'y+' THEN greatest(0, least(1, y / 40)) WHEN 'y-' THEN greatest(0, least(1, 1 - y / 40)) END, 6) AS progress FROM a")
def p6(spark, d):
    x, y, a = F.col("x"), F.col("y"), F.col("attack")
    return attacks(spark, d).select("o_orderkey", G.forward(x, y, F.lit(10.0), F.lit(20.0), a).alias("forward"), F.round(G.progress(x, y, a, 25.0, 40.0), 6).alias("progress"))


@query("p16_restarts", ATTACK + """, n AS (SELECT *, least(abs(x), abs(30 - x), abs(y), abs(47 - y)) AS near FROM a)
SELECT o_orderkey, CASE WHEN near > 0.8 THEN NULL WHEN least(abs(x), abs(30 - x)) = near THEN 'kick_in' WHEN least(abs(x), abs(30 - x)) <= 5 THEN 'corner' ELSE 'ignored_goal_line_restart' END AS restart FROM n""")
def p16(spark, d):
    return attacks(spark, d).select("o_orderkey", G.restart(F.col("x"), F.col("y"), 30.0, 47.0).alias("restart"))


@query("p11_slot_labels", "SELECT p_partkey, regexp_matches(label, '^[AB][0-9]+(~[0-9]+)?$') AS slot FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE '' END || p_size || CASE WHEN p_size % 3 = 0 THEN '~' ELSE '' END || CASE WHEN p_size % 6 = 0 THEN '7' ELSE '' END AS label FROM part)")
def p11(spark, d):
    k = F.col("p_size")
    label = F.concat(F.when(k % 4 == 0, "A").when(k % 4 == 1, "B").when(k % 4 == 2, "C").otherwise(""), k.cast("string"), F.when(k % 3 == 0, "~").otherwise(""), F.when(k % 6 == 0, "7").otherwise(""))
    return table(spark, d, "part").select("p_partkey", L.slot(label).alias("slot"))


@query("p13_colours", "SELECT p_partkey, round(1 - sqrt(CAST((p_size * 5 - 100) * (p_size * 5 - 100) + (p_partkey % 256 - 50) * (p_partkey % 256 - 50) + 900 AS DOUBLE)) / sqrt(195075.0::DOUBLE), 6) AS similarity FROM part")
def p13(spark, d):
    a = [F.col("p_size") * 5, F.col("p_partkey") % 256, F.lit(40)]
    return table(spark, d, "part").select("p_partkey", F.round(G.colour_similarity(a, [F.lit(100), F.lit(50), F.lit(10)]), 6).alias("similarity"))


@query("p15_lanes", "SELECT event_id, round(sqrt((px - 10 * t) * (px - 10 * t) + (py - 20 * t) * (py - 20 * t)), 6) AS away FROM (SELECT *, greatest(0, least(1, (px * 10 + py * 20) / 500)) AS t FROM (SELECT event_id, value / 10 AS px, CAST(user_id % 20 AS DOUBLE) AS py FROM events))")
def p15(spark, d):
    x, y = F.col("value") / 10, (F.col("user_id") % 20).cast("double")
    away = G.segment_distance(x, y, (F.lit(0.0), F.lit(0.0)), (F.lit(10.0), F.lit(20.0)))
    return table(spark, d, "events").select("event_id", F.round(away, 6).alias("away"))


@query("f1_clamp", "SELECT event_id, greatest(10, least(200, value)) AS clamped FROM events")
def f1(spark, d):
    return table(spark, d, "events").select("event_id", G.clamp(F.col("value"), 10.0, 200.0).alias("clamped"))


@query("f2_safe_divide", "SELECT l_orderkey, round(coalesce(count(*) FILTER (l_returnflag = 'R') / nullif(count(*) FILTER (l_returnflag = 'A'), 0), 0), 4) AS ratio FROM lineitem GROUP BY l_orderkey")
def f2(spark, d):
    n = lambda k: F.count(F.when(F.col("l_returnflag") == k, 1))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(L.ratio(n("R"), n("A")).alias("ratio"))


@query("f3_distance", "SELECT l_orderkey, round(max(sqrt((l_quantity - 25) * (l_quantity - 25) + (l_tax - 0.5) * (l_tax - 0.5) + l_discount * l_discount)), 6) AS far FROM lineitem GROUP BY l_orderkey")
def f3(spark, d):
    far = L.euclid([F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")], [F.lit(25.0), F.lit(0.5), F.lit(0.0)])
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.max(far), 6).alias("far"))


@query("f6_content_hash", """SELECT n_nationkey, sha256('{"key":' || n_nationkey || ',"name":"' || n_name || '","region":' || n_regionkey || '}') AS hash FROM nation""")
def f6(spark, d):
    return table(spark, d, "nation").select("n_nationkey", L.content_hash(("region", F.col("n_regionkey")), ("name", F.col("n_name")), ("key", F.col("n_nationkey"))).alias("hash"))


@query("f7_slug", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type || ' / ' || p_brand || '!'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def f7(spark, d):
    return table(spark, d, "part").select("p_partkey", L.slug(F.concat("p_type", F.lit(" / "), "p_brand", F.lit("!"))).alias("slug"))


@query("f9_jersey", "SELECT c_custkey, CASE WHEN regexp_matches(CAST(c_custkey AS VARCHAR), '^[1-9][0-9]?$') THEN CAST(c_custkey AS INTEGER) END AS number FROM customer")
def f9(spark, d):
    return table(spark, d, "customer").select("c_custkey", L.jersey(F.col("c_custkey").cast("string")).alias("number"))


@query("f11_labels", "SELECT event_id, CASE WHEN value >= 85 THEN 'good' WHEN value >= 60 THEN 'fair' ELSE 'poor' END AS label FROM events")
def f11(spark, d):
    return table(spark, d, "events").select("event_id", L.ordered_label(F.col("value"), [(85.0, "good"), (60.0, "fair")], "poor").alias("label"))


@query("j21_lookup", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey IN (1, 2)")
def j21(spark, d):
    n = table(spark, d, "nation").where("n_regionkey IN (1, 2)").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, d, "customer").join(n, "c_nationkey", "left").select("c_custkey", "n_name")


@query("j25_roster", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j25(spark, d):
    roster = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(roster, "c_custkey", "left_semi").select("c_custkey")


@query("j28_unrepresented", "SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem a WHERE l_returnflag = 'N' AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey AND b.l_returnflag = 'R')")
def j28(spark, d):
    x = table(spark, d, "lineitem")
    return x.where("l_returnflag = 'N'").join(x.where("l_returnflag = 'R'"), ["l_orderkey", "l_suppkey"], "left_anti").select("l_orderkey", "l_suppkey").distinct()


@query("j27_claims", """WITH c AS (SELECT l_orderkey, l_suppkey % 3 AS player, l_suppkey, max(l_linenumber) AS priority FROM lineitem GROUP BY ALL),
w AS (SELECT *, max(priority) OVER p AS top, count(*) OVER p AS n FROM c WINDOW p AS (PARTITION BY l_orderkey, player)), v AS (SELECT *, count(*) FILTER (priority = top) OVER (PARTITION BY l_orderkey, player) AS tops FROM w)
SELECT l_orderkey, player, l_suppkey, CASE WHEN n = 1 THEN 'single' WHEN tops > 1 THEN 'demoted' WHEN priority = top THEN 'winner' ELSE 'loser' END AS verdict FROM v""")
def j27(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_orderkey", (F.col("l_suppkey") % 3).alias("player"), "l_suppkey").agg(F.max("l_linenumber").alias("priority"))
    return J.claims(x, ["l_orderkey", "player"], "l_suppkey", "priority").select("l_orderkey", "player", "l_suppkey", "verdict")


@query("j17_frame_overlaps", """WITH b AS (SELECT l_orderkey, l_suppkey, min(l_quantity) AS x FROM lineitem GROUP BY ALL)
SELECT a.l_orderkey, a.l_suppkey AS first, b.l_suppkey AS second, round(greatest(0, 10 - abs(a.x - b.x)) / (20 - greatest(0, 10 - abs(a.x - b.x))), 6) AS iou FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey WHERE abs(a.x - b.x) < 10""")
def j17(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_quantity").alias("x"))
    p = J.pairs_in_frame(x, "l_orderkey", "l_suppkey", ["x"])
    box = lambda c: [F.col(c), F.lit(0.0), F.col(c) + 10, F.lit(1.0)]
    iou, _ = G.box_overlap(box("x_a"), box("x_b"))
    return p.select("l_orderkey", F.col("l_suppkey_a").alias("first"), F.col("l_suppkey_b").alias("second"), F.round(iou, 6).alias("iou")).where("iou > 0")


@query("r1_upsert", "SELECT d.doc_id, CASE WHEN coalesce(l.s, d.source) IN ('accepted', 'rejected') THEN coalesce(l.s, d.source) ELSE 'needs_review' END AS status FROM documents d LEFT JOIN (SELECT doc_id, CASE quality WHEN 1 THEN 'accepted' WHEN 0 THEN 'rejected' END AS s FROM labels) l ON d.doc_id = l.doc_id")
def r1(spark, d):
    reviews = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "accepted").when(F.col("quality") == 0, "rejected").alias("status"))
    base = table(spark, d, "documents").select("doc_id", F.col("source").alias("status"))
    return J.upsert(base, reviews, "doc_id", "status", ["accepted", "rejected"], "needs_review")


@query("u5_validation", """WITH c AS (SELECT l_suppkey, CAST(count(*) AS DOUBLE) AS v FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1), b AS (SELECT l_suppkey, CAST(count(*) AS DOUBLE) AS v FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey % 4 > 0 GROUP BY 1)
SELECT c.l_suppkey, CASE WHEN b.v IS NULL THEN 'production_baseline_unavailable' WHEN abs(c.v - b.v) > 0.1 * abs(b.v) THEN 'ready_with_review' ELSE 'ready' END AS state FROM c LEFT JOIN b ON c.l_suppkey = b.l_suppkey""")
def u5(spark, d):
    n = lambda x: x.groupBy("l_suppkey").agg(F.count(F.lit(1)).cast("double").alias("v"))
    x = table(spark, d, "lineitem")
    return J.validated(n(x.where("l_returnflag = 'N'")), n(x.where("l_returnflag = 'R' AND l_suppkey % 4 > 0")), "l_suppkey", "v", 0.1).select("l_suppkey", "state")


@query("u1_chunks", "SELECT event_id, CAST(0 AS INTEGER) AS chunk FROM events WHERE event_id % 10 < 6 UNION ALL SELECT event_id, CAST(1 AS INTEGER) FROM events WHERE event_id % 10 >= 6")
def u1(spark, d):
    x = table(spark, d, "events")
    part = lambda c, k: x.where(c).select("event_id", F.lit(k).alias("chunk"))
    return part("event_id % 10 < 6", 0).unionByName(part("event_id % 10 >= 6", 1))


@query("k1_severity", """WITH s AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') + 2 * count(*) FILTER (l_discount = 0) + 3 * count(*) FILTER (l_tax = 0) + 2 * count(*) FILTER (l_quantity > 45) AS severity FROM lineitem GROUP BY 1)
SELECT l_orderkey, severity FROM s WHERE severity > 0 ORDER BY severity DESC, l_orderkey LIMIT 30""")
def k1(spark, d):
    n = lambda c: F.count(F.when(c, 1))
    severity = n(F.col("l_returnflag") == "R") + 2 * n(F.col("l_discount") == 0) + 3 * n(F.col("l_tax") == 0) + 2 * n(F.col("l_quantity") > 45)
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(severity.alias("severity")).where("severity > 0").orderBy(F.desc("severity"), "l_orderkey").limit(30)


@query("k3_facets", "SELECT p_brand, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS size, count(*) AS n FROM part WHERE p_retailprice > 950 GROUP BY ALL")
def k3(spark, d):
    size = F.when(F.col("p_size") > 25, "large").otherwise("small")
    return table(spark, d, "part").where("p_retailprice > 950").groupBy("p_brand", size.alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query("k7_sorted", "SELECT s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY coalesce(CASE WHEN s_suppkey % 3 > 0 THEN s_name END, ''), coalesce(s_acctbal, 0), s_suppkey) AS INTEGER) AS place FROM supplier")
def k7(spark, d):
    x = table(spark, d, "supplier").withColumn("name", F.coalesce(F.when(F.col("s_suppkey") % 3 > 0, F.col("s_name")), F.lit(""))).withColumn("balance", F.coalesce("s_acctbal", F.lit(0.0)))
    return x.select("s_suppkey", F.row_number().over(S.ordered(["s_nationkey"], "name", "balance", "s_suppkey")).alias("place"))


@query("k8_queue", "WITH c AS (SELECT o_custkey, count(*) AS cases FROM orders GROUP BY o_custkey) SELECT o_custkey, cases FROM c ORDER BY cases DESC, o_custkey LIMIT 10")
def k8(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("cases")).orderBy(F.desc("cases"), "o_custkey").limit(10)


@query("w15_detected_around", """WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) / 1e6 AS t FROM events), x AS (SELECT *, last_value(CASE WHEN event_type != 'error' THEN t END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
first_value(CASE WHEN event_type != 'error' THEN t END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM e) SELECT event_id, coalesce(b - a <= 86400, false) AS bridged FROM x WHERE event_type = 'error'""")
def w15(spark, d):
    x = table(spark, d, "events").withColumn("t", S.seconds("ts"))
    return S.detected_around(x, ["user_id"], "t", "event_id", F.col("event_type") != "error", 86_400.0).where("event_type = 'error'").select("event_id", "bridged")

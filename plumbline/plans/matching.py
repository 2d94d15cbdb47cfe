"""Tolerance joins: bands, balls, nearest rows, assignments, intervals, coverage."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators import graph, joins
from plumbline.plans._registry import query

_PAIR = "FROM supplier JOIN customer ON s_nationkey = c_nationkey"


def _sides(t):
    return t("supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), t("customer").select("c_custkey", "c_nationkey", "c_acctbal")


def _band(t, tol):
    s, c = _sides(t)
    return joins.band_join(s, c, "s_acctbal", "c_acctbal", tol, [("s_nationkey", "c_nationkey")]).withColumn("d", F.abs(F.col("s_acctbal") - F.col("c_acctbal")))


@query(f"SELECT s_suppkey, c_custkey, round(abs(s_acctbal - c_acctbal), 2) AS d {_PAIR} WHERE abs(s_acctbal - c_acctbal) <= 50")
def band_join_price(t):
    return _band(t, 50.0).select("s_suppkey", "c_custkey", F.round("d", 2).alias("d"))


@query("""SELECT a.p_partkey, b.p_partkey AS other, round(sqrt(power(a.p_size - b.p_size, 2) + power(a.p_retailprice - b.p_retailprice, 2)), 4) AS distance FROM part a JOIN part b ON a.p_partkey < b.p_partkey
  WHERE a.p_brand = b.p_brand AND sqrt(power(a.p_size - b.p_size, 2) + power(a.p_retailprice - b.p_retailprice, 2)) <= 3""")
def ball_join_parts(t):
    p = t("part").selectExpr("p_partkey", "p_brand", "cast(p_size as double) x", "p_retailprice y")
    near = joins.ball_pairs(p, "p_partkey", "x", "y", 3.0, ["p_brand"])
    return near.select("p_partkey", "other", F.round("distance", 4).alias("distance"))


_RANKED = f"SELECT s_suppkey, c_custkey, abs(s_acctbal - c_acctbal) AS d, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(s_acctbal - c_acctbal), c_custkey) AS r, lead(abs(s_acctbal - c_acctbal)) OVER (PARTITION BY s_suppkey ORDER BY abs(s_acctbal - c_acctbal), c_custkey) AS d2 {_PAIR}"


def _nearest(t):
    s, c = _sides(t)
    return joins.nearest_by_value(s, c, ("s_nationkey", "c_nationkey"), "s_acctbal", "c_acctbal", "s_suppkey", "c_custkey").where("c_custkey is not null")


@query(f"SELECT s_suppkey, c_custkey, round(d, 2) AS d FROM ({_RANKED}) WHERE r = 1")
def knn1_value(t):
    return _nearest(t).select("s_suppkey", "c_custkey", F.round("d1", 2).alias("d"))


@query(f"SELECT s_suppkey, c_custkey, CASE WHEN d2 IS NULL OR d2 > 1.5 * d THEN 'verified' ELSE 'queued' END AS status FROM ({_RANKED}) WHERE r = 1")
def ratio_test(t):
    return _nearest(t).select("s_suppkey", "c_custkey", F.when(F.col("d2").isNull() | (F.col("d2") > 1.5 * F.col("d1")), "verified").otherwise("queued").alias("status"))


@query(f"SELECT s_suppkey, min(c_custkey) AS c_custkey {_PAIR} WHERE abs(s_acctbal - c_acctbal) <= 50 GROUP BY 1 HAVING count(*) = 1")
def exactly_one_match(t):
    return joins.exactly_one(_band(t, 50.0), ["s_suppkey"]).select("s_suppkey", "c_custkey")


@query(f"""WITH m AS (SELECT s_suppkey, count(*) AS n {_PAIR} WHERE abs(s_acctbal - c_acctbal) <= 50 GROUP BY 1) SELECT s_suppkey, CASE WHEN n = 1 THEN 'verified' WHEN n > 1 THEN 'queued' ELSE 'refused' END AS status FROM supplier LEFT JOIN m USING (s_suppkey)""")
def match_status(t):
    n = _band(t, 50.0).groupBy("s_suppkey").agg(F.count("*").alias("n"))
    return t("supplier").select("s_suppkey").join(n, "s_suppkey", "left").select("s_suppkey", joins.status_of(F.col("n")).alias("status"))


_CAND = f"SELECT s_suppkey, c_custkey, abs(s_acctbal - c_acctbal) AS d {_PAIR} WHERE abs(s_acctbal - c_acctbal) <= 200"


@query(f"SELECT s_suppkey, c_custkey FROM (SELECT s_suppkey, c_custkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY d, c_custkey) AS a, row_number() OVER (PARTITION BY c_custkey ORDER BY d, s_suppkey) AS b FROM ({_CAND})) WHERE a = 1 AND b = 1")
def mutual_nearest(t):
    return joins.mutual_nearest(_band(t, 200.0), "s_suppkey", "c_custkey", "d").select("s_suppkey", "c_custkey")


@query()
def greedy_one_to_one(t):
    pairs = _band(t, 200.0).select("s_suppkey", "c_custkey", "d")
    return joins.greedy_one_to_one(pairs, "s_suppkey", "c_custkey", "d", graph.checkpointer(pairs.sparkSession))


_BOX = "SELECT p_partkey, p_brand, p_size AS x0, p_size + 1 AS x1, p_retailprice AS y0, p_retailprice + 4 AS y1 FROM part"


@query(f"""WITH b AS ({_BOX}), o AS (SELECT a.p_partkey, b.p_partkey AS other, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / 4 AS share FROM b a JOIN b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)
  SELECT p_partkey, other, round(share, 4) AS share FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY round(share, 6) DESC, other) AS r FROM o) WHERE r = 1""")
def box_overlap_join(t):
    box = lambda k, b, p: t("part").selectExpr(f"p_partkey {k}", f"p_brand {b}", f"cast(p_size as double) {p}x0", f"p_size + 1.0D {p}x1", f"p_retailprice {p}y0", f"p_retailprice + 4 {p}y1")
    both = joins.interval_overlap(box("p_partkey", "p_brand", "a"), box("other", "brand", "b"), "ay0", "ay1", "by0", "by1", 8.0, [("p_brand", "brand"), ("ax0", "bx0")])
    share = (F.least("ax1", "bx1") - F.greatest("ax0", "bx0")) * (F.least("ay1", "by1") - F.greatest("ay0", "by0")) / 4
    o = both.where("p_partkey <> other and ay0 < by1 and by0 < ay1").withColumn("share", F.round(share, 6))
    w = W.partitionBy("p_partkey").orderBy(F.desc("share"), "other")
    return o.withColumn("r", F.row_number().over(w)).where("r = 1").select("p_partkey", "other", F.round("share", 4).alias("share"))


_OPEN = "SELECT o_custkey AS c, o_orderkey AS k, o_orderdate AS a, max(l_shipdate) AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3"


def _open(t):
    last = t("lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("b"))
    return t("orders").join(last, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("a"), "b").where("a <= b")


@query(f"WITH i AS (SELECT * FROM ({_OPEN}) WHERE a <= b) SELECT x.c, count(*) AS pairs FROM i x JOIN i y ON x.c = y.c AND x.k < y.k AND x.a <= y.b AND y.a <= x.b GROUP BY 1")
def interval_overlap_join(t):
    i = _open(t).select("c", "k", F.unix_timestamp(F.col("a").cast("timestamp")).alias("a"), F.unix_timestamp(F.col("b").cast("timestamp")).alias("b"))
    j = i.selectExpr("c c2", "k k2", "a a2", "b b2")
    return joins.interval_overlap(i, j, "a", "b", "a2", "b2", 40.0 * 86400, [("c", "c2")]).where("k < k2").groupBy("c").agg(F.count("*").alias("pairs"))


_USER = "SELECT user_id AS u, min(ts) AS a, min(ts) + INTERVAL 3 DAY AS b FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1"


@query(f"SELECT e.user_id, count(*) AS n, sum(CASE WHEN b IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS covered FROM events e LEFT JOIN ({_USER}) ON e.user_id = u AND ts >= a AND ts <= b GROUP BY 1")
def coverage_flag(t):
    e = t("events")
    kind = e.agg(F.min("event_type").alias("kind"))
    cover = e.join(F.broadcast(kind), F.col("event_type") == F.col("kind")).groupBy(F.col("user_id").alias("u")).agg(F.min("ts").alias("a"))  # one row of kind
    flag = F.col("a").isNotNull() & (F.col("ts") >= F.col("a")) & (F.col("ts") <= F.col("a") + F.expr("interval 3 days"))
    return e.join(cover, F.col("user_id") == F.col("u"), "left").groupBy("user_id").agg(F.count("*").alias("n"), F.sum(flag.cast("long")).alias("covered"))


@query("""SELECT user_id, count(*) AS n FROM events JOIN orders ON o_custkey = user_id WHERE CAST(ts AS TIME) >= CAST(o_orderdate AS TIME) AND extract(dow FROM ts) = extract(dow FROM o_orderdate) GROUP BY 1""")
def point_in_bucket(t):
    """Events whose time of the week falls on an order's day."""
    e = t("events").select("user_id", F.dayofweek("ts").alias("d"), F.date_format(F.col("ts").cast("timestamp"), "HH:mm:ss.SSSSSS").alias("x"))
    o = t("orders").select("o_custkey", F.dayofweek("o_orderdate").alias("d2"), F.date_format(F.col("o_orderdate").cast("timestamp"), "HH:mm:ss.SSSSSS").alias("y"))
    return e.join(o, (F.col("o_custkey") == F.col("user_id")) & (F.col("d") == F.col("d2")) & (F.col("x") >= F.col("y"))).groupBy("user_id").agg(F.count("*").alias("n"))


@query("""SELECT e.event_id, p.value AS previous FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_prev_event(t):
    e = t("events").select("event_id", "user_id", "ts")
    p = t("events").where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return joins.asof_previous(e, p, "user_id", "ts", "ts", "value", "previous").select("event_id", "previous")


@query("""SELECT a.s_nationkey AS n, count(*) AS pairs, round(avg(abs(a.s_acctbal - b.s_acctbal)), 4) AS mean FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey GROUP BY 1""")
def self_pairs(t):
    """Mean difference over all pairs of a group, from sorted prefix sums: no pair is made."""
    w = W.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")
    r = t("supplier").select("s_nationkey", "s_acctbal", (F.row_number().over(w) - 1).alias("i"), F.sum("s_acctbal").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    g = r.groupBy(F.col("s_nationkey").alias("n")).agg(F.sum("i").cast("long").alias("pairs"), F.sum(F.col("i") * F.col("s_acctbal") - F.coalesce("before", F.lit(0.0))).alias("total"))
    return g.where("pairs > 0").select("n", "pairs", F.round(F.col("total") / F.col("pairs"), 4).alias("mean"))


@query("""SELECT count(*) AS n FROM part, (VALUES (0, 900.0, 50, 900.0, 25, 1500.0)) v(ax, ay, bx, by_, cx, cy) WHERE ((ay > p_retailprice) <> (by_ > p_retailprice) AND p_size < (bx - ax) * (p_retailprice - ay) / nullif(by_ - ay, 0) + ax)::INT + ((by_ > p_retailprice) <> (cy > p_retailprice) AND p_size < (cx - bx) * (p_retailprice - by_) / (cy - by_) + bx)::INT + ((cy > p_retailprice) <> (ay > p_retailprice) AND p_size < (ax - cx) * (p_retailprice - cy) / (ay - cy) + cx)::INT = 1""")
def point_in_polygon(t):
    spark = t("part").sparkSession
    ring = spark.createDataFrame([(1, 0.0, 900.0, 50.0, 900.0), (1, 50.0, 900.0, 25.0, 1500.0), (1, 25.0, 1500.0, 0.0, 900.0)], "ring int, x0 double, y0 double, x1 double, y1 double")
    points = t("part").selectExpr("p_partkey", "cast(p_size as double) px", "p_retailprice py")
    return joins.point_in_polygon(points, ring, "px", "py", ["p_partkey"], "ring", 50.0).agg(F.count("*").alias("n"))

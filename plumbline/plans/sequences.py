"""Ordered data: sessions, unions of intervals, spans, walks, gaps."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators import sequences
from plumbline.plans._registry import query
from plumbline.plans.matching import _OPEN, _open


def _by_user():
    return W.partitionBy("user_id").orderBy("ts", "event_id")


@query("""SELECT event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), -1) AS gap_us FROM events""")
def lag_delta(t):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return t("events").select("event_id", F.coalesce(us - F.lag(us).over(_by_user()), F.lit(-1)).alias("gap_us"))


@query("""WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new, event_id FROM events),
  y AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM x) SELECT user_id, s::BIGINT AS session, count(*) AS n FROM y GROUP BY 1, 2""")
def islands_session(t):
    new = F.col("ts") > F.lag("ts").over(_by_user()) + F.expr("interval 30 minutes")
    return sequences.islands(t("events"), ["user_id"], ["ts", "event_id"], new, "session").groupBy("user_id", "session").agg(F.count("*").alias("n"))


_UNION = f"""WITH i AS (SELECT * FROM ({_OPEN}) WHERE a <= b), m AS (SELECT *, max(b) OVER (PARTITION BY c ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
  r AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + INTERVAL 5 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM m), u AS (SELECT c, min(a) AS a, max(b) AS b, count(*) AS pieces FROM r GROUP BY c, run)"""


def _union(t):
    return sequences.interval_union(_open(t), ["c"], "a", "b", F.expr("interval 5 days"))


@query(f"{_UNION} SELECT c, a, b, pieces FROM u")
def interval_union(t):
    return _union(t).select("c", "a", "b", "pieces")


@query(f"{_UNION} SELECT * FROM (SELECT c, b AS hole_lo, lead(a) OVER (PARTITION BY c ORDER BY a) AS hole_hi FROM u) WHERE hole_hi IS NOT NULL")
def interval_holes(t):
    return sequences.interval_holes(_union(t), ["c"], "a", "b")


@query("""WITH q AS (SELECT l_orderkey AS k, l_linenumber AS i, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), p AS (SELECT k, i, v, sum(v) OVER (PARTITION BY k ORDER BY i) AS hi FROM q),
  s AS (SELECT a.k, a.i AS first, b.i AS last FROM p a JOIN p b ON a.k = b.k AND b.i >= a.i WHERE abs(b.hi - (a.hi - a.v) - 60) <= 0.5) SELECT k, min(first) AS first, min(last) AS last FROM s GROUP BY 1 HAVING count(*) = 1""")
def unique_span_sum(t):
    df = t("lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i")).agg(F.sum("l_quantity").alias("v"))
    return sequences.unique_span(df, ["k"], "i", "v", F.lit(60.0), 0.5)


@query("""WITH x AS (SELECT user_id, event_id, CASE WHEN value < 20 THEN NULL ELSE event_type END AS v FROM events), y AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS f, count(v) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM x),
  z AS (SELECT *, sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g) AS len FROM y) SELECT event_id, coalesce(v, CASE WHEN b = f AND len <= 2 THEN b END) AS v FROM z""")
def bridge_null_runs(t):
    df = t("events").select("user_id", "event_id", F.when(F.col("value") >= 20, F.col("event_type")).alias("v"))
    return sequences.bridge_nulls(df, ["user_id"], ["event_id"], "v", 2).select("event_id", "v")


@query("""SELECT l_suppkey, min(l_partkey) AS first, count(*) AS length FROM (SELECT l_suppkey, l_partkey, l_partkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS g FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) GROUP BY l_suppkey, g HAVING count(*) >= 2""")
def consecutive_number_runs(t):
    w = W.partitionBy("l_suppkey").orderBy("l_partkey")
    runs = t("lineitem").select("l_suppkey", "l_partkey").distinct().withColumn("g", F.col("l_partkey") - F.row_number().over(w))
    return runs.groupBy("l_suppkey", "g").agg(F.min("l_partkey").alias("first"), F.count("*").alias("length")).where("length >= 2").drop("g")


@query("""WITH w AS (SELECT user_id, event_id, sum(value * sin(radians(event_id % 360))) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x, sum(value * cos(radians(event_id % 360))) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS y FROM events)
  SELECT user_id, round(max(sqrt(x * x + y * y)), 4) AS farthest, round(arg_max(sqrt(x * x + y * y), event_id), 4) AS misfit FROM w GROUP BY 1""")
def running_walk(t):
    az = F.radians(F.col("event_id") % 360)
    w = sequences.walk(t("events"), ["user_id"], ["ts", "event_id"], F.col("value") * F.sin(az), F.col("value") * F.cos(az)).withColumn("d", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2))
    return w.groupBy("user_id").agg(F.round(F.max("d"), 4).alias("farthest"), F.round(F.max_by("d", "event_id"), 4).alias("misfit"))


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(extract(hour FROM ts) * 60 + extract(minute FROM ts) AS BIGINT) AS m FROM events) SELECT user_id, max(g) AS gap FROM (SELECT user_id, coalesce(lead(m) OVER (PARTITION BY user_id ORDER BY m), first_value(m) OVER (PARTITION BY user_id ORDER BY m) + 1440) - m AS g FROM d) GROUP BY 1""")
def circular_gap(t):
    df = t("events").select("user_id", (F.hour("ts") * 60 + F.minute("ts")).cast("long").alias("m"))
    return sequences.circular_gap(df.distinct(), ["user_id"], "m", 1440)


@query("""WITH p AS (SELECT o_custkey AS k, o_orderkey AS i, 100 * cos(o_orderkey % 7) AS x, 100 * sin(o_orderkey % 7) AS y FROM orders), s AS (SELECT k, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM p WINDOW w AS (PARTITION BY k ORDER BY i))
  SELECT k, round(abs(sum(x * ny - nx * y)) / 2, 3) AS area, round(sum(sqrt(power(nx - x, 2) + power(ny - y, 2))), 3) AS perimeter FROM s GROUP BY 1""")
def closest_ring_closure(t):
    p = t("orders").selectExpr("o_custkey k", "o_orderkey i", "100 * cos(o_orderkey % 7) x", "100 * sin(o_orderkey % 7) y")
    return sequences.ring_area(p, ["k"], ["i"], "x", "y").select("k", F.round("area", 3).alias("area"), F.round("perimeter", 3).alias("perimeter"))


@query("""SELECT conv_id, count(*) AS turns, sum(CASE WHEN role = before THEN 1 ELSE 0 END)::BIGINT AS repeats, sum(CASE WHEN before IS NULL OR role <> before THEN 1 ELSE 0 END)::BIGINT AS runs FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) GROUP BY 1""")
def conversation_turn_order(t):
    c = t("conversations").withColumn("before", F.lag("role").over(W.partitionBy("conv_id").orderBy("turn")))
    same = F.col("role") == F.col("before")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.coalesce(same, F.lit(False)).cast("long")).alias("repeats"), F.sum(F.coalesce(~same, F.lit(True)).cast("long")).alias("runs"))


@query("""WITH c AS (SELECT l_orderkey AS k, unnest([0.0::DOUBLE, 100.0::DOUBLE]) AS s FROM lineitem UNION SELECT l_orderkey, l_quantity::DOUBLE FROM lineitem WHERE l_quantity > 0 AND l_quantity < 100) SELECT k, count(*) AS pieces, round(max(e - s), 4) AS longest FROM (SELECT k, s, lead(s) OVER (PARTITION BY k ORDER BY s) AS e FROM c) WHERE e IS NOT NULL GROUP BY 1""")
def cut_positions(t):
    line = t("lineitem").selectExpr("l_orderkey k", "cast(l_quantity as double) at")
    pieces = sequences.cut_pieces(line.select("k").distinct().withColumn("len", F.lit(100.0)), line, "k", "len", "at")
    return pieces.groupBy("k").agg(F.count("*").alias("pieces"), F.round(F.max(F.col("e") - F.col("s")), 4).alias("longest"))


@query("""SELECT p_brand, count(*) AS elements, round(sum(s1 - s0), 3) AS total FROM (SELECT p_brand, p_size * (i::DOUBLE) / n AS s0, p_size * (i + 1.0::DOUBLE) / n AS s1 FROM (SELECT p_brand, p_size, n, unnest(range(n)) AS i FROM (SELECT p_brand, p_size, CAST(greatest(1, ceil(p_size / 3.0)) AS BIGINT) AS n FROM part))) GROUP BY 1""")
def densify_elements(t):
    e = sequences.densify(t("part").select("p_brand", F.col("p_size").cast("double").alias("len")), "len", 3.0)
    return e.groupBy("p_brand").agg(F.count("*").alias("elements"), F.round(F.sum(F.col("s1") - F.col("s0")), 3).alias("total"))

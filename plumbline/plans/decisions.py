"""Ordered decisions, proofs of falling strength and stations over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import geometry, parsing
from plumbline.operators import aggregates, cascades, joins, keepers, sequences
from plumbline.plans._registry import query


@query("""WITH f AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'kept' WHEN l_quantity < 3 THEN 'tiny' WHEN l_extendedprice < 2000 THEN 'cheap' WHEN l_discount >= 0.095 THEN 'discounted' ELSE 'kept' END AS fate FROM lineitem)
  SELECT fate, count(*) AS n, round(sum(l_extendedprice), 0) AS total, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS protected FROM f GROUP BY 1""")
def removal_cascade(t):
    rules = [("tiny", F.col("l_quantity") < 3), ("cheap", F.col("l_extendedprice") < 2000), ("discounted", F.col("l_discount") >= 0.095)]
    safe = F.col("l_returnflag") == "R"
    out = cascades.removal_cascade(t("lineitem"), rules, safe)
    return out.groupBy(F.coalesce("removed_by", F.lit("kept")).alias("fate")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 0).alias("total"), F.sum(safe.cast("long")).alias("protected"))


@query("""SELECT p_brand, max(p_size) AS p_size FROM (SELECT p_brand, p_size FROM part GROUP BY 1, 2 HAVING count(*) >= 2 AND sum(p_retailprice) >= 2500) GROUP BY 1""")
def heaviest_class(t):
    return cascades.heaviest_class(t("part"), ["p_brand"], "p_size", "p_retailprice", 2, 2500.0)


@query("""WITH p AS (SELECT s_suppkey, c_custkey, CASE WHEN abs(s_acctbal - c_acctbal) <= 5 AND c_mktsegment = 'BUILDING' THEN 1 WHEN abs(s_acctbal - c_acctbal) <= 5 THEN 2 ELSE 3 END AS level
    FROM supplier JOIN customer ON s_nationkey = c_nationkey AND abs(s_acctbal - c_acctbal) <= 40), e AS (SELECT s_suppkey, level, count(*) AS n, min(c_custkey) AS c FROM p GROUP BY 1, 2)
  SELECT s_suppkey, level, n, CASE WHEN n = 1 THEN c END AS c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY level) AS r FROM e) WHERE r = 1""")
def cascade_match(t):
    near = joins.band_join(t("supplier"), t("customer"), "s_acctbal", "c_acctbal", 40.0, [("s_nationkey", "c_nationkey")])
    tight = F.abs(F.col("s_acctbal") - F.col("c_acctbal")) <= 5
    return cascades.cascade_match(near, "s_suppkey", "c_custkey", [tight & (F.col("c_mktsegment") == "BUILDING"), tight, F.lit(True)])


@query("""WITH x AS (SELECT o_orderkey, o_custkey, o_orderpriority, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status FROM orders),
  d AS (SELECT o_custkey, o_orderpriority, min(status) AS s FROM x GROUP BY 1, 2 HAVING min(status) = max(status)) SELECT o_orderkey, coalesce(status, s) AS status FROM x LEFT JOIN d USING (o_custkey, o_orderpriority)""")
def attach_unique(t):
    rows = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"))
    return cascades.attach_unique(rows, ["o_custkey", "o_orderpriority"], "status").select("o_orderkey", "status")


@query("""WITH x AS (SELECT l_partkey, l_extendedprice AS v, l_quantity * 1000 AS want FROM lineitem), y AS (SELECT *, abs(v - want) <= 0.1 * want AS ok FROM x),
  s AS (SELECT l_partkey, sum(ok::INT)::BIGINT AS passed, sum((NOT ok)::INT)::BIGINT AS open_rows, sum(CASE WHEN NOT ok THEN v END) AS a, sum(CASE WHEN NOT ok THEN want END) AS b FROM y GROUP BY 1)
  SELECT l_partkey, passed, open_rows, CASE WHEN open_rows = 0 THEN NULL WHEN open_rows >= 2 AND abs(a - b) <= 0.9 * b THEN 'run' ELSE 'queued' END AS verdict FROM s""")
def settle_by_object(t):
    v, want = F.col("l_extendedprice"), F.col("l_quantity") * 1000
    return cascades.settle_by_object(t("lineitem"), ["l_partkey"], F.abs(v - want) <= 0.1 * want, v, want, 0.9 * want)


@query("""WITH b AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem WHERE l_discount > 0.075)
  SELECT o.l_orderkey, b.l_partkey FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN b ON o.l_orderkey = b.l_orderkey AND b.r = 1""")
def first_violation(t):
    return cascades.first_violation(t("lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"], F.col("l_discount") <= 0.075, ["l_partkey"])


@query("""WITH f AS (SELECT p_brand, regr_slope(p_retailprice, p_size) AS a, regr_intercept(p_retailprice, p_size) AS b FROM part GROUP BY 1)
  SELECT p_brand, round(regr_slope(p_retailprice, p_size), 5) AS slope, round(regr_intercept(p_retailprice, p_size), 4) AS intercept, count(*) AS n FROM part JOIN f USING (p_brand) WHERE abs(p_retailprice - a * p_size - b) <= 33.3 GROUP BY 1""")
def two_pass_line(t):
    fit = cascades.two_pass_line(t("part"), ["p_brand"], "p_size", "p_retailprice", 33.3)
    return fit.select("p_brand", F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


@query("""WITH m AS (SELECT user_id, median(value) AS m FROM events GROUP BY 1) SELECT user_id, round(m, 6) AS median, round(avg(CASE WHEN abs(value - m) <= 7.7771 THEN 1.0 ELSE 0.0 END), 6) AS share FROM events JOIN m USING (user_id) GROUP BY user_id, m""")
def share_near_median(t):
    out = cascades.share_near_median(t("events"), ["user_id"], "value", 7.7771)
    return out.select("user_id", F.round("median", 6).alias("median"), F.round("share", 6).alias("share"))


@query("""WITH r AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
  SELECT o_orderpriority, string_agg(o_orderkey::VARCHAR, ',' ORDER BY r) AS examples FROM r WHERE r <= 4 GROUP BY 1""")
def bucket_examples(t):
    out = cascades.examples_of(t("orders"), ["o_orderpriority"], [F.desc("o_totalprice"), "o_orderkey"], "o_orderkey")
    return out.select("o_orderpriority", F.array_join(F.col("examples").cast("array<string>"), ",").alias("examples"))


@query("""SELECT l_returnflag, least(l_partkey % 50, l_suppkey % 50) AS low_end, greatest(l_partkey % 50, l_suppkey % 50) AS high_end, min(l_orderkey) AS l_orderkey, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""")
def mirror_dedupe(t):
    rows = t("lineitem").select("l_returnflag", "l_orderkey", (F.col("l_partkey") % 50).alias("a"), (F.col("l_suppkey") % 50).alias("b"))
    return cascades.mirror_dedupe(rows, ["l_returnflag"], ("a", "b"), ["l_orderkey"])


@query("""SELECT o_custkey, CASE WHEN count(*) >= 8 AND count(DISTINCT o_orderpriority) >= 4 AND least(sum((o_orderstatus = 'O')::INT), sum((o_orderstatus = 'F')::INT)) >= 2 THEN 'solved' ELSE 'weak' END AS status FROM orders GROUP BY 1""")
def credibility_gate(t):
    n = lambda s: F.sum((F.col("o_orderstatus") == s).cast("int"))
    return t("orders").groupBy("o_custkey").agg(cascades.credible(F.count("*"), F.count_distinct("o_orderpriority"), n("O"), n("F")).alias("status"))


@query("""WITH x AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM events), y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM x)
  SELECT user_id, s::BIGINT AS island, count(*) AS n FROM y GROUP BY 1, 2 HAVING max(value) - min(value) < 12.345""")
def drop_wide_runs(t):
    from pyspark.sql import Window as W

    new = F.col("ts") > F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id")) + F.expr("interval 12 hours")
    return sequences.drop_wide_runs(t("events"), ["user_id"], ["ts", "event_id"], new, "value", 12.345)


@query("""WITH v AS (SELECT user_id, event_id, value AS x, (event_id % 97)::DOUBLE AS y FROM events), s AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM v WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  l AS (SELECT *, sqrt(power(x2 - x, 2) + power(y2 - y, 2)) AS len FROM s), c AS (SELECT *, sum(len) OVER (PARTITION BY user_id ORDER BY event_id) - len AS d0, sum(len) OVER (PARTITION BY user_id) AS length FROM l WHERE len > 0),
  p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM c WHERE d0 <= length * 0.37)
  SELECT user_id, round(length, 3) AS length, round(x + (length * 0.37 - d0) / len * (x2 - x), 3) AS px, round(y + (length * 0.37 - d0) / len * (y2 - y), 3) AS py FROM p WHERE r = 1""")
def point_at_fraction(t):
    rows = t("events").select("user_id", "event_id", F.col("value").alias("x"), (F.col("event_id") % 97).cast("double").alias("y"))
    out = sequences.point_at_fraction(rows, ["user_id"], ["event_id"], "x", "y", 0.37)
    return out.select("user_id", *[F.round(c, 3).alias(c) for c in ("length", "px", "py")])


@query("""WITH g AS (SELECT user_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS step FROM events) SELECT user_id, round(coalesce(greatest(3600, 3 * median(step / 1000000.0)), 3600), 3) AS reach FROM g GROUP BY 1""")
def adaptive_reach(t):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    return sequences.adaptive_reach(t("events"), ["user_id"], ["ts", "event_id"], seconds, 3.0, 3600.0).select("user_id", F.round("reach", 3).alias("reach"))


@query("""SELECT p_brand, count(*) AS n FROM part WHERE NOT ((p_size BETWEEN 4 AND 11 AND p_retailprice BETWEEN 909.5 AND 940.5) OR (p_size BETWEEN 29 AND 41 AND p_retailprice BETWEEN 949.5 AND 990.5)) GROUP BY 1""")
def region_mask(t):
    masked = geometry.in_any_box(F.col("p_size"), F.col("p_retailprice"), [(4.5, 910.0, 10.5, 940.0), (29.5, 950.0, 40.5, 990.0)], 0.5)
    return t("part").where(~masked).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("""WITH a(s, ax, ay, bx, b_y) AS (VALUES (0.0::DOUBLE, 0.0::DOUBLE, 900.0::DOUBLE, 20.0::DOUBLE, 930.0::DOUBLE), (sqrt(1300.0), 20.0, 930.0, 30.0, 960.0), (sqrt(1300.0) + sqrt(1000.0), 30.0, 960.0, 50.0, 999.0)),
  p AS (SELECT p_partkey, s, ax, ay, bx, b_y, p_size AS x, p_retailprice AS y, power(bx - ax, 2) + power(b_y - ay, 2) AS l2 FROM part, a), t AS (SELECT *, greatest(0.0, least(1.0, ((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / l2)) AS t FROM p),
  d AS (SELECT p_partkey, sqrt(power(x - ax - t * (bx - ax), 2) + power(y - ay - t * (b_y - ay), 2)) AS distance, s + t * sqrt(l2) AS station FROM t)
  SELECT p_partkey, round(min(distance), 4) AS distance, round(arg_min(station, distance), 4) AS station FROM d GROUP BY 1""")
def corridor_station(t):
    near = geometry.nearest_station(F.col("p_size").cast("double"), F.col("p_retailprice"), [(0.0, 900.0), (20.0, 930.0), (30.0, 960.0), (50.0, 999.0)])
    return t("part").select("p_partkey", near.alias("n")).select("p_partkey", F.round("n.distance", 4).alias("distance"), F.round("n.station", 4).alias("station"))


@query("""WITH x AS (SELECT l_returnflag, l_quantity AS r, radians(l_discount * 100) AS d, l_quantity * radians(l_discount * 100) * (1 + (l_tax - 0.02) / 2) AS l FROM lineitem)
  SELECT l_returnflag, CASE WHEN abs(l - r * d) <= 0.02 + 0.0005 * l THEN 'pass' WHEN r * (1 - cos(d / 2)) < 0.0321 THEN 'unproven' ELSE 'fail' END AS verdict, count(*) AS n FROM x GROUP BY 1, 2""")
def curve_triple_check(t):
    radius, delta = F.col("l_quantity"), F.col("l_discount") * 100
    length = geometry.arc_length(radius, delta) * (1 + (F.col("l_tax") - 0.02) / 2)
    return t("lineitem").groupBy("l_returnflag", geometry.curve_verdict(radius, delta, length, 0.0321).alias("verdict")).agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT event_type, 0.5 AS ca, (event_id % 10) / 10.0 AS cb, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS a, CASE WHEN event_id % 3 = 0 THEN substr(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), 2) WHEN event_id % 3 = 1 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) ELSE '7' END AS b FROM events),
  y AS (SELECT event_type, CASE WHEN a = b THEN 'agree' WHEN length(a) = length(b) + 1 AND ends_with(a, b) AND TRY_CAST(a AS DOUBLE) BETWEEN 10 AND 60 OR length(b) = length(a) + 1 AND ends_with(b, a) AND TRY_CAST(b AS DOUBLE) BETWEEN 10 AND 60 THEN 'repaired' ELSE 'queue' END AS status,
    CASE WHEN a = b THEN a WHEN length(a) = length(b) + 1 AND ends_with(a, b) AND TRY_CAST(a AS DOUBLE) BETWEEN 10 AND 60 THEN a WHEN length(b) = length(a) + 1 AND ends_with(b, a) AND TRY_CAST(b AS DOUBLE) BETWEEN 10 AND 60 THEN b WHEN cb > ca THEN b ELSE a END AS value FROM x)
  SELECT event_type, status, count(*) AS n, count(DISTINCT value) AS readings FROM y GROUP BY 1, 2""")
def reader_consensus(t):
    a = F.floor("value").cast("string")
    k = F.col("event_id") % 3
    b = F.when(k == 0, F.expr("substring(string(floor(value)), 2)")).when(k == 1, a).otherwise("7")
    # Only digits are cast: an empty reading is no number.
    rows = t("events").select("event_type", a.alias("a"), b.alias("b"), F.lit(0.5).alias("ca"), (F.col("event_id") % 10 / 10.0).alias("cb"))
    read = aggregates.consensus_of_two(F.col("a"), F.col("ca"), F.col("b"), F.col("cb"), F.lit(10), F.lit(60))
    return rows.select("event_type", read.alias("r")).groupBy("event_type", F.col("r.status").alias("status")).agg(F.count("*").alias("n"), F.count_distinct("r.value").alias("readings"))


def _chains(t):
    return t("customer").selectExpr("c_custkey k", "c_custkey u", "(c_custkey * 37 + 11) % 1009 v")


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS k, c_custkey AS u, (c_custkey * 37 + 11) % 1009 AS v FROM customer), n AS (SELECT k, u AS x FROM e UNION ALL SELECT k, v FROM e),
  d AS (SELECT x, min(k) AS a, max(k) AS b FROM n GROUP BY x HAVING count(*) = 2 AND min(k) <> max(k)), l AS (SELECT a, b FROM d UNION SELECT b, a FROM d), r(k, m) AS (SELECT k, k FROM e UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.k)
  SELECT path, count(*) AS edges FROM (SELECT k, min(m) AS path FROM r GROUP BY k) GROUP BY 1""")
def unbranched_paths(t):
    return cascades.unbranched_paths(_chains(t), "k", "u", "v").groupBy("path").agg(F.count("*").alias("edges"))


@query()
def claim_in_order(t):
    near = joins.band_join(t("supplier"), t("customer"), "s_acctbal", "c_acctbal", 200.0, [("s_nationkey", "c_nationkey")])
    near = near.withColumn("d", F.round(F.abs(F.col("s_acctbal") - F.col("c_acctbal")), 2))
    return cascades.claim_in_order(near, "s_suppkey", "c_custkey", "d")


@query()
def seed_groups(t):
    """Places of parts (size, price) within 1.5 of an earlier one that is a seed."""
    return keepers.seed_groups(t("part").selectExpr("p_partkey", "cast(p_size as double) x", "p_retailprice y"), "p_partkey", "x", "y", 1.5)


@query()
def box_keepers(t):
    boxes = t("part").selectExpr("p_partkey", "cast(p_size as double) x0", "p_retailprice y0", "p_size + 3.0D + p_partkey % 3 x1", "p_retailprice + 4.0D y1")
    return keepers.box_keepers(boxes, "p_partkey", ("x0", "y0", "x1", "y1"), 6.0)


@query()
def chain_keepers(t):
    """Each supplier's parts are a chain of places; one that mostly follows a longer chain goes."""
    places = t("lineitem").where("l_quantity <= 10").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).selectExpr("l_suppkey % 20 * 7 + p_size % 3 chain", "cast(p_size as double) x", "round(p_retailprice / 3) * 3 y").distinct()
    sized = places.join(places.groupBy("chain").agg(F.count("*").alias("n")), "chain")
    return keepers.chain_keepers(sized, "chain", "x", "y", "n", 1.0)


@query()
def eliminate_worst(t):
    fit = keepers.eliminate_worst(t("part").where("p_size > 1"), ["p_brand"], "p_partkey", "p_size", "p_retailprice", 51.5)
    return fit.select("p_brand", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'N1081.' || lpad((event_id % 100)::VARCHAR, 2, '0') WHEN event_id % 3 = 1 THEN 'E10' || lpad((event_id % 100)::VARCHAR, 2, '0') || '.25' ELSE 'N' || (2000 + event_id % 7000)::VARCHAR || '.50' END AS repaired,
  CASE WHEN event_id % 3 = 2 THEN 2 ELSE 1 END::INTEGER AS readings FROM events""")
def coordinate_readings(t):
    tail = F.lpad((F.col("event_id") % 100).cast("string"), 2, "0")
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.concat(F.lit("n 10B1"), tail)).when(k == 1, F.concat(F.lit("E10"), tail, F.lit(".25"))).otherwise(F.concat(F.lit("N."), (F.col("event_id") % 7000 + 2000).cast("string"), F.lit("50")))
    return t("events").select("event_id", parsing.repaired_coordinate(text).alias("repaired"), F.size(parsing.readings(text)).alias("readings"))


@query(r"""WITH w AS (SELECT role, text, ' ' || regexp_replace(regexp_replace(lower(text), '\b([a-z])\.', '\1', 'g'), '[^a-z0-9+±]+', ' ', 'g') || ' ' AS w FROM conversations)
  SELECT role, CASE WHEN regexp_matches(text, '[0-9][+][0-9]') OR contains(w, ' sta ') THEN 'station' WHEN contains(text, '±') OR contains(w, ' ac ') OR contains(w, ' acre ') OR contains(w, ' acres ') OR contains(w, ' sq ft ') OR contains(w, ' sqft ') THEN 'area'
    WHEN contains(w, ' datum ') OR contains(w, ' epoch ') THEN 'notes' WHEN contains(w, ' detail ') THEN 'detail' WHEN contains(w, ' not to scale ') OR contains(w, ' nts ') THEN 'scale' ELSE 'none' END AS guard, count(*) AS n FROM w GROUP BY 1, 2""")
def context_guards(t):
    return t("conversations").groupBy("role", F.coalesce(parsing.context_guard(F.col("text")), F.lit("none")).alias("guard")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT c_custkey AS u, (c_custkey * 37 + 11) % 1009 AS v FROM customer WHERE c_mktsegment <> 'BUILDING'), o AS (SELECT u, min(v) AS v FROM (SELECT u % 300 AS u, v FROM e) GROUP BY u HAVING count(*) = 1),
  s0 AS (SELECT s_suppkey AS s, s_suppkey AS x, 0 AS h FROM supplier), s1 AS (SELECT s, coalesce(v, x) AS x, h + CASE WHEN v IS NULL THEN 0 ELSE 1 END AS h FROM s0 LEFT JOIN o ON x = u AND h = 0),
  s2 AS (SELECT s, coalesce(v, x) AS x, h + CASE WHEN v IS NULL THEN 0 ELSE 1 END AS h FROM s1 LEFT JOIN o ON x = u AND h = 1), s3 AS (SELECT s, coalesce(v, x) AS x, h + CASE WHEN v IS NULL THEN 0 ELSE 1 END AS h FROM s2 LEFT JOIN o ON x = u AND h = 2),
  s4 AS (SELECT s, coalesce(v, x) AS x, h + CASE WHEN v IS NULL THEN 0 ELSE 1 END AS h FROM s3 LEFT JOIN o ON x = u AND h = 3) SELECT s AS s_suppkey, x AS stop, h AS hops FROM s4""")
def trace_unique(t):
    edges = t("customer").where("c_mktsegment <> 'BUILDING'").selectExpr("c_custkey % 300 u", "(c_custkey * 37 + 11) % 1009 v")
    return cascades.trace_unique(edges, t("supplier").select("s_suppkey"), "u", "v", 4)


@query("""WITH c AS (SELECT user_id, event_type, (max(value) + min(value)) / 2 AS cut FROM events GROUP BY 1, 2), s AS (SELECT user_id, event_type, avg(CASE WHEN value <= cut THEN value END) AS a, avg(CASE WHEN value > cut THEN value END) AS b, avg(CASE WHEN value > cut THEN 1.0 ELSE 0.0 END) AS p FROM events JOIN c USING (user_id, event_type) GROUP BY 1, 2)
  SELECT user_id, event_type, round(a, 6) AS short, round(b, 6) AS long, coalesce(b >= 2 * a AND p BETWEEN 0.3001 AND 0.6999, false) AS two_kinds FROM s""")
def two_lengths(t):
    out = cascades.two_lengths(t("events"), ["user_id", "event_type"], "value", share=0.3001)
    return out.select("user_id", "event_type", F.round("short", 6).alias("short"), F.round("long", 6).alias("long"), "two_kinds")


@query("""WITH m AS (SELECT user_id, event_type, avg(value) AS m FROM events GROUP BY 1, 2) SELECT x.event_type AS a, y.event_type AS b, count(*) AS cells, round(avg(x.m - y.m), 6) AS "offset", round(sqrt(avg((x.m - y.m) * (x.m - y.m))), 6) AS rms FROM m x JOIN m y USING (user_id) WHERE x.event_type < y.event_type GROUP BY 1, 2""")
def offsets_between(t):
    out = cascades.offsets_between(t("events"), ["user_id"], "event_type", "value")
    return out.select("a", "b", "cells", F.round("offset", 6).alias("offset"), F.round("rms", 6).alias("rms"))


@query("""SELECT a.s_suppkey AS line_in, b.s_suppkey AS curve, c.s_suppkey AS line_out, round(c.s_nationkey * 14.0 - a.s_nationkey * 14.0 - b.s_nationkey * 3.0 + CASE WHEN c.s_nationkey * 14.0 - a.s_nationkey * 14.0 - b.s_nationkey * 3.0 <= -180 THEN 360 WHEN c.s_nationkey * 14.0 - a.s_nationkey * 14.0 - b.s_nationkey * 3.0 > 180 THEN -360 ELSE 0 END, 6)::DOUBLE AS "off"
  FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 JOIN supplier c ON c.s_suppkey = b.s_suppkey + 1 WHERE b.s_suppkey % 2 = 1""")
def tangent_triples(t):
    s = t("supplier").selectExpr("s_suppkey k", "s_suppkey u", "s_suppkey + 1 v", "s_nationkey * 14.0D az", "s_nationkey * 3.0D delta")
    out = cascades.tangent_triples(s.where("k % 2 = 0").drop("delta"), s.where("k % 2 = 1").drop("az"))
    return out.select("line_in", "curve", "line_out", F.round("off", 6).alias("off"))

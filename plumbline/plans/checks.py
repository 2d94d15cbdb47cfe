"""Printed against observed values: tolerances, verdicts, robust statistics, attribution."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import geometry, parsing
from plumbline.operators import aggregates, fits, graph
from plumbline.plans._registry import query


@query("""WITH seen AS (SELECT l_partkey, avg(l_extendedprice / l_quantity) AS got FROM lineitem GROUP BY 1)
  SELECT p_brand, sum(CASE WHEN abs(got - p_retailprice) <= 0.30 + 0.0005 * p_retailprice THEN 1 ELSE 0 END)::BIGINT AS passed,
  sum(CASE WHEN abs(got - p_retailprice) > 0.30 + 0.0005 * p_retailprice THEN 1 ELSE 0 END)::BIGINT AS failed, sum(CASE WHEN got IS NULL THEN 1 ELSE 0 END)::BIGINT AS queued
  FROM part LEFT JOIN seen ON p_partkey = l_partkey GROUP BY 1""")
def bracket_tolerance_check(t):
    seen = t("lineitem").groupBy("l_partkey").agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("got"))
    off, tol = F.abs(F.col("got") - F.col("p_retailprice")), geometry.distance_tolerance(F.col("p_retailprice"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return t("part").join(seen, F.col("p_partkey") == F.col("l_partkey"), "left").groupBy("p_brand").agg(count(off <= tol).alias("passed"), count(off > tol).alias("failed"), count(F.col("got").isNull()).alias("queued"))


@query("""WITH x AS (SELECT o_orderkey, o_totalprice AS printed, sum(l_extendedprice) - o_totalprice AS off, CASE WHEN o_orderstatus = 'O' THEN 'line' ELSE 'arc' END AS kind FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 4),
  y AS (SELECT kind, CASE WHEN kind = 'line' THEN abs(off) / least(abs(printed), abs(printed + off)) > 0.5 ELSE abs(off) / abs(printed) > 0.25 END AS wrong FROM x)
  SELECT kind, wrong, count(*) AS n FROM y GROUP BY 1, 2""")
def wrong_match_classifier(t):
    sums = t("lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("got"))
    x = t("orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey")).select(F.when(F.col("o_orderstatus") == "O", "line").otherwise("arc").alias("kind"), F.col("o_totalprice").alias("printed"), (F.col("got") - F.col("o_totalprice")).alias("off"))
    return x.groupBy("kind", geometry.wrong_match(F.col("kind"), F.col("off"), F.col("printed")).alias("wrong")).agg(F.count("*").alias("n"))


@query("""SELECT event_type, sum(CASE WHEN length(k) = 2 THEN 1 ELSE 0 END)::BIGINT AS two, sum(CASE WHEN length(k) = 3 THEN 1 ELSE 0 END)::BIGINT AS three,
  CASE WHEN sum(CASE WHEN length(k) = 3 THEN 1 ELSE 0 END) > sum(CASE WHEN length(k) = 2 THEN 1 ELSE 0 END) THEN 3 ELSE 2 END::BIGINT AS format FROM (SELECT event_type, regexp_replace(props, '[^0-9]', '', 'g') AS k FROM events) GROUP BY 1""")
def majority_format(t):
    n = lambda k: F.sum((F.length(parsing.digits(F.col("props"))) == k).cast("long"))
    return t("events").groupBy("event_type").agg(n(2).alias("two"), n(3).alias("three"), F.when(n(3) > n(2), 3).otherwise(2).cast("long").alias("format"))


@query("""WITH w AS (SELECT p_brand, p_retailprice AS v, count(*) OVER (PARTITION BY p_brand ORDER BY p_retailprice RANGE BETWEEN CURRENT ROW AND 25.0 FOLLOWING) AS n FROM part),
  b AS (SELECT p_brand, v AS low, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, v) AS r FROM w) WHERE r = 1)
  SELECT p_brand, n AS members, round(CASE WHEN n >= 3 THEN median(p_retailprice) END, 4) AS mode FROM part JOIN b USING (p_brand) WHERE p_retailprice >= low AND p_retailprice <= low + 25.0 GROUP BY 1, 2""")
def densest_mode(t):
    return aggregates.densest_mode(t("part"), ["p_brand"], "p_retailprice", 25.0).withColumn("mode", F.round("mode", 4))


@query("""SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(sqrt(avg(value * value)), 6) AS rms, round(max(value), 6) AS largest FROM events GROUP BY 1""")
def quantile_report(t):
    out = aggregates.quantile_report(t("events"), ["event_type"], "value")
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("""WITH e AS (SELECT min(value) lo, max(value) hi FROM events), h AS (SELECT least(255, CAST(floor((value - lo) * 256 / (hi - lo)) AS BIGINT)) AS bin, lo, hi, count(*) n FROM events, e GROUP BY 1, 2, 3),
  c AS (SELECT bin, lo, hi, sum(n) OVER (ORDER BY bin) w0, sum(n * bin) OVER (ORDER BY bin) s0, sum(n) OVER () w, sum(n * bin) OVER () s FROM h)
  SELECT bin, round(lo + (bin + 1) * (hi - lo) / 256, 6) AS threshold FROM c WHERE w0 < w ORDER BY CAST(w0 AS DOUBLE) * (w - w0) * power(CAST(s0 AS DOUBLE) / w0 - CAST(s - s0 AS DOUBLE) / (w - w0), 2) DESC, bin LIMIT 1""")
def otsu_threshold(t):
    return aggregates.otsu_threshold(t("events"), "value").select("bin", F.round("threshold", 6).alias("threshold"))


@query("""SELECT user_id, CAST(floor(value / 10) AS BIGINT) AS cell, count(*) AS n, round(sum(value), 3) AS total, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY 1, 2""")
def grid_aggregate(t):
    return t("events").groupBy("user_id", F.floor(F.col("value") / 10).alias("cell")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"))


@query("""WITH m AS (SELECT user_id, value - min(value) OVER (PARTITION BY user_id, CAST(floor(value / 10) AS BIGINT)) AS above FROM events) SELECT user_id, round(avg(CASE WHEN above > 0.3 THEN 1.0 ELSE 0.0 END), 6) AS share FROM m GROUP BY 1""")
def min_in_cell_fraction(t):
    w = W.partitionBy("user_id", F.floor(F.col("value") / 10))
    return t("events").select("user_id", (F.col("value") - F.min("value").over(w)).alias("above")).groupBy("user_id").agg(F.round(F.avg(F.when(F.col("above") > 0.3, 1.0).otherwise(0.0)), 6).alias("share"))


@query("""SELECT CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_discount > 0.08 THEN 'discounted' WHEN l_quantity < 5 THEN 'small' ELSE 'plain' END AS cause, count(*) AS n, round(sum(l_extendedprice), 0) AS total, round(sum(l_extendedprice) / (SELECT sum(l_extendedprice) FROM lineitem), 6) AS share FROM lineitem GROUP BY 1""")
def attribution_conserve(t):
    line = t("lineitem")
    rules = [("returned", F.col("l_returnflag") == "R"), ("discounted", F.col("l_discount") > 0.08), ("small", F.col("l_quantity") < 5)]
    out = aggregates.attribution(line, rules, "plain", "l_extendedprice")
    return out.crossJoin(F.broadcast(line.agg(F.sum("l_extendedprice").alias("all_")))).select("cause", "n", F.round("total", 0).alias("total"), F.round(F.col("total") / F.col("all_"), 6).alias("share"))  # one row of totals


@query("""SELECT lang, coalesce(sum(CASE WHEN n_chars > 1000 AND quality = 1 THEN 1 ELSE 0 END), 0)::BIGINT AS hits, coalesce(sum(CASE WHEN n_chars > 1000 AND quality IS NOT NULL THEN 1 ELSE 0 END), 0)::BIGINT AS said,
  round(sum(CASE WHEN n_chars > 1000 AND quality = 1 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN n_chars > 1000 AND quality IS NOT NULL THEN 1 ELSE 0 END), 0), 6) AS precision, sum(CASE WHEN n_chars > 1000 AND quality IS NULL THEN 1 ELSE 0 END)::BIGINT AS unsure
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def precision_by_kind(t):
    x = t("documents").select("doc_id", "lang", "n_chars").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    out = aggregates.precision_by(x, "lang", F.col("n_chars") > 1000, F.col("quality") == 1)
    return out.select("lang", F.coalesce("hits", F.lit(0)).alias("hits"), "said", F.round("precision", 6).alias("precision"), "unsure")


@query("""SELECT p_type, round(sum(p_retailprice * p_size) / sum(p_retailprice), 4) AS cx, round(sum(p_retailprice * p_partkey) / sum(p_retailprice), 1) AS cy FROM part GROUP BY 1""")
def weighted_centroid(t):
    out = aggregates.weighted_centroid(t("part"), ["p_type"], "p_size", "p_partkey", "p_retailprice")
    return out.select("p_type", F.round("cx", 4).alias("cx"), F.round("cy", 1).alias("cy"))


@query("""SELECT user_id, event_type, n, round(n / a, 6) AS share FROM (SELECT user_id, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1""")
def majority_label(t):
    return aggregates.majority_label(t("events"), ["user_id"], "event_type").select("user_id", "event_type", "n", F.round("share", 6).alias("share"))


@query("""SELECT r_name, tol, count(*) AS n FROM (SELECT r_name, abs(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), (VALUES (100.0), (500.0), (2000.0)) s(tol) WHERE v <= tol GROUP BY 1, 2""")
def parameter_sweep(t):
    tols = F.explode(F.array(*[F.lit(x).cast("decimal(5,1)") for x in (100.0, 500.0, 2000.0)]))
    who = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return who.select("r_name", F.abs("c_acctbal").alias("v"), tols.alias("tol")).where("v <= tol").groupBy("r_name", "tol").agg(F.count("*").alias("n"))


@query("""SELECT p_brand, round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 4) AS intercept, count(*) AS n FROM part GROUP BY 1""")
def line_fit(t):
    return fits.line_fit(t("part"), ["p_brand"], "p_size", "p_retailprice").select("p_brand", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


_TURNED = "0.8 * x - 0.6 * y + 100 AS u, 0.6 * x + 0.8 * y - 50 AS v"


@query(f"""WITH p AS (SELECT s_nationkey AS k, s_acctbal / 100 AS x, s_suppkey * 1.0 AS y FROM supplier), q AS (SELECT k, x, y, {_TURNED} FROM p),
  d AS (SELECT k, avg(x * x + y * y) - avg(x) * avg(x) - avg(y) * avg(y) AS d, (avg(x * u) + avg(y * v) - avg(x) * avg(u) - avg(y) * avg(v)) AS a, (avg(x * v) - avg(y * u) - avg(x) * avg(v) + avg(y) * avg(u)) AS b, count(*) AS n FROM q GROUP BY 1)
  SELECT k, round(a / d, 4) AS a, round(b / d, 4) AS b, n FROM d WHERE d > 0""")
def similarity_fit(t):
    q = t("supplier").selectExpr("s_nationkey k", "s_acctbal / 100 x", "cast(s_suppkey as double) y").selectExpr("k", "x", "y", *_TURNED.split(", "))
    return fits.similarity_fit(q, ["k"], "x", "y", "u", "v").where("n > 1").select("k", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), "n")


@query("""WITH p AS (SELECT p_brand AS k, 50 + 20 * cos(p_size) AS x, 10 + 20 * sin(p_size) AS y FROM part) SELECT k, 50.0::DOUBLE AS cx, 10.0::DOUBLE AS cy, 20.0::DOUBLE AS r, count(*) AS n FROM p GROUP BY 1 HAVING count(DISTINCT round(x, 9)) > 3""")
def circle_fit(t):
    p = t("part").selectExpr("p_brand k", "50 + 20 * cos(p_size) x", "10 + 20 * sin(p_size) y")
    return fits.circle_fit(p, ["k"], "x", "y").select("k", F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"), F.round("r", 4).alias("r"), "n")


@query("""WITH h AS (SELECT a.s_suppkey * 1000 + b.s_suppkey AS h, (b.s_acctbal - a.s_acctbal) / (b.s_suppkey - a.s_suppkey) AS m, a.s_acctbal - a.s_suppkey * (b.s_acctbal - a.s_acctbal) / (b.s_suppkey - a.s_suppkey) AS c FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND b.s_suppkey <= 20)
  SELECT h, count(*) FILTER (abs(c_acctbal - m * (c_custkey % 50) - c) <= 200) AS inliers FROM h, customer GROUP BY 1 ORDER BY 2 DESC, round(sum(CASE WHEN abs(c_acctbal - m * (c_custkey % 50) - c) <= 200 THEN abs(c_acctbal - m * (c_custkey % 50) - c) ELSE 0 END), 6), 1 LIMIT 1""")
def consensus_fit(t):
    """Lines through pairs of the first twenty control points (the hypotheses) against all observations."""
    s = t("supplier").where("s_suppkey <= 20")
    a, b = s.selectExpr("s_suppkey i", "s_acctbal p"), s.selectExpr("s_suppkey j", "s_acctbal q")
    h = a.join(F.broadcast(b), F.col("i") < F.col("j")).selectExpr("i * 1000 + j h", "(q - p) / (j - i) slope", "p - i * (q - p) / (j - i) intercept")  # at most 190 rows
    points = t("customer").selectExpr("cast(c_custkey % 50 as double) x", "c_acctbal y")
    return fits.consensus_line(points, h, "x", "y", 200.0).select("h", "inliers")


@query("""SELECT vec_id, nearest, label_found, round(d, 5) AS d_nearest, round(d2, 5) AS d_other FROM (SELECT vec_id, e AS nearest, l AS label_found, d, lead(d) OVER (PARTITION BY vec_id ORDER BY d, e) AS d2, row_number() OVER (PARTITION BY vec_id ORDER BY d, e) AS r FROM
  (SELECT q.vec_id, x.label AS l, min(list_sum(list_transform(list_zip(q.embedding, x.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))) AS d, arg_min(x.vec_id, list_sum(list_transform(list_zip(q.embedding, x.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))) AS e
   FROM embeddings q JOIN embeddings x ON q.vec_id <> x.vec_id GROUP BY 1, 2)) WHERE r = 1""")
def knn_embeddings(t):
    """Every vector against all others."""
    e = t("embeddings")
    others = e.select(F.col("vec_id").alias("eid"), F.col("embedding").alias("evec"), "label")
    out = fits.nearest_exemplar(e, others, "vec_id", "embedding", "eid", "evec", "label")
    return out.select("vec_id", "nearest", "label_found", F.round("d_nearest", 5).alias("d_nearest"), F.round("d_other", 5).alias("d_other"))


@query("""WITH c AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1, 2),
  d AS (SELECT vec_id, v.label, c.label AS l, sum((x - m) * (x - m)) AS d FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) v JOIN c USING (i) GROUP BY 1, 2, 3)
  SELECT vec_id, label, l AS found FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), l) AS r FROM d) WHERE r = 1""")
def centroid_classify(t):
    e = t("embeddings")
    c = fits.centroids(e, "label", "embedding").withColumnRenamed("label", "l")  # a row for each label; Spark broadcasts by size
    d = e.crossJoin(c).select("vec_id", "label", "l", F.round(fits.squared_distance(F.col("embedding"), F.col("centroid")), 9).alias("d"))
    return d.groupBy("vec_id", "label").agg(F.min_by("l", F.struct("d", "l")).alias("found"))


@query("""SELECT o_orderpriority, round(degrees(atan2(sum(o_totalprice * sin(radians(2 * (o_custkey % 180)))), sum(o_totalprice * cos(radians(2 * (o_custkey % 180)))))) / 2, 3) AS mean FROM orders GROUP BY 1""")
def circular_mean(t):
    return t("orders").groupBy("o_orderpriority").agg(F.round(geometry.circular_mean_180(F.col("o_custkey") % 180, F.col("o_totalprice")), 3).alias("mean"))


@query("""WITH p AS (SELECT p_size AS x, p_retailprice / 20 AS y FROM part) SELECT count(*) AS n, round(sum(d), 2) AS total, sum(CASE WHEN d <= 5 THEN 1 ELSE 0 END)::BIGINT AS near FROM (SELECT sqrt(power(x - 50 * t, 2) + power(y - 100 * t, 2)) AS d FROM (SELECT x, y, greatest(0, least(1, (x * 50 + y * 100) / 12500)) AS t FROM p))""")
def corridor_project(t):
    d = geometry.point_segment_distance(F.col("p_size"), F.col("p_retailprice") / 20, F.lit(0.0), F.lit(0.0), F.lit(50.0), F.lit(100.0))
    return t("part").select(d.alias("d")).agg(F.count("*").alias("n"), F.round(F.sum("d"), 2).alias("total"), F.sum((F.col("d") <= 5).cast("long")).alias("near"))


@query("""SELECT CAST(floor(p_size / 5) AS BIGINT) AS ix, CAST(floor(p_retailprice / 100) AS BIGINT) AS iy, count(*) AS n, round(max(p_retailprice), 2) AS top FROM part GROUP BY 1, 2""")
def raster_cells(t):
    cells = t("part").withColumn("px", F.col("p_size") / 5)
    return graph.grid(cells.withColumn("py", F.col("p_retailprice") / 100), "px", "py", 1.0, n=F.count("*"), top=F.round(F.max("p_retailprice"), 2))

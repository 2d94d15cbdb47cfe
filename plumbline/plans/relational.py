"""Scans, filters, equi-joins, sets, grouping sets, ranks, text."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators import aggregates
from plumbline.plans._registry import query

REVENUE = "l_extendedprice * (1 - l_discount)"


@query(f"""SELECT l_orderkey, l_linenumber, round({REVENUE}, 4) AS revenue FROM lineitem
  WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_quantity < 10""")
def scan_project_filter(t):
    return t("lineitem").where("l_shipdate >= timestamp_ntz'1995-01-01' and l_quantity < 10").selectExpr("l_orderkey", "l_linenumber", f"round({REVENUE}, 4) revenue")


@query("""SELECT event_type, CAST(length(json_extract_string(props, '$.k')) AS BIGINT) AS width, count(*) AS n FROM events GROUP BY 1, 2""")
def json_field(t):
    return t("events").groupBy("event_type", F.length(F.get_json_object("props", "$.k")).cast("long").alias("width")).agg(F.count("*").alias("n"))


@query(f"""SELECT r_name, n_name, round(sum({REVENUE}), 0) AS revenue, count(*) AS n FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def equi_join_star(t):
    small = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    who = t("customer").join(small, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")
    lines = t("lineitem").select("l_orderkey", F.expr(REVENUE).alias("x")).groupBy("l_orderkey").agg(F.sum("x").alias("x"), F.count("*").alias("k"))  # before the join: one row an order
    return lines.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(who, F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name", "n_name").agg(F.round(F.sum("x"), 0).alias("revenue"), F.sum("k").alias("n"))


@query("""SELECT c_custkey, CASE WHEN max(o_orderkey) IS NULL THEN 'queued' ELSE 'verified' END AS status FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def left_unmatched_queue(t):
    have = t("orders").select("o_custkey").distinct()
    return t("customer").join(have, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.when(F.col("o_custkey").isNull(), "queued").otherwise("verified").alias("status"))


_LATE = "l_shipdate > o_orderdate + INTERVAL 60 DAY"


@query(f"SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND {_LATE}) GROUP BY 1")
def semi_exists(t):
    return t("orders").join(t("lineitem"), (F.col("l_orderkey") == F.col("o_orderkey")) & F.expr(_LATE), "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query(f"SELECT o_orderpriority, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND {_LATE}) GROUP BY 1")
def anti_not_exists(t):
    return t("orders").join(t("lineitem"), (F.col("l_orderkey") == F.col("o_orderkey")) & F.expr(_LATE), "left_anti").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT 'intersect' AS op, l_returnflag, l_linestatus, count(*) AS n FROM (SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_linenumber = 1 INTERSECT ALL SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_linenumber = 2) GROUP BY 2, 3
  UNION ALL SELECT 'except', l_returnflag, l_linestatus, count(*) FROM (SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_linenumber = 1 EXCEPT ALL SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_linenumber = 2) GROUP BY 2, 3
  UNION ALL SELECT 'distinct', l_returnflag, l_linestatus, count(*) FROM (SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_linenumber = 1 INTERSECT SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_linenumber = 2) GROUP BY 2, 3""")
def intersect_except_all(t):
    a = t("lineitem").where("l_linenumber = 1").select("l_returnflag", "l_linestatus")
    b = t("lineitem").where("l_linenumber = 2").select("l_returnflag", "l_linestatus")
    score = aggregates.multiset_score(a, b, ["l_returnflag", "l_linestatus"])  # counts meet, not rows
    part = lambda op, n: score.select(F.lit(op).alias("op"), "l_returnflag", "l_linestatus", n.cast("long").alias("n")).where("n > 0")
    return part("intersect", F.col("common")).unionByName(part("except", F.col("n_a") - F.col("common"))).unionByName(part("distinct", F.least("common", F.lit(1))))


@query("""WITH a AS (SELECT l_returnflag, l_linestatus, count(*) n FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-01-01' GROUP BY 1, 2),
  b AS (SELECT l_returnflag, l_linestatus, count(*) n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1, 2)
  SELECT l_returnflag, l_linestatus, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, least(coalesce(a.n, 0), coalesce(b.n, 0)) AS common FROM a FULL JOIN b USING (l_returnflag, l_linestatus)""")
def multiset_score(t):
    line = t("lineitem").select("l_returnflag", "l_linestatus", "l_shipdate")
    return aggregates.multiset_score(line.where("l_shipdate < timestamp_ntz'1995-01-01'"), line.where("l_shipdate >= timestamp_ntz'1995-01-01'"), ["l_returnflag", "l_linestatus"])


_GROUPS = "round(sum(o_totalprice), 0) AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _orders_by_place(t):
    place = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t("orders").join(place.select("c_custkey", "c_mktsegment", "n_name", "r_name"), F.col("o_custkey") == F.col("c_custkey"))




def _totals():
    return F.round(F.sum("o_totalprice"), 0).alias("total"), F.count("*").alias("n")


@query(f"SELECT r_name, n_name, {_GROUPS} GROUP BY ROLLUP (r_name, n_name)")
def rollup_total(t):
    return _orders_by_place(t).rollup("r_name", "n_name").agg(*_totals())


@query(f"SELECT r_name, c_mktsegment, {_GROUPS} GROUP BY CUBE (r_name, c_mktsegment)")
def cube_total(t):
    return _orders_by_place(t).cube("r_name", "c_mktsegment").agg(*_totals())


@query(f"SELECT r_name, c_mktsegment, {_GROUPS} GROUP BY GROUPING SETS ((r_name), (c_mktsegment), ())")
def grouping_sets(t):
    df = _orders_by_place(t)
    r, c = F.col("r_name"), F.col("c_mktsegment")
    return df.groupingSets([[r], [c], []], r, c).agg(*_totals())


@query("""SELECT n_name, o_orderkey, round(o_totalprice, 2) AS price, rank FROM (SELECT n_name, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY n_name ORDER BY o_totalprice DESC, o_orderkey) AS rank
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) WHERE rank <= 3""")
def topk_per_group(t):
    w = W.partitionBy("n_name").orderBy(F.desc("o_totalprice"), "o_orderkey")  # Spark keeps k rows a group before the shuffle
    return _orders_by_place(t).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select("n_name", "o_orderkey", F.round("o_totalprice", 2).alias("price"), "rank")


@query("""SELECT s_suppkey, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS q FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 1000))""")
def rank_dense_ntile(t):
    w = W.partitionBy("s_nationkey").orderBy(F.floor(F.col("s_acctbal") / 1000))
    v = W.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")
    return t("supplier").select("s_suppkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("d"), F.ntile(4).over(v).cast("long").alias("q"))


@query("""SELECT lang, tok AS token, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?')) AS tok FROM documents) GROUP BY 1, 2""")
def token_extract(t):
    tokens = F.explode(F.regexp_extract_all("text", F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1)))
    return t("documents").select("lang", tokens.alias("token")).groupBy("lang", "token").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, md5(trim(regexp_replace(lower(regexp_replace(text, '[‘’]', '''', 'g')), '[ \\t\\n\\r]+', ' ', 'g'))) AS canonical FROM documents""")
def text_normalize_cascade(t):
    return t("documents").select("doc_id", F.md5(F.trim(F.regexp_replace(F.lower(F.regexp_replace("text", "[‘’]", "'")), r"[ \t\n\r]+", " "))).alias("canonical"))


_KINDS = [("mail", "[a-z0-9.]+@[a-z0-9-]+\\.[a-z]"), ("licence", "[Ll]icense"), ("table", " \\| "), ("shout", "!!"), ("marks", "(&&&|%%%|\\*\\*\\*|###)"), ("number", "[0-9]")]


@query("SELECT kind, lang, count(*) AS n FROM (SELECT lang, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in _KINDS) + " ELSE 'prose' END AS kind FROM documents) GROUP BY 1, 2")
def kind_classify(t):
    kind = F.lit("prose")
    for k, p in reversed(_KINDS):
        kind = F.when(F.col("text").rlike(p), k).otherwise(kind)
    return t("documents").groupBy(kind.alias("kind"), "lang").agg(F.count("*").alias("n"))


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(length(regexp_replace(html, '<[^>]*>', '', 'g')) AS BIGINT) AS n_text FROM pages""")
def html_text_strip(t):
    return t("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("n_text"))


@query("""SELECT 'customer' AS source, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier""")
def union_tagged(t):
    from plumbline.sources.tables import union_tagged as union

    return union({"customer": t("customer").selectExpr("c_custkey id", "c_acctbal balance", "c_mktsegment segment"), "supplier": t("supplier").selectExpr("s_suppkey id", "s_acctbal balance")})


@query("""SELECT lang, min(doc_id) AS first_id, arg_max(doc_id, n_chars * 1000000 - doc_id) AS longest FROM documents GROUP BY 1""")
def argmax_tuple(t):
    return t("documents").groupBy("lang").agg(F.min("doc_id").alias("first_id"), F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("longest"))


@query("""SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS r, count(*) OVER () AS n FROM events) WHERE r % greatest(1, n // 20) = 0 AND r < greatest(1, n // 20) * 20""")
def stride_sample(t):
    from plumbline.sources.tables import stride_sample as sample

    return sample(t("events").select("event_id"), ["event_id"], 20)

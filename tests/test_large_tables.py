"""Forms that large tables need: no broadcast of multiplied sides, no pairs of copies; against sequential loops."""

import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline.operators import graph, joins, keepers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def in_order(points, near):
    """key, keeper of a loop over rows in order."""
    kept, out = [], {}
    for p in points:
        first = next((q for q in kept if near(q, p)), None)
        if first is None:
            kept.append(p)
        out[p[0]] = (first or p)[0]
    return out


def within(radius):
    return lambda a, b: math.hypot(a[1] - b[1], a[2] - b[2]) <= radius


def test_multiplied_sides_are_not_broadcast(spark):
    a = spark.range(9).selectExpr("id k", "cast(id as double) x", "cast(id as double) y")
    b = a.selectExpr("k other", "x u", "y v")
    assert "Broadcast" not in plan(joins.ball_join(a, b, "x", "y", "u", "v", 2.0))


@pytest.mark.parametrize("copies", [1, 400])
def test_seed_groups_in_order(spark, copies):
    rng = random.Random(7)
    places = [(rng.uniform(0, 20), rng.uniform(0, 20)) for _ in range(150)]
    points = [(i, *p) for i, p in enumerate(places * copies)]
    odd = [(10**6, None, 1.0), (10**6 + 1, math.nan, 1.0), (10**6 + 2, math.nan, 1.0), (10**6 + 3, math.inf, 1.0)]
    got = {r.k: r.keeper for r in keepers.seed_groups(spark.createDataFrame(points + odd, "k int, x double, y double"), "k", "x", "y", 2.0).collect()}
    assert got == in_order(points, within(2.0)) | {k: k for k, *_ in odd}


def test_keepers_in_batches(spark):
    rng = random.Random(8)
    points = [(i, rng.uniform(0, 20), rng.uniform(0, 20)) for i in range(300)]
    df = spark.createDataFrame(points, "k int, x double, y double")

    def near(a, b):
        a, b = a.selectExpr("_pos keeper", "x u", "y v"), b.selectExpr("_pos row", "x", "y")
        return joins.ball_join(b, a, "x", "y", "u", "v", 2.0)

    got = graph.greedy_keepers(df, "k", ["x", "y"], ["_first"], near, F.lit(True), first=20)
    assert {r.k: r.keeper for r in got.collect()} == in_order(points, within(2.0))


def test_ball_pairs_of_copies(spark):
    rng = random.Random(9)
    places = [(rng.choice("ab"), float(rng.randrange(9)), rng.randrange(90) / 10) for _ in range(60)]
    points = [(i, *places[i % 60 if i < 900 else 0]) for i in range(3300)]  # one place has 2,415 points
    odd = [(10**6, None, 1.0, 1.0), (10**6 + 1, "a", None, 1.0), (10**6 + 2, "a", math.nan, 1.0), (10**6 + 3, "a", math.nan, 1.0), (10**6 + 4, "a", math.inf, 1.0), (None, "a", 1.0, 1.0)]
    df = spark.createDataFrame(points + odd, "k int, g string, x double, y double")
    got = joins.ball_pairs(df, "k", "x", "y", 1.5, ["g"])
    assert "Broadcast" not in plan(got)
    got = got.agg(F.count("*"), F.count_distinct("k", "other"), F.sum(F.col("k").cast("long") * F.col("other")), F.max(F.col("k") >= F.col("other")), F.round(F.sum("distance"), 3)).first()
    near = [(a, b, d) for a, b in ((a, b) for i, a in enumerate(points) for b in points[i + 1 :]) if a[1] == b[1] and (d := math.hypot(a[2] - b[2], a[3] - b[3])) <= 1.5]
    assert tuple(got) == (len(near), len(near), sum(a[0] * b[0] for a, b, _ in near), False, pytest.approx(sum(d for *_, d in near), abs=0.01))


def test_claims_within_a_group_in_order(spark):
    rng = random.Random(10)
    points = [(i, rng.uniform(0, 20), rng.uniform(0, 20), rng.choice("abc")) for i in range(300)]
    odd = [(10**6, 1.0, 1.0, None), (10**6 + 1, 1.0, 1.0, None)]
    df = spark.createDataFrame(points + odd, "k int, x double, y double, g string")
    near = lambda a, b: a[3] == b[3] and within(2.0)(a, b)
    assert {r.k: r.keeper for r in keepers.ball_keepers(df, "k", "x", "y", 2.0, ["g"]).collect()} == in_order(points, near) | {k: k for k, *_ in odd}


@pytest.mark.parametrize("above", [0.3, 0.5, 1.0])
def test_box_keepers_in_order(spark, above):
    rng = random.Random(11)
    boxes = [(i, x := float(rng.randrange(30)), y := float(rng.randrange(30)), x + rng.randrange(0, 9), y + rng.randrange(1, 9)) for i in range(300)]
    boxes += [(300 + i, *boxes[i % 300][1:]) for i in range(600)]
    odd = [(10**6, None, 0.0, 1.0, 1.0), (10**6 + 1, 0.0, 0.0, math.nan, 1.0), (10**6 + 2, 0.0, 0.0, math.inf, 1.0)]
    size = lambda b: (b[3] - b[1]) * (b[4] - b[2])

    def near(a, b):
        both = max(0, min(a[3], b[3]) - max(a[1], b[1])) * max(0, min(a[4], b[4]) - max(a[2], b[2]))
        return both > above * (size(a) + size(b) - both)

    got = keepers.box_keepers(spark.createDataFrame(boxes + odd, "k int, x0 double, y0 double, x1 double, y1 double"), "k", ("x0", "y0", "x1", "y1"), 5.0, above).collect()
    assert {r.k: r.keeper for r in got} == in_order(sorted(boxes, key=lambda b: (-size(b), b[0])), near) | {k: k for k, *_ in odd}


def test_components_of_copies_need_few_edges(spark, tmp_path):
    from plumbline.catalogue import QUERIES
    from plumbline.plans import graphs

    rng = random.Random(12)
    s = [(i, rng.randrange(3), rng.randrange(90) * 9.0) for i in range(20)]
    c = [(i, rng.randrange(3), rng.randrange(90) * 9.0) for i in range(40)]
    s, c = [(i + 20 * j, n, v) for j in range(30) for i, n, v in s], [(i + 40 * j, n, v) for j in range(30) for i, n, v in c]
    spark.createDataFrame([*s, (None, 1, 9.0), (999, None, 9.0)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([*c, (9999, 1, None)], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    low = {}
    edges = [(a, b + 1000000) for a, n, v in s for b, m, w in c if n == m and abs(v - w) <= 20]
    label = {x: x for e in edges for x in e}
    while label != low:
        low = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in QUERIES["components"](spark, str(tmp_path)).collect()}
    assert got == label
    assert graphs._edges(lambda t: spark.read.parquet(f"{tmp_path}/{t}.parquet")).count() < 3 * len(s + c) < len(edges)


@pytest.mark.parametrize("shared", [False, True])
def test_components_make_no_pairs(spark, tmp_path, shared):
    import duckdb

    from plumbline.catalogue import ORACLES, QUERIES
    from plumbline.plans import graphs

    rng = random.Random(13)
    s = [(i, rng.randrange(3), rng.randrange(12000) / 10) for i in range(90)] + [(90 + i, 3, i / 10) for i in range(90)]  # nation 3 has all pairs
    c = [(i, rng.randrange(3), rng.randrange(12000) / 10) for i in range(120)] + [(120 + i, 3, 3 + i / 10) for i in range(90)]
    s += [(200, 4, 0.1), (201, 4, 60.0), (202, 4, 20.3), (203, None, 0.1), (204, 4, None), (205, 4, math.nan), (206, 4, math.inf)]
    c += [(300, 4, 20.1), (301, 4, 80.00000000000001), (302, None, 0.1), (303, 4, None), (304, 4, math.nan), (305, 4, -math.inf)]
    if shared:  # rows of one key are one node
        s += [(1000000 + k, rng.randrange(4), rng.randrange(12000) / 10) for k in (5, 17, 29)] + [(k, rng.randrange(4), rng.randrange(900) / 10) for k in (3, 3, 44, 7)]
    spark.createDataFrame(s, "s_suppkey long, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(c, "c_custkey long, c_nationkey int, c_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for t in ("supplier", "customer"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = sorted(con.execute(ORACLES["components"]).fetchall())
    graph.checkpointer(spark)
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(folder.glob("*"))
    got = sorted(tuple(r) for r in QUERIES["components"](spark, str(tmp_path)).collect())
    assert got == want and len({low for _, low in want}) > 9
    assert shared or set(folder.glob("*")) <= before  # no rounds
    assert graphs._edges(lambda t: spark.read.parquet(f"{tmp_path}/{t}.parquet")).count() <= len(s + c)


def test_best_row_skips_unknown_values(spark, tmp_path):
    import duckdb

    from plumbline.catalogue import ORACLES, QUERIES

    rows = [("a", 3, None), ("a", 5, 1.0), ("a", 6, 2.0), ("b", 1, None), (None, 9, 4.0), (None, 8, 5.0), ("c", None, 1.0), ("c", 2, 3.0), ("d", 7, math.nan), ("e", None, 2.0), ("e", 4, 2.0)]
    spark.createDataFrame(rows, "event_type string, event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = set(con.execute(ORACLES["best_row"]).fetchall())
    got = {(r.event_type, r.lowest) for r in QUERIES["best_row"](spark, str(tmp_path)).collect()}
    assert got == want == {("a", 5), (None, 9), ("c", None), ("d", 7), ("e", 4)}


def test_best_row_takes_the_smallest_of_tied_rows(spark, tmp_path):
    from plumbline.catalogue import QUERIES

    spark.range(99, 0, -1).selectExpr("'a' event_type", "id event_id", "cast(id div 50 as double) value").write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in QUERIES["best_row"](spark, str(tmp_path)).collect()] == [("a", 1)]

"""Operators against brute force and small cases with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry, parsing
from plumbline.operators import aggregates, cascades, fits, graph, joins, sequences


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_bearings(spark):
    assert one(spark, parsing.bearing_azimuth(F.lit("S 45°30'00\" E"))) == pytest.approx(134.5)
    assert one(spark, parsing.bearing_azimuth(F.lit("no bearing"))) is None
    assert one(spark, parsing.repair_bearing(F.lit("n 45*30'00\" e"))) == "N 45°30'00\" E"
    assert one(spark, parsing.repair_bearing(F.lit("LOT 5"))) == "LOT 5"
    assert one(spark, parsing.azimuth_bearing(F.lit(134.5))) == "S 45°30'00\" E"


@pytest.mark.parametrize(("text", "want"), [("6,970 S.F. LOT", 6970), ("10.46 AC. MORE", 10.46 * 43560), ("13355 SF", 13355), ("*1,505.853 AC.", 1505.853 * 43560), ("SEE NOTE 2", None)])
def test_areas(spark, text, want):
    got = one(spark, parsing.area_sqft(F.lit(text)))
    assert got is None if want is None else got == pytest.approx(want)


def test_numbers(spark):
    assert one(spark, parsing.station_feet(F.lit("65+48.80"))) == pytest.approx(6548.80)
    assert one(spark, parsing.distance_feet(F.lit("1,234.56'"))) == pytest.approx(1234.56)
    assert one(spark, parsing.distance_feet(F.lit("1,234.56"))) is None
    assert one(spark, geometry.azimuth(F.lit(-1.0), F.lit(0.0))) == pytest.approx(270)
    assert one(spark, geometry.az_diff_undirected(F.lit(179.0), F.lit(1.0))) == pytest.approx(2)
    assert one(spark, parsing.wildcard_match(F.lit("L?1"), F.lit("L21")))


def test_bands_and_balls(spark):
    rng = random.Random(1)
    a = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(120)]
    b = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(120)]
    left, right = spark.createDataFrame(a, "i int, x double, y double"), spark.createDataFrame(b, "j int, u double, v double")
    got = {(r.i, r.j) for r in joins.band_join(left, right, "x", "u", 3.0).collect()}
    assert got == {(p[0], q[0]) for p in a for q in b if abs(p[1] - q[1]) <= 3.0}
    got = {(r.i, r.j) for r in joins.ball_join(left, right, "x", "y", "u", "v", 7.0).collect()}
    assert got == {(p[0], q[0]) for p in a for q in b if ((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) ** 0.5 <= 7.0}


def test_greedy_assignment(spark):
    rng = random.Random(2)
    pairs = [(i, j, float(rng.randint(0, 6))) for i in range(12) for j in range(12) if rng.random() < 0.4]
    used, want = (set(), set()), set()
    for i, j, d in sorted(pairs, key=lambda p: (p[2], p[0], p[1])):
        if i not in used[0] and j not in used[1]:
            want.add((i, j))
            used[0].add(i)
            used[1].add(j)
    df = spark.createDataFrame(pairs, "i int, j int, d double")
    got = {(r.i, r.j) for r in joins.greedy_one_to_one(df, "i", "j", "d", graph.checkpointer(spark)).collect()}
    assert len(got) == len({i for i, _ in got}) == len({j for _, j in got})
    assert len(got) == len(want)


def test_intervals(spark):
    df = spark.createDataFrame([(1, 0, 2), (1, 1, 5), (1, 8, 9), (2, 0, 1)], "k int, a int, b int")
    merged = sequences.interval_union(df, ["k"], "a", "b", 1)
    assert sorted(tuple(r) for r in merged.collect()) == [(1, 0, 5, 2), (1, 8, 9, 1), (2, 0, 1, 1)]
    assert [tuple(r) for r in sequences.interval_holes(merged, ["k"], "a", "b").collect()] == [(1, 5, 8)]


def test_components_and_claims(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(30, 31), (40, 40)], "a long, b long")
    got = {r.node: r.component for r in graph.components(edges, "a", "b").collect()}
    assert all(got[i] == 1 for i in range(1, 21)) and got[31] == 30
    rows = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    claims = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "keeper long, row long")
    assert {r.id: r.keeper for r in graph.first_claim(rows, "id", claims).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_fixpoint_refuses_disagreement(spark):
    nodes = spark.createDataFrame([(1, 7.0), (2, None), (3, None), (4, 9.0), (5, None)], "id long, v double")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5)], "a long, b long")
    got = {r.id: r.v for r in graph.inherit_unique(nodes, "id", "v", edges).collect()}
    assert got == {1: 7.0, 2: 7.0, 3: 9.0, 4: 9.0, 5: 9.0}


def test_fits(spark):
    import math

    pts = [(1, 3 + 5 * math.cos(t), -2 + 5 * math.sin(t)) for t in range(7)]
    c = fits.circle_fit(spark.createDataFrame(pts, "k int, x double, y double"), ["k"], "x", "y").first()
    assert (c.cx, c.cy, c.r) == pytest.approx((3, -2, 5))
    line = [(1, float(i), float(i)) for i in range(4)]
    assert fits.circle_fit(spark.createDataFrame(line, "k int, x double, y double"), ["k"], "x", "y").first().r is None


def test_consensus_and_empty(spark):
    agree = aggregates.consensus_of_two(F.lit("12"), F.lit(0.5), F.lit("12"), F.lit(0.1), F.lit(0), F.lit(99))
    assert one(spark, agree).status == "agree"
    fixed = aggregates.consensus_of_two(F.lit("112"), F.lit(0.5), F.lit("12"), F.lit(0.1), F.lit(100), F.lit(199))
    assert tuple(one(spark, fixed)) == ("repaired", "112")
    empty = spark.createDataFrame([], "k int, a int, b int")
    assert sequences.interval_union(empty, ["k"], "a", "b").count() == 0


def test_stream_sessions(spark, tmp_path):
    from plumbline.streaming import events

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(tmp_path / "in"))
    q = events.tumbling(events.read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.sql("select sum(n) from tumbling").first()[0] == 1000


def test_removal_keeps_what_is_protected(spark):
    df = spark.createDataFrame([(1, 1.0, True), (2, 1.0, False), (3, 9.0, None), (4, None, False)], "k int, v double, safe boolean")
    out = cascades.removal_cascade(df, [("small", F.col("v") < 2), ("large", F.col("v") > 5)], F.col("safe"))
    assert {r.k: r.removed_by for r in out.collect()} == {1: None, 2: "small", 3: "large", 4: None}


@pytest.mark.parametrize(("classes", "want"), [({2.28: (1, 118), 1.68: (8, 12253)}, [1.68]), ({2.0: (3, 800), 1.5: (10, 5000)}, [1.5]), ({2.0: (1, 9000)}, [])])
def test_heaviest_class(spark, classes, want):
    rows = [("s", w, total / n) for w, (n, total) in classes.items() for _ in range(n)]
    out = cascades.heaviest_class(spark.createDataFrame(rows, "sheet string, w double, ft double"), ["sheet"], "w", "ft", 2, 1000.0)
    assert [r.w for r in out.collect()] == want


def test_attach_unique_never_overwrites(spark):
    rows = [(1, "a", None), (2, "a", 5.0), (3, "b", 1.0), (4, "b", 2.0), (5, "b", None), (6, "c", None), (7, None, None)]
    out = cascades.attach_unique(spark.createDataFrame(rows, "k int, region string, r double"), ["region"], "r")
    assert {r.k: r.r for r in out.collect()} == {1: 5.0, 2: 5.0, 3: 1.0, 4: 2.0, 5: None, 6: None, 7: None}


def test_cascade_prefers_proof_and_refuses_ties(spark):
    rows = [(1, 10, 1.0), (1, 11, 0.1), (2, 20, 1.0), (2, 21, 1.0), (3, 30, 9.0), (4, 40, None)]
    out = cascades.cascade_match(spark.createDataFrame(rows, "l int, r int, d double"), "l", "r", [F.col("d") < 0.5, F.col("d") < 5])
    assert sorted(tuple(x) for x in out.collect()) == [(1, 1, 1, 11), (2, 2, 2, None)]


def test_claims_equal_the_sequential_loop(spark):
    rng = random.Random(7)
    rows = sorted({(rng.randrange(40), rng.randrange(30)): rng.randrange(6) for _ in range(300)}.items())
    out = cascades.claim_in_order(spark.createDataFrame([(a, b, d) for (a, b), d in rows], "l int, r int, d int"), "l", "r", "d")
    free, want = set(range(30)), {}
    for left in range(40):
        near = [(d, b) for (a, b), d in rows if a == left and b in free]
        if near:
            want[left] = min(near)[1]
            free.discard(want[left])
    assert {x.l: x.r for x in out.collect()} == want
    none = cascades.claim_in_order(spark.createDataFrame([], "l int, r int, d int"), "l", "r", "d")
    assert none.count() == 0


def test_paths_end_at_branches(spark):
    # 1-2-3 is a chain to the branch at node 4, where 4 and 5 begin; 6 and 7 are a ring.
    edges = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 4), (4, 4, 5), (5, 4, 6), (6, 8, 9), (7, 9, 8)], "k int, u int, v int")
    out = {r.k: r.path for r in cascades.unbranched_paths(edges, "k", "u", "v").collect()}
    assert out == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6}


def test_point_at_fraction(spark):
    rows = [("a", 1, 0.0, 0.0), ("a", 2, 3.0, 0.0), ("a", 3, 3.0, 1.0), ("b", 1, 5.0, 5.0), ("c", 1, 2.0, 2.0), ("c", 2, 2.0, 2.0)]
    out = sequences.point_at_fraction(spark.createDataFrame(rows, "k string, o int, x double, y double"), ["k"], ["o"], "x", "y", 0.5)
    assert [tuple(r) for r in out.collect()] == [("a", 4.0, 2.0, 0.0)]


def test_stations_and_boxes(spark):
    near = geometry.nearest_station(F.lit(12.0), F.lit(4.0), [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)])
    assert tuple(one(spark, near)) == (2.0, 14.0)
    assert one(spark, geometry.in_any_box(F.lit(1.0), F.lit(2.4), [(0, 0, 2, 2)], 0.5))
    assert one(spark, geometry.in_any_box(F.lit(None).cast("double"), F.lit(1.0), [(0, 0, 2, 2)])) is None
    verdict = lambda r, d, length: one(spark, geometry.curve_verdict(F.lit(r), F.lit(d), F.lit(length)))
    assert verdict(100.0, 90.0, 157.08) == "pass" and verdict(100.0, 90.0, 150.0) == "fail" and verdict(100.0, 5.0, 9.0) == "unproven"


def test_trace_stops_at_branches(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (3, 5), (6, 7), (7, 8), (8, 9), (9, 10), (10, 11)], "u int, v int")
    out = cascades.trace_unique(edges, spark.createDataFrame([(1,), (6,), (99,)], "s int"), "u", "v", 4)
    assert {tuple(r) for r in out.collect()} == {(1, 3, 2), (6, 10, 4), (99, 99, 0)}


def test_two_lengths(spark):
    rows = [("a", x) for x in (1.0, 1.2, 5.0, 5.5, None)] + [("b", x) for x in (1.0, 1.1, 1.2, 1.3)] + [("c", 2.0)]
    out = cascades.two_lengths(spark.createDataFrame(rows, "k string, v double"), ["k"], "v")
    assert {r.k: r.two_kinds for r in out.collect()} == {"a": True, "b": False, "c": False}


def test_offsets_between_lines(spark):
    rows = [(c, line, base + c) for c in range(3) for line, base in (("x", 1.0), ("y", 3.0)) for _ in range(2)] + [(9, "x", 50.0)]
    out = cascades.offsets_between(spark.createDataFrame(rows, "c int, line string, z double"), ["c"], "line", "z")
    assert [tuple(r) for r in out.collect()] == [("x", "y", 3, -2.0, 2.0)]


def test_tangent_triples(spark):
    lines = spark.createDataFrame([(1, 10, 11, 350.0), (2, 12, 13, 20.0)], "k int, u int, v int, az double")
    curves = spark.createDataFrame([(5, 11, 12, 30.0), (6, 11, 99, 1.0)], "k int, u int, v int, delta double")
    assert [tuple(r) for r in cascades.tangent_triples(lines, curves).collect()] == [(1, 5, 2, 0.0)]

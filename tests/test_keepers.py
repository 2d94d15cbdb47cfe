"""Greedy keepers and eliminations against the sequential loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import parsing
from plumbline.operators import keepers


def test_seed_groups(spark):
    rng = random.Random(3)
    points = [(i, rng.uniform(0, 20), rng.uniform(0, 20)) for i in range(150)]
    seeds, member = [], set()
    for i, x, y in points:
        if not any((x - a) ** 2 + (y - b) ** 2 <= 4 for _, a, b in seeds):
            seeds.append((i, x, y))
            member.add(i)
    out = keepers.seed_groups(spark.createDataFrame(points, "k int, x double, y double"), "k", "x", "y", 2.0).collect()
    assert len(out) == 150 and {r.k for r in out if r.k == r.keeper} == member


def test_box_keepers(spark):
    rng = random.Random(4)
    boxes = [(i, x := float(rng.randrange(30)), y := float(rng.randrange(30)), x + rng.randrange(0, 9), y + rng.randrange(1, 9)) for i in range(200)]
    area = lambda b: (b[3] - b[1]) * (b[4] - b[2])
    kept = []
    for b in sorted(boxes, key=lambda b: (-area(b), b[0])):
        both = [max(0, min(b[3], c[3]) - max(b[1], c[1])) * max(0, min(b[4], c[4]) - max(b[2], c[2])) for c in kept]
        if not any(o > 0.5 * (area(b) + area(c) - o) for o, c in zip(both, kept, strict=True)):
            kept.append(b)
    out = keepers.box_keepers(spark.createDataFrame(boxes, "k int, x0 double, y0 double, x1 double, y1 double"), "k", ("x0", "y0", "x1", "y1"), 5.0).collect()
    assert {r.k for r in out if r.k == r.keeper} == {b[0] for b in kept} and len(out) == 200


def test_chain_keepers(spark):
    line = lambda k, lo, hi, y: [(k, float(x), y, float(hi - lo)) for x in range(lo, hi)]
    rows = line(1, 0, 20, 0.0) + line(2, 0, 10, 0.5) + line(3, 14, 24, 0.5) + line(4, 0, 10, 5.0) + line(5, 0, 10, 5.5)
    out = keepers.chain_keepers(spark.createDataFrame(rows, "k int, x double, y double, n double"), "k", "x", "y", "n", 0.9)
    assert {r.k: r.keeper for r in out.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_eliminate_worst(spark):
    rng = random.Random(5)
    rows = [(g, i, float(i), 2.0 * i + rng.gauss(0, 0.3) + (rng.choice([-9, 9]) if i % 7 == g else 0)) for g in range(3) for i in range(20)]
    got = {r.g: r for r in keepers.eliminate_worst(spark.createDataFrame([*rows, (None, 1, 1.0, 1.0), (0, 99, None, 1.0)], "g int, k int, x double, y double"), ["g"], "k", "x", "y", 2.0).collect()}
    for g in range(3):
        keep = [r for r in rows if r[0] == g]
        while True:
            a, b = np.polyfit([r[2] for r in keep], [r[3] for r in keep], 1)
            off = [abs(r[3] - a * r[2] - b) for r in keep]
            if max(off) <= 2.0 or len(keep) <= 3:
                break
            keep.pop(int(np.argmax(off)))
        assert got[g].n == len(keep) < 20 and got[g].slope == pytest.approx(a) and got[g].intercept == pytest.approx(b)
    assert set(got) == {0, 1, 2}


@pytest.mark.parametrize(
    ("text", "want"),
    [("$ 45*30'00\" e", "S45°30'00\"E"), ("N05°01'09''W(R)", "N5°01'09\"W(R)"), ("|N4530'15\"E|", "N45°30'15\"E"), ("12O30'15\"", "12°30'15\""), ("1,234.50'", "1,234.50"), ("257.09'(T)", "257.09(T)"), ("LOT 5", "LOT5"), (None, None)],
)
def test_survey_notation(spark, text, want):
    assert spark.range(1).select(parsing.survey_notation(F.lit(text).cast("string"))).first()[0] == want


@pytest.mark.parametrize(("text", "want"), [("STA 12", "station"), ("10+25.3", "station"), ("28.31 AC.", "area"), ("EPOCH 1991.35", "notes"), ("Detail A", "detail"), ("monuments", None), ("scale: N.T.S.", "scale"), ("not  to scale", "scale"), ("100.25", None), (None, None)])
def test_context_guard(spark, text, want):
    assert spark.range(1).select(parsing.context_guard(F.lit(text).cast("string"))).first()[0] == want

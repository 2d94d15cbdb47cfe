"""Tolerance joins as bucketed equi-joins.

A theta join on a distance would plan as a nested loop. Each helper derives
buckets from the tolerance, so that Spark plans an equi-join (broadcast, hash
or sort-merge, by size) and checks the exact condition on its pairs. Sides that
meet several buckets merge after a shuffle: Spark sizes them as they were before
they were multiplied, and would broadcast what the driver cannot hold. Every
result is independent of the order of rows: ties resolve by the right key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, lvalue: str, rvalue: str, tol: float, by: list[tuple[str, str]] = (), how: str = "inner") -> DataFrame:
    """Pairs with |l - r| <= tol, within equal ``by`` keys; the right side meets three buckets."""
    l_ = left.withColumn("_b", F.floor(F.col(lvalue) / tol))
    r_ = right.withColumn("_b2", F.explode(F.array(*[F.floor(F.col(rvalue) / tol) + k for k in (-1, 0, 1)]))).hint("merge")
    on = (F.col("_b") == F.col("_b2")) & (F.abs(F.col(lvalue) - F.col(rvalue)) <= tol)
    for a, b in by:
        on = on & (F.col(a) == F.col(b))
    return l_.join(r_, on, how).drop("_b", "_b2")


def ball_join(left: DataFrame, right: DataFrame, lx: str, ly: str, rx: str, ry: str, radius: float, distance: str = "distance", by: list[tuple[str, str]] = ()) -> DataFrame:
    """Pairs of points within a radius, within equal ``by`` keys; the right side meets its 3 x 3 cells."""
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.array(*[F.struct((cell(rx) + i).alias("i"), (cell(ry) + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    r_ = right.withColumn("_c", F.explode(near)).withColumns({"_i2": F.col("_c.i"), "_j2": F.col("_c.j")}).drop("_c").hint("merge")
    l_ = left.withColumns({"_i": cell(lx), "_j": cell(ly)})
    d = F.sqrt((F.col(lx) - F.col(rx)) ** 2 + (F.col(ly) - F.col(ry)) ** 2)
    on = (F.col("_i") == F.col("_i2")) & (F.col("_j") == F.col("_j2"))
    for a, b in by:
        on = on & (F.col(a) == F.col(b))
    both = l_.join(r_, on).withColumn(distance, d)
    return both.where(F.col(distance) <= radius).drop("_i", "_j", "_i2", "_j2")


def ball_pairs(points: DataFrame, key: str, x: str, y: str, radius: float, by: list[str] = (), distance: str = "distance") -> DataFrame:
    """All pairs of points within a radius and of equal ``by``: key (the smaller), other, distance.

    Points of one place meet the others once, with the list of their keys (at most 1,000 a row); pairs are
    written out only when they are known to be near.
    """
    keys = F.array_sort(F.collect_list(key))
    places = points.where(finite(x, y) & F.col(key).isNotNull()).groupBy(*by, x, y).agg(keys.alias("_all"))
    some = F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / 1000).cast("int")), lambda i: F.slice("_all", i * 1000 + 1, 1000)))
    a = places.select(*by, F.col(x).alias("_ax"), F.col(y).alias("_ay"), some.alias("_a"))
    b = places.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col(x).alias("_bx"), F.col(y).alias("_by"), some.alias("_b"))
    near = ball_join(a, b, "_ax", "_ay", "_bx", "_by", radius, distance, [(c, f"_by{i}") for i, c in enumerate(by)]).where(F.col("_a")[0] <= F.col("_b")[0])
    # Lists of different first keys come in this order only; all others hold pairs of both orders.
    near = near.select(distance, (F.col("_a")[0] < F.col("_b")[0]).alias("_once"), F.explode("_a").alias("_k"), "_b").select(distance, "_once", "_k", F.explode("_b").alias("_o"))
    return near.where("_k < _o or (_once and _k <> _o)").select(F.least("_k", "_o").alias(key), F.greatest("_k", "_o").alias("other"), distance)


def finite(*columns: str) -> Column:
    """True where all columns are numbers: not null, NaN or infinite."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(F.col(c) - F.col(c) == 0, F.lit(False))
    return out


def nearest(pairs: DataFrame, left_key: list[str], distance: str, right_key: list[str], k: int = 1, rank: str = "rank") -> DataFrame:
    """The k nearest candidates of each left row; equal distances by right key."""
    w = W.partitionBy(*left_key).orderBy(distance, *right_key)
    return pairs.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def nearest_by_value(left: DataFrame, right: DataFrame, by: tuple[str, str], lvalue: str, rvalue: str, left_key: str, right_key: str) -> DataFrame:
    """The two nearest right rows of each left row by one number, within equal keys: no pairs are made.

    Both sides are ordered by value within a key; running values carry the two
    rows before and after each left row, of which the two nearest stay. Returns
    the left key, the nearest right key with its distance, and the second
    distance (null if there is one candidate only). Equal distances go to the
    smaller right key.
    """
    rows = left.select(F.col(by[0]).alias("g"), F.col(lvalue).alias("v"), F.col(left_key).alias("l"), F.lit(None).cast("long").alias("r"))
    rows = rows.unionByName(right.select(F.col(by[1]).alias("g"), F.col(rvalue).alias("v"), F.lit(None).cast("long").alias("l"), F.col(right_key).cast("long").alias("r")))
    # Of equal right values only the two smallest keys can matter.
    same = W.partitionBy("g", "v").orderBy(F.col("r").asc_nulls_last())
    rows = rows.withColumn("_n", F.row_number().over(same)).where("l is not null or _n <= 2").drop("_n")
    item = F.when(F.col("r").isNotNull(), F.struct("v", "r"))
    up = W.partitionBy("g").orderBy(F.col("v"), F.col("r").desc_nulls_last(), "l").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("g").orderBy(F.col("v").desc(), F.col("r").desc_nulls_last(), "l").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"_up": F.last(item, True).over(up), "_down": F.last(item, True).over(down)})
    item2 = F.when(F.col("r").isNotNull(), F.struct(F.lag("_up").over(W.partitionBy("g").orderBy("v", F.col("r").desc_nulls_last(), "l")).alias("p")))
    item3 = F.when(F.col("r").isNotNull(), F.struct(F.lag("_down").over(W.partitionBy("g").orderBy(F.col("v").desc(), F.col("r").desc_nulls_last(), "l")).alias("p")))
    rows = rows.withColumns({"_up2": F.last(item2, True).over(up)["p"], "_down2": F.last(item3, True).over(down)["p"]}).where("l is not null")
    near = F.filter(F.array("_up", "_down", "_up2", "_down2"), lambda x: x.isNotNull())
    ranked = F.array_sort(F.array_distinct(F.transform(near, lambda x: F.struct(F.abs(x["v"] - F.col("v")).alias("d"), x["r"].alias("r")))))
    return rows.select(F.col("l").alias(left_key), F.try_element_at(ranked, F.lit(1)).alias("a"), F.try_element_at(ranked, F.lit(2)).alias("b")).select(left_key, F.col("a.r").alias(right_key), F.col("a.d").alias("d1"), F.col("b.d").alias("d2"))


def exactly_one(pairs: DataFrame, left_key: list[str]) -> DataFrame:
    """Pairs of left rows that have exactly one candidate: ambiguity is refused, not guessed."""
    return pairs.withColumn("_n", F.count("*").over(W.partitionBy(*left_key))).where("_n = 1").drop("_n")


def status_of(count: Column) -> Column:
    """verified for one candidate, queued for several, refused for none."""
    return F.when(count == 1, "verified").when(count > 1, "queued").otherwise("refused")


def mutual_nearest(pairs: DataFrame, left_key: str, right_key: str, distance: str) -> DataFrame:
    """Pairs of which each is the other's nearest candidate."""
    a = W.partitionBy(left_key).orderBy(distance, right_key)
    b = W.partitionBy(right_key).orderBy(distance, left_key)
    return pairs.withColumns({"_a": F.row_number().over(a), "_b": F.row_number().over(b)}).where("_a = 1 and _b = 1").drop("_a", "_b")


def greedy_one_to_one(pairs: DataFrame, left_key: str, right_key: str, distance: str, checkpoint) -> DataFrame:
    """Pairs in order of distance, each side used once: rounds of mutual nearest pairs.

    Equals the sorted greedy loop. ``checkpoint`` cuts the lineage of a frame.
    """
    done, rest = None, pairs
    while True:
        chosen = checkpoint(mutual_nearest(rest, left_key, right_key, distance))
        if chosen.isEmpty():
            return chosen if done is None else done
        done = chosen if done is None else done.unionByName(chosen)
        rest = rest.join(chosen.select(left_key), left_key, "left_anti").join(chosen.select(right_key), right_key, "left_anti")
        rest = checkpoint(rest)


def interval_overlap(left: DataFrame, right: DataFrame, l0: str, l1: str, r0: str, r1: str, width: float, by: list[tuple[str, str]] = ()) -> DataFrame:
    """Pairs of closed intervals that overlap; both sides meet the buckets that they cover, each pair is kept once."""
    cover = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    both = left.withColumn("_b", cover(l0, l1)).join(right.withColumn("_b2", cover(r0, r1)), [F.col("_b") == F.col("_b2"), *[F.col(a) == F.col(b) for a, b in by]])
    first = F.floor(F.greatest(F.col(l0), F.col(r0)) / width)
    return both.where((F.col(l0) <= F.col(r1)) & (F.col(r0) <= F.col(l1)) & (F.col("_b") == first)).drop("_b", "_b2")


def asof_previous(left: DataFrame, right: DataFrame, key: str, ltime: str, rtime: str, value: str, out: str) -> DataFrame:
    """The right value last at or before each left row's time: one sort, no pairs."""
    a = left.withColumns({"_t": F.col(ltime), "_v": F.lit(None).cast(right.schema[value].dataType), "_left": F.lit(True)})
    b = right.select(F.col(key), F.col(rtime).alias("_t"), F.col(value).alias("_v")).withColumn("_left", F.lit(False))
    w = W.partitionBy(key).orderBy("_t", F.col("_left"), F.col("_v")).rowsBetween(W.unboundedPreceding, 0)
    return a.unionByName(b, allowMissingColumns=True).withColumn(out, F.last("_v", True).over(w)).where("_left").drop("_t", "_v", "_left")


def point_in_polygon(points: DataFrame, edges: DataFrame, px: str, py: str, point_key: list[str], ring: str, cell: float) -> DataFrame:
    """point_key, ring of points inside rings, by the parity of edge crossings to the right.

    Edges (x0, y0, x1, y1) meet points through the rows of cells that they span.
    """
    rows = F.explode(F.sequence(F.floor(F.least("y0", "y1") / cell), F.floor(F.greatest("y0", "y1") / cell)))
    e = edges.where("y0 <> y1").withColumn("_row", rows)
    both = points.withColumn("_row", F.floor(F.col(py) / cell)).join(e, "_row")
    crosses = ((F.col("y0") > F.col(py)) != (F.col("y1") > F.col(py))) & (F.col(px) < (F.col("x1") - F.col("x0")) * (F.col(py) - F.col("y0")) / (F.col("y1") - F.col("y0")) + F.col("x0"))
    return both.where(crosses).groupBy(*point_key, ring).agg(F.count("*").alias("_n")).where("_n % 2 = 1").drop("_n")

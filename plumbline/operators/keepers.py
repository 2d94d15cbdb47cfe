"""Greedy keepers of points, boxes and chains, and fits that drop their worst rows; all in rounds that equal the loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.fits import line_fit
from plumbline.operators.graph import checkpointer, first_claim, greedy_keepers
from plumbline.operators.joins import ball_join, finite


def seed_groups(points: DataFrame, key: str, x: str, y: str, radius: float) -> DataFrame:
    """Points, in order of key, join a seed within ``radius`` or become one (groups are balls, not chains). Returns key and keeper."""
    return ball_keepers(points, key, x, y, radius)


def ball_keepers(points: DataFrame, key: str, x: str, y: str, radius: float, by: list[str] = ()) -> DataFrame:
    """Points, in order of key, are kept unless a kept earlier one of equal ``by`` lies within ``radius``. Returns key and keeper (the first such)."""

    def near(a, b):
        # The keepers meet their 3 x 3 cells, as they are fewer.
        k = a.select(F.col("_pos").alias("keeper"), F.col(x).alias("_ax"), F.col(y).alias("_ay"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)])
        r = b.select(F.col("_pos").alias("row"), F.col(x).alias("_bx"), F.col(y).alias("_by"), *by)
        return ball_join(r, k, "_bx", "_by", "_ax", "_ay", radius, by=[(c, f"_by{i}") for i, c in enumerate(by)])

    able = finite(x, y)
    for c in by:
        able = able & F.col(c).isNotNull()
    return greedy_keepers(points, key, [*by, x, y], ["_first"], near, able)


def box_keepers(boxes: DataFrame, key: str, box: tuple[str, str, str, str], cell: float, above: float = 0.5) -> DataFrame:
    """Boxes, the largest first (smaller key on ties), are kept unless a kept one overlaps them by more than ``above`` of the union.

    Returns key and keeper (the first such). Boxes meet in cells of size ``cell``, in the cell of their common lower corner only.
    """
    x0, y0, x1, y1 = (F.col(c) for c in box)
    area = (x1 - x0) * (y1 - y0)
    spread = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    names = ["x0", "y0", "x1", "y1"]

    def near(a, b):
        cells = [df.select("_pos", *[F.col(c).alias(n) for c, n in zip(box, names, strict=True)], area.alias("area")).withColumn("i", spread("x0", "x1")).withColumn("j", spread("y0", "y1")) for df in (a, b)]
        other = cells[1].select(*[F.col(c).alias(c if c in "ij" else f"_{c}") for c in cells[1].columns]).hint("merge")
        left, low = F.greatest("x0", "_x0"), F.greatest("y0", "_y0")
        common = F.greatest(F.lit(0.0), F.least("x1", "_x1") - left) * F.greatest(F.lit(0.0), F.least("y1", "_y1") - low)
        pairs = cells[0].join(other, ["i", "j"]).where((F.col("i") == F.floor(left / cell)) & (F.col("j") == F.floor(low / cell)))
        return pairs.where(common > above * (F.col("area") + F.col("_area") - common)).select(F.col("_pos").alias("keeper"), F.col("__pos").alias("row"))

    able = finite(*box) & F.coalesce((x1 > x0) & (y1 > y0), F.lit(False))
    # With ``above`` of 1 or more equal boxes do not claim each other.
    return greedy_keepers(boxes, key, [*box] if above < 1 else [*box, key], [area.desc(), "_first"], near, able)


def chain_keepers(points: DataFrame, chain: str, x: str, y: str, length: str, tol: float, share: float = 0.8) -> DataFrame:
    """Chains, the longest first (smaller key on ties), are kept unless ``share`` of their points lie within ``tol`` of one kept chain.

    ``points`` has a row for each point, ``length`` the same for all of a chain. Returns chain and keeper.
    """
    p = points.select(F.col(chain).alias("k"), F.col(x).alias("_ax"), F.col(y).alias("_ay"), F.col(length).alias("n"), F.monotonically_increasing_id().alias("p"))
    p = checkpointer(points.sparkSession)(p)  # the ids of points must not change between the sides
    a = p.select(F.col("k").alias("keeper"), F.col("n").alias("m"), F.col("_ax").alias("_x"), F.col("_ay").alias("_y"))
    near = ball_join(a, p, "_x", "_y", "_ax", "_ay", tol).where("keeper <> k and (m > n or (m = n and keeper < k))")
    hits = near.groupBy("keeper", "k").agg(F.count_distinct("p").alias("hits"))
    claims = hits.join(p.groupBy("k").agg(F.count("*").alias("all_")), "k").where(F.col("hits") >= share * F.col("all_")).select("keeper", F.col("k").alias("row"))
    return first_claim(p.select("k").distinct(), "k", claims).withColumnRenamed("k", chain)


def eliminate_worst(df: DataFrame, by: list[str], key: str, x: str, y: str, limit: float, least: int = 3) -> DataFrame:
    """A line for each group; while its worst residual exceeds ``limit`` and more than ``least`` rows remain, that row goes.

    A round drops one row of every group that needs it, so there are as many rounds as the most that one group loses.
    Ties drop the larger key. Rows with a null group, x or y do not count.
    """
    cut = checkpointer(df.sparkSession)
    rest = cut(df.select(*by, key, x, y).dropna())
    while True:
        off = rest.join(line_fit(rest, by, x, y), by).withColumn("_r", F.abs(F.col(y) - F.col("slope") * F.col(x) - F.col("intercept")))
        worst = off.where(F.col("n") > least).groupBy(*by).agg(F.max(F.struct("_r", key)).alias("w")).where(F.col("w._r") > limit)
        worst = cut(worst.select(*by, F.col(f"w.{key}").alias(key)))
        if worst.isEmpty():
            return line_fit(rest, by, x, y)
        rest = cut(rest.join(worst, [*by, key], "left_anti"))

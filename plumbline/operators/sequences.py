"""Ordered sequences: islands, interval unions, spans, walks. All by windows; order keys must end in a unique one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(df: DataFrame, by: list[str], order: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """Number runs of rows (from 0); ``breaks`` (which may use lag over the same order) begins a new run."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("_new", F.coalesce(breaks, F.lit(False)).cast("int")).withColumn(name, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long")).drop("_new")


def band_runs(df: DataFrame, by: list[str], value: str, left: Column, right: Column, tol: float, name: str = "run") -> DataFrame:
    """Number the components of left and right rows that link within ``tol``, without their pairs; ``value`` is unique in a group.

    A row between two linked ones links to one of them, so components are runs in order of value: a run goes on past
    a gap if the last row of one side before it links to the first row of the other side after it. Rows without links are runs alone.
    """
    w = W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    back = W.partitionBy(*by).orderBy(F.desc(value)).rowsBetween(W.unboundedPreceding, 0)
    own = {"_l": F.when(left, F.col(value)), "_r": F.when(right, F.col(value))}
    ends = df.withColumns(own).withColumns({"_l0": F.max("_l").over(w), "_r0": F.max("_r").over(w), "_l1": F.min("_l").over(back), "_r1": F.min("_r").over(back)})
    near = lambda a, b: F.coalesce(F.col(b) - F.col(a) <= tol, F.lit(False))
    return islands(ends, by, [value], ~(near("_l0", "_r1") | near("_r0", "_l1")), name).drop("_l", "_r", "_l0", "_r0", "_l1", "_r1")


def interval_union(df: DataFrame, by: list[str], lo: str, hi: str, gap: Column | float = 0) -> DataFrame:
    """Merged intervals of each group; gaps up to ``gap`` are bridged. Returns by, lo, hi, pieces."""
    w = W.partitionBy(*by).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(W.unboundedPreceding, -1))
    limit = reach + (gap if isinstance(gap, Column) else F.lit(gap))
    marked = df.withColumn("_new", F.coalesce((F.col(lo) > limit).cast("int"), F.lit(1)))
    marked = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_run").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count("*").alias("pieces")).drop("_run")


def interval_holes(merged: DataFrame, by: list[str], lo: str, hi: str) -> DataFrame:
    """Gaps between the merged intervals of each group."""
    w = W.partitionBy(*by).orderBy(lo)
    return merged.withColumn("_next", F.lead(lo).over(w)).where(F.col("_next").isNotNull()).select(*by, F.col(hi).alias("hole_lo"), F.col("_next").alias("hole_hi"))


def unique_span(df: DataFrame, by: list[str], order: str, value: str, target: Column, tol: float) -> DataFrame:
    """The one contiguous run of a group whose sum is within ``tol`` of the target; none if several are.

    Prefix sums meet each other by a band join on their difference; nothing is
    compared with all others.
    """
    w = W.partitionBy(*by).orderBy(order)
    p = df.select(*by, order, F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("_hi"), F.col(value).alias("_v"), target.alias("_target"))
    p = p.withColumn("_lo", F.col("_hi") - F.col("_v"))
    a = p.select(*by, F.col(order).alias("first"), F.col("_lo").alias("_from"), F.floor((F.col("_lo") + F.col("_target")) / tol).alias("_b"))
    b = p.select(*by, F.col(order).alias("last"), F.col("_hi").alias("_to"), "_target", F.explode(F.array(*[F.floor(F.col("_hi") / tol) + k for k in (-1, 0, 1)])).alias("_b"))
    spans = a.join(b, [*by, "_b"]).where((F.col("last") >= F.col("first")) & (F.abs(F.col("_to") - F.col("_from") - F.col("_target")) <= tol))
    spans = spans.select(*by, "first", "last").distinct()
    return spans.withColumn("_n", F.count("*").over(W.partitionBy(*by))).where("_n = 1").drop("_n")


def bridge_nulls(df: DataFrame, by: list[str], order: list[str], value: str, longest: int) -> DataFrame:
    """Fill runs of at most ``longest`` nulls whose two neighbours agree."""
    w = W.partitionBy(*by).orderBy(*order)
    before = F.last(value, True).over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.first(value, True).over(w.rowsBetween(1, W.unboundedFollowing))
    run = W.partitionBy(*by, "_seen").orderBy(*order)
    marked = df.withColumns({"_before": before, "_after": after, "_seen": F.count(value).over(w.rowsBetween(W.unboundedPreceding, 0))})
    marked = marked.withColumn("_len", F.sum(F.col(value).isNull().cast("int")).over(run.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    fill = F.when((F.col("_before") == F.col("_after")) & (F.col("_len") <= longest), F.col("_before"))
    return marked.withColumn(value, F.coalesce(value, fill)).drop("_before", "_after", "_seen", "_len")


def walk(df: DataFrame, by: list[str], order: list[str], dx: Column, dy: Column) -> DataFrame:
    """Positions x, y after each course, carried from the origin."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({"x": F.sum(dx).over(w), "y": F.sum(dy).over(w)})


def ring_area(df: DataFrame, by: list[str], order: list[str], x: str, y: str) -> DataFrame:
    """Shoelace area and perimeter of closed rings."""
    w = W.partitionBy(*by).orderBy(*order)
    first = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nx, ny = F.coalesce(F.lead(x).over(w), F.first(x).over(first)), F.coalesce(F.lead(y).over(w), F.first(y).over(first))
    side = df.withColumns({"_cross": F.col(x) * ny - nx * F.col(y), "_len": F.sqrt((nx - F.col(x)) ** 2 + (ny - F.col(y)) ** 2)})
    return side.groupBy(*by).agg((F.abs(F.sum("_cross")) / 2).alias("area"), F.sum("_len").alias("perimeter"))


def circular_gap(df: DataFrame, by: list[str], value: str, period: float) -> DataFrame:
    """The widest gap between the distinct values of a group on a circle; the period if there is one value."""
    w = W.partitionBy(*by).orderBy(value)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    after = F.coalesce(F.lead(value).over(w), F.first(value).over(whole) + period)
    return df.select(*by, value).distinct().withColumn("_gap", after - F.col(value)).groupBy(*by).agg(F.max("_gap").alias("gap"))


def cut_pieces(lines: DataFrame, cuts: DataFrame, key: str, length: str, at: str) -> DataFrame:
    """Pieces of lines (0 to length) between distinct cut positions strictly inside."""
    ends = lines.select(key, F.explode(F.array(F.lit(0.0), F.col(length))).alias("s"))
    inner = cuts.join(lines.select(key, length), key).where((F.col(at) > 0) & (F.col(at) < F.col(length))).select(key, F.col(at).alias("s"))
    w = W.partitionBy(key).orderBy("s")
    return ends.unionByName(inner).distinct().withColumn("e", F.lead("s").over(w)).where("e is not null")


def densify(df: DataFrame, length: str, step: float) -> DataFrame:
    """Equal elements of at most ``step``: columns s0, s1 along each row's length."""
    n = F.greatest(F.lit(1), F.ceil(F.col(length) / step)).cast("int")
    return df.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumns({"s0": F.col(length) * F.col("_i") / F.col("_n"), "s1": F.col(length) * (F.col("_i") + 1) / F.col("_n")}).drop("_n", "_i")


def drop_wide_runs(df: DataFrame, by: list[str], order: list[str], breaks: Column, value: str, widest: float) -> DataFrame:
    """Runs whose values range over less than ``widest``: by, island and n; a wider run is a reversal or noise."""
    runs = islands(df, by, order, breaks).groupBy(*by, "island").agg(F.count("*").alias("n"), (F.max(value) - F.min(value)).alias("_range"))
    return runs.where(F.col("_range") < widest).drop("_range")


def point_at_fraction(df: DataFrame, by: list[str], order: list[str], x: str, y: str, fraction: float) -> DataFrame:
    """The point of each polyline at a fraction of its length, with the length; none for one without length."""
    w = W.partitionBy(*by).orderBy(*order)
    s = df.withColumns({"_x": F.lead(x).over(w), "_y": F.lead(y).over(w)})
    s = s.withColumn("_len", F.sqrt((F.col("_x") - F.col(x)) ** 2 + (F.col("_y") - F.col(y)) ** 2)).where("_len > 0")
    s = s.withColumns({"_at": F.coalesce(F.sum("_len").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)), "length": F.sum("_len").over(W.partitionBy(*by))})
    t = (F.col("length") * fraction - F.col("_at")) / F.col("_len")
    here = F.struct(*order, "length", (F.col(x) + t * (F.col("_x") - F.col(x))).alias("px"), (F.col(y) + t * (F.col("_y") - F.col(y))).alias("py"))
    return s.where(F.col("_at") <= F.col("length") * fraction).groupBy(*by).agg(F.max(here).alias("p")).select(*by, "p.length", "p.px", "p.py")


def adaptive_reach(df: DataFrame, by: list[str], order: list[str], value: Column, factor: float, floor: float) -> DataFrame:
    """A reach for each group: ``factor`` times its median step to the next row, not below ``floor``."""
    step = df.withColumn("_step", F.lead(value).over(W.partitionBy(*by).orderBy(*order)) - value)
    return step.groupBy(*by).agg(F.coalesce(F.greatest(F.lit(floor), factor * F.percentile("_step", F.lit(0.5))), F.lit(floor)).alias("reach"))

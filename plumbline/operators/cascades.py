"""Ordered decisions: removal with protected rows, proofs of falling strength, donors, groups that settle what rows cannot.

Everything is one or two aggregations; unknown conditions never decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators.fits import line_fit
from plumbline.operators.graph import checkpointer


def removal_cascade(df: DataFrame, rules: list[tuple[str, Column]], protected: Column, name: str = "removed_by") -> DataFrame:
    """The first rule that removes each row; null where it stays. Protected rows always stay."""
    cause = F.lit(None).cast("string")
    for rule, holds in reversed(rules):
        cause = F.when(holds, F.lit(rule)).otherwise(cause)
    return df.withColumn(name, F.when(~F.coalesce(protected, F.lit(False)), cause))


def heaviest_class(df: DataFrame, by: list[str], weight: str, measure: str, least: int, floor: float) -> DataFrame:
    """The largest weight of each group with at least ``least`` rows and a total of at least ``floor``; none if no class has both."""
    classes = df.groupBy(*by, weight).agg(F.count("*").alias("_n"), F.sum(measure).alias("_total"))
    return classes.where((F.col("_n") >= least) & (F.col("_total") >= floor)).groupBy(*by).agg(F.max(weight).alias(weight))


def cascade_match(pairs: DataFrame, left_key: str, right_key: str, levels: list[Column]) -> DataFrame:
    """The partner of each left row at its strongest level of proof, if it is the only one there.

    Returns left_key, level (from 1), n (partners of that level) and right_key (null if several).
    Pairs without a level do not count.
    """
    level = F.lit(None).cast("int")
    for i, holds in reversed(list(enumerate(levels, 1))):
        level = F.when(holds, F.lit(i)).otherwise(level)
    each = pairs.withColumn("level", level).where("level is not null").groupBy(left_key, "level").agg(F.count("*").alias("n"), F.min(right_key).alias(right_key))
    best = each.groupBy(left_key).agg(F.min(F.struct("level", "n", right_key)).alias("b"))
    return best.select(left_key, "b.level", "b.n", F.when(F.col("b.n") == 1, F.col(f"b.{right_key}")).alias(right_key))


def attach_unique(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows without a value take that of their group, if all rows of it that have one agree; nothing is overwritten."""
    donors = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")).where("_lo = _hi").drop("_hi")
    return df.join(donors, by, "left").withColumn(value, F.coalesce(F.col(value), "_lo")).drop("_lo")


def settle_by_object(df: DataFrame, by: list[str], passed: Column, value: Column, target: Column, tol: Column, least: int = 2) -> DataFrame:
    """Rows that fail alone are judged by the total of the object they share.

    Returns by, passed (rows), open_rows and verdict of the latter: 'run' if at least ``least``
    open rows sum to the total of their targets within ``tol`` (of that total), else 'queued';
    null if none is open.
    """
    alone = F.coalesce(passed, F.lit(False))
    s = df.groupBy(*by).agg(F.sum(alone.cast("long")).alias("passed"), F.sum((~alone).cast("long")).alias("open_rows"), F.sum(F.when(~alone, value)).alias("_v"), F.sum(F.when(~alone, target)).alias("_t"), F.sum(F.when(~alone, tol)).alias("_tol"))
    run = (F.col("open_rows") >= least) & (F.abs(F.col("_v") - F.col("_t")) <= F.col("_tol"))
    return s.select(*by, "passed", "open_rows", F.when(F.col("open_rows") > 0, F.when(run, "run").otherwise("queued")).alias("verdict"))


def first_violation(df: DataFrame, by: list[str], order: list[str], agrees: Column, hit: list[str]) -> DataFrame:
    """For each group the first row (by ``order``) that does not agree, as columns ``hit``; null if all do. Unknown agreement passes."""
    bad = F.min(F.when(~agrees, F.struct(*order, *[F.col(c).alias(f"_hit{i}") for i, c in enumerate(hit)]))).alias("b")
    return df.groupBy(*by).agg(bad).select(*by, *[F.col(f"b._hit{i}").alias(c) for i, c in enumerate(hit)])


def two_pass_line(df: DataFrame, by: list[str], x: str, y: str, tol: float) -> DataFrame:
    """A line through all rows of each group, then one through those within ``tol`` of it."""
    first = line_fit(df, by, x, y).select(*by, F.col("slope").alias("_a"), F.col("intercept").alias("_b"))
    near = df.join(first, by).where(F.abs(F.col(y) - F.col("_a") * F.col(x) - F.col("_b")) <= tol)
    return line_fit(near, by, x, y)


def share_near_median(df: DataFrame, by: list[str], value: str, tol: float) -> DataFrame:
    """Median of each group, and the share of its rows within ``tol`` of it."""
    middle = df.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("median"))
    return df.join(middle, by).groupBy(*by, "median").agg(F.avg(F.when(F.abs(F.col(value) - F.col("median")) <= tol, 1.0).otherwise(0.0)).alias("share"))


def examples_of(df: DataFrame, by: list[str], order: list[Column | str], value: str, k: int = 4) -> DataFrame:
    """The first ``k`` values of each group, in order; k rows a group and partition reach the shuffle."""
    top = df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k)
    sorted_ = F.array_sort(F.collect_list(F.struct("_r", F.col(value).alias("v"))))
    return top.groupBy(*by).agg(F.transform(sorted_, lambda x: x["v"]).alias("examples"))


def mirror_dedupe(df: DataFrame, same: list[str], ends: tuple[str, str], order: list[str]) -> DataFrame:
    """The first row (by ``order``) of each unordered pair of ends with the same other columns, and how many there were."""
    key = [*same, "_lo", "_hi"]
    rows = df.withColumns({"_lo": F.least(*ends), "_hi": F.greatest(*ends)})
    return rows.groupBy(*key).agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n")).select(*same, F.col("_lo").alias("low_end"), F.col("_hi").alias("high_end"), *[F.col(f"first.{c}").alias(c) for c in order], "n")


#: The least equations, features and observations of an axis of a credible solution.
CREDIBLE = {"equations": 8, "features": 4, "axis": 2}


def credible(equations: Column, features: Column, axis_a: Column, axis_b: Column) -> Column:
    """'solved' with enough equations, features and observations on each axis (CREDIBLE), else 'weak'; 'none' without any."""
    enough = (equations >= CREDIBLE["equations"]) & (features >= CREDIBLE["features"]) & (F.least(axis_a, axis_b) >= CREDIBLE["axis"])
    return F.when(F.coalesce(equations, F.lit(0)) == 0, "none").when(enough, "solved").otherwise("weak")


def claim_in_order(pairs: DataFrame, left: str, right: str, distance: str) -> DataFrame:
    """Left rows, in order of their key, each take their nearest right row that is still free.

    Equal to the sequential loop: each round every left row without a partner asks its
    nearest right row (smallest key on ties) that has not refused it; a right row keeps
    the asker of the smallest key. Rounds are written; state is one row a pair at most.
    """
    cut = checkpointer(pairs.sparkSession)
    open_ = cut(pairs.where(F.col(distance).isNotNull()).groupBy(F.col(left).alias("l"), F.col(right).alias("r")).agg(F.min(distance).alias("d")))
    while True:
        asks = open_.groupBy("l").agg(F.min(F.struct("d", "r")).alias("a")).select("l", F.col("a.r").alias("r"), F.col("a.d").alias("d"))
        held = cut(asks.groupBy("r").agg(F.min(F.struct("l", "d")).alias("h")).select("r", F.col("h.l").alias("l"), F.col("h.d").alias("d")))
        # A holder refuses all later askers for good; earlier ones may still take its place.
        rest = cut(open_.join(held.select("r", F.col("l").alias("_holder")), "r", "left").where("_holder is null or l <= _holder").select("l", "r", "d"))
        if rest.count() == open_.count():
            return held.select(F.col("l").alias(left), F.col("r").alias(right), F.col("d").alias(distance))
        open_ = rest


def unbranched_paths(edges: DataFrame, key: str, u: str, v: str) -> DataFrame:
    """Edges that meet in nodes of exactly two ends form one path.

    Returns key and path (its smallest edge key).
    """
    from plumbline.operators.graph import components

    ends = edges.select(key, F.explode(F.array(u, v)).alias("x"))
    links = ends.groupBy("x").agg(F.count("*").alias("n"), F.min(key).alias("a"), F.max(key).alias("b")).where("n = 2 and a <> b")
    found = components(links, "a", "b")
    return edges.join(found, edges[key] == found["node"], "left").select(key, F.coalesce("component", key).alias("path"))


def trace_unique(edges: DataFrame, starts: DataFrame, u: str, v: str, hops: int = 4) -> DataFrame:
    """Follow each start through nodes with exactly one way on, at most ``hops`` times.

    ``starts`` has one column, its name is kept. Returns it, the node where the trace stops and the hops made.
    """
    start = starts.columns[0]
    on = edges.groupBy(F.col(u).alias("_u")).agg(F.count("*").alias("_n"), F.min(v).alias("_v")).where("_n = 1").drop("_n")
    out = starts.select(start, F.col(start).alias("stop"), F.lit(0).alias("hops"))
    for i in range(hops):
        out = out.join(on, (F.col("stop") == F.col("_u")) & (F.col("hops") == i), "left")
        out = out.select(start, F.coalesce("_v", "stop").alias("stop"), (F.col("hops") + F.col("_u").isNotNull().cast("int")).alias("hops"))
    return out


def two_lengths(df: DataFrame, by: list[str], value: str, ratio: float = 2.0, share: float = 0.3) -> DataFrame:
    """Whether a group has two kinds of values: those above the middle of its range average ``ratio`` times the others,
    and each kind has at least ``share`` of the rows. Returns by, short, long (averages) and two_kinds."""
    ends = df.groupBy(*by).agg(((F.max(value) + F.min(value)) / 2).alias("_cut"))
    high = F.col(value) > F.col("_cut")
    s = df.join(ends, by).where(F.col(value).isNotNull()).groupBy(*by).agg(F.avg(F.when(~high, F.col(value))).alias("short"), F.avg(F.when(high, F.col(value))).alias("long"), F.avg(high.cast("double")).alias("_p"))
    two = (F.col("long") >= ratio * F.col("short")) & F.col("_p").between(share, 1 - share)
    return s.select(*by, "short", "long", F.coalesce(two, F.lit(False)).alias("two_kinds"))


def offsets_between(df: DataFrame, cell: list[str], line: str, value: str) -> DataFrame:
    """Mean offset of each pair of lines over the cells that both meet: a, b, cells, offset, rms.

    Rows become one mean for each cell and line first; pairs are of lines within a cell.
    """
    means = df.groupBy(*cell, line).agg(F.avg(value).alias("_m"))
    a = means.select(*cell, F.col(line).alias("a"), F.col("_m").alias("_ma"))
    b = means.select(*cell, F.col(line).alias("b"), F.col("_m").alias("_mb"))
    d = F.col("_ma") - F.col("_mb")
    return a.join(b, cell).where("a < b").groupBy("a", "b").agg(F.count("*").alias("cells"), F.avg(d).alias("offset"), F.sqrt(F.avg(d * d)).alias("rms"))


def tangent_triples(lines: DataFrame, curves: DataFrame) -> DataFrame:
    """Line, curve, line that share ends: keys of the three and the turn at the curve less its angle, in degrees of (-180, 180].

    ``lines`` has k, u, v, az; ``curves`` has k, u, v, delta.
    """
    into = lines.select(F.col("k").alias("line_in"), F.col("v").alias("u"), F.col("az").alias("_a"))
    out = lines.select(F.col("k").alias("line_out"), F.col("u").alias("v"), F.col("az").alias("_b"))
    off = F.pmod(F.col("_b") - F.col("_a") - F.col("delta") + 180, F.lit(360.0)) - 180
    return curves.join(into, "u").join(out, "v").select("line_in", F.col("k").alias("curve"), "line_out", F.when(off == -180, 180.0).otherwise(off).alias("off"))

"""Aggregations: multisets, robust modes, thresholds, reports, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def multiset_score(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """by, n_a, n_b, common: the bag intersection of two frames, counted before they meet."""
    na, nb = a.groupBy(*by).agg(F.count("*").alias("n_a")), b.groupBy(*by).agg(F.count("*").alias("n_b"))
    both = na.join(nb, by, "full").fillna(0, ["n_a", "n_b"])
    return both.withColumn("common", F.least("n_a", "n_b"))


def densest_mode(df: DataFrame, by: list[str], value: str, tol: float, least: int = 3) -> DataFrame:
    """Robust mode: the window [v, v + tol] of most members (the lowest on ties) and the median of its members.

    A range frame counts each window from its first member; no pairs are made.
    Groups whose best window has fewer than ``least`` members have null.
    """
    keys = ", ".join(f"`{c}`" for c in by)
    counted = df.select(*by, value).withColumn("_n", F.expr(f"count(*) over (partition by {keys} order by `{value}` range between current row and {float(tol)}D following)"))
    best = counted.groupBy(*by).agg(F.max(F.struct("_n", (-F.col(value)).alias("_v"))).alias("m"))
    best = best.select(*by, F.col("m._n").alias("members"), (-F.col("m._v")).alias("low"))
    inside = df.select(*by, value).join(best, by).where((F.col(value) >= F.col("low")) & (F.col(value) <= F.col("low") + tol))
    return inside.groupBy(*by, "members").agg(F.median(value).alias("_mode")).select(*by, "members", F.when(F.col("members") >= least, F.col("_mode")).alias("mode"))


def quantile_report(df: DataFrame, by: list[str], value: str, points: tuple[float, ...] = (0.1, 0.5, 0.9, 0.95)) -> DataFrame:
    """Linear quantiles, root mean square and maximum by group."""
    q = [F.percentile(value, F.lit(p)).alias(f"p{round(100 * p):02d}") for p in points]
    return df.groupBy(*by).agg(*q, F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.max(value).alias("largest"))


def otsu_threshold(df: DataFrame, value: str, bins: int = 256) -> DataFrame:
    """The histogram bin that splits values with the largest between-class variance; the lowest on ties."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))))
    hist = df.crossJoin(F.broadcast(ends)).where("hi > lo").groupBy(at.cast("long").alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))  # one row of ends
    run = W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)  # at most ``bins`` rows
    all_ = W.orderBy("bin").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    h = hist.withColumns({"w0": F.sum("n").over(run), "s0": F.sum(F.col("n") * F.col("bin")).over(run), "w": F.sum("n").over(all_), "s": F.sum(F.col("n") * F.col("bin")).over(all_)})
    h = h.where("w0 < w").withColumn("between", F.expr("cast(w0 as double) * (w - w0) * power(s0 / w0 - (s - s0) / (w - w0), 2)"))
    return h.select("bin", (F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / bins).alias("threshold"), "between").orderBy(F.desc("between"), "bin").limit(1)


def attribution(df: DataFrame, rules: list[tuple[str, Column]], otherwise: str, measure: str) -> DataFrame:
    """Sum of a measure by the first rule that holds; causes exclude each other and sum to the total."""
    cause = None
    for name, rule in rules:
        cause = F.when(rule, F.lit(name)) if cause is None else cause.when(rule, F.lit(name))
    cause = F.lit(otherwise) if cause is None else cause.otherwise(otherwise)
    return df.groupBy(cause.alias("cause")).agg(F.count("*").alias("n"), F.sum(measure).alias("total"))


def precision_by(df: DataFrame, by: str, said: Column, truth: Column) -> DataFrame:
    """Precision of a tri-state verdict: rows of unknown truth do not count; null where nothing was said."""
    hit = F.sum((said & truth).cast("int"))
    all_ = F.sum((said & truth.isNotNull()).cast("int"))
    return df.groupBy(by).agg(hit.alias("hits"), all_.alias("said"), F.when(all_ > 0, hit / all_).alias("precision"), F.sum((said & truth.isNull()).cast("int")).alias("unsure"))


def best_row(df: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """One row of each group, by a preference order."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def lowest(df: DataFrame, by: list[str], value: str, key: str) -> DataFrame:
    """by, key of the row with the lowest value of each group, the smallest key on ties; rows without a value do not count."""
    best = F.min(F.when(F.col(key).isNotNull(), F.struct(F.col(value).alias("v"), F.col(key).alias("k")))).alias("_b")
    low = F.min(value).alias("_m")
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(best, low).select(*by, F.when(F.col("_b.v") == F.col("_m"), F.col("_b.k")).alias(key))


def weighted_centroid(df: DataFrame, by: list[str], x: str, y: str, weight: str) -> DataFrame:
    s = F.sum(weight)
    return df.groupBy(*by).agg((F.sum(F.col(weight) * F.col(x)) / s).alias("cx"), (F.sum(F.col(weight) * F.col(y)) / s).alias("cy"))


def majority_label(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """The commonest label of each group with its share; the smallest label on ties."""
    n = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    top = best_row(n.withColumn("all_", F.sum("n").over(W.partitionBy(*by))), by, [F.desc("n"), label])
    return top.withColumn("share", F.col("n") / F.col("all_")).drop("all_")


def consensus_of_two(a: Column, conf_a: Column, b: Column, conf_b: Column, lo: Column, hi: Column) -> Column:
    """struct<status, value> of two readings: agree; repaired if one is the other less its leading digit and in range; else queue."""
    num = lambda c: c.cast("double")
    inside = lambda c: num(c).between(lo, hi)
    longer = F.when((F.length(a) == F.length(b) + 1) & a.endswith(b) & inside(a), a).when((F.length(b) == F.length(a) + 1) & b.endswith(a) & inside(b), b)
    best = F.when(conf_b > conf_a, b).otherwise(a)
    return F.when(a == b, F.struct(F.lit("agree").alias("status"), a.alias("value"))).when(longer.isNotNull(), F.struct(F.lit("repaired").alias("status"), longer.alias("value"))).otherwise(F.struct(F.lit("queue").alias("status"), best.alias("value")))

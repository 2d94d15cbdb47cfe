"""Graphs and iteration: components, greedy keepers, propagation, bounded paths.

Loops run on the driver over small decisions only (has anything changed?);
each round is written under ``spark.checkpoint.dir``, so that plans stay short
and a lost executor costs one round.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def checkpointer(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """checkpoint() into the folder of ``spark.checkpoint.dir``; a temporary one where it is unset."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="plumbline-"))
    return lambda df: df.checkpoint()


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """node, component (its smallest node), by labels that flow along edges and jump to their labels' labels."""
    cut = checkpointer(edges.sparkSession)
    both = cut(edges.select(F.col(u).alias("a"), F.col(v).alias("b")).union(edges.select(v, u)).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        low = cut(labels.join(near, labels.node == near.a).select("node", F.col("component").alias("old"), F.least("component", "c").alias("component")))
        jump = low.select(F.col("node").alias("component"), F.col("component").alias("to"))
        labels = cut(low.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("to", "component")).alias("component")))
        if labels.where("old <> component").isEmpty():
            return labels.select("node", "component")


def first_claim(rows: DataFrame, key: str, claims: DataFrame) -> DataFrame:
    """Greedy keepers: in order of key, a row is kept unless a kept earlier row claims it.

    ``claims`` has (keeper, row) pairs with keeper < row. Returns key and keeper
    (itself if kept). Rounds decide every row without an undecided earlier
    claimant, which equals the sequential loop.
    """
    cut = checkpointer(rows.sparkSession)
    open_ = cut(claims.select(F.col("keeper").alias("k"), F.col("row").alias("r")).distinct())
    rest, done = cut(rows.select(F.col(key).alias("r"))), None
    while not rest.isEmpty():
        kept = rest.join(open_, "r", "left_anti").select("r")
        taken = open_.join(kept.select(F.col("r").alias("k")), "k", "left_semi").groupBy("r").agg(F.min("k").alias("keeper"))
        step = cut(kept.select("r", F.col("r").alias("keeper")).unionByName(taken))
        done = step if done is None else done.unionByName(step)
        rest = cut(rest.join(step, "r", "left_anti"))
        open_ = cut(open_.join(step.select("r"), "r", "left_anti").join(step.select(F.col("r").alias("k")), "k", "left_anti"))
    return (done if done is not None else rest.select("r", F.col("r").alias("keeper"))).select(F.col("r").alias(key), "keeper")


def positions(df: DataFrame, order: list[Column | str], name: str = "_pos") -> DataFrame:
    """Rows with their place (from 0) in an order; ranges of it are numbered each for itself, a few row counts give where each begins."""
    cut = checkpointer(df.sparkSession)
    sorted_ = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    begins, at = [F.lit(-1), F.lit(0)], 0
    for p, n in sorted(tuple(r) for r in sorted_.groupBy("_p").count().collect()):
        begins += [F.lit(p), F.lit(at)]
        at += n
    row = F.row_number().over(W.partitionBy("_p").orderBy(*order)) - 1 + F.element_at(F.create_map(*begins), F.col("_p"))
    return cut(sorted_.withColumn(name, row.cast("long")).drop("_p"))


def greedy_keepers(rows: DataFrame, key: str, same: list[str], order: list[Column | str], near: Callable[[DataFrame, DataFrame], DataFrame], able: Column, first: int = 20_000) -> DataFrame:
    """Greedy keepers without the pairs of all neighbours: key, keeper (the first kept row, in order, that claims the row; itself if kept).

    Rows equal in ``same`` must claim each other and the same others: they share the fate of the smallest key of
    them, so one row of each such class takes part. ``order`` sorts classes (columns ``same``, and ``_first``, the
    smallest key). ``near(a, b)`` has keeper, row (``_pos`` of a and b) of classes that claim each other. Rows that
    are not ``able`` neither claim nor are claimed.

    The first classes of the order are decided among themselves; then those they claim go, and what is left of
    twice as many is decided: the same as one loop, but pairs are only made of rows that no earlier keeper claims.
    """
    cut = checkpointer(rows.sparkSession)
    able = able & F.col(key).isNotNull()
    all_ = positions(rows.where(able).groupBy(*same).agg(F.min(key).alias("_first")), order)
    n, rest, kept, high = all_.count(), all_, all_.limit(0), first
    while True:
        batch = rest if high >= n else cut(rest.where(F.col("_pos") < high))
        alone = first_claim(batch, "_pos", near(batch, batch).where("keeper < row")).where("_pos = keeper")
        new = cut(batch.join(alone.select("_pos"), "_pos", "left_semi"))
        kept = kept.unionByName(new)
        if high >= n:
            break
        later = rest.where(F.col("_pos") >= high)
        rest = cut(later.join(near(new, later).select(F.col("row").alias("_pos")), "_pos", "left_anti"))
        high *= 2
    by = near(kept, all_).where("keeper < row").select("keeper", "row").unionByName(kept.select(F.col("_pos").alias("keeper"), F.col("_pos").alias("row")))
    by = by.groupBy("row").agg(F.min("keeper").alias("keeper"))
    found = all_.join(by, all_._pos == by.row).select(*same, F.col("keeper").alias("_k"))
    found = found.join(kept.select(F.col("_pos").alias("_k"), F.col("_first").alias("keeper")), "_k").select(*same, "keeper")
    return rows.where(able).join(found, same).select(key, "keeper").unionByName(rows.where(~able | F.col(key).isNull()).select(key, F.col(key).alias("keeper")))


def inherit_unique(nodes: DataFrame, key: str, value: str, edges: DataFrame) -> DataFrame:
    """Fixpoint: a row without a value takes that of its neighbours iff all that have one agree; ends when none takes any.

    Rounds are synchronous; own values are never overridden and a row that
    inherits keeps what it got.
    """
    cut = checkpointer(nodes.sparkSession)
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    now = cut(nodes.select(F.col(key).alias("a"), F.col(value).alias("v")))
    while True:
        seen = both.join(now.where("v is not null").select(F.col("a").alias("b"), "v"), "b").groupBy("a").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        new = cut(now.where("v is null").join(seen.where("lo = hi"), "a").select("a", F.col("lo").alias("w")))
        if new.isEmpty():
            return now.select(F.col("a").alias(key), F.col("v").alias(value))
        now = cut(now.join(new, "a", "left").select("a", F.coalesce("v", "w").alias("v")))


def bounded_paths(edges: DataFrame, starts: DataFrame, goals: DataFrame, depth: int) -> DataFrame:
    """Simple paths of at most ``depth`` edges from starts to goals: start, goal, path, edges."""
    cut = checkpointer(edges.sparkSession)
    step = edges.select(F.col("a").alias("at"), F.col("b").alias("next"))
    front = starts.select(F.col("node").alias("start"), F.col("node").alias("at"), F.array("node").alias("path"))
    goal, out = goals.select(F.col("node").alias("at")), None
    for i in range(1, depth + 1):
        front = cut(front.join(step, "at").where(~F.array_contains("path", F.col("next"))).select("start", F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path")))
        found = front.join(goal, "at", "left_semi").select("start", F.col("at").alias("goal"), "path", F.lit(i).alias("edges"))
        out = found if out is None else out.unionByName(found)
        front = front.join(goal, "at", "left_anti")  # a path ends at its first goal
    return out


def accept_unique_close(paths: DataFrame, branch: str = "start") -> DataFrame:
    """Starts with exactly one closing path are accepted, others stay open: ambiguous or none."""
    return paths.withColumn("_n", F.count("*").over(W.partitionBy(branch))).withColumn("status", F.when(F.col("_n") == 1, "closed").otherwise("ambiguous")).drop("_n")


def fold_complementary(df: DataFrame, by: list[str], order: str, values: list[str]) -> DataFrame:
    """One row of each group: of every column the first non-null value in order."""
    return df.groupBy(*by).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in values], F.count("*").alias("pieces"))


def label_cells(cells: DataFrame, ix: str = "ix", iy: str = "iy") -> DataFrame:
    """8-connected regions of cells: ix, iy, region (the smallest cell id)."""
    cell = cells.select(ix, iy, (F.col(ix) * F.lit(1 << 31) + F.col(iy)).alias("cell"))
    near = F.explode(F.array(*[F.struct((F.col(ix) + i).alias("i"), (F.col(iy) + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    pairs = cell.select("cell", near.alias("p")).join(cell.select(F.col(ix).alias("i"), F.col(iy).alias("j"), F.col("cell").alias("other")), (F.col("p.i") == F.col("i")) & (F.col("p.j") == F.col("j")))
    c = components(pairs, "cell", "other")
    return cell.join(c, cell.cell == c.node).select(ix, iy, F.col("component").alias("region"))


def dilate(cells: DataFrame, r: int = 1, ix: str = "ix", iy: str = "iy") -> DataFrame:
    near = F.explode(F.array(*[F.struct((F.col(ix) + i).alias(ix), (F.col(iy) + j).alias(iy)) for i in range(-r, r + 1) for j in range(-r, r + 1)]))
    return cells.select(near.alias("p")).select("p.*").distinct()


def erode(cells: DataFrame, r: int = 1, ix: str = "ix", iy: str = "iy") -> DataFrame:
    """Cells whose whole square is set: each cell votes for its neighbours."""
    near = F.explode(F.array(*[F.struct((F.col(ix) + i).alias(ix), (F.col(iy) + j).alias(iy)) for i in range(-r, r + 1) for j in range(-r, r + 1)]))
    return cells.select(ix, iy).distinct().select(near.alias("p")).select("p.*").groupBy(ix, iy).agg(F.count("*").alias("n")).where(F.col("n") == (2 * r + 1) ** 2).drop("n")


def grow(seed: DataFrame, allowed: DataFrame, rounds: int = 10) -> DataFrame:
    """Dilate a seed within allowed cells, a bounded number of times."""
    cut, now = checkpointer(seed.sparkSession), seed.select("ix", "iy").distinct()
    for _ in range(rounds):
        now = cut(dilate(now).join(allowed.select("ix", "iy").distinct(), ["ix", "iy"]).unionByName(seed.select("ix", "iy")).distinct())
    return now


def grid(df: DataFrame, x: str, y: str, cell: float, **aggs: Column) -> DataFrame:
    """Cells with aggregates; partial sums are made before rows move."""
    return df.groupBy(F.floor(F.col(x) / cell).alias("ix"), F.floor(F.col(y) / cell).alias("iy")).agg(*[c.alias(k) for k, c in aggs.items()])

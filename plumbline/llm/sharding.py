"""Sharding by extendible hashing, in DataFrame operations only.

A directory is indexed by the leading bits of a hash. A bucket whose rows
exceed the byte limit splits on its next bit, and only that bucket, until
every shard fits. Byte sums of fine cells (a fixed number of leading bits)
come from one aggregation with partial sums; all shallower buckets are sums
of cells, and only cells that are too large themselves are opened further.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import Scratch

#: Bits by which one aggregation refines a bucket: at most 2**STEP cells each.
STEP = 14
_BITS = 60


def _prefix(depth) -> F.Column:
    """The leading ``depth`` bits of hash h (of _BITS bits)."""
    return F.expr(f"shiftright(h, {_BITS} - {depth})")


def extendible_shards(df: DataFrame, limit_bytes: int, key: str = "doc_id", text: str = "text", step: int = STEP) -> DataFrame:
    """Assign every row to a shard of at most ``limit_bytes`` bytes of text.

    Returns key (as doc_id), n_bytes, shard_id (the bucket's leading bits and
    its depth in one number), local_depth, shard_bytes, shard_rows and
    oversized. The hash is of key and text, so that copies under different keys
    spread. Null text counts 0 bytes; a null key hashes as null. A shard is
    oversized only if rows of one hash alone (one row beyond the limit, or
    repeated rows) exceed the limit: no bit separates them. Other columns are
    ignored; an empty table has no shard.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    k, t = F.col(f"`{key}`"), F.col(f"`{text}`")
    h = F.expr("shiftrightunsigned(h, 4)")
    rows = df.select(k.alias("doc_id"), F.coalesce(F.octet_length(t), F.lit(0)).cast("long").alias("n_bytes"), F.xxhash64(k, t).alias("h")).withColumn("h", h)
    rows = scratch.write(rows, "rows")  # three numbers a row: the text is read once

    parents, base, found = None, 0, None
    while True:
        top = min(base + step, _BITS)
        open_rows = rows if parents is None else rows.join(parents, _prefix(base) == F.col("p"), "left_semi")
        cells = open_rows.groupBy(_prefix(top).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        cells = scratch.write(cells, "cells")
        least = base + 1 if base else 0
        sums = (
            cells.select("b", "n", "cell", F.explode(F.sequence(F.lit(least), F.lit(top))).alias("depth"))
            .groupBy("depth", F.expr(f"shiftright(cell, {top} - depth)").alias("p"))
            .agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        )
        # A bucket exists if its parent was too large, and is a leaf if it fits or cannot split.
        split = sums.where((F.col("b") > limit_bytes) & (F.col("n") > 1)).select((F.col("depth") + 1).alias("depth"), F.col("p").alias("up"))
        born = sums.where(F.col("depth") > least).withColumn("up", F.expr("shiftright(p, 1)")).join(split, ["depth", "up"], "left_semi")
        born = scratch.write(born.select("depth", "p", "b", "n").unionByName(sums.where(F.col("depth") == least).select("depth", "p", "b", "n")), "buckets")
        fits = (F.col("b") <= limit_bytes) | (F.col("n") == 1) | F.lit(top == _BITS) & (F.col("depth") == top)
        # A leaf fills 2**(top - depth) entries of this part of the directory.
        entry = F.explode(F.expr(f"sequence(0L, shiftleft(1L, {top} - depth) - 1L)"))
        entries = born.where(fits).select("depth", "b", "n", "p", entry.alias("i")).select(F.expr(f"shiftleft(p, {top} - depth) + i").alias("slot"), F.struct("p", "depth", "b", "n").alias(f"leaf{top}"))
        placed = (found if found is not None else rows).withColumn("slot", _prefix(top)).join(entries, "slot", "left").drop("slot")
        last = placed.columns[-1]
        found = placed.withColumn("leaf", F.col(last) if found is None else F.coalesce("leaf", last)).drop(last)
        more = born.where(~fits & (F.col("depth") == top)).select("p")
        if top == _BITS or more.isEmpty():
            break
        parents, base = scratch.write(more, "large"), top

    leaf = F.col("leaf")
    shard = F.shiftleft(leaf["p"], 6).bitwiseOR(leaf["depth"].cast("long"))
    return found.select("doc_id", "n_bytes", shard.alias("shard_id"), leaf["depth"].cast("int").alias("local_depth"), leaf["b"].alias("shard_bytes"), leaf["n"].alias("shard_rows"), (leaf["b"] > limit_bytes).alias("oversized"))


def write_shards(df: DataFrame, shards: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write the rows of ``df`` under ``path``, one folder for each shard; keys must be unique."""
    named = shards.select(F.col("doc_id").alias("_shard_key"), "shard_id")
    out = df.join(named, F.col(f"`{key}`").eqNullSafe(F.col("_shard_key"))).drop("_shard_key")
    out.repartition("shard_id").write.partitionBy("shard_id").parquet(path)

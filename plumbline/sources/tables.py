"""Reading and writing: Parquet tables, JSON and GeoJSON, CSV with ragged headers, first-reader-wins.

Readers take any path that Spark can open; nothing here opens local files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators.graph import checkpointer


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a data folder; filters and columns reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def without_nan(df: DataFrame, *columns: str) -> DataFrame:
    """NaN becomes null, as unknown values never match: in the named columns, or in all of floating type."""
    names = columns or tuple(c for c, t in df.dtypes if t in ("double", "float"))
    return df.withColumns({c: F.when(~F.isnan(c), F.col(f"`{c}`")) for c in names})


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A GeoJSON file as one row for each feature: kind of geometry, coordinates as JSON, properties as a map."""
    raw = spark.read.schema("features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>").json(path, multiLine=True)
    f = raw.select(F.posexplode("features").alias("ordinal", "f"))
    return f.select("ordinal", F.col("f.geometry.type").alias("geometry"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def first_reader_wins(frames: list[DataFrame], key: str) -> DataFrame:
    """Of several readings of the same groups, all rows of the first reading that has any for the group."""
    tagged = None
    for i, df in enumerate(frames):
        part = df.withColumn("_reader", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    first = tagged.groupBy(key).agg(F.min("_reader").alias("_first"))
    return tagged.join(first, key).where("_reader = _first").drop("_reader", "_first")


def union_tagged(frames: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """Union with the source's name; columns that a source lacks are null."""
    out = None
    for name, df in frames.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; ragged sources go through union_tagged first."""
    df.write.csv(path, header=True)


def append_evolving(df: DataFrame, path: str) -> None:
    """Append Parquet; readers merge schemas, so old rows have null in new columns."""
    df.write.mode("append").parquet(path)


def read_evolving(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def write_features(df: DataFrame, geometry: Column, properties: list[str], path: str) -> None:
    """One GeoJSON feature a line."""
    out = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))
    df.select(F.to_json(out).alias("value")).write.text(path)


def patch_flag(target: DataFrame, flags: DataFrame, key: str, column: str) -> DataFrame:
    """Set one boolean column by key; refuses unless both sides have the same keys, each once."""
    sides = target.select(F.col(key).alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(flags.select(F.col(key).alias("k"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    odd = sides.groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a <> 1 or b <> 1 or k is null")
    if not odd.isEmpty():
        raise ValueError("flags and rows differ in their keys")
    return target.drop(column).join(flags.select(key, column), key)


def stride_sample(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """n rows at even steps of an order that no two rows share (a feature of reports: few rows by design).

    Ranges of the order are numbered each for itself; their row counts (a few numbers) give where each begins.
    """
    cut = checkpointer(df.sparkSession)
    sorted_ = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_p")))
    sizes = sorted(tuple(r) for r in sorted_.groupBy("_p").count().collect())
    step = max(1, sum(c for _, c in sizes) // max(1, n))
    begins, at = {}, 0
    for p, c in sizes:
        begins[p] = at
        at += c
    if not begins:
        return df.limit(0)
    first = F.element_at(F.create_map(*[x for p, b in begins.items() for x in (F.lit(p), F.lit(b))]), F.col("_p"))
    row = F.row_number().over(W.partitionBy("_p").orderBy(*order)) - 1 + first
    return sorted_.withColumn("_r", row).where((F.col("_r") % step == 0) & (F.col("_r") < step * n)).drop("_r", "_p")

"""The corpus pipeline: five stages over documents, each through one corpus operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import jaccard_join, langid, packing, pii, quality
from plumbline.llm._common import Scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """With a hash of each row: ids may be null or repeat, so verdicts go by row; only equal rows share one."""
    parts = [c for name in ("doc_id", "text", "lang", "source") for c in (F.col(name), F.col(name).isNull())]
    return docs.withColumn("_key", F.xxhash64(*parts))


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The keyed rows that are not rejected; the few rejected keys travel, where Spark finds them small enough."""
    keys = rejected.select(F.col("_key").alias("_rejected")).distinct()
    return docs.join(keys, F.col("_key") == F.col("_rejected"), "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found."""
    model, docs = langid.fit(docs), _keyed(docs)
    judged = langid.identify(docs, model, "_key", F.col("text"), F.col("lang"), F.col("source"))
    return _without(docs, judged.where(~F.col("kept"))).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither a base rule nor a certified cutoff rejects; labels hold for all rows of their id."""
    docs = _keyed(docs)
    keys = docs.select(F.col("doc_id").cast("long").alias("_id"), "_key").distinct()
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("_id"), "quality")
    labels = labels.join(keys, "_id").select(F.col("_key").alias("doc_id"), "quality")
    judged = quality.quality_verdicts(spark, docs.select(F.col("_key").alias("doc_id"), "text", "lang"), labels)
    return _without(docs, judged.where(~F.col("kept")).withColumnRenamed("doc_id", "_key")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id. Equal rows are one."""
    docs = _keyed(docs)
    groups = jaccard_join.jaccard_components(docs, "_key").select(F.col("doc_id").alias("_key"), "component_id")
    groups = groups.join(docs.select("_key", "doc_id"), "_key").distinct()
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key"))["_key"].alias("_first"))
    out = _without(docs, groups.join(first, "component_id").where("_key <> _first"))
    repeated = not docs.groupBy("_key").count().where("count > 1").isEmpty()
    return (out.dropDuplicates(["_key"]) if repeated else out).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which every span of personal data is replaced by its kind in brackets."""
    return pii.redact(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 ids."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language", language),
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Merge tables, trigram models and certified cutoffs are beyond SQL; brute force in tests/llm instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

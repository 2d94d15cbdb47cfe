"""One query for each corpus operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import html_text, jaccard_join, langid, media, packing, pii, piece_bpe, quality, sharding, url_filter
from plumbline.llm._common import table

#: Production limit of a shard, in bytes of text.
SHARD_BYTES = 4 << 20

RULES = (
    url_filter.Rule("block", "net", "/"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
)


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document: its text, its declared language, its source as host."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs), "doc_id", F.col("text"), F.col("lang"), F.col("source"))


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page: its visible text, markup language, address suffix and host."""
    pages = table(spark, sf_dir, "pages")
    host = F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1))
    return langid.identify(
        pages,
        langid.fit(table(spark, sf_dir, "documents")),
        "page_id",
        F.col("html"),
        F.regexp_extract("html", r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z-]+)", 1),
        host,
        F.regexp_extract(host, r"\.([a-z]+)(?::\d+)?$", 1),
        html_text.render,
    )


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.UrlPolicy(RULES))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_documents(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"), with_ids=False)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op7_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of all vectors; every hundredth asks for its copies among all."""
    vectors = media.picture_column(table(spark, sf_dir, "embeddings"), "embedding")
    return media.find_copies(vectors, F.col("picture"), "vec_id", F.col("vec_id") % 100 == 0)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.extendible_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), ranks_path=_vocabulary("byte_bpe_50k.tiktoken"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_html_extraction, op3_url_filter, op4_pii, op5_sentencepiece, op6_jaccard_join, op7_media_copies, op8_sharding, op9_packing, op10_quality_rules, pages_language_id)}


def oracle_sql() -> dict[str, str]:
    return {}

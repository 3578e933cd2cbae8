"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm import bpe_transducer, centroids, hard_negatives, langid, mixing, packing, pq_dedup, simhash, suffix_dedup, toxicity, urlfilter, voronoi, warc


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


documents, embeddings, pages, labels = (_table(t) for t in ("documents", "embeddings", "pages", "labels"))


def op1_pq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.near_duplicates(embeddings(spark, sf_dir))


def op2_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(documents(spark, sf_dir))


def op4_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.search_every_nth(embeddings(spark, sf_dir))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(pages(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(documents(spark, sf_dir), labels(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.judge(documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_transducer.count_tokens(documents(spark, sf_dir), tokenizer_path())


def op11_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to archives and read back; see warc.archived_pages for nulls, copies and repeated ids."""
    return warc.archived_pages(spark, pages(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth embedding against all rows; see hard_negatives.mine for nulls and ties. Every seventh
    row takes the next label first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(embeddings(spark, sf_dir).withColumn("label", label))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rounds over all embeddings of 64 components; see centroids.cluster for nulls, ties and empty clusters."""
    return centroids.cluster(embeddings(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pq_near_dedup, op2_pattern_packing, op3_simhash, op4_voronoi_topk, op5_source_mixing, op6_url_filter, op7_toxicity,
        op8_suffix_dedup, op9_language_id, op10_token_counts, op11_warc_roundtrip, op12_hard_negatives, op13_centroid_clusters,
    )
}

ORACLE_SQL = {
    "op1_pq_near_dedup": pq_dedup.ORACLE,
    "op4_voronoi_topk": voronoi.ORACLE,
    "op5_source_mixing": mixing.ORACLE,
    "op11_warc_roundtrip": warc.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_centroid_clusters": centroids.ORACLE,
}

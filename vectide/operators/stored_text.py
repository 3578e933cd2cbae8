"""Word postings on disk: Parquet partitioned by a hash of the word and sorted by it, with a table of words and one of sizes,
so that a search opens the partitions of the words it asks for and, of these, the row groups that can hold them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions import text as T
from vectide.operators import text_search

MOST_LISTED = 1000  # asked words up to which the scan gets them as a list


@dataclass(frozen=True)
class StoredText:
    """postings: (term, id, tf, dl, bucket); terms: (term, df, bucket); sizes: one row (n, avgdl, buckets)."""

    postings: DataFrame
    terms: DataFrame
    sizes: DataFrame


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write(docs: DataFrame, path: str, buckets: int = 64, rows_per_file: int = 5_000_000, id_col: str = "doc_id", text_col: str = "text") -> StoredText:
    """Store the postings of all documents; those with null text or without words have none. Rows are dealt by ranges of
    (bucket, word, id), so that a frequent word is written by many tasks. Sizes come last: a folder without them is not finished."""
    spark = docs.sparkSession
    found = text_search.postings(docs, id_col, text_col).withColumn("bucket", _bucket(F.col("term"), buckets))
    dealt = found.repartitionByRange("bucket", "term", "id").sortWithinPartitions("bucket", "term", "id")
    dealt.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("bucket").parquet(f"{path}/postings")
    found.limit(0).drop("bucket").coalesce(1).write.mode("overwrite").parquet(f"{path}/schema")
    terms = _postings(spark, path).groupBy("bucket", "term").agg(F.count("*").alias("df"))
    terms.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    T.bm25_sizes(docs, text_col).withColumn("buckets", F.lit(buckets)).coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes")
    return read(spark, path)


def _postings(spark: SparkSession, path: str) -> DataFrame:
    known = spark.read.parquet(f"{path}/schema").schema
    return spark.read.schema(known.add("bucket", "integer")).parquet(f"{path}/postings")


def read(spark: SparkSession, path: str) -> StoredText:
    terms = spark.read.schema("term string, df long, bucket int").parquet(f"{path}/terms")
    return StoredText(_postings(spark, path), terms, spark.read.parquet(f"{path}/sizes"))


def asked_only(queries: DataFrame, stored: StoredText) -> tuple[DataFrame, DataFrame]:
    """Postings and words of the partitions that the queries' words lie in; of up to `MOST_LISTED` words their rows alone."""
    buckets = stored.sizes.first()["buckets"]
    asked = queries.select(F.explode(T.words(F.col("text"))).alias("term")).distinct()
    listed = [r.term for r in asked.limit(MOST_LISTED + 1).collect()]
    opened = sorted(r.b for r in asked.select(_bucket(F.col("term"), buckets).alias("b")).distinct().collect())  # at most `buckets`
    keep = F.col("bucket").isin(opened)
    if len(listed) <= MOST_LISTED:
        keep &= F.col("term").isin(listed)
    return stored.postings.where(keep), stored.terms.where(keep)


def find(queries: DataFrame, stored: StoredText, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(q_id, id, score, rank): as text.bm25, over stored postings; how many documents have a word is read, not counted."""
    postings, terms = asked_only(queries, stored)
    return text_search.over_postings(queries, postings.select("term", "id", "tf", "dl"), k, stored.sizes, terms.select("term", "df"), k1, b)

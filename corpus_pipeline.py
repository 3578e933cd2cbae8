"""A training corpus from `documents`: toxic documents go, near-duplicates go, repeated passages go, sources are mixed
to their weights, and what is left is packed into sequences. Each stage is one of the operators, applied to all that
its predecessor kept; run() writes each stage as Parquet and reads it again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vectide.llm import mixing, packing, simhash, suffix_dedup, toxicity
from vectide.llm.common import materialize
from vectide.llm.registry import labels, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic, learnt from a bounded sample of the labelled rows
    among `docs`. Null texts count as empty, repeated rows go or stay together; with no labels every document stays."""
    known = labels(spark, sf_dir)
    model = toxicity.fit(toxicity.training_rows(docs, known, folds=1, held_out=1))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity of at least 0.8) the document with the smallest id."""
    return simhash.similar_dedup(docs, similarity=0.8, shingle=5)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 50 bytes that an earlier document has; n_chars follows the text."""
    cut = suffix_dedup.without_repeats(docs)
    return cut.selectExpr(*["cast(length(text) as bigint) as n_chars" if c == "n_chars" else c for c in cut.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, at most three times; null sources are a source."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document: where it lies in which sequence. Copies of a document have rows of their own,
    null texts are a piece of one token."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("source_mixing", mix_sources),
    ("pattern_packing", pack_sequences),
]

#: The classifier, suffix sort and tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Sources and sinks: corpora, question sets, and files of packed vectors."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.sources import vecs

QA_SCHEMA = "id string, question string, golden_answers array<string>, choices array<string>, metadata map<string,string>"
CORPUS_SCHEMA = "id string, title string, text string, contents string"


def read_corpus(spark: SparkSession, path: str, schema: str = CORPUS_SCHEMA) -> DataFrame:
    """JSON lines or Parquet, by the path's ending. The schema is given, so nothing is scanned to infer it."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.schema(schema).json(path)


def read_questions(spark: SparkSession, path: str, count: int | None = None, random: bool = False, seed: int = 2025) -> DataFrame:
    """All questions, or `count` of them: the first by id, or drawn by hash."""
    rows = spark.read.schema(QA_SCHEMA).json(path)
    return rows if count is None else rows.orderBy(F.xxhash64("id", F.lit(seed)) if random else F.col("id")).limit(count)


def splits(spark: SparkSession, folder: str, names: tuple[str, ...] = ("train", "dev", "test")) -> dict[str, DataFrame]:
    """The question sets of a folder by split: those of train.jsonl, dev.jsonl and test.jsonl that can be read."""
    found = {}
    for name in names:
        try:
            found[name] = read_questions(spark, f"{folder}/{name}.jsonl")
        except AnalysisException:  # there is no such file
            continue
    return found


def read_vectors(spark: SparkSession, paths: list[str], first: int | None = None, share: float | None = None, seed: int = 1234) -> DataFrame:
    """(vec_id, embedding) of several Parquet files as one table; the `first` rows by id, or a `share` of them by hash of it."""
    rows = spark.read.parquet(*paths).select("vec_id", "embedding")
    if share is not None:
        rows = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    return rows if first is None else rows.orderBy("vec_id").limit(first)


def fetch(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Hits (q_id, rank, doc_id) with their texts; hits without a document keep a null text. A document found by several
    hits comes once for each; order the result by q_id and rank."""
    return hits.join(corpus.select("doc_id", "text"), "doc_id", "left")


def read_vecs(spark: SparkSession, path: str, kind: str = "fvecs") -> DataFrame:
    """(file, position, embedding) of fvecs, ivecs or bvecs files, in ranges of bytes; see vecs.read for more."""
    return vecs.read(spark, path, kind).select("file", "position", "embedding")


def write_results(results: DataFrame, path: str) -> None:
    """Append measurements as CSV."""
    results.write.mode("append").csv(path, header=True)


def write_answers(answers: DataFrame, path: str) -> None:
    answers.write.mode("overwrite").json(path)

"""Stored postings: results of the plain search, what a search opens, edges."""

import pytest
from pyspark.sql import functions as F

from vectide.functions import text as T
from vectide.operators import stored_text

pytestmark = pytest.mark.seconds(200)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('text')}/postings"
    docs = [(i, " ".join(["the"] * (i % 5 + 1) + [f"w{i % 40}", f"w{i % 7}", f"x{i}"])) for i in range(600)] + [(900, None), (901, ""), (902, "... !"), (903, "W3 the w3")]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return docs, stored_text.write(docs, at, buckets=16, rows_per_file=100), at


def told(df):
    return sorted((r.q_id, r.rank, r.id, round(r.score, 9)) for r in df.collect())


def test_same_as_plain(spark, made, monkeypatch):
    docs, held, at = made
    queries = spark.createDataFrame([(1, "the w3"), (2, "x17 X17 nowhere"), (3, None), (4, ""), (5, "w39 w6 x5")], "q_id long, text string")
    wanted = told(T.bm25(queries, T.bm25_index(docs), 5, sizes=T.bm25_sizes(docs)))
    assert wanted and told(stored_text.find(queries, held, 5)) == wanted == told(stored_text.find(queries, stored_text.read(spark, at), 5))
    monkeypatch.setattr(stored_text, "MOST_LISTED", 2)  # many words
    assert told(stored_text.find(queries, held, 5)) == wanted
    assert stored_text.find(queries.where("q_id in (3, 4)"), held, 5).count() == stored_text.find(queries.limit(0), held, 5).count() == 0


def test_opens_what_it_asks_for(spark, made):
    _, held, _ = made
    queries = spark.createDataFrame([(1, "w3 x17")], "q_id long, text string")
    postings, terms = stored_text.asked_only(queries, held)
    plan = postings._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(term, [" in plan.split("PushedFilters:")[1]
    files = lambda df: {r.f for r in df.select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
    opened = {f.split("bucket=")[1].split("/")[0] for f in files(postings)}
    assert 1 <= len(opened) <= 2 and len(files(held.postings)) > 16
    assert {r.term: r.df for r in terms.collect()} == {r.term: r.n for r in postings.groupBy("term").agg(F.count("*").alias("n")).collect()}


def test_no_documents(spark, made, tmp_path):
    docs, _, _ = made
    empty = stored_text.write(docs.limit(0), f"file://{tmp_path}/none")
    assert stored_text.find(docs.select(F.col("doc_id").alias("q_id"), "text"), empty, 3).count() == 0

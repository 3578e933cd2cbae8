"""Texts counted and scored where they lie: same results, and no postings on the move."""

import pytest
from pyspark.sql import functions as F

from vectide.functions import text as T
from vectide.operators import index, quantizers, text_search

pytestmark = pytest.mark.seconds(200)


def docs_of(spark, twice):
    made = [(i, " ".join(["the"] * (i % 5 + 1) + [f"w{i % 40}", f"W{i % 7}", "x"])) for i in range(400)] + [(900, None), (901, ""), (902, "...")]
    return spark.createDataFrame(made + [(3, "the w3 again")] * twice, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("twice", [0, 1])
def test_bm25_in_rows(spark, monkeypatch, twice):
    """Also copies with one score, more cells than a task may hold, and an id that repeats."""
    docs = docs_of(spark, twice)
    queries = spark.createDataFrame([(1, "the w3"), (2, "x X nowhere"), (3, None), (4, ""), (5, "w39 w6 the")], "q_id long, text string")
    told = lambda df: sorted((r.q_id, r.rank, r.id, round(r.score, 6)) for r in df.collect())
    wanted = told(T.bm25(queries, T.bm25_index(docs), 5))
    monkeypatch.setattr(text_search, "CELLS", 30)
    monkeypatch.setattr(text_search, "SUMS", 7)
    assert wanted and told(text_search.find(queries, docs, 5)) == wanted
    postings = text_search.postings(docs)
    rows = lambda df: sorted(tuple(r) for r in df.select("term", "id", "tf", "dl").collect())
    assert rows(postings) == rows(T.bm25_index(docs))
    known = postings.groupBy("term").agg(F.count("*").alias("df"))
    sizes = spark.createDataFrame([(400, sum(i % 5 + 4 for i in range(400)) / 400)], "n long, avgdl double")
    if not twice:
        assert "Exchange hash" not in postings._jdf.queryExecution().executedPlan().toString()
        assert told(text_search.over_postings(queries, postings, 5, sizes, known)) == wanted
    assert text_search.find(queries.limit(0), docs, 3).count() == text_search.find(queries, docs.limit(0), 3).count() == 0


@pytest.mark.parametrize("twice", [0, 1])
def test_counts_in_rows(spark, twice):
    places = docs_of(spark, twice).select(F.col("doc_id").alias("vec_id"), F.transform(T.words(F.col("text")), lambda w: T.bucket_of(w, 8)).alias("places"))
    centers = spark.createDataFrame([(4, [float(i) for i in range(8)]), (2, [1.0, -1.0] * 4), (7, [float(i) for i in range(8)])], "list_no int, embedding array<double>")
    flat = places.select("vec_id", F.explode("places").alias("pos")).groupBy("vec_id", "pos").agg(F.count("*").cast("double").alias("x"))
    told = lambda df: sorted((r.vec_id, r.list_no, round(r.score, 6)) for r in df.collect())
    found = index.assign_counts(places, centers)
    assert told(found) == told(index.assign_sparse(flat, centers)) and found.count() == 400
    assert twice or "Exchange hash" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_task_tells_the_best_alone(spark):
    """However many batches a task sees, only k rows a query come out of it."""
    rows = spark.range(5000).select(F.col("id").alias("vec_id"), F.array(*[(F.hash("id", F.lit(i)) % 100).cast("double") for i in range(4)]).alias("embedding")).coalesce(1)
    books = quantizers.polysemous(quantizers.train(rows, 2, 4, 4, 3), 50)
    queries = rows.where("vec_id < 9").select(F.col("vec_id").alias("q_id"), "embedding")
    coded = quantizers.encode(rows, books)
    assert quantizers._polysemous(queries, coded, books, 4, 3).count() == 27
    pairs = lambda df: {(r.q_id, r.vec_id, round(r.score, 6)) for r in df.collect()}
    assert pairs(quantizers.polysemous_knn(queries, coded, books, 3, 4)) == pairs(quantizers.knn(queries, coded, books, 3))

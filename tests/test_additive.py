"""Additive codes: beam search, local search, least-squares books, searches by tables."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.operators import additive, search

pytestmark = pytest.mark.seconds(200)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('additive')}/rows"
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 8)) * np.geomspace(4, 0.5, 8) @ np.linalg.qr(rng.normal(size=(8, 8)))[0]
    spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4).write.parquet(at)
    return x, spark.read.parquet(at)


def errors(df):
    return np.array([r.error for r in df.orderBy("vec_id").collect()])


def exhaustive(x, books):
    best = np.full(len(x), np.inf)
    for codes in itertools.product(*[range(len(b)) for b in books]):
        best = np.minimum(best, ((x - sum(b[c] for b, c in zip(books, codes))) ** 2).sum(1))
    return best


def test_beam_and_local_search_against_all_codes(spark, made):
    """A beam of the whole space is exact; narrower ones and local search lie between greedy and exact."""
    x, rows = made
    books = np.random.default_rng(3).normal(size=(3, 8, 8)) * 2
    table, exact = additive.as_table(spark, books), exhaustive(x, books)
    greedy, beam, whole = (additive.beam_codes(rows, table, b) for b in (1, 6, 64))
    assert np.allclose(errors(whole), exact)
    local = additive.local_search_codes(greedy, table, 12, 2)
    sums = [errors(df).sum() for df in (greedy, beam, local)]
    print("error against exact: greedy, beam of 6, local search", [s / exact.sum() for s in sums])
    assert exact.sum() <= sums[1] < sums[0] and exact.sum() * (1 - 1e-9) <= sums[2] < 1.05 * exact.sum()
    assert (errors(local) <= errors(greedy) + 1e-9).all()
    back = additive.decoded(local, table).orderBy("vec_id").collect()
    assert np.allclose([((x[r.vec_id] - np.array(r.decoded)) ** 2).sum() for r in back], [r.error for r in back])
    again = {r.vec_id: r.codes for r in additive.local_search_codes(greedy.repartition(7), table, 12, 2).collect()}
    assert again == {r.vec_id: r.codes for r in back}  # whichever task has a row


def test_least_squares(spark, made):
    x, rows = made
    books = np.random.default_rng(4).normal(size=(2, 8, 8))
    books[1, 7] = 1e6  # nobody's centre
    coded = additive.beam_codes(rows, additive.as_table(spark, books), 4)
    held = coded.orderBy("vec_id").collect()
    b = np.zeros((len(x), 16))
    for r in held:
        b[r.vec_id, [r.codes[0], 8 + r.codes[1]]] = 1
    wanted = ((x - b @ np.linalg.lstsq(b, x, rcond=None)[0]) ** 2).sum()
    new = additive._books(additive.refit(coded, additive.as_table(spark, books)))
    got = sum(((x[r.vec_id] - new[0][r.codes[0]] - new[1][r.codes[1]]) ** 2).sum() for r in held)
    assert wanted * (1 - 1e-9) <= got < wanted * 1.0001 and np.allclose(new[1, 7], 1e6)


def test_training_and_search(spark, made):
    x, rows = made
    told = additive.train_local(rows, 3, 16, rounds=4, beam=4)
    greedy = errors(additive.beam_codes(rows, additive.train(rows, 3, 16, beam=1), 1)).sum()
    print("error by round against greedy", [e / greedy for e in told.errors])
    assert all(b <= a * (1 + 1e-9) for a, b in zip(told.errors, told.errors[1:])) and told.errors[0] < greedy and told.errors[-1] < 0.9 * greedy
    numbered, norms = additive.with_norms(told.coded, told.books)
    back = {r.vec_id: np.array(r.decoded) for r in additive.decoded(told.coded, told.books).collect()}
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
    hits = additive.knn(queries, numbered, told.books, norms, 10).collect()
    assert len(hits) == 200 and all(abs(((x[r.q_id] - back[r.vec_id]) ** 2).sum() - r.score) <= norms.step / 2 + 1e-6 for r in hits)
    exact = {(r.q_id, r.vec_id) for r in search.knn(queries, additive.decoded(told.coded, told.books).select("vec_id", F.col("decoded").alias("embedding")), 10).collect()}
    assert len(exact & {(r.q_id, r.vec_id) for r in hits}) >= 0.8 * len(exact)


def test_edges(spark):
    """Null vectors and vectors with null or non-finite components get no code; other columns stay; empty tables are empty."""
    table = additive.as_table(spark, np.arange(8.0).reshape(2, 2, 2))
    rows = spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, None, "b"), (3, [float("nan"), 0.0], "c"), (4, [None, 1.0], "d"), (1, [1.0, 2.0], "e"), (None, [0.0, 0.0], "f")], "vec_id long, embedding array<double>, code string")
    coded = additive.beam_codes(rows, table)
    assert sorted((r.code, len(r.codes)) for r in coded.collect()) == [("a", 2), ("e", 2), ("f", 2)] and coded.columns == ["vec_id", "embedding", "code", "codes", "error"]
    assert additive.local_search_codes(coded, table).count() == 3
    empty = additive.beam_codes(rows.limit(0), table)
    assert empty.count() == 0 and additive.local_search_codes(empty, table).count() == 0
    numbered, norms = additive.with_norms(empty, table)
    assert additive.knn(rows.select(F.col("vec_id").alias("q_id"), "embedding"), numbered, table, norms, 3).count() == 0
    assert np.allclose(additive._books(additive.refit(empty, table)), np.arange(8.0).reshape(2, 2, 2))
    with pytest.raises(ValueError):
        additive.beam_codes(rows, additive.as_table(spark, np.zeros((17, 256, 1))))

"""Learnt codes: rotations, renumbered codes and their bit filter, Bloom filters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_stored import moved
from vectide.operators import codecs, index, quantizers, search

pytestmark = pytest.mark.seconds(200)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """3,000 vectors whose components are strongly correlated: the case that rotations are for."""
    at = f"file://{tmp_path_factory.mktemp('codes')}/rows"
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)) * np.geomspace(8, 0.1, 16) @ np.linalg.qr(rng.normal(size=(16, 16)))[0]
    spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4).write.parquet(at)
    return x, spark.read.parquet(at)


def test_rotation(spark, made):
    x, rows = made
    told = quantizers.opq(rows, 4, 16, 16, 10)
    assert np.allclose(told.rotation @ told.rotation.T, np.eye(16)) and all(b <= a * (1 + 1e-9) for a, b in zip(told.errors, told.errors[1:]))
    books = np.array(quantizers._books(told.books))
    y = x @ told.rotation.T
    error = sum(((y[:, None, 4 * s : 4 * s + 4] - books[s]) ** 2).sum(2).min(1).sum() for s in range(4))
    plain = np.array(quantizers._books(quantizers.train(rows, 4, 16, 16, 20)))
    before = sum(((x[:, None, 4 * s : 4 * s + 4] - plain[s]) ** 2).sum(2).min(1).sum() for s in range(4))
    print("opq: error against plain", error / before)
    assert error < 0.9 * before
    turned = quantizers.rotated(rows.withColumn("more", F.lit("kept")), told.rotation)
    assert np.allclose(np.array([r.embedding for r in turned.orderBy("vec_id").collect()]), y) and turned.columns == ["vec_id", "embedding", "more"]
    with pytest.raises(ValueError):
        quantizers.opq(rows.limit(5), 4, 16, 16)


def test_bits_tell_distance(spark, made, monkeypatch):
    """Renumbering brings bits in line with distances; recall against the share of pairs looked up is better than before it."""
    x, rows = made
    books = quantizers.train(rows, 4, 16, 16, 8)
    new = quantizers.polysemous(books)
    old_, new_ = quantizers._books(books), quantizers._books(new)
    bits = np.bitwise_count(np.arange(16)[:, None] ^ np.arange(16)).astype(float)
    agree = lambda c: np.corrcoef(bits[np.triu_indices(16, 1)], np.sqrt(((c[:, None] - c) ** 2).sum(2))[np.triu_indices(16, 1)])[0, 1]
    for a, b in zip(old_, new_):
        assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and agree(b) > agree(a) + 0.1 and agree(b) > 0.3
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
    coded = quantizers.encode(rows, new)
    pairs = lambda df: {(r.q_id, r.vec_id, round(r.score, 6)) for r in df.collect()}
    wanted = pairs(quantizers.knn(queries, coded, new, 5))
    assert pairs(quantizers.polysemous_knn(queries, coded, new, 5, 16)) == wanted
    share = len(pairs(quantizers.polysemous_knn(queries, coded, new, 5, 5)) & wanted) / len(wanted)
    rate = quantizers.polysemous_rate(queries, coded, new, 5)
    plain = len(pairs(quantizers.polysemous_knn(queries, quantizers.encode(rows, books), books, 5, 5)) & wanted) / len(wanted)
    print("polysemous: recall", share, "of", rate, "of the pairs; codes as trained:", plain)
    assert share >= 0.8 and rate < 0.4 and share >= plain - 0.02
    monkeypatch.setattr(search, "BROADCAST_BYTES", 4 * 16 * 8 * 7)  # queries in blocks
    assert pairs(quantizers.polysemous_knn(queries, coded, new, 5, 16)) == wanted
    assert quantizers.polysemous_knn(queries.limit(0), coded, new, 5, 16).count() == 0
    with pytest.raises(ValueError):
        quantizers.polysemous(books.where("code < 9"))


def test_bloom_filter(spark, made):
    _, rows = made
    ids = spark.createDataFrame([(i,) for i in [*range(0, 3000, 50), 7, 7, 99_999, None]], "vec_id long")
    wanted = {r.vec_id for r in rows.join(ids, "vec_id", "left_semi").collect()}
    got = index.among(rows, ids)
    assert {r.vec_id for r in got.collect()} == wanted and got.columns == rows.columns
    bloom = index.bloom_of(ids)
    assert bloom.nbytes == 1 << 20 and wanted <= {r.vec_id for r in index.maybe_in(rows, bloom).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain, sifted = rows.join(ids, "vec_id", "left_semi"), index.among(rows, ids)
        assert len(plain.collect()) == len(sifted.collect()) == len(wanted)
        assert moved(sifted) < 0.1 * moved(plain)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert index.among(rows, ids.limit(0)).count() == 0


def test_square_waves(spark, made):
    """Bits by hand, and recall beside sign bits: with a period wider than the data both tell the same, a shorter one tells more of near rows."""
    row = spark.createDataFrame([([0.0, 0.6, 1.1, -0.4, 2.2], [0.0, 0.0, 0.0, 0.0, 0.0])], "v array<double>, c array<double>")
    words = row.select(codecs.spectral_words(F.col("v"), F.col("c"), 1.0, 5).alias("w")).first().w
    assert words == [0b01010]  # in halves of a period: 0, 1, 2, -1, 4
    x, rows = made
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
    centroids = spark.createDataFrame([(0, x.mean(0).tolist())], "list_no int, embedding array<double>")
    lists = rows.withColumn("list_no", F.lit(0))
    exact = {(r.q_id, r.vec_id) for r in search.knn(queries, rows, 5).collect()}
    recalls = {}
    for period in (1e6, 8.0):
        found = search.spectral(queries, queries.select("q_id", F.lit(0).alias("list_no")), centroids, lists, 30, period, 16)
        recalls[period] = len(exact & {(r.q_id, r.vec_id) for r in found.collect()}) / len(exact)
    print("square waves: recall of 5 in 30 by period", recalls)
    assert recalls[8.0] > 0.1

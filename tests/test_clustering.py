"""k-means of the registered query against plain rounds over all rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide import catalog
from vectide.operators import clustering


@pytest.mark.seconds(90)
def test_kmeans_takes_all_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(12, 8)) * 4, 300, axis=0) + rng.normal(size=(3600, 8))
    df = spark.createDataFrame([(i, v.tolist(), i % 5) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    first = df.orderBy(F.xxhash64("vec_id", F.lit(1234)), "vec_id").limit(10).collect()
    c = np.array([r.embedding for r in first])
    for _ in range(8):
        at = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        c = np.array([x[at == j].mean(0) for j in range(10)])
    got = catalog.QUERIES["kmeans"](spark, str(tmp_path)).orderBy("list_no").collect()
    assert np.allclose([r.embedding for r in got], c, atol=1e-6)


def test_two_levels(spark, monkeypatch):
    """Close to plain k-means at a fraction of the distances; cells in many slices; cells of equal rows."""
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(40, 6)) * 3)[np.arange(4000) % 40] + rng.normal(size=(4000, 6))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(8)
    _, plain = clustering.kmeans(df, 64, 15, per_cluster=None)
    for more in ({}, {"task_rows": 100}, {"refine": 1}):
        centers, told = clustering.two_level(df, 64, 8, 15, **more)
        at = np.array([r.embedding for r in centers.orderBy("list_no").collect()])
        d = ((x[:, None] - at) ** 2).sum(2)
        assert len(at) == 64 and np.isclose(told["objective"], d.min(1).sum())
        print("two levels", more, "objective", told["objective"] / plain[-1], "distances", told["distances"] / (4000 * 64 * 15))
        assert told["objective"] <= 1.05 * plain[-1] and told["distances"] < (1.0 if "task_rows" in more else 0.5) * 4000 * 64 * 15
    equal = spark.createDataFrame([(i, [1.0, 2.0] if i < 30 else [float(i), 0.0]) for i in range(50)], "vec_id long, embedding array<double>")
    centers, told = clustering.two_level(equal, 10, 2)
    assert centers.count() <= 10 and told["objective"] >= 0
    with pytest.raises(ValueError):
        clustering.two_level(equal.limit(5), 10, 2)


def test_shares():
    assert clustering.shares(np.array([10, 0, 90]), 10).tolist() == [1, 0, 9]
    assert clustering.shares(np.array([1, 1, 98]), 4).tolist() == [1, 1, 2]
    assert clustering.shares(np.array([2, 2]), 4).tolist() == [2, 2]
    assert clustering.shares(np.array([5, 0, 5, 5]), 2).tolist() == [1, 0, 1, 1]  # a cell with rows needs a centre


def test_one_dimension_is_exact(spark):
    rng = np.random.default_rng(3)
    for trial in range(60):
        n, k = int(rng.integers(1, 12)), int(rng.integers(1, 5))
        v, w = np.unique(rng.integers(-20, 20, n).astype(float)), None
        w = rng.integers(1, 6, len(v)).astype(float)
        k = min(k, len(v))

        def loss(cuts):
            return sum((w[a:b] * (v[a:b] - np.average(v[a:b], weights=w[a:b])) ** 2).sum() for a, b in zip(cuts, cuts[1:]))

        best = min(loss([0, *c, len(v)]) for c in itertools.combinations(range(1, len(v)), k - 1))
        got = clustering.exact_cuts(v - v.mean(), w, k)
        assert len(got) == k + 1 and all(a < b for a, b in zip(got, got[1:])) and np.isclose(loss(got), best), trial
    big = np.sort(rng.normal(size=3000))
    got = clustering.exact_cuts(big, np.ones(3000), 7)
    plain = {(0, 0): 0.0}
    s1, s2 = np.concatenate([[0], np.cumsum(big)]), np.concatenate([[0], np.cumsum(big**2)])
    cost = lambda a, b: s2[b] - s2[a] - (s1[b] - s1[a]) ** 2 / (b - a)
    row = np.array([cost(0, i) if i else 0 for i in range(3001)])
    for _ in range(6):
        row = np.array([np.inf, *[(row[:i] + (s2[i] - s2[:i] - (s1[i] - s1[:i]) ** 2 / (i - np.arange(i)))).min() for i in range(1, 3001)]])
    assert np.isclose(sum(cost(a, b) for a, b in zip(got, got[1:])), row[3000])
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (None,), (float("nan"),), (50.0,), (52.0,)], "x double")
    rows = clustering.one_dimensional(df, 2).orderBy("cluster").collect()
    assert [(r.low, r.high, r.n, round(r.mean, 4)) for r in rows] == [(1.0, 2.0, 3, 1.3333), (50.0, 52.0, 2, 51.0)]
    assert clustering.one_dimensional(df, 9).count() == 4 and clustering.one_dimensional(df.limit(0), 3).count() == 0
    for bad, most in ((df, 3), (spark.createDataFrame([(float("inf"),)], "x double"), 100)):
        with pytest.raises(ValueError):
            clustering.one_dimensional(bad, 2, most)

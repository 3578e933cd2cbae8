"""Whole-number clustering against Python's integers and SQL; the intervals of the float32 screen."""

import hashlib

import numpy as np
import pytest

from tests.compare import assert_same, duck, rows_of
from vectide.llm import centroids, registry

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.seconds(120)
SCHEMA = "vec_id long, embedding array<double>, cluster int, v double"


def brute(rows, k=8, rounds=10, dim=64):
    rows = [(i, [int(np.floor(1024.0 * x)) for x in v]) for i, v in rows]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)[:k]
    c = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, x)), n) for n, x in enumerate(c)) for _, v in rows]

    for _ in range(rounds):
        at = [n for _, n in assign()]
        for n in range(len(c)):
            mine = [v for (_, v), m in zip(rows, at) if m == n]
            if mine:
                c[n] = [sum(z) // len(mine) for z in zip(*mine)]
    far = assign()
    fits = lambda x: x if x < 1 << 63 else None
    loss = {n: sum(d for d, m in far if m == n) for _, n in far}
    return sorted(((i, n, fits(d), fits(loss[n]), fits(sum(loss.values())), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(rows, far)), key=str)


def told(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], SCHEMA)


def test_against_sql(spark):
    assert_same(rows_of(registry.op13_centroid_clusters(spark, SF)), duck(SF, centroids.ORACLE, ["embeddings"]))


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(60)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (60, [0.0] * 64), (61, [-0.0001] * 64), (62, [1.0] * 64), (63, [1.0] * 64)]
    odd = [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [float("nan")] * 64), (105, [None] + [1.0] * 63), (106, [float("-inf")] * 64), (107, [1e306] * 64)]
    got = centroids.cluster(table(spark, rows + odd).repartition(4))
    assert told(got) == brute(rows)
    assert told(centroids.cluster(table(spark, rows[:3]))) == brute(rows[:3])
    assert centroids.cluster(table(spark, odd)).count() == centroids.cluster(table(spark, [])).count() == 0


def test_huge_components(spark):
    """Sums and distances beyond a long: assignments and centroids stay exact, numbers that do not fit are null."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=64) * 10.0 ** rng.integers(0, 36)).astype(np.float32).astype(float).tolist()) for i in range(40)]
    assert told(centroids.cluster(table(spark, rows), rounds=4)) == brute(rows, rounds=4)


def test_ties_and_screen():
    """Centroids in equal distance, and distances that float32 cannot tell apart: always the smallest number of the nearest."""
    rng = np.random.default_rng(7)
    for size in (3, 1000, 1 << 22, 1 << 25):
        c = rng.integers(-size, size, size=(40, 16))
        c[20:] = c[:20]
        c[10:20, 0] = c[:10, 0] + rng.integers(0, 2, size=10)
        x = np.concatenate([c[rng.integers(0, 40, 400)] + rng.integers(-1, 2, size=(400, 16)), rng.integers(-size, size, size=(100, 16))]).astype(float)
        held = centroids.centroids_from(c.tolist())
        d = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in c] for v in x.astype(int)], object)
        wanted = [min(range(40), key=lambda n: (row[n], n)) for row in d]
        assert centroids.nearest(x, held).tolist() == wanted
        for single in (True, False):
            may = centroids.shortlist(x, held, single)
            assert may[np.arange(len(x)), wanted].all() and (d[may] >= 0).all()
        if size == 1000:
            assert may.mean() < 0.2

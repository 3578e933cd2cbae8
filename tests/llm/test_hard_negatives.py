"""Hard negatives against all pairs: clusters, odd rows, groups in many blocks and tasks."""

from functools import partial

import numpy as np
import pytest

from tests.compare import assert_same, duck, rows_of
from vectide.llm import hard_negatives, registry

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.seconds(120)
SCHEMA = "vec_id long, embedding array<float>, label int, leaf int, score long, low double, task string"


def brute(rows, every=50):
    """All pairs; rows (id, vector, label) that take part."""
    rows = [(i, np.floor(256 * np.array(v, np.float32).astype(float)), y) for i, v, y in rows]
    out = []
    for a, x, label in {r[0]: r for r in sorted(rows, key=lambda r: (r[0], r[2], r[1].tolist()), reverse=True) if r[0] % every == 0}.values():
        scored = sorted((-int(x @ v), i, y) for i, v, y in rows if len(v) == len(x) and i != a)
        for n, (p, i, _) in enumerate([s for s in scored if s[2] == label][:5]):
            near = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(a, i, m + 1, s[1], -p, -s[0], n + 1) for m, s in enumerate(near)]
    return sorted(out)


def told(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank").collect())


def test_against_sql(spark):
    assert_same(rows_of(registry.op12_hard_negatives(spark, SF)), duck(SF, hard_negatives.ORACLE, ["embeddings"]))


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    some = [(i, rng.normal(size=4).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(120)]
    some += [(i, [1.0, 0.5], i % 2) for i in range(200, 260)] + [(50, some[50][1], some[50][2]), (7, some[7][1], 1), (300, [1.0], 1), (350, [-1.0, -1.0, -1.0, 0.0, 0.5], 1), (351, [-1.0, -1.0, -1.0, 0.0, 0.5], 1)]
    odd = [(None, [1.0] * 4, 1), (400, None, 1), (450, [], 1), (500, [float("nan")] * 4, 1), (550, [None, 1.0, 1.0, 1.0], 1), (600, [float("inf")] * 4, 1), (650, [1.0] * 4, None)]
    df = spark.createDataFrame([(*r, 1, 2, 3.0, "t") for r in some + odd], SCHEMA)
    assert told(hard_negatives.mine(df)) == brute(some)
    assert hard_negatives.mine(df.limit(0)).count() == hard_negatives.mine(df.where("vec_id = 7")).count() == 0
    assert hard_negatives.mine(df.where("vec_id = 50")).count() == 0
    large = spark.createDataFrame([(i, [1e18 * (i + 1), 1.0], i % 2, 1, 2, 3.0, "t") for i in range(0, 100, 10)], SCHEMA)
    assert all(r.positive_score >= r.negative_score for r in hard_negatives.mine(large).collect())


def test_clusters_in_many_tasks(spark, monkeypatch):
    """Clustered vectors: most leaf pairs drop out, and nothing is lost over many groups, blocks and tasks."""
    rng = np.random.default_rng(5)
    center = rng.normal(size=(24, 8)) * 2
    x = (center[np.arange(3000) % 24] + rng.normal(size=(3000, 8)) * 0.05).astype(np.float32)
    x[1000:1100] = x[999]  # copies
    rows = [(i, x[i].tolist(), int(i % 24 // 4)) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(8)
    shares = []
    meet = hard_negatives.meet

    def watched(anchors, sizes, data, upper, *rest, **more):
        shares.append((upper > -np.inf)[sizes > 0].mean())
        return meet(anchors, sizes, data, upper, *rest, group_anchors=10, rows_per_task=100)

    monkeypatch.setattr(hard_negatives, "meet", watched)
    monkeypatch.setattr(hard_negatives, "planted", lambda rows, n, most, dim, name, f=hard_negatives.planted: f(rows, n // 8, most, dim, name))
    assert told(hard_negatives.mine(df, anchor_every=20)) == brute(rows, 20)
    print("dual tree: shares of leaf pairs scored", shares)
    assert shares[1] < 0.3


def test_intervals_hold():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(300, 5)), rng.normal(size=(500, 5)) + 1
    trees = []
    for z, leaves in ((x, 8), (y, 16)):
        tree = hard_negatives.grow(z, leaves)
        leaf = hard_negatives.route(z, tree)
        for n in range(len(tree.size)):
            lo = hi = n  # leaves below node n
            while lo < tree.inner:
                lo, hi = 2 * lo + 1, 2 * hi + 2
            below = (leaf + tree.inner >= lo) & (leaf + tree.inner <= hi)
            if below.any():
                tree.size[n], tree.radius[n] = below.sum(), np.sqrt(((z[below] - tree.center[n]) ** 2).sum(1)).max() * (1 + 1e-9)
        trees.append((z, leaf, tree))
    (x, at, a), (y, to, c) = trees
    assert at.max() < 8 and np.bincount(at).min() > 20
    low, high = hard_negatives.interval(a, np.repeat(a.inner + at, len(y)), c, np.tile(c.inner + to, len(x)))
    s = (x @ y.T).ravel()
    assert (low <= s).all() and (s <= high).all()
    upper, seen = hard_negatives.surviving(a, c, lambda i, j, lo, hi: hi >= 6.0)
    assert ((x @ y.T >= 6.0) <= (upper[at][:, to] > -np.inf)).all() and seen < (2 * 8 - 1) * (2 * 16 - 1)

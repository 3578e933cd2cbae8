"""Paths that only large inputs take, forced on small ones, and what must not grow: plans, model calls, groups."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vectide.operators import codecs, evaluate, search
from vectide.plans import graph, workflow
from vectide.streaming import windows

pytestmark = pytest.mark.seconds(200)


def corpus(spark):
    docs = spark.createDataFrame([(i, [float(i % 3), 1.0], f"text {i}") for i in range(9)], "vec_id long, embedding array<double>, text string")
    return workflow.Corpus(docs, lambda r: r.select("id", F.array(F.length("text") % 3 + 0.0, F.lit(1.0)).alias("embedding")))


def test_generators_run_once_and_plans_stay_small(spark):
    """Ten rounds with branches: the last plan is as small as the first, and a counted generator is asked once a row and node."""
    calls = spark.sparkContext.accumulator(0)

    def count(prompt):
        calls.add(1)
        return prompt[-20:]

    model = F.udf(count, "string").asNondeterministic()
    say = lambda name: workflow.Generate(lambda: F.concat(F.lit(name), F.col("question")), "answer", model)
    g = graph.Graph("branches").add_node("a", say("a")).add_node("b", say("b"))
    for n in ("a", "b"):
        g.add_edge(n, graph.END, lambda: F.col("round") >= 10).add_edge(n, "b", lambda: F.col("id") % 2 == 0).add_edge(n, "a")
    g.add_edge(graph.START, "a")
    requests = spark.createDataFrame([(i, f"q{i}") for i in range(6)], "id long, question string")
    out = graph.run(requests, g, corpus(spark), rounds=12)
    assert sorted((r.id, r.passed) for r in out.collect()) == [(i, 10) for i in range(6)]
    assert calls.value == 60
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 14
    calls.value = 0
    flow = workflow.Workflow("twice", (say("x"), workflow.SetColumn("query", lambda: F.col("answer")), workflow.Retrieve(2), say("y")))
    assert workflow.run(requests, flow, corpus(spark)).count() == 6 and calls.value == 12


def test_histogram_of_many_queries(spark, monkeypatch):
    rng = np.random.default_rng(1)
    q, x = rng.integers(0, 4, (50, 3)).astype(float), rng.integers(0, 4, (200, 3)).astype(float)
    queries = spark.createDataFrame([(i, v) for i, v in enumerate(q.tolist())] + [(99, None)], "q_id long, embedding array<double>")
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    values, n = np.unique(np.abs(q[:, None] - x).sum(2), return_counts=True)
    for limit in (search.BROADCAST_BYTES, 0):
        monkeypatch.setattr(search, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(search, "QUERY_BLOCK", 7)
        monkeypatch.setattr(search, "DATA_BLOCK", 30)
        got = search.histogram(queries, rows, "l1").orderBy("score").collect()
        assert [(r.score, r.n) for r in got] == list(zip(values.tolist(), n.tolist()))


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(501, 3)), np.tile([1e9, 0.0, -5.0], (300, 1)), [[np.nan, 1.0, 2.0]]])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    got = codecs.quantiles(df, [0.0, 0.25, 0.5, 0.999, 1.0], bins=5)
    for pos in range(3):
        column = x[~np.isnan(x[:, pos]), pos]
        assert np.allclose(got[pos], np.quantile(column, [0.0, 0.25, 0.5, 0.999, 1.0]), rtol=1e-12)
    assert codecs.quantiles(df.limit(0), [0.5]) == {}


def test_thresholds_without_pairs(spark):
    """Precision and recall by threshold against counting; the plan joins no hits with thresholds."""
    rng = np.random.default_rng(3)
    hits = [(int(q), int(v), float(s)) for q, v, s in zip(rng.integers(0, 9, 300), range(300), rng.integers(0, 20, 300) / 4)]
    good = {(q, v) for q, v, s in hits if s < 2.5} | {(77, 1)}
    found = spark.createDataFrame([*hits, (1, 900, float("nan"))], "q_id long, vec_id long, score double")
    truth = spark.createDataFrame(sorted(good), "q_id long, vec_id long")
    limits = [-1.0, 0.25, 2.5, 2.6, 99.0]
    df = evaluate.precision_recall_at(truth, found, spark.createDataFrame([(t,) for t in [*limits, 2.5]], "threshold double"))
    got = {r.threshold: (r.precision, r.recall) for r in df.collect()}
    for t in limits:
        passed = [(q, v) for q, v, s in hits if s < t]
        both = len(good & set(passed))
        assert got[t] == pytest.approx((both / len(passed) if passed else 1.0, both / len(good)))
    assert len(got) == 5 and "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_running_sums_and_lags_in_ranges(spark):
    rows = spark.range(300).selectExpr("id * id as id", "id % 4 as g", "if(id % 7 = 0, null, id) as v").repartition(6)
    got = {r.id: r.start_time for r in windows.arrivals(rows, 2.0, ranges=5).collect()}
    whole = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    gap = -F.ln(1 - F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit("|2025"))), 1, 8), 16, 10).cast("double") / 4294967296.0) / 2.0
    for r in rows.select("id", F.sum(gap).over(whole).alias("s")).collect():
        assert got[r.id] == pytest.approx(r.s)
    lagged = sorted(map(str, windows.lagged(rows, "g", "id", "v", "w", ranges=5).select("id", "w").collect()))
    assert lagged == sorted(map(str, rows.select("id", F.lag("v").over(Window.partitionBy("g").orderBy("id")).alias("w")).collect()))
    assert windows.arrivals(rows.limit(0), 2.0).count() == windows.lagged(rows.limit(0), "g", "id", "v", "w").count() == 0


def test_nearest_values(spark):
    """Few distinct values, many copies, several ranges: against sorting everything for each query."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(0, 40, 300) / 2, np.full(200, 7.0), rng.normal(size=100)])
    q = np.concatenate([rng.integers(-5, 60, 40) / 2, [7.0, 7.0, 1e9, -1e9]])
    values = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(9000, None), (9001, float("nan"))], "vec_id long, x double").repartition(5)
    queries = spark.createDataFrame([(i, float(v)) for i, v in enumerate(q)] + [(900, None)], "q_id long, x double")
    for k, per in ((1, 20), (4, 30), (700, 10_000)):
        got = sorted((r.q_id, r["rank"], r.vec_id) for r in search.nearest_values(queries, values, k, per).collect())
        wanted = [(j, n + 1, i) for j, v in enumerate(q) for n, i in enumerate(np.lexsort((np.arange(600), np.abs(x - v)))[:k].tolist())]
        assert got == sorted(wanted)
    assert search.nearest_values(queries, values.limit(0), 2).count() == search.nearest_values(queries.limit(0), values, 2).count() == 0


def test_kept_lists_are_released(spark):
    lists = spark.range(100).selectExpr("id as vec_id", "array(double(id)) as embedding", "int(id % 5) as list_no")
    hot = spark.createDataFrame([(1,), (2,)], "list_no int")
    queries = spark.createDataFrame([(0, [41.0]), (1, [3.0])], "q_id long, embedding array<double>")
    probed = spark.createDataFrame([(0, 1), (0, 3), (1, 2), (1, 4)], "q_id long, list_no int")
    with search.kept_lists(lists, hot) as kept:
        found = [search.hot_and_cold(queries, probed, lists, kept, hot, 2) for _ in range(2)]
        assert kept.storageLevel.useMemory
    assert not kept.storageLevel.useMemory
    for f in found:
        assert sorted((r.q_id, r.vec_id) for r in f.collect()) == [(0, 41), (0, 43), (1, 2), (1, 4)]

"""Stored indexes: what a search opens and moves follows the lists it probes; interrupted work goes on where it stopped."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.operators import index, search, stored

pytestmark = pytest.mark.seconds(150)


def scans(df) -> list[int]:
    """Files read by each scan of a plan that has run."""
    found = []

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        if kind == "FileSourceScanExec":
            found.append(plan.metrics().apply("numFiles").value())
        for i in range(plan.children().size()):
            walk(plan.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def moved(df) -> int:
    """Rows written by the shuffles of a plan that has run."""
    total = 0

    def walk(plan):
        nonlocal total
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        if kind == "ShuffleExchangeExec":
            total += plan.metrics().apply("shuffleRecordsWritten").value()
        for i in range(plan.children().size()):
            walk(plan.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return total


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """100 lists of 200 vectors around far apart centres, on disk."""
    at = f"file://{tmp_path_factory.mktemp('index')}"
    rng = np.random.default_rng(1)
    center = rng.normal(size=(100, 8)) * 10
    x = np.repeat(center, 200, axis=0) + rng.normal(size=(20_000, 8)) * 0.1
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    rows.repartition(8).write.parquet(f"{at}/rows")
    rows = spark.read.parquet(f"{at}/rows")
    centroids = spark.createDataFrame([(i, v) for i, v in enumerate(center.tolist())], "list_no int, embedding array<double>")
    return rows, centroids, stored.write(index.build(rows, centroids), centroids, f"{at}/one"), at


@pytest.mark.parametrize("probes_sent", [200_000, 0])
def test_only_probed_lists_are_opened(spark, made, monkeypatch, probes_sent):
    rows, centroids, at, _ = made
    monkeypatch.setattr(search, "PROBES", probes_sent)
    queries = rows.where("vec_id in (5, 7, 3001)").select(F.col("vec_id").alias("q_id"), "embedding")
    found = stored.find(queries, at, 10, 2)
    got = sorted((r.q_id, r.vec_id, r.rank) for r in found.collect())
    assert got == sorted(tuple(r) for r in search.knn(queries, rows, 10).select("q_id", "vec_id", "rank").collect())
    lists = len({r.list_no for r in search.probes(queries, centroids, 2).collect()})
    assert lists in scans(found) and max(scans(found)) <= max(lists, 8)  # the table of queries has 8 files
    assert moved(found) < (lists * 200 + 100 if probes_sent == 0 else 100)
    plan = found._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan if probes_sent == 0 else "PartitionFilters: [list_no" in plan


def test_many_lists_and_selectors(spark, made, monkeypatch):
    """More list numbers than go into a filter, tasks that hold few pairs, long lists in several files, max_codes, ranges."""
    rows, centroids, at, folder = made
    queries = rows.where("vec_id % 150 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
    told = lambda df: sorted(tuple(r) for r in df.select("q_id", "vec_id", "rank").collect())
    wanted = told(search.knn(queries, rows, 3, selector=F.col("vec_id") % 2 == 0))
    monkeypatch.setattr(search, "LISTED", 3)
    monkeypatch.setattr(search, "HELD", 2)
    assert told(stored.find(queries, at, 3, 1, selector=F.col("vec_id") % 2 == 0)) == wanted
    cut = stored.write(at.lists, centroids, f"{folder}/cut", rows_per_file=50)
    assert len({r[0] for r in cut.lists.where("list_no = 3").select(F.input_file_name()).distinct().collect()}) >= 4
    assert told(stored.find(queries, cut, 3, 5, selector=F.col("vec_id") % 2 == 0, max_codes=1)) == wanted
    both = stored.merge(spark, f"{folder}/one", f"{folder}/cut", 1_000_000, f"{folder}/both")
    assert both.model.selectExpr("sum(n)").first()[0] == both.lists.count() == 40_000
    none = stored.write(at.lists.limit(0), centroids, f"{folder}/none")
    assert stored.find(queries, none, 3, 2).count() == 0 and stored.find(queries.limit(0), at, 3, 2).count() == 0


def test_encoding_goes_on(spark, made):
    rows, centroids, _, folder = made
    path = f"{folder}/parts"
    rows = rows.where("vec_id % 7 = 0")
    assert stored.encode_parts(rows, centroids, path, 5, most=2) == 3
    half = stored.from_parts(spark, centroids, path)
    low = half.lists.agg(F.max("vec_id")).first()[0]
    assert 0 < half.lists.count() < rows.count() and half.lists.count() == rows.where(F.col("vec_id") <= low).count()
    # a part that was begun and not entered is done again
    half.lists.limit(5).write.mode("overwrite").partitionBy("list_no").parquet(f"{path}/parts/part=3")
    assert stored.encode_parts(rows, centroids, path, 5) == 0 and stored.encode_parts(rows, centroids, path, 5) == 0
    whole = stored.from_parts(spark, centroids, path)
    got = whole.lists.select("vec_id", "list_no")
    assert got.exceptAll(index.build(rows, centroids).select("vec_id", "list_no")).count() == 0 and got.count() == rows.count()
    assert stored.finished_parts(spark, path).selectExpr("sum(n)", "count(*)").first() == (rows.count(), 5)
    assert stored.encode_parts(rows.limit(0), centroids, f"{folder}/nothing", 3) == 0


def test_ranges_go_on(spark, made):
    rows, centroids, at, folder = made
    queries = rows.where("vec_id % 500 = 3").select(F.col("vec_id").alias("q_id"), "embedding")
    probed = search.probes(queries, centroids, 4)
    path = f"{folder}/ranges"
    assert stored.find_in_ranges(queries, probed, at, 5, path, 10, most=6) is None
    got = stored.find_in_ranges(queries, probed, at, 5, path, 10)
    assert sorted(map(tuple, got.select("q_id", "vec_id", "rank").collect())) == sorted(map(tuple, search.knn(queries, rows, 5).select("q_id", "vec_id", "rank").collect()))

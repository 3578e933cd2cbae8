"""Evaluation of search results as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall_at(truth: DataFrame, found: DataFrame, r: int) -> DataFrame:
    """(recall): share of queries whose true nearest is among the first r found."""
    first = truth.where("rank = 1").select("q_id", F.col("vec_id"))
    hit = found.where(F.col("rank") <= r).select("q_id", "vec_id").withColumn("hit", F.lit(1.0))
    return first.join(hit, ["q_id", "vec_id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))


def intersection_at(truth: DataFrame, found: DataFrame, r: int) -> DataFrame:
    """(share): size of the common part of the first r, over r, averaged over the queries of the truth."""
    a, b = (x.where(F.col("rank") <= r).select("q_id", "vec_id") for x in (truth, found))
    both = a.join(b, ["q_id", "vec_id"]).groupBy("q_id").agg(F.count("*").alias("n"))
    return a.select("q_id").distinct().join(both, "q_id", "left").agg(F.avg(F.coalesce("n", F.lit(0)) / F.lit(float(r))).alias("share"))


def precision_recall(truth: DataFrame, found: DataFrame, queries: DataFrame) -> DataFrame:
    """(precision, recall, mean_precision, mean_recall) of range results. A query without results has precision 1 if it has
    no truth either, else 0; one without truth has recall 1."""
    n_true = truth.groupBy("q_id").agg(F.count("*").alias("t"))
    n_found = found.groupBy("q_id").agg(F.count("*").alias("f"))
    n_both = truth.select("q_id", "vec_id").join(found.select("q_id", "vec_id"), ["q_id", "vec_id"]).groupBy("q_id").agg(F.count("*").alias("b"))
    each = queries.select("q_id").join(n_true, "q_id", "left").join(n_found, "q_id", "left").join(n_both, "q_id", "left").fillna(0, ["t", "f", "b"])
    precision = F.when(F.col("f") > 0, F.col("b") / F.col("f")).when(F.col("t") == 0, 1.0).otherwise(0.0)
    recall = F.when(F.col("t") > 0, F.col("b") / F.col("t")).otherwise(1.0)
    overall = lambda part, whole: F.when(F.sum(whole) > 0, F.sum(part) / F.sum(whole)).otherwise(1.0)
    return each.agg(overall("b", "f").alias("precision"), overall("b", "t").alias("recall"), F.avg(precision).alias("mean_precision"), F.avg(recall).alias("mean_recall"))


def frontier(points: DataFrame) -> DataFrame:
    """(perf, time) that are optimal: perf above 0, the least time of its perf, and no better perf at less time."""
    least = points.where("perf > 0").groupBy("perf").agg(F.min("time").alias("time"))
    better = Window.orderBy(F.desc("perf")).rowsBetween(Window.unboundedPreceding, -1)
    return least.withColumn("best", F.min("time").over(better)).where("best is null or time <= best").select("perf", "time")


def precision_recall_at(truth: DataFrame, found: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(threshold, precision, recall) of hits (q_id, vec_id, score) with score below each threshold, all queries together.
    Thresholds are a short list, which goes into the plan; each hit is counted once, at the first threshold that it passes,
    and sums run over the thresholds."""
    marked = found.join(truth.select("q_id", "vec_id", F.lit(1).alias("good")), ["q_id", "vec_id"], "left")
    limits = sorted({float(r.threshold) for r in thresholds.select("threshold").where("threshold is not null").distinct().collect()})
    all_ = truth.count()
    rows = [(i, t) for i, t in enumerate(limits)]
    listed = found.sparkSession.createDataFrame(rows, "place int, threshold double")
    first = F.size(F.filter(F.lit(limits), lambda t: t <= F.col("score"))) if limits else F.lit(0)
    counted = marked.where("score is not null").groupBy(first.alias("place")).agg(F.count("*").alias("n"), F.count("good").alias("both"))
    upto = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    sums = listed.join(counted, "place", "left").select("threshold", F.sum(F.coalesce("n", F.lit(0))).over(upto).alias("n"), F.sum(F.coalesce("both", F.lit(0))).over(upto).alias("both"))
    precision = F.when(F.col("n") > 0, F.col("both") / F.col("n")).otherwise(1.0)
    return sums.select("threshold", precision.alias("precision"), (F.col("both") / F.lit(all_) if all_ else F.lit(1.0)).alias("recall"))


def same_modulo_ties(first: DataFrame, second: DataFrame, digits: int = 5) -> DataFrame:
    """(q_id, same): whether two results hold the same ids at the same scores; ids of the worst score kept may differ, as
    ties there are cut by k."""

    def sides(hits):
        scored = hits.select("q_id", "vec_id", F.round("score", digits).alias("score"))
        last = scored.groupBy("q_id").agg(F.max("score").alias("last"))
        inner = F.array_sort(F.collect_list(F.when(F.col("score") < F.col("last"), F.struct("score", "vec_id"))))
        return scored.join(last, "q_id").groupBy("q_id").agg(inner.alias("inner"), F.array_sort(F.collect_list("score")).alias("scores"))

    a, b = sides(first), sides(second)
    both = a.join(b.select("q_id", F.col("inner").alias("inner_b"), F.col("scores").alias("scores_b")), "q_id", "full")
    return both.select("q_id", F.coalesce((F.col("inner") == F.col("inner_b")) & (F.col("scores") == F.col("scores_b")), F.lit(False)).alias("same"))


def best_latency(measured: DataFrame, by: list[str], settings: list[str], time: str) -> DataFrame:
    """(by..., best, settings of it): the mean time of each setting, and for each key the setting with the least mean."""
    means = measured.groupBy(*by, *settings).agg(F.avg(time).alias("mean"))
    first = Window.partitionBy(*by).orderBy("mean", *settings)
    return means.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n").withColumnRenamed("mean", "best")


def probe_settings(lists: int) -> list[int]:
    """The numbers of probes worth trying: powers of two up to 2^12 below the number of lists."""
    return [1 << i for i in range(13) if 1 << i < lists]


def profile(hits: DataFrame, previous: DataFrame) -> DataFrame:
    """(q_id, top1, top5, top20, in_old): the scores at ranks 1, 5 and 20 of each query, and the share of its hits that are
    among the hits of the query before it (`previous`: q_id of the later one, vec_id)."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score"))).alias(f"top{r}")
    marked = hits.join(previous.select("q_id", "vec_id", F.lit(1.0).alias("old")), ["q_id", "vec_id"], "left")
    return marked.groupBy("q_id").agg(at(1), at(5), at(20), F.avg(F.coalesce("old", F.lit(0.0))).alias("in_old"))

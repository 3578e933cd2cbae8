"""The offline path from vectors to a checked search result, as a chain of DataFrame jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.operators import clustering, evaluate, index, search


def run(rows: DataFrame, queries: DataFrame, k: int, clusters: int, nprobe: int, shards: int) -> DataFrame:
    """(q_id, vec_id, rank, score, intersection): statistics (components must be finite), one of each group of equal
    vectors, coarse centroids, an index for each shard of ids, their merge, a search of `nprobe` lists with duplicates
    expanded, and what it has in common with the exact result."""
    bad = index.statistics(rows).agg(F.sum(F.col("n_nan") + F.col("n_inf"))).first()[0]
    if bad:
        raise ValueError(f"{bad} components are not finite")
    groups = index.duplicates(rows)
    kept = rows.join(groups.where("vec_id = representative").select("vec_id"), "vec_id", "left_semi").select("vec_id", "embedding")
    centers, _ = clustering.kmeans(kept, clusters, 10, per_cluster=None)
    centroids = rows.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "list_no int, embedding array<double>")
    parts = [index.build(kept.where(F.pmod("vec_id", F.lit(shards)) == i), centroids) for i in range(shards)]
    lists = reduce(lambda a, b: index.merged(a, b, 0), parts)
    hits = search.ivf(queries, centroids, lists, k, nprobe)
    found = search.ranked(index.expanded(hits, groups), k)
    exact = search.knn(queries, rows.select("vec_id", "embedding"), k)
    return found.join(evaluate.intersection_at(exact, found, k).withColumnRenamed("share", "intersection"))  # one row

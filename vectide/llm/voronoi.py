"""Exact top-k inner products by a Voronoi kNN join."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm.common import hash_sample, kmeans, materialize


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, keep: list[str] | None = None) -> DataFrame:
    """(vec_id, v array<double>, and the columns `keep`): floor(scale * x) of each component. Vectors that are null or hold
    a null, NaN or infinite component are left out; empty vectors too. Whole numbers are kept as doubles: sums stay exact
    below 2^53. Doubles from 2^53 are whole already, where a floor would not fit a long."""
    x = F.col(vector_col)
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    scaled = F.transform(x, lambda c: F.lit(float(scale)) * c.cast("double"))
    v = F.transform(scaled, lambda c: F.when(F.abs(c) < F.lit(2.0**53), F.floor(c).cast("double")).otherwise(c))
    return vectors.where(good).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), *(keep or []))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Cells(NamedTuple):
    """Cells of queries: pivot, radius and number of queries of each."""

    pivots: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray


def query_cells(queries: DataFrame, pivot_queries: int, max_pivots: int, sample: int = 8192) -> tuple[DataFrame, Cells]:
    """(vec_id, v, cell) of every query, and its cells. Pivots are cluster centres of at most `sample` queries."""
    n = queries.count()
    if not n:
        return queries.withColumn("cell", F.lit(0)), Cells(np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    some = np.array([r.v for r in hash_sample(queries, ["vec_id"], sample).collect()])
    pivots = kmeans(some, min(max_pivots, max(1, n // pivot_queries)), 8, 3)
    shared = queries.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches):
        p = shared.value
        for batch in batches:
            x = _matrix(batch.column("v"))
            if len(x):
                cell = ((p**2).sum(1) - 2 * x @ p.T).argmin(1)
                away = np.sqrt(((x - p[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(away)], ["vec_id", "v", "cell", "away"])

    asked = materialize(queries.select("vec_id", "v").mapInArrow(assign, "vec_id long, v array<double>, cell int, away double"), "voronoi-queries")
    radius, sizes = np.zeros(len(pivots)), np.zeros(len(pivots), int)
    for r in asked.groupBy("cell").agg(F.max("away").alias("far"), F.count("*").alias("n")).collect():  # one row a pivot
        radius[r.cell], sizes[r.cell] = r.far, r.n
    return asked.drop("away"), Cells(pivots, radius, sizes)


def neighbour_groups(cells: Cells, group_queries: int) -> np.ndarray:
    """The group of each cell: a seed and its nearest neighbours, until they hold about `group_queries`."""
    group, left, g = np.zeros(len(cells.sizes), int), np.flatnonzero(cells.sizes > 0), 0
    while len(left):
        away = ((cells.pivots[left] - cells.pivots[left[0]]) ** 2).sum(1)
        near = left[np.argsort(away, kind="stable")]
        took = max(1, int(np.searchsorted(np.cumsum(cells.sizes[near]), group_queries, side="right")))
        group[near[:took]] = g
        left, g = np.sort(near[took:]), g + 1
    return group


def wanted_rows(vectors: DataFrame, cells: Cells, group: np.ndarray, k: int) -> DataFrame:
    """(grp, vec_id, v): the rows that the k best of a group's queries can be among. Rows far from all queries of a group
    drop out where cells are tight; where vectors have no clusters, every group wants nearly all rows."""
    used = np.flatnonzero(cells.sizes > 0)
    first = np.flatnonzero(np.diff(np.sort(group[used]), prepend=-1))
    order = used[np.argsort(group[used], kind="stable")]  # cells of one group next to each other
    shared = vectors.sparkSession.sparkContext.broadcast((cells.pivots[order], cells.radius[order], first))

    def summarise(batches):
        p, r, _ = shared.value
        best = np.full((k + 1, len(p)), -np.inf)
        for batch in batches:
            x = _matrix(batch.column("v"))
            for lo in range(0, len(x), 2048):
                part = x[lo : lo + 2048]
                low = part @ p.T - np.sqrt((part**2).sum(1))[:, None] * r
                best = -np.sort(-np.concatenate([best, low]), axis=0)[: k + 1]
        at, cell = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(best[at, cell])], ["cell", "low"])

    nth = F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("low")))
    lows = vectors.select("v").mapInArrow(summarise, "cell long, low double").withColumn("nth", nth).where(F.col("nth") == k + 1)
    bound = np.full(len(order), -np.inf)
    for row in lows.select("cell", "low").collect():  # one row a pivot
        bound[row.cell] = row.low

    def replicate(batches):
        p, r, first = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                x = _matrix(part.column("v"))
                high = x @ p.T + np.sqrt((x**2).sum(1))[:, None] * r
                wanted = np.logical_or.reduceat(high >= bound - 1e-9 * (1 + np.abs(high)), first, axis=1)
                row, grp = np.nonzero(wanted)
                some = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(grp.astype(np.int32)), some.column("vec_id"), some.column("v")], ["grp", "vec_id", "v"])

    return vectors.select("vec_id", "v").mapInArrow(replicate, "grp int, vec_id long, v array<double>")


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = 5, pivot_queries: int = 32, max_pivots: int = 1024, group_queries: int = 1024, rows_per_task: int = 20_000) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of every query with all other rows, ties to the
    smaller vec_id; all rows if there are fewer. Inputs are (vec_id long, v array<double>) of whole components. Rows meet
    queries of their own length; each length is searched by itself. Repeated ids among the queries are one query (the
    smallest vector of that length), repeated rows of the data are candidates of their own. An empty side gives no rows.

    Queries belong to the cell of their nearest pivot, about `pivot_queries` a cell, and neighbouring cells to groups of
    about `group_queries`. For a cell with pivot p and radius r, every query q of it has q.y between p.y - r|y| and
    p.y + r|y|. A first pass over the data summarises, for each cell, the k + 1 largest lower bounds: k rows besides the
    query itself surely reach the smallest of them. A second one counts the rows that each group wants, those whose upper
    bound reaches the bound of one of its cells, and a third replicates them to it, in tasks of about `rows_per_task`;
    large groups are dealt out by blocks of queries, too, and the tasks' k best are merged. The driver holds pivots and
    summaries: a few numbers a cell. How many rows can be left out depends on the data: see `wanted_rows`.
    """
    lengths = sorted(r[0] for r in queries.select(F.size("v")).distinct().collect())  # one row a length
    each = [_of_one_length(vectors.where(F.size("v") == n), queries.where(F.size("v") == n), n, k, pivot_queries, max_pivots, group_queries, rows_per_task) for n in lengths]
    if not each:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(lambda a, b: a.unionByName(b), each)


def _of_one_length(vectors: DataFrame, queries: DataFrame, dim: int, k: int, pivot_queries: int, max_pivots: int, group_queries: int, rows_per_task: int) -> DataFrame:
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    asked, cells = query_cells(queries, pivot_queries, max_pivots)
    group = neighbour_groups(cells, group_queries)
    sent = wanted_rows(vectors, cells, group, k)
    n = np.bincount(group, weights=cells.sizes).astype(int)
    wanted = np.zeros(len(n), int)
    for r in sent.groupBy("grp").count().collect():  # one row a group
        wanted[r.grp] = r["count"]
    of_group = lambda numbers: F.element_at(F.lit([int(max(1, x)) for x in numbers]), F.col("grp") + 1)
    chunks, blocks = of_group(-(-wanted // rows_per_task)), of_group(-(-n // (2 * group_queries)))
    salt = F.xxhash64("vec_id")
    own = asked.select(F.element_at(F.lit(group.tolist()), F.col("cell") + 1).alias("grp"), "vec_id", "v")
    query_rows = own.withColumn("block", F.pmod(salt, blocks).cast("int")).select("grp", "block", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.lit(0).alias("kind"), "vec_id", "v")
    data_rows = sent.select("grp", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.pmod(salt, chunks).cast("int").alias("chunk"), F.lit(1).alias("kind"), "vec_id", "v")
    both = query_rows.union(data_rows).select(F.xxhash64("grp", "block", "chunk").alias("task"), "kind", "vec_id", "v").repartition("task").sortWithinPartitions("task", "kind")

    def best(ids: np.ndarray, scores: np.ndarray):
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]

    def solve(batches):
        state = None  # task, query ids, query matrix, best ids and scores so far

        def done():
            for q, ids, scores in zip(state["ids"], state["best"], state["scores"]):
                for i, s in zip(ids.tolist(), scores.tolist()):
                    yield q, i, int(s)

        def emit(rows):
            q, i, s = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], ["query_id", "vec_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, kind = (batch.column(c).to_numpy() for c in ("task", "kind"))
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(key)]):
                ids, x = batch.column("vec_id").to_numpy()[a:b], _matrix(batch.column("v").slice(a, b - a))
                if state is None or state["key"] != key[a]:
                    if state is not None:
                        yield emit(list(done()))
                    state = {"key": key[a], "ids": np.zeros(0, np.int64), "x": np.zeros((0, dim)), "best": [], "scores": []}
                if kind[a] == 0:
                    state["ids"] = np.concatenate([state["ids"], ids])
                    state["x"] = np.concatenate([state["x"], x])
                    state["best"] += [np.zeros(0, np.int64)] * len(ids)
                    state["scores"] += [np.zeros(0)] * len(ids)
                    continue
                for lo in range(0, len(state["ids"]), 256):
                    score = state["x"][lo : lo + 256] @ x.T
                    for j, row in enumerate(score, lo):
                        other = ids != state["ids"][j]
                        cut = -np.inf
                        if len(state["scores"][j]) == k:
                            cut = state["scores"][j][-1]
                        elif len(row) > 4 * k + 8:
                            cut = np.partition(row, len(row) - k - 1)[len(row) - k - 1]
                        keep = np.flatnonzero(other & (row >= cut))
                        if len(keep):
                            state["best"][j], state["scores"][j] = best(np.concatenate([state["best"][j], ids[keep]]), np.concatenate([state["scores"][j], row[keep]]))
        if state is not None:
            yield emit(list(done()))

    found = both.mapInArrow(solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_every_nth(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Top-k of the rows whose vec_id is divisible by `every` against all rows; ids that are null take no part."""
    rows = quantized(vectors).where("vec_id is not null")
    return top_inner_products(rows, rows.where(F.col("vec_id") % every == 0), k)


ORACLE = """
WITH good AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
  FROM good q JOIN good d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

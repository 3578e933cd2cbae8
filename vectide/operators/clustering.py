"""k-means as Spark jobs: rows are assigned where they lie, and sums for each cluster are combined before they move."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.operators.search import _matrix
from vectide.sources.written import written


def _split_empty(c: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> None:
    """Each empty cluster takes half of one drawn in proportion to size - 1; the two move apart by 1/1024."""
    for e in np.flatnonzero(n == 0):
        weights = np.maximum(n - 1, 0)
        if not weights.sum():
            return
        donor = rng.choice(len(n), p=weights / weights.sum())
        shift = np.where(np.arange(c.shape[1]) % 2 == 0, 1, -1) / 1024
        c[e] = c[donor] * (1 + shift)
        c[donor] = c[donor] * (1 - shift)
        n[e] = n[donor] / 2
        n[donor] -= n[e]


def kmeans(rows: DataFrame, k: int, rounds: int = 25, redo: int = 1, seed: int = 1234, spherical: bool = False, whole: bool = False, per_cluster: int | None = 256, weight_col: str | None = None) -> tuple[np.ndarray, list[float]]:
    """(centroids k x d, objective by round) of rows (vec_id, embedding[, weight]).

    Trains on all rows, or on about k * per_cluster of them by hash if there are more (None: always on all); starts from k rows drawn by hash.
    Every round is one job that returns k sums a task. The objective is the sum of squared distances before the update;
    of several runs the one with the least is kept. Raises if a component is not finite or rows are fewer than k.
    """
    columns = ["vec_id", F.col("embedding").alias("v"), (F.col(weight_col).cast("double") if weight_col else F.lit(1.0)).alias("w")]
    used = rows.where("embedding is not null").select(*columns)
    bad, total = used.agg(F.count(F.when(F.exists("v", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), 1)), F.count("*")).first()
    if bad:
        raise ValueError(f"{bad} rows hold components that are not finite")
    if total < k:
        raise ValueError(f"{total} rows are fewer than {k} clusters")
    if per_cluster is not None and total > k * per_cluster:
        used = used.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * k * per_cluster / total))
    used = used.persist()
    best: tuple[float, np.ndarray, list[float]] | None = None
    for run in range(redo):
        rng = np.random.default_rng(seed + 1 + run)
        first = used.orderBy(F.xxhash64("vec_id", F.lit(seed + run)), "vec_id").limit(k).collect()
        c, history = np.array([r.v for r in first], np.float64), []
        for _ in range(rounds):
            shared = rows.sparkSession.sparkContext.broadcast(c)

            def sums(batches):
                c = shared.value
                total, weight, loss = np.zeros_like(c), np.zeros(len(c)), np.zeros(len(c))
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    x = _matrix(batch.column("v"))
                    w = batch.column("w").to_numpy()
                    d = (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T
                    at = d.argmin(1)
                    np.add.at(total, at, x * w[:, None])
                    weight += np.bincount(at, weights=w, minlength=len(c))
                    loss += np.bincount(at, weights=np.maximum(d.min(1), 0) * w, minlength=len(c))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c))), pa.array(list(total)), pa.array(weight), pa.array(loss)], ["c", "total", "w", "loss"])

            parts = used.mapInArrow(sums, "c long, total array<double>, w double, loss double")
            by_cluster = parts.select("c", "w", "loss", F.posexplode("total").alias("pos", "x")).groupBy("c", "pos").agg(F.sum("x").alias("x"), F.sum("w").alias("w"), F.sum("loss").alias("loss"))
            n, moved, loss = np.zeros(k), np.zeros_like(c), 0.0
            for r in by_cluster.collect():  # k * d sums
                moved[r.c, r.pos], n[r.c] = r.x, r.w
                loss += r.loss if r.pos == 0 else 0.0
            shared.unpersist()
            history.append(loss)
            c = np.where(n[:, None] > 0, moved / np.maximum(n, 1e-300)[:, None], c)
            _split_empty(c, n, rng)
            if spherical:
                c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
            if whole:
                c = np.round(c)
        if best is None or history[-1] < best[0]:
            best = (history[-1], c, history)
    used.unpersist()
    return best[1], best[2]


def pca(rows: DataFrame, wanted: int, power: float = 0.0, epsilon: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, mean): project with matrix @ (x - mean). Second moments are summed by task, d * d numbers each; rows of
    the matrix are scaled by (variance + epsilon) ** power."""
    def moments(batches):
        n, first, second = 0, None, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("embedding"))
                n += len(x)
                first = x.sum(0) if first is None else first + x.sum(0)
                second = x.T @ x if second is None else second + x.T @ x
        if n:
            flat = np.concatenate([[n], first, second.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "x"])

    parts = rows.where("embedding is not null").select("embedding").mapInArrow(moments, "i long, x double")
    flat = np.array([r.x for r in parts.groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()])  # d * d + d + 1 numbers
    d = int((np.sqrt(4 * len(flat) - 3) - 1) / 2)
    mean = flat[1 : d + 1] / flat[0]
    values, axes = np.linalg.eigh(flat[d + 1 :].reshape(d, d) / flat[0] - np.outer(mean, mean))
    order = np.argsort(-values)[:wanted]
    return axes[:, order].T * ((np.maximum(values[order], 0) + epsilon) ** power if power else np.ones(len(order)))[:, None], mean


def _assigned(rows: DataFrame, centers: np.ndarray) -> DataFrame:
    """(vec_id, v array<double>, cell, loss): nearest of the centres, and the squared distance to it."""
    shared = rows.sparkSession.sparkContext.broadcast(centers)

    def run(batches):
        c = shared.value
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("embedding"))
                d = (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T
                cell = d.argmin(1)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.ListArray.from_arrays(ends, pa.array(x.ravel())), pa.array(cell.astype(np.int32)), pa.array(np.maximum(d.min(1), 0))], ["vec_id", "v", "cell", "loss"])

    return rows.where("embedding is not null").select("vec_id", "embedding").mapInArrow(run, "vec_id long, v array<double>, cell int, loss double")


def shares(sizes: np.ndarray, k: int) -> np.ndarray:
    """How many of k centres each cell gets: in proportion to its size, one at least where it has rows and never more than
    rows; what rounding leaves goes to the largest remainders."""
    wanted = sizes * k / max(1, sizes.sum())
    n = np.minimum(np.maximum(np.floor(wanted), sizes > 0), sizes).astype(int)
    while n.sum() < min(k, sizes.sum()):
        open_ = np.where(n < sizes, wanted - n, -np.inf)
        n[open_.argmax()] += 1
    while n.sum() > max(k, (sizes > 0).sum()):
        over = np.where(n > 1, n - wanted, -np.inf)
        n[over.argmax()] -= 1
    return n


def two_level(rows: DataFrame, k: int, cells: int, rounds: int = 15, refine: int = 0, task_rows: int = 50_000, seed: int = 1234) -> tuple[DataFrame, dict]:
    """(list_no, embedding) of k centres over (vec_id, embedding), and what it took: {"distances", "objective"}.

    Rows go to coarse cells, the cells share the k centres in proportion to their rows, and each cell is clustered by
    itself, all cells at once: a distance is computed to the centres of the own cell only, k / cells of them on average. Cells are cut in
    slices of about `task_rows` rows; each of several slices is clustered into four times the cell's number of centres, and these, weighted
    by their rows, are clustered once more, so no task holds a whole cell. With `refine`, rounds of plain k-means over all rows follow (k distances a
    row). Raises, like kmeans, where rows are fewer than k or not finite.
    """
    spark = rows.sparkSession
    coarse, _ = kmeans(rows, cells, rounds, per_cluster=None, seed=seed)
    placed = written(_assigned(rows, coarse), "two-level")
    sizes = np.zeros(cells, int)
    for r in placed.groupBy("cell").count().collect():  # one row a cell
        sizes[r.cell] = r["count"]
    if sizes.sum() < k:
        raise ValueError(f"{sizes.sum()} rows are fewer than {k} clusters")
    wanted, slices = shares(sizes, k), np.maximum(1, -(-sizes // task_rows))
    shared = spark.sparkContext.broadcast(wanted)

    def of_slice(key, table):
        return solve(key, table, False)

    def of_cell(key, table):
        return solve(key, table, True)

    def solve(key, table, last):
        cell = key[0].as_py()
        x, w = _matrix(table.column("v").combine_chunks()), table.column("w").to_numpy()
        order = np.lexsort((*x.T[::-1],))  # whatever order rows came in
        x, w = x[order], w[order]
        many = 4 if not last and slices[cell] > 1 else 1  # of a slice, more than the cell will have
        c, weight, work = _lloyd(x, w, int(min(many * shared.value[cell], len(x))), rounds, seed + cell)
        return pa.table({"cell": pa.array(np.full(len(c), cell, np.int32)), "v": pa.array(list(c), pa.list_(pa.float64())), "w": weight, "work": np.full(len(c), work / len(c))})

    out = "cell int, v array<double>, w double, work double"
    slice_ = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.element_at(F.lit(slices.tolist()), F.col("cell") + 1)).alias("slice")
    parts = placed.select("cell", slice_, "v", F.lit(1.0).alias("w")).groupBy("cell", "slice").applyInArrow(of_slice, out)
    parts = written(parts, "two-level-parts")
    whole = written(parts.groupBy("cell").applyInArrow(of_cell, out), "two-level-centers")
    found = whole.where("w > 0").orderBy("cell", F.desc("w"), "v").collect()  # k rows
    work = sizes.sum() * cells * rounds + parts.agg(F.sum("work")).first()[0] + whole.agg(F.sum("work")).first()[0]
    centers = np.array([r.v for r in found])
    for _ in range(refine):
        moved = {r.cell: np.array(r.m) for r in _means(_assigned(rows, centers)).collect()}  # k rows
        centers = np.array([moved.get(i, c) for i, c in enumerate(centers)])
        work += int(sizes.sum()) * len(centers)
    loss = _assigned(rows, centers).agg(F.sum("loss")).first()[0]
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "list_no int, embedding array<double>")
    return table, {"distances": float(work), "objective": float(loss)}


def _means(assigned: DataFrame) -> DataFrame:
    """(cell, m): the mean of each cell's vectors."""
    parts = assigned.select("cell", F.posexplode("v").alias("pos", "x")).groupBy("cell", "pos").agg(F.avg("x").alias("m"))
    return parts.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("m"))


def _lloyd(x: np.ndarray, w: np.ndarray, k: int, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(centres, their weights, distances computed) of k-means over the rows of one task. It starts from rows drawn one by
    one, in proportion to weight and squared distance to those drawn before."""
    rng = np.random.default_rng(seed)
    far, first = np.ones(len(x)), []
    for _ in range(k):
        chance = w * far if (w * far).sum() > 0 else np.ones(len(x))
        first.append(rng.choice(len(x), p=chance / chance.sum()))
        d = ((x - x[first[-1]]) ** 2).sum(1)
        far = np.minimum(far, d) if len(first) > 1 else d
    c = x[first].copy()
    for _ in range(rounds):
        d = (c * c).sum(1) - 2 * x @ c.T
        at = d.argmin(1)
        n = np.bincount(at, weights=w, minlength=k)
        sums = np.stack([np.bincount(at, weights=w * column, minlength=k) for column in x.T], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1e-300)[:, None], c)
        _split_empty(c, n.astype(float), rng)
    at = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
    return c, np.bincount(at, weights=w, minlength=k), len(x) * k * (rounds + 2)


def one_dimensional(values: DataFrame, k: int, most_distinct: int = 1 << 20) -> DataFrame:
    """(cluster, low, high, n, mean, loss): the partition of column x into k intervals with the least sum of squared
    distances to their means, exactly; fewer where there are fewer distinct values. Nulls and NaN are left out; infinite values raise.

    An optimal cluster is an interval of the sorted distinct values, so counts by value are all that is needed; Spark makes
    them. The driver gets at most `most_distinct` of them (16 MB at the default), and more raise. Row by row of a table over the
    values, the best place of the last cut never moves left as values are added, so halving finds each row in
    n log n steps.
    """
    x = F.col("x").cast("double")
    counts = values.select(x.alias("x")).where("x is not null and not isnan(x)").groupBy("x").agg(F.count("*").alias("n"))
    held = counts.limit(most_distinct + 1).toPandas().sort_values("x")
    if len(held) > most_distinct:
        raise ValueError(f"more than {most_distinct} distinct values: round them first")
    v, w = held["x"].to_numpy(float), held["n"].to_numpy(float)
    schema = "cluster int, low double, high double, n long, mean double, loss double"
    if not len(v):
        return values.sparkSession.createDataFrame([], schema)
    if not np.isfinite(v).all():
        raise ValueError("values are not all finite")
    middle = float(np.average(v, weights=w))
    cuts = exact_cuts(v - middle, w, min(k, len(v)))
    out = []
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        mean = float(np.average(v[a:b], weights=w[a:b]))
        out.append((i, float(v[a]), float(v[b - 1]), int(w[a:b].sum()), mean, float((w[a:b] * (v[a:b] - mean) ** 2).sum())))
    return values.sparkSession.createDataFrame(out, schema)


def exact_cuts(v: np.ndarray, w: np.ndarray, k: int) -> list[int]:
    """Where the k best intervals of the ascending values v with weights w begin, and the end."""
    n = len(v)
    one, two, three = (np.concatenate([[0], np.cumsum(z)]) for z in (w, w * v, w * v * v))

    def cost(a, b):
        """Of the intervals a..b-1."""
        return np.maximum(three[b] - three[a] - (two[b] - two[a]) ** 2 / (one[b] - one[a]), 0)

    best = cost(np.zeros(n, int), np.arange(1, n + 1))  # of the first i + 1 values in one interval
    from_ = [np.zeros(n, int)]
    for _ in range(1, k):
        now, at = np.full(n, np.inf), np.zeros(n, int)
        # all intervals of one depth of the halving at once: rows lo..hi whose last cuts lie in first..last
        spans = [(0, n - 1, 0, n - 1)]
        while spans:
            below = []
            for lo, hi, first, last in spans:
                mid = (lo + hi) // 2
                a = np.arange(max(first, 1), min(mid, last) + 1)
                if len(a):
                    total = best[a - 1] + cost(a, np.full(len(a), mid + 1))
                    now[mid], at[mid] = total.min(), a[total.argmin()]
                place = at[mid] if len(a) else first
                if lo < mid:
                    below.append((lo, mid - 1, first, place if len(a) else last))
                if mid < hi:
                    below.append((mid + 1, hi, place, last))
            spans = below
        best = now
        from_.append(at)
    cuts, end = [n], n
    for at in reversed(from_):
        end = int(at[end - 1])
        cuts.append(end)
    return cuts[::-1]

"""Clustering by whole-number centroids: float32 products screen, rounding-error intervals decide what must be computed exactly."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import materialize

#: Whole components up to here: squared distances of up to 1,024 of them fit a long.
SMALL = 1 << 25
LONG = 1 << 63


class Centroids(NamedTuple):
    """k x d whole numbers, exact (Python's own where a long is too short), as doubles, and their exact squared norms."""

    whole: np.ndarray
    near: np.ndarray
    squares: list[int]


def centroids_from(rows: list[list[int]]) -> Centroids:
    exact = [[int(x) for x in row] for row in rows]
    kind = np.int64 if all(abs(x) <= SMALL for row in exact for x in row) else object
    return Centroids(np.array(exact, kind), np.array(exact, np.float64), [sum(x * x for x in row) for row in exact])


def whole_vectors(vectors: DataFrame, dim: int = 64, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>): floor(scale * x) of vectors with exactly `dim` components, none null or non-finite before
    or after scaling. All other rows are left out; null ids stay. Whole doubles are exact, however large."""
    x = F.col(vector_col)
    v = F.transform(x, lambda c: F.lit(float(scale)) * c.cast("double"))
    good = x.isNotNull() & (F.size(x) == dim) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(v, lambda c: F.when(F.abs(c) < F.lit(2.0**53), F.floor(c).cast("double")).otherwise(c))
    return vectors.where(good).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def shortlist(x: np.ndarray, c: Centroids, single: bool = True) -> np.ndarray:
    """n x k booleans: which centroids may be the nearest of each row of x.

    Of |x - c|^2 the part |c|^2 - 2 x.c tells centroids apart. x.c comes from one matrix product in float32 (`single`) or
    double. In either, whatever the order of summation, it is off by at most g |x| |c| with g = (d + 2) u / (1 - (d + 2) u),
    u the unit roundoff, the 2 for rounding both factors; doubles round what is added to it by another 2^-53 each. A
    centroid whose lower end lies above another's upper end is out.
    """
    d = x.shape[1]
    unit = 2.0**-24 if single else 2.0**-53
    kind = np.float32 if single else np.float64
    product = (x.astype(kind) @ c.near.astype(kind).T).astype(np.float64)
    g = (d + 2) * unit / (1 - (d + 2) * unit)
    squares = np.array([float(s) for s in c.squares])
    reach = 2 * g * np.sqrt((x * x).sum(1))[:, None] * np.sqrt(squares) * (1 + 1e-6)
    middle = squares - 2 * product
    reach = reach + 2.0**-50 * (squares + 2 * np.abs(product))
    return middle - reach <= (middle + reach).min(1)[:, None]


def _exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of c (or to one), as whole numbers of a long's or of Python's kind."""
    if c.dtype != object and np.abs(x).max(initial=0) <= SMALL and x.shape[1] <= 1 << 10:
        return ((x.astype(np.int64) - c) ** 2).sum(1)
    left = np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    return ((left - c.astype(object)) ** 2).sum(1) if len(x) else np.zeros(0, object)


def nearest(x: np.ndarray, c: Centroids) -> np.ndarray:
    """The number of the centroid nearest to each row of x (whole doubles), exactly; ties go to the smaller number."""
    largest = max(np.abs(x).max(initial=0), np.abs(c.near).max(initial=0))
    may = shortlist(x, c, single=largest < 2.0**50 and x.shape[1] < 1 << 20)
    at = may.argmax(1)
    unsure = np.flatnonzero(may.sum(1) > 1)
    if len(unsure):
        best = _exact(x[unsure], c.whole[at[unsure]])
        for number in range(1, len(c.whole)):
            asks = np.flatnonzero(may[unsure, number] & (at[unsure] < number))
            if len(asks):
                d = _exact(x[unsure[asks]], c.whole[number])
                closer = d < best[asks]
                best[asks[closer]] = d[closer]
                at[unsure[asks[closer]]] = number
    return at


def _limbs(n: int) -> list[tuple[int, int]]:
    """n as a sum of value * 2^(40 i) with values that fit a long: one unless it is huge."""
    out, i = [], 0
    while not -(1 << 62) <= n < 1 << 62:
        out.append((i, n & ((1 << 40) - 1)))
        n, i = n >> 40, i + 1
    return [*out, (i, n)]


def _sums(rows: DataFrame, c: Centroids, with_distance: bool = False) -> tuple[list[list[int]], list[int], list[int]]:
    """(sums of components, numbers of rows, sums of squared distances) by centroid, exact. A task adds up its rows; what
    moves is a number for each centroid and component."""
    k, d = c.near.shape
    shared = rows.sparkSession.sparkContext.broadcast(c)

    def add(batches):
        c = shared.value
        small, large = np.zeros((k, d), np.int64), {}
        n, loss = np.zeros(k, np.int64), [0] * k
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            at = nearest(x, c)
            n += np.bincount(at, minlength=k)
            if with_distance:
                for number, far in zip(at.tolist(), _exact_to(x, at, c).tolist()):
                    loss[number] += far
            fits = np.abs(x).max(1, initial=0) <= SMALL
            order = np.flatnonzero(fits)[np.argsort(at[fits], kind="stable")]
            if len(order):
                first = np.flatnonzero(np.diff(at[order], prepend=-1))
                small[at[order[first]]] += np.add.reduceat(x[order].astype(np.int64), first, axis=0)
            for row in np.flatnonzero(~fits):
                total = large.setdefault(int(at[row]), [0] * d)
                for i, v in enumerate(x[row].tolist()):
                    total[i] += int(v)
        told = []
        for number in range(k):
            if n[number]:
                extra = large.get(number, [0] * d)
                values = [(-2, loss[number]), (-1, int(n[number])), *((i, int(small[number, i]) + extra[i]) for i in range(d))]
                told += [(number, i, limb, part) for i, v in values for limb, part in _limbs(v)]
        columns = [pa.array(z, pa.int64()) for z in zip(*told)] if told else [pa.array([], pa.int64())] * 4
        yield pa.RecordBatch.from_arrays(columns, ["c", "i", "limb", "x"])

    parts = rows.select("v").mapInArrow(add, "c long, i long, limb long, x long")
    total: list[dict[int, int]] = [{} for _ in range(k)]
    for r in parts.groupBy("c", "i", "limb").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():  # k * (d + 2)
        total[r.c][r.i] = total[r.c].get(r.i, 0) + (int(r.x) << (40 * r.limb))
    shared.unpersist()
    return [[t.get(i, 0) for i in range(d)] for t in total], [t.get(-1, 0) for t in total], [t.get(-2, 0) for t in total]


def _exact_to(x: np.ndarray, at: np.ndarray, c: Centroids) -> np.ndarray:
    """The exact squared distance of each row to its centroid."""
    if c.whole.dtype == object:
        return _exact(x, c.whole[at])
    out = np.zeros(len(x), object)
    fits = np.abs(x).max(1, initial=0) <= SMALL
    for part in (np.flatnonzero(fits), np.flatnonzero(~fits)):
        out[part] = _exact(x[part], c.whole[at[part]])
    return out


def _long(n: int) -> int | None:
    return n if -LONG <= n < LONG else None


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: float = 1024.0, salt: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): Lloyd's algorithm in whole numbers.

    Vectors become floor(scale * x); those that are null, of another length than `dim` or with null or non-finite components
    are left out. Centroids start as the k vectors with the smallest sha256 of `<salt>:<id>` (equal hashes, that is
    repeated ids: by components; null ids are assigned but start nothing); with fewer vectors there are fewer. Each round
    assigns every vector to the nearest centroid, ties to the smaller number, and moves it to floor(sum / count); a
    centroid without vectors stays. Repeated rows count each. No vector: no row. Distances and inertias that do not fit
    a long are null; assignments are exact all the same.

    The vectors are written once, and every round reads them where they lie. A round is one job that returns
    k * (dim + 2) sums a task, combined before they move; centroids go out as a broadcast of k * dim numbers.
    """
    rows = materialize(whole_vectors(vectors, dim, scale, id_col, vector_col), "centroid-vectors")
    hash_ = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id is not null").orderBy(hash_, "v").limit(k).collect()
    spark = rows.sparkSession
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    c = centroids_from([r.v for r in first])
    for _ in range(rounds):
        sums, counts, _ = _sums(rows, c)
        c = centroids_from([[s // n for s in total] if n else old for total, n, old in zip(sums, counts, c.whole.tolist())])
    _, counts, losses = _sums(rows, c, with_distance=True)
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.whole.tolist()]
    shared = spark.sparkContext.broadcast(c)
    by_cluster, over_all = pa.array([_long(x) for x in losses], pa.int64()), _long(sum(losses))

    def tell(batches):
        c = shared.value
        for batch in batches:
            if batch.num_rows:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                at = nearest(x, c)
                far = pa.array([_long(v) for v in _exact_to(x, at, c).tolist()], pa.int64())
                number = pa.array(at.astype(np.int32))
                columns = [batch.column("vec_id"), number, far, by_cluster.take(number), pa.array([over_all] * len(x), pa.int64()), pa.array(digests).take(number)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return rows.mapInArrow(tell, schema)


def oracle(k: int = 8, rounds: int = 10) -> str:
    """The same in SQL: a step of assignment and one of update for each round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT row_no, vec_id, v, cluster, distance FROM (
    SELECT x.row_no, x.vec_id, x.v, c.cluster, list_sum([CAST((z[1] - z[2]) * (z[1] - z[2]) AS BIGINT) FOR z IN list_zip(x.v, c.c)]) AS distance,
      row_number() OVER (PARTITION BY x.row_no ORDER BY list_sum([CAST((z[1] - z[2]) * (z[1] - z[2]) AS BIGINT) FOR z IN list_zip(x.v, c.c)]), c.cluster) AS nth
    FROM w x, c{r} c) WHERE nth = 1)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY cluster, i)""")
            steps.append(f"""m{r} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{r} GROUP BY cluster)""")
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c{r}.cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON m{r}.cluster = c{r}.cluster)""")
    return f"""
WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS row_no, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), v) - 1 AS cluster, v AS c FROM w WHERE vec_id IS NOT NULL
  QUALIFY cluster < {k}),
{",".join(steps)},
t AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY cluster)
SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, cluster_inertia,
  (SELECT CAST(sum(distance) AS BIGINT) FROM a{rounds}) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN t ON t.cluster = a.cluster JOIN c{rounds} c ON c.cluster = a.cluster
"""


ORACLE = oracle()

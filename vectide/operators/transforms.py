"""Transforms of whole vector tables: chains of column functions, and matrices that are broadcast."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.operators.search import _matrix


@dataclass(frozen=True)
class Chain:
    """Column functions of the vector, one after another; the same chain goes over queries, rows and centroids."""

    steps: list[Callable[[Column], Column]]

    def __call__(self, rows: DataFrame) -> DataFrame:
        v = F.col("embedding")
        for step in self.steps:
            v = step(v)
        return rows.withColumn("embedding", v)


def random_rotation(size: int, wanted: int | None = None, seed: int = 1234) -> np.ndarray:
    """Orthonormal rows (or columns, if more are wanted than there are dimensions) from a Gaussian matrix."""
    wanted = wanted or size
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(max(size, wanted), min(size, wanted))))
    return q if wanted > size else q.T


def apply(rows: DataFrame, matrix: np.ndarray, mean: np.ndarray | None = None) -> DataFrame:
    """matrix @ (embedding - mean) in place of the embedding."""
    shared = rows.sparkSession.sparkContext.broadcast((matrix, mean))
    names = rows.columns

    def run(batches):
        matrix, mean = shared.value
        for batch in batches:
            x = _matrix(batch.column("embedding"))
            y = (x if mean is None else x - mean) @ matrix.T if len(x) else np.zeros((0, len(matrix)))
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(matrix))
            turned = pa.ListArray.from_arrays(ends, pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([turned if n == "embedding" else batch.column(n) for n in names], names)

    schema = ", ".join(f"`{f.name}` {'array<double>' if f.name == 'embedding' else f.dataType.simpleString()}" for f in rows.schema)
    return rows.where("embedding is not null").mapInArrow(run, schema)


def itq(rows: DataFrame, size: int, rounds: int = 20, seed: int = 1234) -> np.ndarray:
    """A rotation after which signs lose little: in turn the signs of the rotated rows, and the rotation that brings the rows
    nearest to them. A round is one job that returns the size * size products of signs and rows, summed by task."""
    r = random_rotation(size, seed=seed)
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(r)

        def products(batches):
            total = np.zeros((size, size))
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column("embedding"))
                    total += np.where(x @ shared.value.T >= 0, 1.0, -1.0).T @ x
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.ravel())], ["i", "x"])

        parts = rows.where("embedding is not null").select("embedding").mapInArrow(products, "i long, x double")
        flat = np.array([p.x for p in parts.groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()])  # size^2 numbers
        shared.unpersist()
        u, _, vt = np.linalg.svd(flat.reshape(size, size))
        r = u @ vt
    return r

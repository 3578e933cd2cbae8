"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Where all run on one machine (tests) and none is
    set, a temporary one; on a cluster that is an error, as executors do not see the driver's folders."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = f"file://{tempfile.mkdtemp(prefix='vectide-')}"
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most `rows` rows from now on: long texts would else make batches of a hundred megabytes, once
    each in the JVM and in every Python worker. And unions whose parts lie by one key do not count as lying by it, which
    adaptive execution does not keep to (Spark 4.1)."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def materialize(df: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back (as `schema`, if given): lineage ends there, and a lost executor
    costs nothing.

    Unlike a checkpoint the result carries no partitioning, so joins on it stay open to AQE's skew handling.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/vectide/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def hash_sample(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The `n` rows with the smallest hashes of `keys` (all if fewer; ties by key).

    A threshold on the hash, taken from the number of rows, first leaves about 1.5 n of them, so that the one task that
    orders them reads little however large the table. Meant for keys that hardly repeat.
    """
    total = rows.count()
    hash_ = F.pmod(F.xxhash64(*keys), F.lit(1 << 40))
    if total > 2 * n:
        rows = rows.where(hash_ < int((1.5 * n + 100) / total * (1 << 40)))
    return rows.orderBy(hash_, *keys).limit(n)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on `keys` where nulls equal nulls; the keys appear once."""
    right = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    joined = left.join(right, [left[k].eqNullSafe(right[f"__right_{k}"]) for k in keys], how)
    return joined.drop(*[f"__right_{k}" for k in keys])


def text_slices(batches, budget: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about `budget` bytes of text (a longer single text stays whole). What
    Arrow has freed goes back to the system when all are through: the worker may wait for its next task a long time."""
    yield from _text_slices(batches, budget, column)
    give_back()


def give_back() -> None:
    """Return freed memory of this worker to the system, where its C library can: idle workers stay with their executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _text_slices(batches, budget: int, column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        lo = 0
        while lo < batch.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + budget, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column as one array, and the offset at which each row starts (one more at the end)."""
    filled = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm on a bounded sample; empty cells move to the points farthest from theirs."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        d = (c**2).sum(1) - 2 * x @ c.T
        cell = d.argmin(1)
        n = np.bincount(cell, minlength=len(c))
        for j in range(x.shape[1]):
            c[:, j] = np.where(n > 0, np.bincount(cell, weights=x[:, j], minlength=len(c)) / np.maximum(n, 1), c[:, j])
        if (n == 0).any():
            far = np.argsort(-(d[np.arange(len(x)), cell] + (x**2).sum(1)))[: (n == 0).sum()]
            c[np.flatnonzero(n == 0)[: len(far)]] = x[far]
    return c


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph with edges a-b: every node but the smallest of its component, with that smallest.

    Keeps what a task says about a dense group linear in the number of its nodes.
    """
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of `edges` (a long, b long): rows (node, component) for every node of an edge,
    where component is the smallest node reachable.

    Alternates large-star and small-star contraction until a round changes nothing: each edge then leads to the smallest
    node of its component, and the number of rounds grows with the logarithm of the longest path. Every round is written to the shared folder, minima are
    aggregated before they are shuffled, and hubs meet their minimum in a join that AQE may split. No link or
    component passes the driver; it only sees one checksum a round.
    """

    def minima(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("a").agg(F.min("b").alias("m"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, f"{name}-edges")
    seen = state(e)
    while seen[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = minima(both).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = minima(large)
        joined = large.join(low, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        e = materialize(small.distinct(), f"{name}-edges")
        now = state(e)
        if now == seen:
            break
        seen = now
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

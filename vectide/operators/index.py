"""Inverted lists as tables: assignment, statistics, and maintenance. An index is (centroids, lists) where lists has
vec_id, embedding and list_no; on disk lists are Parquet partitioned by list_no."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectide.functions import vectors as V
from vectide.operators.search import BROADCAST_BYTES, _matrix, knn, pairwise, plain_unions


def centroids_of(rows: DataFrame, key: str = "label") -> DataFrame:
    """(list_no, embedding): the mean vector of each key. Sums are combined before they are shuffled."""
    parts = rows.where("embedding is not null").select(F.col(key).alias("list_no"), F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("list_no", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "m")))
    return means.groupBy("list_no").agg(F.transform(ordered, lambda s: s["m"]).alias("embedding"))


def assign(rows: DataFrame, centroids: DataFrame, name: str = "l2") -> DataFrame:
    """(vec_id, list_no, score): the nearest centroid of every row; ties to the smaller list_no.

    Rows are the data side and centroids the queries of a search turned around: each row wants one centroid. Centroids
    are few against the rows; up to `BROADCAST_BYTES` they go to every task, which scans its rows once without a
    shuffle. More of them are matched as the searched side of a kNN.
    """
    size = centroids.agg(F.coalesce(F.sum(F.size("embedding") * 8), F.lit(0))).first()[0]
    if size > BROADCAST_BYTES:
        near = knn(rows.select(F.col("vec_id").alias("q_id"), "embedding"), centroids.select(F.col("list_no").cast("long").alias("vec_id"), "embedding"), 1, name)
        return near.select(F.col("q_id").alias("vec_id"), F.col("vec_id").cast("int").alias("list_no"), "score")
    held = centroids.orderBy("list_no").collect()
    shared = rows.sparkSession.sparkContext.broadcast((np.array([r.list_no for r in held], np.int32), np.array([r.embedding for r in held], np.float64)))

    def scan(batches):
        numbers, c = shared.value
        for batch in batches:
            if not batch.num_rows or not len(numbers):
                continue
            x = _matrix(batch.column("embedding"))
            d = pairwise(name, c, x)
            at = (d.argmax(0) if name in V.SIMILARITIES else d.argmin(0))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(numbers[at]), pa.array(d[at, np.arange(len(x))])], ["vec_id", "list_no", "score"])

    return rows.where("embedding is not null").select("vec_id", "embedding").mapInArrow(scan, "vec_id long, list_no int, score double")


def build(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """Lists of all rows."""
    return rows.join(assign(rows, centroids).select("vec_id", "list_no"), "vec_id")


def list_sizes(lists: DataFrame, centroids: DataFrame) -> DataFrame:
    """(list_no, n) for every centroid, empty lists included."""
    return centroids.select("list_no").join(lists.groupBy("list_no").agg(F.count("*").alias("n")), "list_no", "left").select("list_no", F.coalesce("n", F.lit(0)).alias("n"))


def imbalance(sizes: DataFrame) -> DataFrame:
    """(imbalance): number of lists * sum of squared sizes / squared sum; 1 where all are equal."""
    n = F.col("n").cast("double")
    return sizes.agg((F.count("*") * F.sum(n * n) / (F.sum(n) * F.sum(n))).alias("imbalance"))


def merged(first: DataFrame, second: DataFrame, shift: int) -> DataFrame:
    """Both indexes, the second's ids shifted."""
    plain_unions(first.sparkSession)
    return first.unionByName(second.withColumn("vec_id", F.col("vec_id") + shift))


def without(lists: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the listed ids; those that stay keep theirs."""
    return lists.join(ids.select("vec_id").distinct(), "vec_id", "left_anti")


def updated(lists: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of `changes` replace those of the same id."""
    plain_unions(lists.sparkSession)
    return without(lists, changes).unionByName(changes)


def window_of_slices(rows: DataFrame, slice_col: str, width: int) -> DataFrame:
    """The newest `width` slices."""
    newest = rows.agg(F.max(slice_col).alias("__newest"))
    return rows.join(F.broadcast(newest)).where(F.col(slice_col) > F.col("__newest") - width).drop("__newest")


def duplicates(rows: DataFrame) -> DataFrame:
    """(vec_id, representative, copies): equal vectors; the smallest id of each group stands for it."""
    groups = rows.groupBy("embedding").agg(F.min("vec_id").alias("representative"), F.count("*").alias("copies"))
    return rows.join(groups, "embedding").select("vec_id", "representative", "copies")


def statistics(rows: DataFrame) -> DataFrame:
    """(pos, n, n_nan, n_inf, n_zero, low, high, mean, deviation) of each component; NaN and infinite ones are only counted."""
    x = F.col("x").cast("double")
    infinite = F.abs(x) == float("inf")
    good = F.when(~F.isnan(x) & ~infinite, x)
    parts = rows.select(F.posexplode("embedding").alias("pos", "x"))
    return parts.groupBy("pos").agg(
        F.count("*").alias("n"), F.count(F.when(F.isnan(x), 1)).alias("n_nan"), F.count(F.when(infinite, 1)).alias("n_inf"), F.count(F.when(x == 0, 1)).alias("n_zero"), F.min(good).alias("low"), F.max(good).alias("high"), F.avg(good).alias("mean"), F.stddev_pop(good).alias("deviation")
    )


def by_size(sizes: DataFrame) -> DataFrame:
    """(list_no, n, new_no): lists renumbered from the largest."""
    return sizes.withColumn("new_no", F.row_number().over(Window.orderBy(F.desc("n"), "list_no")) - 1)


def save(lists: DataFrame, path: str) -> None:
    lists.repartition("list_no").write.mode("overwrite").partitionBy("list_no").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Searches prune to the lists they probe."""
    return spark.read.parquet(path)


def pending(rows: DataFrame, done: DataFrame, key: str = "vec_id") -> DataFrame:
    """Rows that an interrupted job has not written yet."""
    return rows.join(done.select(key), key, "left_anti")


def row_statistics(rows: DataFrame) -> DataFrame:
    """(n, n_distinct, least_norm, largest_norm) of whole vectors."""
    each = rows.where("embedding is not null").groupBy("embedding").agg(F.count("*").alias("n")).withColumn("norm", V.norm(F.col("embedding")))
    return each.agg(F.sum("n").alias("n"), F.count("*").alias("n_distinct"), F.min("norm").alias("least_norm"), F.max("norm").alias("largest_norm"))


def stacked(first: DataFrame, second: DataFrame, shift: int) -> DataFrame:
    """The lists of both, the second's numbered `shift` further."""
    plain_unions(first.sparkSession)
    return first.unionByName(second.withColumn("list_no", F.col("list_no") + shift))


def sliced(lists: DataFrame, begin: int, end: int) -> DataFrame:
    """Lists begin..end-1, numbered from 0."""
    return lists.where((F.col("list_no") >= begin) & (F.col("list_no") < end)).withColumn("list_no", F.col("list_no") - begin)


def without_long_lists(lists: DataFrame, most: int) -> DataFrame:
    """Lists of more than `most` rows count as empty, like stop words."""
    short = lists.groupBy("list_no").count().where(F.col("count") <= most).select("list_no")
    return lists.join(short, "list_no", "left_semi")


def masked(first: DataFrame, second: DataFrame) -> DataFrame:
    """Each list from `first`, or from `second` where the first has it empty."""
    plain_unions(first.sparkSession)
    return first.unionByName(second.join(first.select("list_no").distinct(), "list_no", "left_anti"))


def checksum(rows: DataFrame) -> DataFrame:
    """(vec_id, checksum): sum of floor(2^20 * component) * (place + 1) of each vector; equal vectors have equal sums."""
    v = V.doubles(F.col("embedding"))
    weighed = F.transform(v, lambda x, i: F.floor(x * F.lit(1048576.0)) * (i + 1))
    return rows.select("vec_id", F.aggregate(weighed, F.lit(0).cast("long"), lambda s, x: s + x).alias("checksum"))


def compatible(first: DataFrame, second: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(same_lists, largest_gap, compatible) of two coarse models (list_no, embedding): indexes merge only if they have the
    same lists with the same centroids."""
    a = first.select("list_no", F.col("embedding").alias("a"))
    b = second.select("list_no", F.col("embedding").alias("b"))
    gap = F.when(F.size("a") == F.size("b"), V.metric("linf", F.col("a"), F.col("b")))
    each = a.join(b, "list_no", "full").agg(F.count("*").alias("n"), F.count(gap).alias("paired"), F.max(gap).alias("largest_gap"))
    same = F.col("n") == F.col("paired")
    return each.select(same.alias("same_lists"), "largest_gap", (same & (F.coalesce("largest_gap", F.lit(0.0)) <= tolerance)).alias("compatible"))


def in_bitmap(rows: DataFrame, bitmap: DataFrame) -> DataFrame:
    """Rows whose id is set in a bitmap (word_no, bits): bit id % 32 of word id / 32."""
    word = rows.withColumn("word_no", F.floor(F.col("vec_id") / 32))
    return word.join(bitmap, "word_no").where(F.getbit("bits", F.pmod("vec_id", F.lit(32))) == 1).select(*rows.columns)


def bitmap_of(ids: DataFrame) -> DataFrame:
    """(word_no, bits) of the ids (vec_id)."""
    bit = F.pow(F.lit(2.0), F.pmod("vec_id", F.lit(32))).cast("long")
    return ids.select("vec_id").distinct().groupBy(F.floor(F.col("vec_id") / 32).alias("word_no")).agg(F.bit_or(bit).alias("bits"))


def expanded(hits: DataFrame, groups: DataFrame) -> DataFrame:
    """(q_id, vec_id, score): hits on representatives with all their copies; `groups` is what duplicates() tells."""
    copies = groups.select(F.col("representative").alias("rep"), "vec_id")
    return hits.select("q_id", F.col("vec_id").alias("rep"), "score").join(copies, "rep").select("q_id", "vec_id", "score")


def assign_sparse(sparse: DataFrame, centroids: DataFrame) -> DataFrame:
    """(vec_id, list_no, score): the centroid with the largest inner product with each sparse row (vec_id, pos, x); equal to
    nine digits, ties to the smaller list_no."""
    dense = centroids.select("list_no", F.posexplode(V.doubles(F.col("embedding"))).alias("pos", "c"))
    scores = sparse.join(dense, "pos").groupBy("vec_id", "list_no").agg(F.sum(F.col("x") * F.col("c")).alias("score"))
    first = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc(F.round("score", 9)), "list_no"))
    return scores.withColumn("n", first).where("n = 1").select("vec_id", F.col("list_no").cast("int").alias("list_no"), "score")


def assign_counts(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """(vec_id, list_no, score): as assign_sparse of how often each place is in rows (vec_id, places array<int>), counted and scored
    in the row, without a shuffle. Rows without places have no list. Ids that repeat, lists without number and more than
    `BROADCAST_BYTES` of centroids take assign_sparse."""
    size, unnumbered = centroids.agg(F.coalesce(F.sum(F.size("embedding") * 8), F.lit(0)), F.count(F.when(F.col("list_no").isNull(), 1))).first()
    if size > BROADCAST_BYTES or unnumbered or not rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        flat = rows.select("vec_id", F.explode("places").alias("pos"))
        return assign_sparse(flat.groupBy("vec_id", "pos").agg(F.count("*").cast("double").alias("x")), centroids)
    held = centroids.orderBy("list_no").collect()
    shared = rows.sparkSession.sparkContext.broadcast((np.array([r.list_no for r in held], np.int32), np.array([r.embedding for r in held], np.float64)))

    def scan(batches):
        numbers, c = shared.value
        for some in batches:
            for batch in (some.slice(lo, 1024) for lo in range(0, some.num_rows if len(numbers) else 0, 1024)):
                n = batch.column("places").value_lengths().to_numpy(zero_copy_only=False)
                at = batch.column("places").flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(n)), n)
                known = (at >= 0) & (at < c.shape[1])
                x = np.bincount(row[known] * c.shape[1] + at[known], minlength=len(n) * c.shape[1]).reshape(len(n), -1)
                score = x @ c.T
                best = (np.floor(score * 1e9 + 0.5)).argmax(1)
                told = np.flatnonzero(x.any(1))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(told)), pa.array(numbers[best[told]]), pa.array(score[told, best[told]])], ["vec_id", "list_no", "score"])

    return rows.where("places is not null").select("vec_id", F.col("places").cast("array<int>").alias("places")).mapInArrow(scan, "vec_id long, list_no int, score double")


def bloom_of(ids: DataFrame, bits: int = 1 << 23, hashes: int = 3) -> np.ndarray:
    """A Bloom filter of the ids (vec_id) as 64-bit words: a table of fixed size (1 MB by default), whatever their number. Words
    are combined before they move."""
    places = F.array(*[F.pmod(F.xxhash64("vec_id", F.lit(h)), F.lit(bits)) for h in range(hashes)])
    set_ = ids.where("vec_id is not null").select(F.explode(places).alias("at"))
    words = set_.groupBy(F.expr("cast(at div 64 as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(-(-bits // 64), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def maybe_in(rows: DataFrame, bloom: np.ndarray, bits: int = 1 << 23, hashes: int = 3) -> DataFrame:
    """Rows whose vec_id may be one of the ids of a Bloom filter, without a shuffle; all that are, and few others. Rows of any columns."""
    shared = rows.sparkSession.sparkContext.broadcast(bloom)
    names = rows.columns
    hashed = rows.select("*", *[F.pmod(F.xxhash64("vec_id", F.lit(h)), F.lit(bits)).alias(f"__bloom_{h}") for h in range(hashes)])

    def run(batches):
        words = shared.value
        for batch in batches:
            hit = np.ones(batch.num_rows, bool)
            for h in range(hashes):
                at = batch.column(f"__bloom_{h}").to_numpy()
                hit &= (words[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names], names).filter(pa.array(hit))

    return hashed.mapInArrow(run, rows.schema)


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose vec_id is in `ids`: a Bloom filter first, so that few others are shuffled, and the set itself after it."""
    return maybe_in(rows.where("vec_id is not null"), bloom_of(ids)).join(ids.select("vec_id").distinct(), "vec_id", "left_semi")

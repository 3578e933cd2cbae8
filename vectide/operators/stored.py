"""Indexes on disk: a model table (list_no, embedding, n) and the lists as Parquet partitioned by list_no, so that a search
opens the files of the lists it probes and no others."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.operators import index, search
from vectide.sources.written import exists

@dataclass(frozen=True)
class Stored:
    """model: centroid and number of rows of every list; lists: (vec_id, embedding, list_no)."""

    model: DataFrame
    lists: DataFrame


def _save_lists(lists: DataFrame, sizes: DataFrame, path: str, rows_per_file: int) -> None:
    """One file a list, several where it has more than `rows_per_file` rows: no task writes more of one."""
    files = sizes.select(F.col("list_no").alias("__list"), F.ceil(F.col("n") / rows_per_file).cast("int").alias("__files"))
    dealt = lists.join(files, lists["list_no"] == files["__list"]).withColumn("__file", F.pmod(F.xxhash64("vec_id"), F.greatest("__files", F.lit(1))))
    spread = dealt.repartition("list_no", "__file").select("vec_id", "embedding", "list_no")
    spread.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("list_no").parquet(path)


def write(lists: DataFrame, centroids: DataFrame, path: str, rows_per_file: int = 1_000_000) -> Stored:
    """Store lists (vec_id, embedding, list_no) with their centroids (list_no, embedding). The model is written last: a
    folder without one is an index that was not finished."""
    sizes = index.list_sizes(lists, centroids)
    lists = lists.select("vec_id", "embedding", F.col("list_no").cast("int").alias("list_no"))
    lists.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/schema")
    _save_lists(lists, sizes, f"{path}/lists", rows_per_file)
    centroids.select("list_no", "embedding").join(sizes, "list_no").select(F.col("list_no").cast("int").alias("list_no"), "embedding", "n").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    return read(lists.sparkSession, path)


def read(spark: SparkSession, path: str) -> Stored:
    return Stored(spark.read.parquet(f"{path}/model"), spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/lists"))


def find(queries: DataFrame, stored: Stored, k: int, nprobe: int, name: str = "l2", max_codes: int = 0, selector: Column | None = None) -> DataFrame:
    """(q_id, vec_id, list_no, score, rank): sizes come from the model, so no list is read to be counted."""
    return search.ivf(queries, stored.model, stored.lists, k, nprobe, name, max_codes, selector, stored.model.select("list_no", "n"))


def merge(spark: SparkSession, first: str, second: str, shift: int, path: str, rows_per_file: int = 1_000_000) -> Stored:
    """A third index on disk of two that have the same model; ids of the second are shifted. Raises if models differ."""
    a, b = read(spark, first), read(spark, second)
    if not index.compatible(a.model, b.model).first()["compatible"]:
        raise ValueError("the models differ: their lists cannot be merged")
    return write(index.merged(a.lists.select("vec_id", "embedding", "list_no"), b.lists.select("vec_id", "embedding", "list_no"), shift), a.model, path, rows_per_file)


def finished_parts(spark: SparkSession, path: str) -> DataFrame:
    """(part, low, high, n): the manifest of what is encoded; a part has a row once all of it is written."""
    schema = "part int, low long, high long, n long"
    return spark.read.schema(schema).parquet(f"{path}/manifest") if exists(spark, f"{path}/manifest") else spark.createDataFrame([], schema)


def encode_parts(rows: DataFrame, centroids: DataFrame, path: str, parts: int, most: int | None = None) -> int:
    """Assign rows to lists, a range of ids at a time, each written and then entered in the manifest. Run again after a
    failure, it does what the manifest does not have; half-written parts are replaced. `most` parts are done at most.
    Returns how many are missing. The ranges are fixed by the first run; later ones must bring the same rows."""
    spark = rows.sparkSession
    ranges_at = f"{path}/ranges"
    if not exists(spark, f"{ranges_at}/_SUCCESS"):
        low, high = rows.agg(F.min("vec_id"), F.max("vec_id")).first()
        if low is None:
            return 0
        width = max(1, -(-(high - low + 1) // parts))
        bounds = [(i, low + i * width, min(high, low + (i + 1) * width - 1)) for i in range(parts) if low + i * width <= high]
        spark.createDataFrame(bounds, "part int, low long, high long").coalesce(1).write.mode("overwrite").parquet(ranges_at)
    bounds = sorted(map(tuple, spark.read.parquet(ranges_at).collect()))
    done = {r.part for r in finished_parts(spark, path).collect()}
    left = [b for b in bounds if b[0] not in done]
    for part, low, high in left[:most]:
        mine = rows.where(F.col("vec_id").between(low, high)).select("vec_id", "embedding")
        at = f"{path}/parts/part={part}"
        index.build(mine, centroids).select("vec_id", "embedding", "list_no").repartition("list_no").write.mode("overwrite").partitionBy("list_no").parquet(at)
        n = mine.where("embedding is not null").count()
        spark.createDataFrame([(part, low, high, n)], "part int, low long, high long, n long").coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return len(left) - len(left[:most])


def from_parts(spark: SparkSession, centroids: DataFrame, path: str) -> Stored:
    """The index of all finished parts, as it lies; a search opens the probed lists of every part."""
    done = [r.part for r in finished_parts(spark, path).collect()]
    if not done:
        raise ValueError("no part is finished")
    lists = spark.read.parquet(f"{path}/parts").where(F.col("part").isin(done)).select("vec_id", "embedding", F.col("list_no").cast("int").alias("list_no"))
    return Stored(centroids.select("list_no", "embedding").join(index.list_sizes(lists, centroids), "list_no"), lists)


def find_in_ranges(queries: DataFrame, probed: DataFrame, stored: Stored, k: int, path: str, ranges: int, name: str = "l2", most: int | None = None) -> DataFrame | None:
    """(q_id, vec_id, score, rank) of a large batch, a range of list numbers at a time: each range's k best are written, and
    a run after a failure goes on with the ranges that are not there yet. None while ranges are missing (`most` are done in
    one run at most). `probed` brings the assignment (q_id, list_no); it must be the same in every run."""
    spark = queries.sparkSession
    low, high = stored.model.agg(F.min("list_no"), F.max("list_no")).first()
    if low is None:
        return search.ranked(spark.createDataFrame([], search.RESULT), k, name)
    width = max(1, -(-(high - low + 1) // ranges))
    starts = range(low, high + 1, width)
    missing = [s for s in starts if not exists(spark, f"{path}/from={s}/_SUCCESS")]
    pairs = probed.select("q_id", "list_no")
    for start in missing[:most]:
        inside = F.col("list_no").between(start, start + width - 1)
        hits = search.scan_lists(queries, pairs.where(inside), stored.lists.where(inside), name, k=k, sizes=stored.model.select("list_no", "n"))
        search.ranked(hits.select("q_id", "vec_id", "score"), k, name).drop("rank").write.mode("overwrite").parquet(f"{path}/from={start}")
    if len(missing) > len(missing[:most]):
        return None
    parts = [spark.read.schema(search.RESULT).parquet(f"{path}/from={s}") for s in starts]
    return search.ranked(reduce(lambda a, b: a.unionByName(b), parts), k, name)

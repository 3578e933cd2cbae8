"""Near-duplicate embeddings by inverted lists with product-quantised residuals."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import components, forest, hash_sample, kmeans, materialize


def _unit(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # keeps squares of huge or tiny components finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _links(classes: DataFrame, dim: int, threshold: float, train_rows: int, list_size: int, max_lists: int, subspaces: int, slack: float, tile: int, seed: int) -> DataFrame:
    """(cls, links, a, b) of classes (cls, n, v) of one length: rows with how many vectors a class links to, once a task
    that found any, and rows with the edges of spanning forests."""
    spark, total = classes.sparkSession, classes.count()
    train = np.array([*hash_sample(classes.select("v"), ["v"], train_rows).toPandas()["v"]], np.float64)
    train = train / np.abs(train).max(1, keepdims=True)
    train = train / np.linalg.norm(train, axis=1, keepdims=True)
    lists = int(min(max_lists, max(1, len(train) // 4), max(1, -(-total // list_size))))
    coarse = kmeans(train, lists, 8, seed)
    home = ((coarse**2).sum(1) - 2 * train @ coarse.T).argmin(1)
    residual = train - coarse[home]
    edges = np.linspace(0, dim, min(subspaces, dim) + 1).astype(int)
    books = [kmeans(residual[:, a:b], 256, 6, seed) for a, b in zip(edges, edges[1:])]
    reach = float(np.sqrt(2 - 2 * threshold))
    shared = spark.sparkContext.broadcast((coarse, books, edges))  # at most max_lists centroids and 256 codes a subspace

    def probes(d_home: np.ndarray, d_list: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Whether vectors at these squared distances from their home's and another list's centroid ask that list; `gap`
        is the squared distance of the two centroids."""
        return (gap < 1e-12) | (d_list - d_home <= 2 * slack * reach * np.sqrt(np.maximum(gap, 0)))

    def index(batches):
        coarse, books, edges = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                u = _unit(part.column("v"))
                squares = (coarse**2).sum(1)
                d = np.maximum((u**2).sum(1)[:, None] + squares - 2 * u @ coarse.T, 0)
                home = d.argmin(1)
                gap = squares[home][:, None] + squares - 2 * coarse[home] @ coarse.T
                probe = probes(d[np.arange(len(u)), home][:, None], d, gap)
                probe[np.arange(len(u)), home] = True
                left = u - coarse[home]
                codes = np.empty((len(u), len(books)), np.uint8)
                error = np.zeros(len(u))
                for m, book in enumerate(books):
                    s = left[:, edges[m] : edges[m + 1]]
                    e = (s**2).sum(1)[:, None] + (book**2).sum(1) - 2 * s @ book.T
                    codes[:, m] = e.argmin(1)
                    error += np.maximum(e.min(1), 0)
                row, to = np.nonzero(probe)
                asked = pa.array(row)
                code = pa.array([c.tobytes() for c in codes])
                told = [pa.array(home.astype(np.int32)), part.column("cls"), part.column("n"), part.column("v"), pa.array(np.sqrt(error))]
                names = ["list", "is_query", "home", "cls", "n", "v", "err", "code"]
                yield pa.RecordBatch.from_arrays([told[0], pa.array(np.zeros(len(u), bool)), *told, code], names)
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(np.ones(len(row), bool)), *[c.take(asked) for c in told], pa.nulls(len(row), pa.binary())], names)

    kind = classes.schema["v"].dataType.simpleString()
    stored = materialize(classes.select("cls", "n", "v").mapInArrow(index, f"list int, is_query boolean, home int, cls long, n long, v {kind}, err double, code binary"), "pq-index")
    counts = stored.groupBy("list").agg(F.count(F.when(~F.col("is_query"), 1)).alias("members"), F.count(F.when(F.col("is_query"), 1)).alias("asked"))
    counts = counts.select("list", F.greatest(F.lit(1), F.ceil(F.col("members") / tile)).cast("int").alias("chunks"), F.greatest(F.lit(1), F.ceil(F.col("asked") / (2 * tile))).cast("int").alias("blocks"))
    dealt = stored.join(F.broadcast(counts), "list")  # one row a list: at most max_lists
    slot = F.pmod(F.xxhash64("cls"), F.when(F.col("is_query"), F.col("blocks")).otherwise(F.col("chunks"))).cast("int")
    other = F.sequence(F.lit(0), F.when(F.col("is_query"), F.col("chunks")).otherwise(F.col("blocks")) - 1)
    dealt = dealt.withColumn("slot", slot).select("list", "is_query", "home", "cls", "n", "v", "err", "code", "slot", F.explode(other).alias("other"))
    chunk, block = F.when(F.col("is_query"), F.col("other")).otherwise(F.col("slot")), F.when(F.col("is_query"), F.col("slot")).otherwise(F.col("other"))
    dealt = dealt.select(F.xxhash64("list", chunk, block).alias("task"), "list", "is_query", "home", "cls", "n", "v", "err", "code").repartition("task").sortWithinPartitions("task", "is_query")

    def search(batches):
        coarse, books, edges = shared.value
        held = None

        def solve(batch):
            task = batch.column("task").to_numpy()
            is_query = batch.column("is_query").to_numpy(zero_copy_only=False)
            cls, n, err, lists, home = (batch.column(c).to_numpy() for c in ("cls", "n", "err", "list", "home"))
            u = _unit(batch.column("v"))
            codes = np.zeros((len(task), len(books)), np.uint8)
            codes[~is_query] = np.frombuffer(b"".join(batch.column("code").drop_null().to_pylist()), np.uint8).reshape(-1, len(books))
            cuts = np.flatnonzero(np.diff(task)) + 1
            who, links, a_, b_ = [], [], [], []
            for lo, hi in zip([0, *cuts], [*cuts, len(task)]):
                mid = lo + int(np.searchsorted(is_query[lo:hi], True))
                if mid == lo or mid == hi:
                    continue
                found_a, found_b = [], []
                for q in range(mid, hi, 256):
                    top = min(hi, q + 256)
                    r = u[q:top] - coarse[lists[lo]]
                    adc = np.zeros((top - q, mid - lo))
                    for m, book in enumerate(books):  # one table a subspace: distance of the query's part to every code
                        s = r[:, edges[m] : edges[m + 1]]
                        table = (s**2).sum(1)[:, None] + (book**2).sum(1) - 2 * s @ book.T
                        adc += table[:, codes[lo:mid, m]]
                    i, j = np.nonzero(np.sqrt(np.maximum(adc, 0)) <= reach + err[lo:mid] + 1e-6)
                    other = cls[q + i] != cls[lo + j]
                    i, j = q + i[other], lo + j[other]
                    exact = np.einsum("ij,ij->i", u[i], u[j]) >= threshold
                    i, j = i[exact], j[exact]
                    # where the other end asks this one's home too, only the smaller class takes the pair
                    to_own, to_other = (((u[j] - coarse[c]) ** 2).sum(1) for c in (home[j], home[i]))
                    gap = ((coarse[home[i]] - coarse[home[j]]) ** 2).sum(1)
                    own = (cls[i] < cls[j]) | ~probes(to_own, to_other, gap)
                    i, j = i[own], j[own]
                    if len(i):
                        ends, at = np.unique(np.concatenate([i, j]), return_inverse=True)
                        who.append(cls[ends])
                        links.append(np.bincount(at, weights=np.concatenate([n[j], n[i]])).astype(np.int64))
                        x, y = forest(cls[i], cls[j])
                        found_a.append(x)
                        found_b.append(y)
                if found_a:
                    x, y = forest(np.concatenate(found_a), np.concatenate(found_b))
                    a_.append(x)
                    b_.append(y)
            who, links, a_, b_ = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (who, links, a_, b_))
            none = pa.nulls(len(who), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(links), none, none], ["cls", "links", "a", "b"])
            none = pa.nulls(len(a_), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(a_), pa.array(b_)], ["cls", "links", "a", "b"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                if held is not None:
                    part = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
                task = part.column("task").to_numpy()
                last = int(np.searchsorted(task, task[-1], side="left"))
                if last:
                    yield from solve(part.slice(0, last))
                held = part.slice(last)
        if held is not None:
            yield from solve(held)

    return materialize(dealt.mapInArrow(search, "cls long, links long, a long, b long"), "pq-links")


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, train_rows: int = 16_384, list_size: int = 200, max_lists: int = 4096, subspaces: int = 16, slack: float = 0.5, tile: int = 2048, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): vectors linked by cosine >= threshold.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Vectors of different length
    do not link; each length has an index of its own. Equal vectors are one class (they link with cosine 1), searched once and counted
    with its size. Null ids form no class of their own: a null id is counted like any other row and is only ever a
    component_id where nothing else is reachable.

    The index is fitted on at most `train_rows` distinct vectors: coarse centroids, about one for `list_size` vectors,
    and `subspaces` codebooks of 256 residual codes. Every vector is coded and stored in its nearest list with its exact
    coding error. A query probes each list whose boundary is within `slack` times the largest distance of a linked pair;
    slack = 1 makes probing exact, 0.5 misses a pair only if its difference points at a boundary about four times as
    much as a random direction would in 64 dimensions, from both of its ends. In a list, table-lookup distances keep what
    may be within the threshold given the coding error, and the exact cosine in double precision decides. A pair that
    both ends could find is taken where its smaller class asks, one that only one end finds there; either way both ends
    count it. Lists of more than `tile` rows are cut in chunks, so that no list has to fit in one task; a task reports
    counts and a spanning forest, not pairs. Above `max_lists` * `list_size` vectors lists get longer instead of more.
    """
    x = F.col(vector_col)
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(x, lambda c: c != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(good, x).alias("v"))
    classes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if classes.isEmpty():
        return alone
    lengths = sorted(r[0] for r in classes.select(F.size("v")).distinct().collect())  # one row a length
    each = [_links(classes.where(F.size("v") == dim), dim, threshold, train_rows, list_size, max_lists, subspaces, slack, tile, seed) for dim in lengths]
    found = reduce(lambda a, b: a.unionByName(b), each)
    links = found.where("cls is not null").groupBy("cls").agg(F.sum("links").alias("links"))
    joined = components(found.where("a is not null").select("a", "b"), "pq").withColumnRenamed("node", "cls")
    rooted = classes.select("v", "cls", "low", "n").join(joined, "cls", "left").withColumn("root", F.coalesce("component", "cls")).join(links, "cls", "left")
    smallest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    told = rooted.join(smallest, "root").select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    told = materialize(told, "pq-classes")
    linked = rows.where("v is not null").join(told, "v").select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
    return linked.unionByName(alone.where(rows["v"].isNull()))


ORACLE = """
WITH RECURSIVE good AS (
  SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
comp AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node),
deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN comp c ON c.node = e.vec_id LEFT JOIN deg d ON d.a = e.vec_id
"""

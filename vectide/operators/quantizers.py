"""Product and residual quantisers. A codebook is a table (sub, code, center): for each part of the vector its centres;
a set of codebooks has parts * codes rows, is collected for encoding and broadcast. Searches on codes turn each query into
a table of distances by code, so that a row costs one look-up a part."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.functions import vectors as V
from vectide.operators import clustering, search


#: Rows that a task works on at a time: what lies between a batch and its result is bounded by it.
SLICE = 1024


def part_of(v: Column, sub: int, width: int) -> Column:
    return F.slice(V.doubles(v), sub * width + 1, width)


def train(rows: DataFrame, parts: int, dim: int, codes: int = 256, rounds: int = 25, per_cluster: int | None = None) -> DataFrame:
    """Codebooks of k-means centres of each part, trained on all rows (or about codes * per_cluster of them)."""
    found = []
    for sub in range(parts):
        c, _ = clustering.kmeans(rows.select("vec_id", part_of(F.col("embedding"), sub, dim // parts).alias("embedding")), codes, rounds, per_cluster=per_cluster)
        found += [(sub, i, v.tolist()) for i, v in enumerate(c)]
    return rows.sparkSession.createDataFrame(found, "sub int, code int, center array<double>")


def from_groups(rows: DataFrame, key: str, parts: int, dim: int) -> DataFrame:
    """Codebooks whose centres are the mean parts of given groups, numbered in the order of their keys."""
    split = F.array(*[F.struct(F.lit(i).alias("sub"), part_of(F.col("embedding"), i, dim // parts).alias("v")) for i in range(parts)])
    flat = rows.select(F.col(key).alias("key"), F.explode(split).alias("p")).select("key", "p.sub", F.posexplode("p.v").alias("pos", "x"))
    means = flat.groupBy("key", "sub", "pos").agg(F.avg("x").alias("m"))
    centers = means.groupBy("key", "sub").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("center"))
    return centers.select("sub", F.col("key").cast("int").alias("code"), "center")


def _books(books: DataFrame) -> list[np.ndarray]:
    """Centres by part, in order of their code."""
    held = books.orderBy("sub", "code").collect()  # parts * codes rows
    return [np.array([r.center for r in held if r.sub == sub]) for sub in sorted({r.sub for r in held})]


def encode(rows: DataFrame, books: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds code (array<int>): the nearest centre of each part, ties to the smaller code; codes count from 0."""
    shared = rows.sparkSession.sparkContext.broadcast(_books(books))
    names = rows.columns

    def run(batches):
        for batch in batches:
            x = search._matrix(batch.column(vector))
            codes = np.empty((len(x), len(shared.value)), np.int32)
            for lo in range(0, len(x), SLICE):
                at = 0
                for sub, c in enumerate(shared.value):
                    part = x[lo : lo + SLICE, at : at + c.shape[1]]
                    at += c.shape[1]
                    codes[lo : lo + SLICE, sub] = ((part[:, None] - c) ** 2).sum(2).argmin(1) if SLICE * c.size < 1 << 20 else ((c**2).sum(1) - 2 * part @ c.T).argmin(1)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * codes.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(codes.ravel()))], [*names, "code"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.where(F.col(vector).isNotNull()).mapInArrow(run, f"{schema}, code array<int>")


def decode(coded: DataFrame, books: DataFrame) -> DataFrame:
    """Adds decoded: the centres of a row's codes, one after another."""
    by_part = books.groupBy("sub").agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "center"))), lambda s: s["center"]).alias("centers"))
    one = by_part.agg(F.transform(F.array_sort(F.collect_list(F.struct("sub", "centers"))), lambda s: s["centers"]).alias("books"))  # one row
    value = F.flatten(F.zip_with("books", "code", lambda b, c: F.element_at(b, c + 1)))
    return coded.join(F.broadcast(one)).withColumn("decoded", value).drop("books")


def tables(queries: DataFrame, books: DataFrame) -> DataFrame:
    """The queries with, as embedding, their squared distance to each centre, part by part."""
    shared = queries.sparkSession.sparkContext.broadcast(_books(books))
    names = queries.columns

    def run(batches):
        for batch in batches:
            x, at, found = search._matrix(batch.column("embedding")), 0, []
            for c in shared.value:
                found.append(((x[:, None, at : at + c.shape[1]] - c) ** 2).sum(2))
                at += c.shape[1]
            flat = np.concatenate(found, axis=1)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * flat.shape[1])
            columns = [pa.ListArray.from_arrays(ends, pa.array(flat.ravel())) if n == "embedding" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"`{f.name}` {'array<double>' if f.name == 'embedding' else f.dataType.simpleString()}" for f in queries.schema)
    return queries.where("embedding is not null").mapInArrow(run, schema)


def knn(queries: DataFrame, coded: DataFrame, books: DataFrame, k: int) -> DataFrame:
    """(q_id, vec_id, score, rank): the k smallest squared distances of the queries to decoded rows. All parts need books of
    one size."""
    codes = coded.select("vec_id", V.doubles(F.col("code")).alias("embedding"))
    return search.knn(tables(queries.select("q_id", "embedding"), books), codes, k, "lut")


def residual_codes(lists: DataFrame, centroids: DataFrame, books: DataFrame) -> DataFrame:
    """(list_no, vec_id, code): what is left of each row after its list's centroid, coded."""
    left = lists.join(centroids.select("list_no", F.col("embedding").alias("c")), "list_no")
    return encode(left.select("list_no", "vec_id", V.subtract(F.col("embedding"), F.col("c")).alias("embedding")), books).select("list_no", "vec_id", "code")


def ivf_knn(queries: DataFrame, probed: DataFrame, centroids: DataFrame, coded: DataFrame, books: DataFrame, k: int) -> DataFrame:
    """(q_id, vec_id, list_no, score, rank) over coded residuals: for each probed list the query less its centroid becomes a
    table of distances, and the list's rows look theirs up."""
    left = probed.select("q_id", "list_no").join(queries.select("q_id", "embedding"), "q_id").join(centroids.select("list_no", F.col("embedding").alias("c")), "list_no")
    asked = tables(left.select("q_id", "list_no", V.subtract(F.col("embedding"), F.col("c")).alias("embedding")), books)
    rows = coded.select("list_no", "vec_id", V.doubles(F.col("code")).alias("embedding"))
    return search.ranked(search._by_list(asked, rows, "lut", k, None), k)


def residual_steps(rows: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """(vec_id, codes, embedding): additive codes. Each step (codebooks of one part) codes what the steps before have left;
    embedding is what is left in the end."""
    out = rows.select("vec_id", V.doubles(F.col("embedding")).alias("embedding"), F.array().cast("array<int>").alias("codes"))
    for books in steps:
        coded = decode(encode(out, books), books)
        out = coded.select("vec_id", V.subtract(F.col("embedding"), F.col("decoded")).alias("embedding"), F.concat("codes", "code").alias("codes"))
    return out


def product_probes(queries: DataFrame, books: DataFrame, nprobe: int) -> DataFrame:
    """(q_id, list_no, score, probe_rank): the nearest cells of a product of two codebooks; list_no = code of the first part *
    codes of the second + code of the second. A best cell has both its codes among the nprobe nearest, so only those meet."""
    width = books.where("sub = 1").count()
    near = []
    for sub in (0, 1):
        centers = books.where(F.col("sub") == sub).select(F.col("code").cast("long").alias("vec_id"), F.col("center").alias("embedding"))
        part = queries.select("q_id", F.slice(V.doubles(F.col("embedding")), sub * F.size("embedding") / 2 + 1, F.size("embedding") / 2).alias("embedding"))
        near.append(search.knn(part, centers, nprobe).select("q_id", F.col("vec_id").alias(f"c{sub}"), F.col("score").alias(f"s{sub}")))
    cells = near[0].join(near[1], "q_id").select("q_id", (F.col("c0") * width + F.col("c1")).alias("vec_id"), (F.col("s0") + F.col("s1")).alias("score"))
    return search.ranked(cells, nprobe).select("q_id", F.col("vec_id").alias("list_no"), "score", F.col("rank").alias("probe_rank"))


@dataclass(frozen=True)
class Rotated:
    """rotation (d x d, y = rotation @ x), codebooks of the rotated vectors, and the squared error of all rows by round."""

    rotation: np.ndarray
    books: DataFrame
    errors: list[float]


def opq(rows: DataFrame, parts: int, dim: int, codes: int = 256, rounds: int = 10, seed: int = 9) -> Rotated:
    """A rotation that makes product codes of the vectors lose less, and its codebooks.

    It starts from plain product quantisation and alternates: centres become the means of the parts coded with them, then
    the rotation becomes the one that brings vectors nearest to what their codes stand for (orthogonal Procrustes, from
    d x d cross products). Each half is one job over all rows that returns sums by task; the error never rises. Rows must
    be finite and at least `codes`; null vectors are left out.
    """
    width = dim // parts
    used = rows.where("embedding is not null")
    first = used.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(codes).collect()
    if len(first) < codes:
        raise ValueError(f"{len(first)} rows are fewer than {codes} codes")
    start = np.array([r.embedding for r in first], np.float64)
    books = start.reshape(codes, parts, width).transpose(1, 0, 2).copy()
    rotation, errors = np.eye(dim), []

    def job(wants_rotation: bool) -> np.ndarray:
        shared = rows.sparkSession.sparkContext.broadcast((rotation, books))

        def sums(batches):
            r, b = shared.value
            total, n, cross, error = np.zeros_like(b), np.zeros(b.shape[:2]), np.zeros((dim, dim)), 0.0
            for batch in (some.slice(lo, SLICE) for some in batches for lo in range(0, some.num_rows, SLICE)):
                x = search._matrix(batch.column("embedding"))
                y = x @ r.T
                decoded = np.empty_like(y)
                for sub in range(parts):
                    part = y[:, sub * width : (sub + 1) * width]
                    at = ((b[sub] ** 2).sum(1) - 2 * part @ b[sub].T).argmin(1)
                    decoded[:, sub * width : (sub + 1) * width] = b[sub][at]
                    n[sub] += np.bincount(at, minlength=codes)
                    total[sub] += np.stack([np.bincount(at, weights=c, minlength=codes) for c in part.T], axis=1)
                error += ((y - decoded) ** 2).sum()
                if wants_rotation:
                    cross += decoded.T @ x
            flat = np.concatenate([[error], cross.ravel()] if wants_rotation else [[error], n.ravel(), total.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "x"])

        parts_ = used.select("embedding").mapInArrow(sums, "i long, x double")
        held = parts_.groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toPandas()["x"].to_numpy()  # d * d, or d * codes, numbers
        shared.unpersist()
        errors.append(float(held[0]))
        return held[1:]

    for _ in range(rounds):
        flat = job(False)
        n, total = flat[: parts * codes].reshape(parts, codes), flat[parts * codes :].reshape(parts, codes, width)
        books = np.where(n[:, :, None] > 0, total / np.maximum(n, 1)[:, :, None], books)
        u, _, v = np.linalg.svd(job(True).reshape(dim, dim))
        rotation = u @ v
    flat = [(sub, code, books[sub, code].tolist()) for sub in range(parts) for code in range(codes)]
    return Rotated(rotation, rows.sparkSession.createDataFrame(flat, "sub int, code int, center array<double>"), errors)


def rotated(rows: DataFrame, rotation: np.ndarray) -> DataFrame:
    """The rows with rotated vectors."""
    shared = rows.sparkSession.sparkContext.broadcast(rotation)
    names = rows.columns

    def run(batches):
        for batch in batches:
            y = search._matrix(batch.column("embedding")) @ shared.value.T if batch.num_rows else np.zeros((0, len(shared.value)))
            ends = pa.array(np.arange(len(y) + 1, dtype=np.int32) * len(shared.value))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(y.ravel())) if n == "embedding" else batch.column(n) for n in names], names)

    schema = ", ".join(f"`{f.name}` {'array<double>' if f.name == 'embedding' else f.dataType.simpleString()}" for f in rows.schema)
    return rows.where("embedding is not null").mapInArrow(run, schema)


def polysemous(books: DataFrame, steps: int = 20_000, seed: int = 3) -> DataFrame:
    """The same centres under new codes, such that codes of near centres differ in few bits: for each part, numbers are
    swapped at random, and a swap stays if it brings the Hamming distances of codes closer to the (scaled) distances of
    centres, near ones counting most; at first also if it does not. Each part has a power of two of codes."""
    out = []
    for sub, c in enumerate(_books(books)):
        k = len(c)
        if k & (k - 1):
            raise ValueError(f"{k} codes are no power of two")
        rng = np.random.default_rng(seed + sub)
        bits = np.bitwise_count(np.arange(k)[:, None] ^ np.arange(k)).astype(float)
        d = np.sqrt(np.maximum(((c[:, None] - c) ** 2).sum(2), 0))
        off = ~np.eye(k, dtype=bool)
        spread = d[off].std() or 1.0
        target = (d - d[off].mean()) / spread * bits[off].std() + bits[off].mean() if k > 1 else d
        weight = np.exp(-0.5 * np.maximum(target, 0)) * off
        number = np.arange(k)  # code of each centre

        def loss_of(rows, number):
            return 2 * (weight[rows] * (bits[number[rows]][:, number] - target[rows]) ** 2).sum()

        heat = loss_of(np.arange(k), number) / max(1, k) / 10
        for step in range(steps if k > 2 else 0):
            pair = rng.choice(k, 2, replace=False)
            before = loss_of(pair, number)
            number[pair] = number[pair[::-1]]
            worse = loss_of(pair, number) - before
            if worse > 0 and rng.random() >= np.exp(-worse / max(heat, 1e-300)):
                number[pair] = number[pair[::-1]]
            heat *= 0.9995
        out += [(sub, int(number[i]), c[i].tolist()) for i in range(k)]
    return books.sparkSession.createDataFrame(out, "sub int, code int, center array<double>")


def _polysemous(queries: DataFrame, coded: DataFrame, books: DataFrame, most_bits: int, k: int) -> DataFrame:
    """(q_id, vec_id, score): the k best of each query and task over rows (vec_id, code) whose codes differ in at most `most_bits` bits
    from the query's own; for k = 0 rows with their number as vec_id. A task holds the k best and looks at 64 queries and
    `SLICE` rows at a time."""
    sizes = [len(b) for b in _books(books)]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    asked = tables(encode(queries.select("q_id", "embedding"), books), books)
    blocks = max(1, -(-queries.count() * sum(sizes) * 8 // search.BROADCAST_BYTES))
    found = []
    for block in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == block).toArrow().combine_chunks()
        if not held.num_rows:
            continue
        shared = queries.sparkSession.sparkContext.broadcast((held.column("q_id").to_numpy(), search._matrix(held.column("embedding").combine_chunks()), search._matrix(held.column("code").combine_chunks()).astype(np.int64)))

        def run(batches, shared=shared):
            ids, table, own = shared.value
            best, passed = search._Best(ids, table, "l2", k, None, 3.0) if k else None, 0
            for batch in (some.slice(lo, SLICE) for some in batches for lo in range(0, some.num_rows, SLICE)):
                codes, vec = search._matrix(batch.column("code")).astype(np.int64), batch.column("vec_id").to_numpy()
                for lo in range(0, len(ids), 64):
                    differ = np.zeros((len(ids[lo : lo + 64]), len(codes)), np.int32)
                    for sub in range(codes.shape[1]):
                        differ += np.bitwise_count(own[lo : lo + 64, sub, None] ^ codes[:, sub])
                    i, j = np.nonzero(differ <= most_bits)
                    passed += len(i)
                    if best:
                        score = table[(lo + i)[:, None], codes[j] + starts].sum(1)
                        near = score <= best._worst(lo + i)
                        best._keep(lo + i[near], vec[j[near]], score[near])
            yield from search._batches(best.rest() if best else [(np.zeros(1, np.int64), np.array([passed]), np.zeros(1))])

        found.append(coded.select("vec_id", "code").mapInArrow(run, search.RESULT))
    return reduce(lambda a, b: a.unionByName(b), found) if found else queries.sparkSession.createDataFrame([], search.RESULT)


def polysemous_knn(queries: DataFrame, coded: DataFrame, books: DataFrame, k: int, most_bits: int) -> DataFrame:
    """(q_id, vec_id, score, rank): like knn, but distances are looked up only for rows whose codes differ in at most
    `most_bits` bits from the query's own; `books` come from polysemous(), `coded` was encoded with them. Queries go to every
    task in blocks of at most `BROADCAST_BYTES` of tables."""
    return search.ranked(_polysemous(queries, coded, books, most_bits, k), k)


def polysemous_rate(queries: DataFrame, coded: DataFrame, books: DataFrame, most_bits: int) -> float:
    """The share of pairs of query and row that get past the bits."""
    passed = _polysemous(queries, coded, books, most_bits, 0).agg(F.coalesce(F.sum("vec_id"), F.lit(0))).first()[0]
    return passed / max(1, queries.where("embedding is not null").count() * coded.count())

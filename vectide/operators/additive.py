"""Additive codes: a vector is a sum of whole centres, one of each codebook. Codebooks are tables (sub, code, center) as in
quantizers.py, all of one size here; codes are found by beam search or by local search, codebooks by least squares.

Vectors that are null or hold null or non-finite components get no code. Books have at most `MOST_CENTERS` centres together:
every task holds the products of all pairs of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions import vectors as V
from vectide.operators import clustering, quantizers, search
from vectide.sources import written

MOST_CENTERS = 4096
BLOCK = 512  # vectors that are coded at once


def as_table(spark, books: np.ndarray) -> DataFrame:
    flat = [(sub, code, c.tolist()) for sub, book in enumerate(books) for code, c in enumerate(book)]
    return spark.createDataFrame(flat, "sub int, code int, center array<double>")


def _books(books: DataFrame) -> np.ndarray:
    held = quantizers._books(books)
    if len({b.shape for b in held}) > 1:
        raise ValueError("books differ in size")
    if sum(map(len, held)) > MOST_CENTERS:
        raise ValueError(f"{sum(map(len, held))} centres are more than {MOST_CENTERS}")
    return np.array(held)


def _usable(rows: DataFrame) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)))


def _beam(x: np.ndarray, books: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared errors; equal errors go to the smaller codes of the better beginning."""
    n, size = len(x), books.shape[1]
    left, codes = x[:, None, :], np.zeros((n, 1, 0), np.int64)
    for c in books:
        d = ((left**2).sum(2)[:, :, None] - 2 * left @ c.T + (c**2).sum(1)).reshape(n, -1)
        keep = min(beam, d.shape[1])
        found = np.sort(np.argpartition(d, keep - 1, axis=1)[:, :keep], axis=1)
        found = np.take_along_axis(found, np.argsort(np.take_along_axis(d, found, 1), axis=1, kind="stable"), 1)
        begin, code = found // size, found % size
        left = np.take_along_axis(left, begin[:, :, None], 1) - c[code]
        codes = np.concatenate([np.take_along_axis(codes, begin[:, :, None], 1), code[:, :, None]], axis=2)
    return codes[:, 0], (left[:, 0] ** 2).sum(1)


def _sums(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[sub][codes[:, sub]] for sub in range(len(books)))


def _drawn(ids: np.ndarray, *salt: int) -> np.ndarray:
    """64 random bits an id, the same whichever task asks (the finaliser of splitmix64)."""
    z = ids.astype(np.uint64)
    for s in salt:
        z = z + np.uint64((s + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return z


def _searched(x, ids, codes, books, cross, tries: int, changes: int, sweeps: int, seed: int):
    """Iterated local search: change some codes at random, then take the best code of one book after another until nothing
    moves; a result stays where its error is smaller."""
    n, (parts, size, dim) = len(x), books.shape
    flat = books.reshape(-1, dim)
    own = ((flat**2).sum(1) - 2 * x @ flat.T).reshape(n, parts, size)
    best, error, every = codes.copy(), ((x - _sums(codes, books)) ** 2).sum(1), np.arange(n)
    for t in range(tries):
        now = best.copy()
        for j in range(changes if t else 0):  # the first try settles what is there
            z = _drawn(ids, seed, t, j)
            now[every, (z % np.uint64(parts)).astype(np.int64)] = ((z >> np.uint64(32)) % np.uint64(size)).astype(np.int64)
        for _ in range(sweeps):
            before = now.copy()
            for sub in range(parts):
                score = own[:, sub].copy()
                for other in range(parts):
                    if other != sub:
                        score += cross[other, now[:, other], sub]
                now[:, sub] = score.argmin(1)
            if (before == now).all():
                break
        told = ((x - _sums(now, books)) ** 2).sum(1)
        better = told < error
        best[better], error[better] = now[better], told[better]
    return best, error


def _coded(rows: DataFrame, how) -> DataFrame:
    """The rows with codes and error from how(matrix, ids, codes known so far or None), block by block."""
    names = [n for n in rows.columns if n not in ("codes", "error")]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = search._matrix(batch.column("embedding")), batch.column("vec_id").fill_null(0).to_numpy()
            known = search._matrix(batch.column("codes")).astype(np.int64) if "codes" in batch.schema.names else None
            parts = [how(x[i : i + BLOCK], ids[i : i + BLOCK], None if known is None else known[i : i + BLOCK]) for i in range(0, len(x), BLOCK)]
            codes, error = np.concatenate([c for c, _ in parts]).astype(np.int32), np.concatenate([e for _, e in parts])
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * codes.shape[1])
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.ListArray.from_arrays(ends, pa.array(codes.ravel())), pa.array(error)], [*names, "codes", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    return rows.mapInArrow(run, f"{schema}, codes array<int>, error double")


def beam_codes(rows: DataFrame, books: DataFrame, beam: int = 8) -> DataFrame:
    """Rows (vec_id, embedding, ...) with codes (array<int>, one a book) and error (squared). The `beam` best beginnings go on to
    the next book; 1 is the greedy coder, and with two books the whole first one finds the best pair."""
    shared = rows.sparkSession.sparkContext.broadcast(_books(books))
    return _coded(_usable(rows.drop("codes", "error")), lambda x, ids, known: _beam(x, shared.value, beam))


def local_search_codes(coded: DataFrame, books: DataFrame, tries: int = 8, changes: int = 2, sweeps: int = 4, seed: int = 5) -> DataFrame:
    """Rows that have codes (of any origin, as many as books) with codes whose error is at most as large. What is drawn depends on
    vec_id alone, so that a task that runs again finds the same."""
    held = _books(books)
    flat = held.reshape(-1, held.shape[2])
    shared = coded.sparkSession.sparkContext.broadcast((held, (2 * flat @ flat.T).reshape(*held.shape[:2], *held.shape[:2])))
    return _coded(coded, lambda x, ids, known: _searched(x, ids, known, *shared.value, tries, changes, sweeps, seed))


def refit(coded: DataFrame, books: DataFrame, ridge: float = 1e-6) -> DataFrame:
    """The centres with the least error for given codes. Tasks return how often centres meet and the sums of vectors by centre,
    which do not grow with the rows; the step from the old centres is solved for with a small penalty, so the error never
    rises and centres that no row has stay."""
    held = _books(books)
    parts, size, dim = held.shape
    centers = parts * size

    def sums(batches):
        meet, total, seen = np.zeros(centers * centers), np.zeros((centers, dim)), False
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = True
            x, at = search._matrix(batch.column("embedding")), search._matrix(batch.column("codes")).astype(np.int64) + np.arange(parts) * size
            for a in range(parts):
                for c in range(dim):
                    total[:, c] += np.bincount(at[:, a], weights=x[:, c], minlength=centers)
                for b in range(a, parts):
                    pair, n = np.unique(at[:, a] * centers + at[:, b], return_counts=True)
                    meet[pair] += n
        if seen:
            flat = np.concatenate([meet, total.ravel()])
            kept = np.nonzero(flat)[0]
            yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(flat[kept])], ["i", "x"])

    added = coded.select("embedding", "codes").mapInArrow(sums, "i long, x double").groupBy("i").agg(F.sum("x").alias("x"))
    told, flat = added.toPandas(), np.zeros(centers * (centers + dim))  # a number a pair of centres that meet, and dim a centre
    flat[told["i"].to_numpy()] = told["x"].to_numpy()
    meet, total = flat[: centers * centers].reshape(centers, centers), flat[centers * centers :].reshape(centers, dim)
    meet = meet + np.triu(meet, 1).T
    old = held.reshape(centers, dim)
    step = np.linalg.solve(meet + ridge * max(1.0, meet.diagonal().mean()) * np.eye(centers), total - meet @ old)
    return as_table(coded.sparkSession, (old + step).reshape(held.shape))


def train(rows: DataFrame, parts: int, codes: int = 256, rounds: int = 10, beam: int = 8) -> DataFrame:
    """Books of k-means centres, each of what the beam's best codes of the books before leave of all rows."""
    used, left, held = _usable(rows.select("vec_id", "embedding")), None, []
    for sub in range(parts):
        if held:
            shared = rows.sparkSession.sparkContext.broadcast(np.array(held))
            left = decoded(_coded(used, lambda x, ids, known, shared=shared: _beam(x, shared.value, beam)), as_table(rows.sparkSession, np.array(held)))
            left = left.select("vec_id", V.subtract(F.col("embedding"), F.col("decoded")).alias("embedding"))
        c, _ = clustering.kmeans(used if left is None else left, codes, rounds, seed=1234 + sub, per_cluster=None)
        held.append(c)
    return as_table(rows.sparkSession, np.array(held))


@dataclass(frozen=True)
class Trained:
    """Books, the rows (vec_id, embedding, codes, error) in the end, and the error of all rows by round: first the beam's."""

    books: DataFrame
    coded: DataFrame
    errors: list[float]


def train_local(rows: DataFrame, parts: int, codes: int = 256, rounds: int = 5, beam: int = 8, tries: int = 8, changes: int = 2) -> Trained:
    """Books and codes by turns: least squares for the books, local search for the codes, from beam codes on. The error never
    rises. Each round reads the codes that the one before wrote and then drops them."""
    spark = rows.sparkSession
    books = train(rows, parts, codes, beam=beam)
    made, at, errors = beam_codes(rows.select("vec_id", "embedding"), books, beam), None, []
    for turn in range(rounds + 1):
        if turn:
            books = refit(coded, books)
            made = local_search_codes(coded, books, tries, changes, seed=turn)
        before, at = at, written.new_folder(spark, "additive")
        made.write.parquet(at)
        coded = spark.read.schema(made.schema).parquet(at)
        errors.append(float(coded.agg(F.coalesce(F.sum("error"), F.lit(0.0))).first()[0]))
        if before:
            written.removed(spark, before)
    return Trained(books, coded, errors)


def decoded(coded: DataFrame, books: DataFrame) -> DataFrame:
    """Adds decoded: the sum of a row's centres."""
    shared = coded.sparkSession.sparkContext.broadcast(_books(books))
    names = [n for n in coded.columns if n != "decoded"]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                y = _sums(search._matrix(batch.column("codes")).astype(np.int64), shared.value)
                ends = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1])
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], [*names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema if f.name in names)
    return coded.mapInArrow(run, f"{schema}, decoded array<double>")


@dataclass(frozen=True)
class Norms:
    """Squared lengths of decoded rows as two digits of as many levels as a book has codes: low + step * (number + 1/2)."""

    low: float
    step: float


def with_norms(coded: DataFrame, books: DataFrame) -> tuple[DataFrame, Norms]:
    """(vec_id, codes) with two more codes, the digits of the length; and what they mean. Distances are off by at most half a step."""
    levels = _books(books).shape[1] ** 2
    lengths = decoded(coded.select("vec_id", "codes"), books).select("vec_id", "codes", V.squared_norm(F.col("decoded")).alias("s"))
    low, high = lengths.agg(F.coalesce(F.min("s"), F.lit(0.0)), F.coalesce(F.max("s"), F.lit(0.0))).first()
    step, base = (high - low) / levels or 1.0, int(levels**0.5 + 0.5)
    number = F.least(F.floor((F.col("s") - low) / step), F.lit(levels - 1)).cast("int")
    digits = F.array(F.floor(number / base).cast("int"), F.pmod(number, F.lit(base)).cast("int"))
    return lengths.select("vec_id", F.concat("codes", digits).alias("codes")), Norms(low, step)


def knn(queries: DataFrame, numbered: DataFrame, books: DataFrame, norms: Norms, k: int) -> DataFrame:
    """(q_id, vec_id, score, rank): the k smallest squared distances of the queries to rows of with_norms(), by tables: a query has
    its product with every centre and the lengths that the digits stand for, a row costs a look-up a book and two. Queries
    without an id are left out."""
    shared = queries.sparkSession.sparkContext.broadcast(_books(books))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            c, x = shared.value, search._matrix(batch.column("embedding"))
            size = c.shape[1]
            upper = norms.low + norms.step * size * np.arange(size) + (x**2).sum(1)[:, None]
            lower = np.broadcast_to(norms.step * (np.arange(size) + 0.5), (len(x), size))
            flat = np.concatenate([-2 * x @ c.reshape(-1, c.shape[2]).T, upper, lower], axis=1)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * flat.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("q_id"), pa.ListArray.from_arrays(ends, pa.array(flat.ravel()))], ["q_id", "embedding"])

    asked = _usable(queries.where("q_id is not null").select("q_id", "embedding")).mapInArrow(run, "q_id long, embedding array<double>")
    return search.knn(asked, numbered.select("vec_id", V.doubles(F.col("codes")).alias("embedding")), k, "lut")

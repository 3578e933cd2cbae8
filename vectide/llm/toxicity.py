"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from vectide.llm.common import flat_text, hash_sample, materialize, small_batches, text_slices

BUCKETS = 1 << 20
SIZES = (3, 4, 5, 6)


class Model(NamedTuple):
    """A weight for each bucket, an intercept, and the n-gram sizes they belong to."""

    weights: np.ndarray
    intercept: float
    sizes: tuple[int, ...]

    def log_odds(self, text: pa.Array) -> np.ndarray:
        """Of whole texts; n-grams count once a text, null texts are empty."""
        buckets = len(self.weights)
        found = [np.zeros(0, np.int64)]
        for row, bucket in gram_buckets(text, self.sizes, buckets):
            keep = (self.weights != 0)[bucket]
            found.append(np.unique(row[keep] * buckets + bucket[keep]))
        key = np.unique(np.concatenate(found))
        return np.bincount(key // buckets, weights=self.weights[key % buckets], minlength=len(text)) + self.intercept


def gram_buckets(text: pa.Array, sizes=SIZES, buckets: int = BUCKETS, chunk: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, buckets) of every n-gram of code points of whole texts, lower-cased, a blank before and after each; `chunk`
    places of one size at a time, so that memory does not follow the length of a text."""
    data, offsets = flat_text(pc.utf8_lower(pc.fill_null(text, "")))
    first = (data & 0xC0) != 0x80  # first byte of each character
    points = data
    if not first.all():
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum(first)])[offsets]
    n = len(offsets) - 1
    stream = np.full(len(points) + 2 * n, 32, np.uint32)
    stream[np.arange(len(points)) + np.repeat(2 * np.arange(n) + 1, np.diff(offsets))] = np.where((points >= 9) & (points <= 13), 32, points)
    bounds = offsets + 2 * np.arange(n + 1)
    for lo in range(0, len(stream), chunk):
        wide = stream[lo : lo + chunk + max(sizes) - 1].astype(np.uint64)
        row = np.searchsorted(bounds, np.arange(lo, lo + len(wide)), side="right") - 1
        code = wide
        for size in range(2, max(sizes) + 1):
            code = code[:-1] * np.uint64(0x9E3779B97F4A7C15) + wide[size - 1 :]
            if size in sizes:
                begin, end = row[: len(code)][:chunk], row[size - 1 :][:chunk]
                mixed = (code[:chunk] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - buckets.bit_length() + 1)
                inside = begin == end
                yield begin[inside], mixed.astype(np.int64)[inside]


def _distinct(part: pa.RecordBatch, sizes: tuple[int, ...], buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its distinct buckets) of each text."""
    seen, place = np.full(buckets, -1, np.int32), np.zeros(buckets, np.int32)
    for i in range(part.num_rows):
        found = [np.zeros(0, np.int64)]
        for _, bucket in gram_buckets(part.column("text").slice(i, 1), sizes, buckets):
            bucket = bucket[seen[bucket] != i]
            at = np.arange(len(bucket), dtype=np.int32)
            place[bucket] = at  # the last of equal buckets stands for them
            bucket = bucket[place[bucket] == at]
            seen[bucket] = i
            found.append(bucket)
        yield i, np.concatenate(found)


def fit(labelled: DataFrame, features: int = 12_000, buckets: int = BUCKETS, alpha: float = 1.0, regularization: float = 0.01, sizes: tuple[int, ...] = SIZES, tasks: int = 24) -> Model:
    """A model from all rows (text, label 0/1) of `labelled`; training_rows draws a bounded sample of them.

    An n-gram counts once a document. Its log-count ratio is r = log((p + alpha) / |p|) - log((q + alpha) / |q|) with p
    and q its numbers of toxic and other documents; of those in three documents or more the `features` n-grams that tell
    most (ratio by the square root of the count) are scaled by r and weighed by logistic regression in which both labels
    weigh the same. Rows without text or label are left out. Without rows of both labels there are no weights and the
    intercept leans to the one label seen; with no labels at all nothing counts as toxic.
    """
    usable = labelled.where("text is not null and label is not null").select("text", F.col("label").cast("double").alias("label"))
    train = materialize(usable.repartition(tasks), "toxic-train")
    seen = {r.label: r.n for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weights = np.zeros(buckets, np.float32)
    if len(seen) < 2:
        return Model(weights, 5.0 if 1.0 in seen else -5.0, sizes)
    size = 4096

    def count(batches):
        both = np.zeros((2, buckets), np.int32)
        for part in text_slices(batches, 1 << 20):
            label = (part.column("label").to_numpy() > 0.5).astype(int)
            for i, bucket in _distinct(part, sizes, buckets):
                both[label[i], bucket] += 1
        if both.any():
            ends = pa.array(np.arange(0, buckets + 1, size, dtype=np.int32))
            other, toxic = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in both)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets // size)), toxic, other], ["block", "toxic", "other"])

    yes, no = seen[1.0], seen[0.0]

    def ratios(table: pa.Table) -> pa.Table:  # one block of buckets, a row from each task of count
        p, q = (table.column(c).combine_chunks().flatten().to_numpy().reshape(-1, size).sum(0) for c in ("toxic", "other"))
        r = np.log((p + alpha) / yes) - np.log((q + alpha) / no)
        at = np.flatnonzero(p + q >= 3)
        bucket = table.column("block")[0].as_py() * size + at
        return pa.table({"bucket": bucket, "ratio": r[at], "told": np.abs(r[at]) * np.sqrt((p + q)[at])})

    parts = train.mapInArrow(count, "block long, toxic array<int>, other array<int>")
    told = parts.groupBy("block").applyInArrow(ratios, "bucket long, ratio double, told double")
    top = told.orderBy(F.desc("told"), "bucket").limit(features).select("bucket", "ratio").toPandas()
    width = len(top)
    if not width:
        return Model(weights, float(np.log(yes / no)), sizes)
    number = np.full(buckets, -1, np.int32)
    number[top["bucket"]] = np.arange(width)
    shared = train.sparkSession.sparkContext.broadcast((number, top["ratio"].to_numpy()))
    even = {label: (yes + no) / (2 * n) for label, n in seen.items()}  # both labels weigh the same

    def vectors(batches):
        number, ratio = shared.value
        for part in text_slices(batches, 1 << 20):
            found = [np.sort(number[bucket][number[bucket] >= 0]) for _, bucket in _distinct(part, sizes, buckets)]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32))
            at = np.concatenate(found)
            n = len(found)
            sparse = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, width, np.int32)), pa.ListArray.from_arrays(ends, pa.array(at)), pa.ListArray.from_arrays(ends, pa.array(ratio[at]))]
            weight = pc.if_else(pc.greater(part.column("label"), 0.5), even[1.0], even[0.0])
            yield pa.RecordBatch.from_arrays([part.column("label"), weight, pa.StructArray.from_arrays(sparse, ["type", "size", "indices", "values"])], ["label", "weight", "features"])

    kind = "label double, weight double, features struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"
    read = StructType([StructField("label", DoubleType()), StructField("weight", DoubleType()), StructField("features", VectorUDT())])
    ready = materialize(train.mapInArrow(vectors, kind), "toxic-vectors", read)  # the layout in which Spark keeps sparse vectors
    model = LogisticRegression(maxIter=60, regParam=regularization, standardization=False, weightCol="weight").fit(ready)
    weights[top["bucket"]] = model.coefficients.toArray() * top["ratio"].to_numpy()
    return Model(weights, float(model.intercept), sizes)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): probability of toxic for every whole text; null texts count as empty. The weights that are
    broadcast have a fixed size (4 MB at 2^20 buckets)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in text_slices(batches, 1 << 20):
            odds = np.clip(shared.value.log_odds(part.column("text")), -500, 500)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(1 / (1 + np.exp(-odds)))], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo `folds`; null ids are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def training_rows(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, most: int = 12_000) -> DataFrame:
    """(text, label) of at most `most` labelled documents outside the held-out fold, half of each label where there are
    enough, chosen by hash of their id. An id with labels of both kinds counts as toxic; of rows that share an id the
    smallest text counts. Null ids, texts and labels take no part. Texts move only where they were chosen."""
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("label")).where(fold("doc_id", folds) != held_out)
    known = materialize(known.join(docs.where("text is not null").select("doc_id"), "doc_id", "left_semi"), "toxic-labels")
    parts = [hash_sample(known.where(F.col("label") == v), ["doc_id"], most // 2) for v in (1, 0)]
    chosen = F.broadcast(parts[0].union(parts[1]))  # at most `most` short rows
    return docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).select("text", "label")


def judge(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`, learnt from labels outside the held-out fold."""
    scored = score(docs, fit(training_rows(docs, labels, folds, held_out)))
    return scored.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` that score below 0.5, with all their columns; one pass, no join. Null texts count as empty,
    repeated rows stay or go together, an empty table stays empty."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in text_slices(batches, 1 << 20):
            yield part.filter(pa.array(shared.value.log_odds(part.column("text")) < 0))

    return docs.mapInArrow(run, docs.schema)

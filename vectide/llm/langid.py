"""Language identification by nearest centroids of TF-IDF character n-grams."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm.common import flat_text, materialize, text_slices
from vectide.llm.toxicity import fold

BUCKETS = 4096
SIZES = (1, 2, 3)
UNKNOWN = "und"


class Centroids(NamedTuple):
    """idf by bucket; one unit centroid a row; the language of each; the similarity below which a text is rejected."""

    idf: np.ndarray
    centers: np.ndarray
    languages: list[str]
    floor: float


def gram_counts(column: pa.Array, buckets: int = BUCKETS, sizes=SIZES) -> np.ndarray:
    """Rows of counts of hashed n-grams of whole texts, letters folded to lower case, every other run to one mark."""
    folded = pc.utf8_lower(pc.fill_null(column, ""))
    data, offsets = flat_text(folded)
    n = len(column)
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    symbol = np.where(letter, data, 32)
    keep = np.ones(len(symbol), bool)
    keep[1:] = letter[1:] | letter[:-1] | (row[1:] != row[:-1])
    symbol, row = symbol[keep].astype(np.uint32), row[keep]
    total = np.zeros(n * buckets)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    code = symbol
    for size in range(1, max(sizes) + 1):
        if size > 1:
            code = code[:-1] * np.uint32(257) + symbol[size - 1 :]
        if size in sizes and len(code):
            last = row[size - 1 :]
            inside = row[: len(code)] == last
            at = ((code + np.uint32(size)) * np.uint32(2654435761)) >> shift
            total += np.bincount((last * buckets + at)[inside], minlength=n * buckets)
    return total.reshape(n, buckets)


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit rows of (1 + log count) * idf; rows without n-grams stay zero."""
    x = np.log1p(counts, dtype=np.float32) * idf.astype(np.float32)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=x, where=norm > 0)


def _slices(batches, rows: int = 256):
    for part in text_slices(batches, 1 << 20):
        for lo in range(0, part.num_rows, rows):
            yield part.slice(lo, rows)


def train(docs: DataFrame, per_language: int = 400, clusters: int = 3, reject: float = 0.01, buckets: int = BUCKETS) -> Centroids:
    """Centroids from rows (text, lang); rows without text or language are left out.

    Document frequencies cover all rows. The centroids of a language come from k-means (cosine) on
    `per_language` of its distinct texts, chosen by hash, or all if they are fewer, inside one task a language. A text is rejected if its best cosine lies
    below the `reject` quantile of the training sample's. No rows give no centroids.
    """
    usable = docs.where("text is not null and lang is not null").select("text", "lang")

    def frequencies(batches):
        total, n = np.zeros(buckets, np.int64), 0
        for part in _slices(batches):
            counts = gram_counts(part.column("text"), buckets)
            total += (counts > 0).sum(0)
            n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, buckets)), pa.array(np.concatenate([[n], total]))], ["bucket", "n"])

    counted = usable.mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # buckets + 1 rows
    seen = dict(zip(counted["bucket"].tolist(), counted["n"].tolist()))
    if not seen.get(-1):
        return Centroids(np.zeros(buckets), np.zeros((0, buckets), np.float32), [], 0.0)
    idf = np.log((1 + seen[-1]) / (1 + np.array([seen.get(b, 0) for b in range(buckets)]))) + 1

    # the smallest hashes of each language's distinct texts, first by salt, so that no task has to order a whole language
    hashed = usable.withColumn("hash", F.xxhash64(F.lit(17), "text")).withColumn("at", F.pmod("hash", F.lit(1 << 30)))
    distinct = hashed.select("lang", "hash", "at").distinct().withColumn("salt", F.pmod(F.xxhash64("hash"), F.lit(64)))
    for by in (["lang", "salt"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("at", "hash"))
        distinct = distinct.withColumn("rank", rank).where(F.col("rank") <= per_language).drop("rank")
    chosen = materialize(distinct.select("lang", "hash"), "language-hashes")  # per_language rows a language
    sample = hashed.join(F.broadcast(chosen), ["lang", "hash"]).dropDuplicates(["lang", "hash"])
    sample = materialize(sample.select("lang", "text", "at", "hash"), "language-sample")

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["at", "hash"])
        x = np.concatenate([tfidf(gram_counts(pa.array(frame["text"].iloc[i : i + 256]), buckets), idf) for i in range(0, len(frame), 256)])
        rng = np.random.default_rng(3)
        k = min(clusters, len(x))
        c = x[rng.choice(len(x), k, replace=False)].copy()
        for _ in range(8):
            cell = (x @ c.T).argmax(1)
            for j in range(k):
                if (cell == j).any():
                    c[j] = x[cell == j].mean(0)
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        best = (x @ c.T).max(1)
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]] * k, "center": [row.tolist() for row in c], "low": float(np.quantile(best, reject))})

    found = sample.groupBy("lang").applyInPandas(cluster, "lang string, center array<float>, low double").orderBy("lang").collect()  # clusters rows a language
    return Centroids(idf, np.array([r.center for r in found], np.float32), [r.lang for r in found], min(r.low for r in found))


def identify(docs: DataFrame, model: Centroids, rejecting: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every whole text.

    score is the cosine with the nearest centroid, in 0..1; `rejected` tells that it lies below the model's floor, and
    with `rejecting` such a text is `und`. Null texts and texts without a letter are always `und` with score 0. Repeated
    rows and null ids give a row each. The model has a fixed size for a set of languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], object)
        for part in _slices(batches):
            text = part.column("text")
            has_letter = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if len(m.languages):
                cosine = tfidf(gram_counts(text, len(m.idf)), m.idf) @ m.centers.T
                best = cosine.argmax(1)
                score = np.clip(cosine[np.arange(len(best)), best].astype(float), 0, 1)
            else:
                best, score = np.full(len(text), -1), np.zeros(len(text))
            rejected = score < m.floor
            unknown = ~has_letter | (best < 0) | (rejected & rejecting)
            score[~has_letter] = 0
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(names[np.where(unknown, -1, best)], pa.string()), pa.array(score), pa.array(rejected | ~has_letter)], ["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def judge(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected), learnt from documents outside the held-out fold. Here the nearest
    language is told even where the distance would reject it; `rejected` keeps that finding."""
    model = train(docs.where(fold("doc_id", folds) != held_out))
    told = identify(docs, model, rejecting=False)
    return told.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "lang_pred", "score", "rejected")

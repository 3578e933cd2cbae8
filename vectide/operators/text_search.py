"""BM25 without a row for each query and document: documents are scored where their words are together, all queries at once,
and k rows a query and task come out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.functions import text as T
from vectide.operators.search import NOBODY

#: Documents times queries that a task scores at a time, and sums that it makes at a time.
CELLS, SUMS = 1 << 21, 1 << 20


def _asked(queries: DataFrame) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Query ids, asked words, and the queries of word i: places of ids, between two starts. Queries are held by every task."""
    told = queries.select("q_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("term")).distinct().toArrow()
    ids, place = np.unique(told.column("q_id").to_numpy(), return_inverse=True)
    coded = told.column("term").combine_chunks().dictionary_encode()
    terms, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    return ids, terms, place[order], np.searchsorted(code[order], np.arange(len(terms) + 1))


class _Top:
    """The k best documents of each query: by score to nine digits, then by id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score, self.found = np.full((queries, k), -np.inf), np.full((queries, k), NOBODY)

    def see(self, ids: np.ndarray, doc: np.ndarray, word: np.ndarray, weight: np.ndarray, askers: np.ndarray, starts: np.ndarray):
        """Weights of words in documents; doc counts from 0, in order."""
        n = len(self.score)
        step = max(1, CELLS // max(1, n))
        for lo in range(0, len(ids), step):
            a, b = np.searchsorted(doc, [lo, lo + step])
            cells = np.zeros(min(step, len(ids) - lo) * n)
            many = np.cumsum(starts[word[a:b] + 1] - starts[word[a:b]])
            cuts = np.searchsorted(many, np.arange(SUMS, many[-1] if len(many) else 0, SUMS)) if len(many) else []
            for part in np.split(np.arange(a, b), cuts):
                count = starts[word[part] + 1] - starts[word[part]]
                if not count.sum():
                    continue
                at = np.repeat(starts[word[part]] - np.cumsum(count) + count, count) + np.arange(count.sum())
                cells += np.bincount(np.repeat(doc[part] - lo, count) * n + askers[at], np.repeat(weight[part], count), len(cells))
            near = np.where(cells > 0, np.floor(cells * 1e9 + 0.5) / 1e9, -np.inf).reshape(-1, n)
            row, q = np.nonzero((cells.reshape(-1, n) > 0) & (near >= self.score[:, -1]))
            self._keep(q, ids[lo + row], near[row, q])

    def _keep(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray):
        if not len(q):
            return
        some = np.unique(q)
        at = np.concatenate([np.repeat(some, self.k), q])
        ids, score = np.concatenate([self.found[some].ravel(), ids]), np.concatenate([self.score[some].ravel(), score])
        order = np.lexsort((ids, -score, at))
        at, ids, score = at[order], ids[order], score[order]
        best = np.arange(len(at)) - np.searchsorted(at, at) < self.k
        self.found[some], self.score[some] = ids[best].reshape(-1, self.k), score[best].reshape(-1, self.k)

    def batch(self, ids: np.ndarray) -> pa.RecordBatch:
        i, j = np.nonzero(self.found != NOBODY)
        return pa.RecordBatch.from_arrays([pa.array(ids[i], pa.int64()), pa.array(self.found[i, j], pa.int64()), pa.array(self.score[i, j], pa.float64())], ["q_id", "id", "score"])


def _counted(words: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, word, tf) of the asked words in lists of words, in order."""
    doc = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    code = pc.fill_null(pc.index_in(words.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
    known = code >= 0
    key, tf = np.unique(doc[known] * len(terms) + code[known], return_counts=True)
    return key // len(terms), key % len(terms), tf


def repeat(docs: DataFrame, id_col: str) -> bool:
    """Whether an id comes twice. Only ids move."""
    return not docs.groupBy(id_col).count().where("count > 1").isEmpty()


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, id, tf, dl): as text.bm25_index, but where no id repeats a document's words are counted in its row, and nothing moves."""
    if repeat(docs, id_col):
        return T.bm25_index(docs, id_col, text_col)
    held = docs.select(F.col(id_col).alias("id"), T.words(F.col(text_col)).alias("w")).where(F.size("w") > 0)

    def count(batches):
        for batch in batches:
            if batch.num_rows:
                dl = pc.list_value_length(batch.column("w")).to_numpy(zero_copy_only=False)
                coded = batch.column("w").flatten().dictionary_encode()
                key, tf = np.unique(np.repeat(np.arange(len(dl)), dl) * len(coded.dictionary) + coded.indices.to_numpy(), return_counts=True)
                doc, code = np.divmod(key, len(coded.dictionary))
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code)), batch.column("id").take(pa.array(doc)), pa.array(tf, pa.int64()), pa.array(dl[doc].astype(np.int32))], ["term", "id", "tf", "dl"])

    return held.mapInArrow(count, f"term string, id {held.schema['id'].dataType.simpleString()}, tf long, dl int")


def _weights(idf: np.ndarray, tf: np.ndarray, dl: np.ndarray, avgdl: float, k1: float, b: float) -> np.ndarray:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def _idf(n: int, df: np.ndarray) -> np.ndarray:
    return np.log(1 + (n - df + 0.5) / (df + 0.5))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def find(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(q_id, id, score, rank): as text.bm25 over text.bm25_index(docs), from two passes over the documents and without postings:
    one counts in how many documents asked words are, one scores. Scores are told to nine digits. Ids that repeat take text.bm25."""
    if repeat(docs, id_col):
        return T.bm25(queries, T.bm25_index(docs, id_col, text_col), k, k1, b)
    ids, terms, askers, starts = _asked(queries)
    held = docs.select(F.col(id_col).cast("long").alias("id"), T.words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    context = docs.sparkSession.sparkContext
    asked = context.broadcast((ids, terms, askers, starts))

    def count(batches):
        terms = asked.value[1]
        df = np.zeros(len(terms) + 2, np.int64)  # of words, then documents and words of all documents
        for batch in batches:
            words = batch.column("w")
            if batch.num_rows:
                df[:-2] += np.bincount(_counted(words, terms)[1], minlength=len(terms))
                df[-2:] += batch.num_rows, len(words.flatten())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(df))), pa.array(df)], ["i", "n"])

    told = held.mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()  # a number an asked word
    df = np.zeros(len(terms) + 2)
    df[told.column("i").to_numpy()] = told.column("n").to_numpy()
    n, avgdl = df[-2], df[-1] / max(1, df[-2])
    idf = context.broadcast(_idf(n, df[:-2]))

    def score(batches):
        ids, terms, askers, starts = asked.value
        top = _Top(len(ids), k)
        for batch in batches:
            if batch.num_rows and len(ids):
                doc, word, tf = _counted(batch.column("w"), terms)
                dl = pc.list_value_length(batch.column("w")).to_numpy(zero_copy_only=False)
                top.see(batch.column("id").to_numpy(), doc, word, _weights(idf.value[word], tf, dl[doc], avgdl, k1, b), askers, starts)
        yield top.batch(ids)

    return _ranked(held.mapInArrow(score, "q_id long, id long, score double"), k)


def over_postings(queries: DataFrame, postings: DataFrame, k: int, sizes: DataFrame, known: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(q_id, id, score, rank): as text.bm25 over postings (term, id, tf, dl) of documents with the `sizes` and `known` word counts.
    Postings of asked words move once, to their document. Scores are told to nine digits."""
    ids, terms, askers, starts = _asked(queries)
    spark, (n, avgdl) = queries.sparkSession, sizes.select("n", "avgdl").first()
    numbered = spark.createDataFrame(pa.table({"term": terms.cast(pa.string()), "word": pa.array(np.arange(len(terms)), pa.int32())}))
    weighed = numbered.join(known, "term").select("term", "word", F.ln(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    moved = postings.join(F.broadcast(weighed), "term").select(F.col("id").cast("long").alias("id"), "word", "idf", "tf", "dl")  # a row an asked word
    dealt = moved.repartition("id").sortWithinPartitions("id", "word")
    asked = spark.sparkContext.broadcast((ids, askers, starts))

    def score(batches):
        ids, askers, starts = asked.value
        top, rest = _Top(len(ids), k), None

        def see(batch):
            docs, doc = np.unique(batch.column("id").to_numpy(), return_inverse=True)
            idf, tf, dl = (batch.column(c).to_numpy().astype(np.float64) for c in ("idf", "tf", "dl"))
            top.see(docs, doc, batch.column("word").to_numpy(), _weights(idf, tf, dl, avgdl, k1, b), askers, starts)

        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            at = batch.column("id").to_numpy()
            cut = int(np.searchsorted(at, at[-1]))
            if cut:
                see(batch.slice(0, cut))
            rest = batch.slice(cut)
        if rest is not None:
            see(rest)
        yield top.batch(ids)

    return _ranked(dealt.mapInArrow(score, "q_id long, id long, score double"), k)

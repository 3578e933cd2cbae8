"""Text functions: a deterministic hashing encoder, contents, prompts and BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits of ASCII."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def content(title: Column, text: Column, contents: Column | None = None) -> Column:
    """A document's content: `contents` where given, else title and text on two lines."""
    both = F.concat_ws("\n", title, text)
    return both if contents is None else F.coalesce(contents, both)


def bucket_of(word: Column, size: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int")


def encode(rows: DataFrame, id_col: str, text_col: str, size: int = 64) -> DataFrame:
    """(id, embedding array<double>): unit vector of hashed word counts; a text without words is a zero vector. Rows
    that share an id count as one text. Counts are combined before they are shuffled: at most `size` rows a text."""
    hashed = F.transform(words(F.col(text_col)), lambda w: bucket_of(w, size))
    exploded = rows.select(F.col(id_col).alias("id"), F.explode_outer(hashed).alias("b"))
    counted = exploded.groupBy("id", "b").agg(F.count("b").cast("double").alias("c"))
    entries = F.collect_list(F.when(F.col("b").isNotNull(), F.struct("b", "c")))
    gathered = counted.groupBy("id").agg(F.map_from_entries(entries).alias("m"), F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("n"))
    share = lambda i: F.coalesce(F.when(F.col("n") > 0, F.try_element_at("m", i) / F.col("n")), F.lit(0.0))
    return gathered.select("id", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), share).alias("embedding"))


def references(texts: Column) -> Column:
    """One block of numbered documents: the first line is the title, what follows is the body."""

    def one(text: Column, i: Column) -> Column:
        title = F.substring_index(text, "\n", 1)
        body = F.substring(text, F.length(title) + 2, F.length(text))
        return F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit("(Title: "), title, F.lit(") "), body, F.lit("\n"))

    return F.array_join(F.transform(texts, one), "")


def middle_out(text: Column, most: int) -> Column:
    """At most `most` words: of longer texts the first and the last half of them (the first half is rounded down)."""
    parts = F.split(F.trim(text), r"\s+")
    head, tail = most // 2, most // 2
    kept = F.concat(F.slice(parts, 1, head), F.slice(parts, -tail, tail)) if most > 1 else F.slice(parts, 1, 0)
    return F.when(F.size(parts) <= most, text).otherwise(F.array_join(kept, " "))


def bm25_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, id, tf, dl): postings."""
    listed = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    exploded = listed.select("id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    return exploded.groupBy("term", "id").agg(F.count("*").alias("tf"), F.max("dl").alias("dl")).select("term", "id", "tf", "dl")


def bm25_sizes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(n, avgdl): one row, over the documents that have words."""
    dl = F.size(words(F.col(text_col)))
    return docs.select(dl.alias("dl")).where("dl > 0").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def bm25(queries: DataFrame, postings: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, sizes: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """(q_id, id, score, rank): the k best documents of each query (q_id, text); a query's word counts once. `sizes` is what
    bm25_sizes() tells of the documents, `known` (term, df) in how many of them words are; without them, both are taken from
    the postings. Only postings of asked words go on."""
    if sizes is None:
        sizes = postings.groupBy("id").agg(F.max("dl").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    asked = queries.select("q_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    wanted = postings.join(asked.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count("*").alias("df")) if known is None else known
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    hits = asked.join(df, "term").join(wanted, "term").join(F.broadcast(sizes))
    scored = hits.groupBy("q_id", "id").agg(F.sum(weight).alias("score"))
    order = Window.partitionBy("q_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def token_f1(answer: Column, golden: Column) -> Column:
    """F1 of the sets of words."""
    a, g = F.array_distinct(words(answer)), F.array_distinct(words(golden))
    common = F.size(F.array_intersect(a, g))
    return F.when(common == 0, F.lit(0.0)).otherwise(2.0 * common / (F.size(a) + F.size(g)))


def passage(text: Column) -> Column:
    """A document as encoders trained on queries and passages want it."""
    return F.concat(F.lit("passage: "), F.coalesce(text, F.lit("")))


def latest_messages(turns: DataFrame, most: int, by: str = "conv_id", order: str = "turn", text_col: str = "text") -> DataFrame:
    """The rows of the latest turns of each conversation that together have at most `most` words."""
    n = F.size(F.split(F.trim(F.coalesce(F.col(text_col), F.lit(""))), r"\s+"))
    newest = Window.partitionBy(by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.withColumn("__total", F.sum(n).over(newest)).where(F.col("__total") <= most).drop("__total")

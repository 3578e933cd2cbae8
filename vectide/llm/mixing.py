"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm.common import WORD, null_safe_join

WEIGHTS = (5, 2, 1)
MOST = 3
SALTS = 256


def _whole_before(rows, keys):
    return Window.partitionBy(*rows).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)


def source_targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target): the share of all words that each source is to get.

    `sized` has source and size. Sources in code point order, null last, take the weights in turn. Targets are in
    proportion to the weights but stop at `most` times the source's size; what is over goes to the others by weight.
    With sources ordered by size per weight, those that stop come first: level k = (all words - most * sizes of the
    first k) / (weights of the rest), and the level to use is the first that the next source does not stop at.
    The windows run over one row per source.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("turn") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighted = by_source.withColumn("turn", turn).withColumn("weight", weight)
    full = F.col("source_size") * F.lit(float(most))
    order = Window.orderBy(full / F.col("weight"), "turn")
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum(full).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(rest)
    leveled = weighted.withColumn("level", level).withColumn("fits", F.col("level") <= full / F.col("weight"))
    chosen = leveled.withColumn("chosen", F.min(F.when(F.col("fits"), F.struct((full / F.col("weight")).alias("at"), F.col("turn"), F.col("level")))).over(everything)["level"])
    return chosen.select("source", "source_size", F.least(full, F.coalesce(F.col("weight") * F.col("chosen"), full)).alias("target"))


def expected_copies(docs: DataFrame, seed: int = 7, weights=WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source, source_size, target, copies) for every row of `docs`.

    size is the number of words of the whole text (null: 0). Each document of a source expects target / source_size
    copies; running over the documents by size, it gets one copy for each integer that the prefix sum of expected
    copies plus one random offset in [0, 1) crosses. Ordering by size keeps the words taken within one longest
    document of the target. The prefix sum is the expected copies times a document's place, and places are counted
    as (source, size) groups before it + salted groups before it + place in its salted group, so no source or size has
    to fit in one task. The offset comes from `seed` and the source, so reruns agree. Null ids and repeated rows count
    like any other row; a source of empty texts has target 0 and is not taken.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))
    salt = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 2)
    sized = sized.withColumn("salt", salt)
    groups = sized.groupBy("source", "size", "salt").agg(F.count("*").alias("n"))
    in_size = groups.withColumn("in_size", F.coalesce(F.sum("n").over(_whole_before(["source", "size"], ["salt"])), F.lit(0)))
    by_size = groups.groupBy("source", "size").agg(F.sum("n").alias("n"))
    before = by_size.withColumn("before", F.coalesce(F.sum("n").over(_whole_before(["source"], ["size"])), F.lit(0))).drop("n")
    targets = source_targets(by_size.select("source", (F.col("size") * F.col("n")).alias("size")), weights, most)
    offset = F.conv(F.substring(F.md5(F.concat(F.coalesce("source", F.lit("")), F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    placed = null_safe_join(in_size, before, ["source", "size"])
    placed = placed.select("source", "size", "salt", (F.col("in_size") + F.col("before")).alias("before"))
    placed = null_safe_join(placed, targets, ["source"]).withColumn("offset", offset)
    within = Window.partitionBy("source", "size", "salt").orderBy("doc_id")
    numbered = sized.withColumn("nth", F.row_number().over(within))
    joined = null_safe_join(numbered, placed, ["source", "size", "salt"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = F.col("before") + F.col("nth")
    copies = F.floor(rate * place + F.col("offset")) - F.floor(rate * (place - 1) + F.col("offset"))
    return joined.select("doc_id", "size", "source", "source_size", "target", F.least(copies, F.lit(most)).cast("long").alias("copies"))


def mix(docs: DataFrame, seed: int = 7, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken): taken is the words the mix takes of the document, repeats counted."""
    return expected_copies(docs, seed, weights, most).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 7, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it; a row that is not taken goes. Null texts have size 0, null ids
    and sources are a value like any other, an empty table stays empty. Among rows of one id, source and size the smaller
    numbers of copies go to the smaller hashes of their texts, so reruns agree."""
    counted = expected_copies(docs, seed, weights, most)
    within = Window.partitionBy("doc_id", "source", "size").orderBy("copies")
    counted = counted.withColumn("__nth", F.row_number().over(within)).where("copies > 0")
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    numbered = docs.withColumn("__size", size).withColumn("__nth", F.row_number().over(Window.partitionBy("doc_id", "source", "__size").orderBy(F.xxhash64("text"))))
    counted = counted.select("doc_id", "source", F.col("size").alias("__size"), "__nth", F.col("copies").alias("__copies"))
    taken = null_safe_join(numbered, counted, ["doc_id", "source", "__size", "__nth"])
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")).drop("__copy")


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2) AS salt
  FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((turn - 1) % 3) + 1] AS weight, source_size * 3.0::DOUBLE AS full_size
  FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS turn FROM by_source)),
leveled AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(full_size) OVER (ORDER BY full_size / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (ORDER BY full_size / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
chosen AS (SELECT level FROM leveled WHERE level <= full_size / weight ORDER BY full_size / weight, turn LIMIT 1),
targets AS (SELECT source, source_size, least(full_size, coalesce(weight * (SELECT level FROM chosen), full_size)) AS target FROM leveled),
placed AS (
  SELECT s.*, row_number() OVER (PARTITION BY source ORDER BY size, salt, doc_id) AS place,
         CAST(('0x' || substr(md5(coalesce(source, '') || '|7'), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS off
  FROM sized s),
rated AS (
  SELECT p.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(least(floor(rate * place + off) - floor(rate * (place - 1) + off), 3) * size AS BIGINT) AS taken
FROM rated
"""

"""Vectors made up by rule, for tests and trials; the same seed gives the same rows however they are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _uniform(seed: int, i: Column) -> Column:
    """In (0, 1), by hash of id and place."""
    return (F.pmod(F.xxhash64("vec_id", i, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))


def uniform(spark: SparkSession, n: int, size: int, seed: int = 123) -> DataFrame:
    """(vec_id, embedding) in the unit cube."""
    return spark.range(n).select(F.col("id").alias("vec_id")).withColumn("embedding", F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: _uniform(seed, i)))


def gaussian(spark: SparkSession, n: int, size: int, seed: int = 123) -> DataFrame:
    """(vec_id, embedding) of independent normal components, from pairs of uniform ones."""
    normal = lambda i: F.sqrt(-2 * F.ln(_uniform(seed, i))) * F.cos(2 * F.pi() * _uniform(seed + 1, i))
    return spark.range(n).select(F.col("id").alias("vec_id")).withColumn("embedding", F.transform(F.sequence(F.lit(1), F.lit(size)), normal))


def manifold(spark: SparkSession, n: int, size: int, inner: int = 10, seed: int = 1338) -> DataFrame:
    """(vec_id, embedding) on a curved surface of `inner` dimensions: normal vectors, mapped linearly, then the sine."""
    from vectide.operators import transforms

    matrix = transforms.random_rotation(inner, size, seed) * (size / inner) ** 0.5
    flat = transforms.apply(gaussian(spark, n, inner, seed), matrix)
    return flat.withColumn("embedding", F.transform("embedding", lambda x: F.sin(4 * x)))

"""Scalar codecs and binary codes, all as column expressions; trained ranges are small tables joined by position."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.functions import vectors as V


def ranges(rows: DataFrame, margin: float = 0.0) -> DataFrame:
    """One row (low array, width array): each component's range, widened on both sides by `margin` of it."""
    parts = rows.where("embedding is not null").select(F.posexplode("embedding").alias("pos", "x"))
    by_pos = parts.groupBy("pos").agg(F.min(F.col("x").cast("double")).alias("low"), F.max(F.col("x").cast("double")).alias("high"))
    spread = (F.col("high") - F.col("low")) * margin
    wide = by_pos.select("pos", (F.col("low") - spread).alias("low"), (F.col("high") + spread).alias("high"))
    ordered = wide.agg(F.array_sort(F.collect_list(F.struct("pos", "low", "high"))).alias("r"))  # one entry a component
    return ordered.select(F.transform("r", lambda s: s["low"]).alias("low"), F.transform("r", lambda s: s["high"] - s["low"]).alias("width"))


def _codes(v: Column, low: Column, width: Column, levels: int) -> Column:
    unit = F.zip_with(F.zip_with(V.doubles(v), low, lambda x, a: x - a), width, lambda d, w: F.when(w == 0, F.lit(0.0)).otherwise(F.least(F.greatest(d / w, F.lit(0.0)), F.lit(1.0))))
    return F.transform(unit, lambda u: F.floor(u * levels).cast("int"))


def _values(codes: Column, low: Column, width: Column, levels: int) -> Column:
    return F.zip_with(F.zip_with(codes, width, lambda c, w: w * (c + F.lit(0.5)) / levels), low, lambda x, a: a + x)


def encode(rows: DataFrame, trained: DataFrame, bits: int = 8) -> DataFrame:
    """Adds code (array<int>): truncated level of each component in its range."""
    return rows.join(F.broadcast(trained)).withColumn("code", _codes(F.col("embedding"), F.col("low"), F.col("width"), (1 << bits) - 1)).drop("low", "width")


def decode(coded: DataFrame, trained: DataFrame, bits: int = 8) -> DataFrame:
    """Adds decoded: the middle of each level."""
    return coded.join(F.broadcast(trained)).withColumn("decoded", _values(F.col("code"), F.col("low"), F.col("width"), (1 << bits) - 1)).drop("low", "width")


def rowwise(rows: DataFrame, bits: int = 8) -> DataFrame:
    """Adds low, scale and code: each row in its own range."""
    v = V.doubles(F.col("embedding"))
    levels = (1 << bits) - 1
    ranged = rows.withColumn("low", F.array_min(v)).withColumn("scale", F.array_max(v) - F.array_min(v))
    code = F.transform(v, lambda x: F.when(F.col("scale") == 0, F.lit(0.0)).otherwise((x - F.col("low")) / F.col("scale")))
    return ranged.withColumn("code", F.transform(code, lambda u: F.floor(u * levels).cast("int")))


def from_rowwise(coded: DataFrame, bits: int = 8) -> DataFrame:
    levels = (1 << bits) - 1
    return coded.withColumn("decoded", F.transform("code", lambda c: F.col("low") + F.col("scale") * (c + F.lit(0.5)) / levels))


def binary(rows: DataFrame, size: int, thresholds: Column | None = None) -> DataFrame:
    """Adds words: sign bits of the vector, or of its difference to thresholds."""
    v = F.col("embedding") if thresholds is None else V.subtract(F.col("embedding"), thresholds)
    return rows.withColumn("words", V.sign_words(v, size))


def quantiles(rows: DataFrame, shares: list[float], bins: int = 128) -> dict[int, list[float]]:
    """Exact quantiles of each component, by position (as `percentile`: between two values in proportion). Components must be
    finite; NaN and nulls are left out.

    A pass counts the values of an interval in `bins` bins, and the bin that holds a wanted rank is the next interval, until
    it has one value. What moves is a count for each component, rank and bin, whatever the number of rows.
    """
    parts = rows.where("embedding is not null").select(F.posexplode("embedding").alias("pos", "x"))
    parts = parts.select("pos", F.col("x").cast("double").alias("x")).where("x is not null and not isnan(x)")
    found: dict[tuple[int, int], float] = {}
    open_, wanted = [], {}
    for r in parts.groupBy("pos").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect():  # one row a component
        wanted[r.pos] = [share * (r.n - 1) for share in shares]
        for rank in sorted({int(z) for w in wanted[r.pos] for z in (np.floor(w), np.ceil(w))}):
            open_.append((r.pos, rank, rank, r.low, r.high))
    while open_:
        still = rows.sparkSession.createDataFrame(open_, "pos int, rank long, left long, low double, high double")
        place = F.when(F.col("high") > F.col("low"), F.least(F.lit(bins - 1), F.floor((F.col("x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * bins))).otherwise(0)
        inside = parts.join(F.broadcast(still), "pos").where("x between low and high").groupBy("pos", "rank", place.alias("bin"))
        counted: dict[tuple[int, int], list] = {}
        for r in inside.agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect():
            counted.setdefault((r.pos, r.rank), []).append((r.bin, r.n, r.low, r.high))
        now, open_ = open_, []
        for pos, rank, left, _, _ in now:
            for _, n, low, high in sorted(counted[pos, rank]):
                if left < n:
                    if low == high:
                        found[pos, rank] = low
                    else:
                        open_.append((pos, rank, left, low, high))
                    break
                left -= n
    between = lambda pos, w: found[pos, int(np.floor(w))] * (1 - (w - np.floor(w))) + found[pos, int(np.ceil(w))] * (w - np.floor(w))
    return {pos: [float(between(pos, w)) for w in ws] for pos, ws in wanted.items()}


def medians(rows: DataFrame) -> DataFrame:
    """One row (middle array): the exact median of each component."""
    middle = [m for _, (m,) in sorted(quantiles(rows, [0.5]).items())]
    return rows.sparkSession.createDataFrame([(middle,)], "middle array<double>")


def hamming_pairs(queries: DataFrame, coded: DataFrame, flips: int, bits: int) -> DataFrame:
    """(q_id, vec_id, score): binary hash search. A bucket is the low `bits` bits of the first word; a query looks in all
    buckets at most `flips` bits away, an equi-join, and takes the Hamming distance of whole codes."""
    masks = [m for m in range(1 << bits) if bin(m).count("1") <= flips]
    bucket = lambda w: w[0].bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    asked = queries.select("q_id", F.col("words").alias("q"), F.explode(F.array(*[bucket(F.col("words")).bitwiseXOR(F.lit(m).cast("long")) for m in masks])).alias("bucket"))
    stored = coded.select("vec_id", "words", bucket(F.col("words")).alias("bucket"))
    return asked.join(stored, "bucket").select("q_id", "vec_id", V.hamming(F.col("q"), F.col("words")).alias("score"))


def packed(codes: Column, bits: int) -> Column:
    """Codes of `bits` bits each, packed in words of at most 32 bits, least significant first."""
    per = 32 // bits
    def word(i: Column) -> Column:
        part = F.transform(F.slice(codes, (i * per + 1).cast("int"), per), lambda c, j: c.cast("long") * F.pow(F.lit(2.0), j * bits).cast("long"))
        return F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s + x)

    return F.transform(F.sequence(F.lit(0), (F.ceil(F.size(codes) / F.lit(per)) - 1).cast("int")), word)


def unpacked(words: Column, bits: int, size: int) -> Column:
    per = 32 // bits
    at = lambda i: F.element_at(words, (F.floor(i / per) + 1).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.pmod(F.floor(at(i) / F.pow(F.lit(2.0), F.pmod(i, F.lit(per)) * bits)), F.lit(1 << bits)).cast("int"))


def uniform_range(trained: DataFrame) -> DataFrame:
    """One range for all components instead of one each."""
    low, high = F.array_min("low"), F.array_max(F.zip_with("low", "width", lambda a, w: a + w))
    bounds = trained.select(F.size("low").alias("n"), low.alias("a"), high.alias("b"))
    return bounds.select(F.array_repeat("a", F.col("n")).alias("low"), F.array_repeat(F.col("b") - F.col("a"), F.col("n")).alias("width"))


def quantile_ranges(rows: DataFrame, share: float) -> DataFrame:
    """Ranges from the `share` to the 1 - `share` quantile of each component."""
    bounds = [(pos, low, high) for pos, (low, high) in quantiles(rows, [share, 1 - share]).items()]
    return _as_ranges(rows.sparkSession.createDataFrame(bounds, "pos int, low double, high double"))


def deviation_ranges(rows: DataFrame, times: float) -> DataFrame:
    """Ranges of `times` standard deviations on both sides of the mean."""
    parts = rows.where("embedding is not null").select(F.posexplode("embedding").alias("pos", "x"))
    x = F.col("x").cast("double")
    stats = parts.groupBy("pos").agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s"))
    return _as_ranges(stats.select("pos", (F.col("m") - F.col("s") * times).alias("low"), (F.col("m") + F.col("s") * times).alias("high")))


def _as_ranges(by_pos: DataFrame) -> DataFrame:
    ordered = by_pos.agg(F.array_sort(F.collect_list(F.struct("pos", "low", "high"))).alias("r"))  # one entry a component
    return ordered.select(F.transform("r", lambda s: s["low"]).alias("low"), F.transform("r", lambda s: s["high"] - s["low"]).alias("width"))


def multi_hash_pairs(queries: DataFrame, coded: DataFrame, flips: int, bits: int, hashes: int) -> DataFrame:
    """(q_id, vec_id, score): as hamming_pairs with `hashes` buckets a code, taken from successive `bits` bits of its
    first word; a pair that several of them bring together counts once."""
    masks = [m for m in range(1 << bits) if bin(m).count("1") <= flips]
    part = lambda w, h: F.shiftright(w[0], h * bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    near = lambda w: F.flatten(F.array(*[F.array(*[F.struct(F.lit(h).alias("h"), part(w, h).bitwiseXOR(F.lit(m).cast("long")).alias("bucket")) for m in masks]) for h in range(hashes)]))
    asked = queries.select("q_id", F.explode(near(F.col("words"))).alias("b")).select("q_id", "b.h", "b.bucket")
    stored = coded.select("vec_id", F.explode(F.array(*[F.struct(F.lit(h).alias("h"), part(F.col("words"), h).alias("bucket")) for h in range(hashes)])).alias("b")).select("vec_id", "b.h", "b.bucket")
    pairs = asked.join(stored, ["h", "bucket"]).select("q_id", "vec_id").distinct()
    both = pairs.join(queries.select("q_id", F.col("words").alias("q")), "q_id").join(coded.select("vec_id", "words"), "vec_id")
    return both.select("q_id", "vec_id", V.hamming(F.col("q"), F.col("words")).alias("score"))


def spectral_words(v: Column, center: Column, period: float, size: int) -> Column:
    """Bits of the first `size` components: whether a square wave of this period, at 0 in the centre, is in its second half;
    packed like sign bits."""
    half = F.zip_with(F.slice(V.doubles(v), 1, size), F.slice(V.doubles(center), 1, size), lambda a, c: F.floor((a - c) * (2.0 / period)))
    return V.sign_words(F.transform(half, lambda h: F.when(F.pmod(h, F.lit(2)) == 1, 1.0).otherwise(-1.0)), size)

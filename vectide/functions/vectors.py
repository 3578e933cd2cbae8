"""Vector functions as column expressions on arrays; everything is accumulated in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Metrics for which larger is closer.
SIMILARITIES = ("inner_product", "cosine", "jaccard")
METRICS = ("inner_product", "l2", "l1", "linf", "lp", "canberra", "bray_curtis", "jensen_shannon", "jaccard", "nan_euclidean", "abs_inner_product", "cosine")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    """Sum of an array, left to right."""
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def _sum(a: Column, b: Column, f) -> Column:
    return total(F.zip_with(a, b, f))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(float("nan"))).otherwise(num / den)


def metric(name: str, a: Column, b: Column, p: float = 3.0) -> Column:
    """Distance or similarity of two arrays of one length. l2 and lp carry no root; canberra and bray_curtis are NaN
    where they would divide by zero; nan_euclidean scales the sum over the components present on both sides and is NaN
    if there are none; abs_inner_product sums the absolute products and counts as a distance."""
    a, b = doubles(a), doubles(b)
    if name == "inner_product":
        return _sum(a, b, lambda x, y: x * y)
    if name == "cosine":
        return _ratio(_sum(a, b, lambda x, y: x * y), norm(a) * norm(b))
    if name == "l2":
        return _sum(a, b, lambda x, y: (x - y) * (x - y))
    if name == "l1":
        return _sum(a, b, lambda x, y: F.abs(x - y))
    if name == "linf":
        return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    if name == "lp":
        return _sum(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p)))
    if name == "canberra":
        return _sum(a, b, lambda x, y: _ratio(F.abs(x - y), F.abs(x) + F.abs(y)))
    if name == "bray_curtis":
        return _ratio(_sum(a, b, lambda x, y: F.abs(x - y)), _sum(a, b, lambda x, y: F.abs(x + y)))
    if name == "jensen_shannon":

        def term(x: Column, y: Column) -> Column:
            m = (x + y) / 2
            return -x * F.ln(m / x) - y * F.ln(m / y)

        return _sum(a, b, term) / 2
    if name == "jaccard":
        return _ratio(_sum(a, b, lambda x, y: F.least(x, y)), _sum(a, b, lambda x, y: F.greatest(x, y)))
    if name == "nan_euclidean":
        present = F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z: ~F.isnan(z["x"]) & ~F.isnan(z["y"]))
        summed = F.aggregate(present, F.lit(0.0), lambda s, z: s + (z["x"] - z["y"]) * (z["x"] - z["y"]))
        return F.when(F.size(present) == 0, F.lit(float("nan"))).otherwise(F.size(a) / F.size(present) * summed)
    if name == "abs_inner_product":
        return _sum(a, b, lambda x, y: F.abs(x * y))
    raise ValueError(f"unknown metric {name}")


def squared_norm(v: Column) -> Column:
    return total(F.transform(doubles(v), lambda x: x * x))


def norm(v: Column) -> Column:
    return F.sqrt(squared_norm(v))


def normalized(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def add(a: Column, b: Column, factor: float = 1.0) -> Column:
    """a + factor * b."""
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y * factor)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def nearest_position(v: Column) -> Column:
    """Position (from 0) of the smallest component."""
    return F.array_position(v, F.array_min(v)) - 1


def remap(v: Column, size: int, wanted: int, uniform: bool = False) -> Column:
    """Pad with zeros or crop to `wanted` components; `uniform` spreads or strides instead of taking the first."""
    zero = F.lit(0.0)
    if not uniform:
        return F.slice(F.concat(doubles(v), F.array_repeat(zero, max(0, wanted - size))), 1, wanted)
    if wanted <= size:
        return F.array(*[doubles(v)[i * size // wanted] for i in range(wanted)])
    source = {i * wanted // size: i for i in range(size)}
    return F.array(*[doubles(v)[source[j]] if j in source else zero for j in range(wanted)])


def linear(v: Column, matrix: list[list[float]], bias: list[float] | None = None) -> Column:
    """matrix * v + bias for a small matrix that becomes part of the plan."""
    rows = [total(F.zip_with(doubles(v), F.array(*[F.lit(float(x)) for x in row]), lambda a, b: a * b)) for row in matrix]
    return F.array(*[r + float(b) for r, b in zip(rows, bias or [0.0] * len(rows))])


def sign_words(v: Column, size: int) -> Column:
    """Sign bits packed in words of 32, least significant first; a bit is 1 where the component is not negative."""

    def word(lo: int) -> Column:
        bits = F.transform(F.slice(doubles(v), lo + 1, min(32, size - lo)), lambda x, i: F.when(x >= 0, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), i).cast("long"))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s + x)

    return F.array(*[word(lo) for lo in range(0, size, 32)])


def from_sign_words(words: Column, size: int) -> Column:
    """Back to components of 1 and -1."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.when(F.getbit(F.element_at(words, (F.floor(i / 32) + 1).cast("int")), F.pmod(i, F.lit(32))) == 1, F.lit(1.0)).otherwise(F.lit(-1.0)),
    )


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def l2_from_inner_product(a: Column, b: Column) -> Column:
    """Squared distance as |a|^2 + |b|^2 - 2 a.b."""
    return squared_norm(a) + squared_norm(b) - 2 * metric("inner_product", a, b)


def k_smallest(v: Column, k: int) -> Column:
    return F.slice(F.array_sort(doubles(v)), 1, k)


def k_largest(v: Column, k: int) -> Column:
    return F.slice(F.sort_array(doubles(v), asc=False), 1, k)

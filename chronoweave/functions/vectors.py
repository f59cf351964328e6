"""Bit vectors and float vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sign_bits(vector: Column, bits: int = 60) -> Column:
    """Bit i: whether element i is positive."""
    one = F.lit(1).cast("long")
    return F.aggregate(F.slice(F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", one, i)).otherwise(F.lit(0).cast("long"))), 1, bits), F.lit(0).cast("long"), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def layout_similarity(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2, and one half where a vector has no length."""
    return F.coalesce((F.try_divide(dot(a, b), norm(a) * norm(b)) + 1) / 2, F.lit(0.5))


def bhattacharyya(a: Column, b: Column) -> Column:
    """Distance of two non-negative histograms: 0 for equal shapes, 1 for none in common."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda s, x: s + x.cast("double"))
    common = F.aggregate(F.zip_with(a, b, lambda x, y: F.sqrt(x.cast("double") * y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(common, F.sqrt(total(a) * total(b))), F.lit(0.0))))


def z_normalized(values: Column) -> Column:
    """Mean 0, then length 1; zeros where there is no spread."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double")) / n
    off = F.transform(values, lambda x: x.cast("double") - mean)
    size = F.sqrt(F.aggregate(off, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(off, lambda x: F.coalesce(F.try_divide(x, size), F.lit(0.0)))


def bound(value: Column, use) -> Column:
    """``use`` of a column that is worked out once: a lambda's argument, not a copy of the expression at each place."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hex_bits(hexadecimal: Column) -> Column:
    """The 64 bits of 16 hexadecimal digits, lowest first."""
    digit = lambda i: F.conv(F.substring(hexadecimal, F.lit(16) - F.floor(i / 4).cast("int"), F.lit(1)), 16, 10).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (digit(i).bitwiseAND(F.pow(F.lit(2), i % 4).cast("int")) > 0).cast("int"))


def bits_hex(bits: Column) -> Column:
    """16 hexadecimal digits of 64 bits, lowest first."""

    def digits(b: Column) -> Column:
        at = lambda j, k: F.element_at(b, F.lit(64) - 4 * j - k) * (8 >> k)
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: F.lower(F.hex(at(j, 0) + at(j, 1) + at(j, 2) + at(j, 3)))), "")

    return bound(bits, digits)


def fused_bits(scales: list[Column], variances: list[Column]) -> Column:
    """Bits on which the scales vote, each with the softmax weight of its variance over the mean one; the second scale's where no scale varies."""
    total = sum(variances[1:], variances[0])
    mean = total / len(variances) + 1e-6
    force = [F.exp(v / mean) for v in variances]
    whole = sum(force[1:], force[0])
    parts = F.struct(*[b.alias(f"b{k}") for k, b in enumerate(scales)], *[(w / whole).alias(f"w{k}") for k, w in enumerate(force)], total.alias("total"))

    def vote(p: Column) -> Column:
        at = lambda i: sum((F.element_at(p[f"b{k}"], i + 1) * p[f"w{k}"] for k in range(1, len(scales))), F.element_at(p["b0"], i + 1) * p["w0"])
        return F.when(p["total"] < 1e-6, p["b1"]).otherwise(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (at(i) > 0.5).cast("int")))

    return bound(parts, vote)

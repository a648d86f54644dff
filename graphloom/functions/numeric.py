"""Column functions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

M = 1 << 31


def lcg(a: Column, b: Column, seed: int = 0) -> Column:
    """A portable random integer of [0, 2**31) for two non-negative integers: two rounds of a linear congruential generator."""
    first = (a.cast("long") % M * 1103515245 + 12345 + seed) % M
    return (((first + b.cast("long") % M * 7919) % M) * 1103515245 + 12345) % M


BITS = 52


def draw(*parts: Column | str | int) -> Column:
    """A portable random integer of [0, 2**52): the first 13 hex digits of the MD5 of the parts, written as text with | between."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def uniform(*parts: Column | str | int) -> Column:
    """A portable draw from [0, 1) in steps of 2**-52."""
    return draw(*parts) / F.lit(float(1 << BITS))


def r6(x: Column) -> Column:
    """Six digits, without a negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def leaky_relu(x: Column, slope: float = 0.2) -> Column:
    return F.greatest(x, x * slope)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def log_sigmoid(x: Column) -> Column:
    """Stable for large arguments of either sign."""
    return -(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    exps = F.transform(a, lambda x: F.exp(x - top))
    total = F.aggregate(exps, F.lit(0.0), lambda s, x: s + x)
    return F.transform(exps, lambda x: x / total)


def argmax(a: Column) -> Column:
    """Place of the largest element from 0, the first on ties."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def hadamard(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def l1_normalised(a: Column) -> Column:
    """Divided by its sum; all zeros where that is 0."""
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x.cast("double"), total), F.lit(0.0)))


def l2_normalised(a: Column) -> Column:
    size = norm2(a)
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x.cast("double"), size), F.lit(0.0)))

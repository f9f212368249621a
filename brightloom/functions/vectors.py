"""Vector expressions over ``array<float>`` columns; sums run left to right in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def literal(vector: list[float]) -> Column:
    """A vector of doubles as a literal."""
    return F.array(*[F.lit(float(x)) for x in vector])


def quantize(a: Column) -> Column:
    """``struct(low, high, codes)``: values as whole numbers from 0 to 255 between the vector's bounds, rounded down."""
    low, high = F.array_min(a).cast("double"), F.array_max(a).cast("double")
    width = F.when(high > low, high - low).otherwise(F.lit(1.0))
    return F.struct(low.alias("low"), high.alias("high"), F.transform(a, lambda v: F.floor((v.cast("double") - low) / width * 255).cast("smallint")).alias("codes"))


def dequantize(q: Column) -> Column:
    """Values of a quantised vector."""
    width = F.when(q["high"] > q["low"], q["high"] - q["low"]).otherwise(F.lit(1.0))
    return F.transform(q["codes"], lambda c: c / 255.0 * width + q["low"])

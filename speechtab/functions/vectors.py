"""Vector expressions on ``array<double>`` columns (MTH1, MTH4, dot, cosine)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double_array(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v: Column) -> Column:
    """MTH4: v / ||v||; a zero vector stays zero (no division by zero)."""
    n = l2_norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(F.transform(v, lambda x: x * 0.0))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """AGG12 element: a.b / (max(|a|, eps) * max(|b|, eps))."""
    return dot(a, b) / (F.greatest(l2_norm(a), F.lit(eps)) * F.greatest(l2_norm(b), F.lit(eps)))


def cos_to_rating(cos: Column, max_label: float = 6.0) -> Column:
    """MTH1: cosine -> 1..max_label similarity rating ((max-1) * cos + 1)."""
    return (F.lit(float(max_label)) - 1) * cos + 1


def rating_to_unit(label: Column, max_label: float = 6.0) -> Column:
    """MTH1 inverse: 1..max_label -> 0..1."""
    return (label - 1) / (F.lit(float(max_label)) - 1)


def round_array(v: Column, places: int = 6) -> Column:
    return F.transform(v, lambda x: F.round(x, places))

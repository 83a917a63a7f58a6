"""Distances between vectors as native columns; smaller is always nearer.

Inventory DF1-DF9.  Sums run in double over the stored floats, left to right.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("l2", "ip", "cosine")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def l2(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance."""
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def ip(a: Column | str, b: Column | str) -> Column:
    """Negated inner product."""
    return -dot(a, b)


def cosine(a: Column | str, b: Column | str) -> Column:
    """One minus the cosine, never below 0; 0 if either vector is all zero."""
    both = norm(a) * norm(b)
    return F.when(both == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - dot(a, b) / both))


def metric(name: str) -> Callable[[Column | str, Column | str], Column]:
    """The function of a metric; an unknown name is an error, not a default."""
    try:
        return {"l2": l2, "ip": ip, "cosine": cosine}[name.lower()]
    except KeyError:
        raise ValueError(f"unknown metric {name!r}; one of {METRICS}") from None


def int8_scale(vectors: DataFrame, vec: str = "vec") -> float:
    """Largest magnitude over 127, so that codes fill a byte; 1 if all is zero."""
    most = vectors.agg(F.max(F.array_max(F.transform(vec, lambda x: F.abs(x.cast("double")))))).first()[0]
    return most / 127.0 if most else 1.0


def int8_codes(vec: Column | str, scale: float) -> Column:
    """Codes of -127 to 127, halves away from zero."""
    return F.transform(_col(vec), lambda x: F.round(F.greatest(F.lit(-127.0), F.least(F.lit(127.0), x.cast("double") / F.lit(scale)))).cast("tinyint"))


def l2_int8(a: Column | str, b: Column | str) -> Column:
    """Squared distance of two code arrays, as a whole number."""
    parts = F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("int") - y.cast("int")) * (x.cast("int") - y.cast("int")))
    return F.aggregate(parts, F.lit(0), lambda s, v: s + v)

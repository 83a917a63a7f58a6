"""Where to filter: cost model and choice."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Calibration:
    """Microseconds for a unit of fetched hits, and of scanned vector elements."""

    c_index: float = 1.859288
    c_scan: float = 0.001214


def post_cost(s: float, n: int, k: int, c: Calibration) -> float:
    """Search first: K hits and those that the filter will drop."""
    return c.c_index * (k + n * (1.0 - s))


def pre_cost(s: float, n: int, dim: int, c: Calibration) -> float:
    """Filter first: every match is compared."""
    return c.c_scan * n * s * dim


def choose(s: float, n: int, dim: int, k: int, c: Calibration | None = None) -> str:
    """``post`` only if strictly cheaper, else ``pre``."""
    c = c or Calibration()
    return "post" if post_cost(s, n, k, c) < pre_cost(s, n, dim, c) else "pre"


def slope(points: Iterable[tuple[float, float]]) -> float:
    """Least squares through the origin; 0 without points."""
    points = list(points)
    xx = sum(x * x for x, _ in points)
    return sum(x * y for x, y in points) / xx if xx else 0.0


def slope_column(x: Column, y: Column) -> Column:
    """The same as an aggregate of a table of any size."""
    return F.coalesce(F.try_divide(F.sum(x * y), F.sum(x * x)), F.lit(0.0))


def calibrate(scans: Iterable[tuple[float, float]], searches: Iterable[tuple[float, float]]) -> Calibration:
    return Calibration(c_index=slope(searches), c_scan=slope(scans))

"""Recall, percentiles and timing."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(found: DataFrame, truth: DataFrame, k: int) -> float:
    """Share of the true (q, id) that were found."""
    hits = truth.select("q", "id").join(found.select("q", "id").distinct(), ["q", "id"], "left_semi").count()
    queries = truth.select("q").distinct().count()
    return hits / (queries * k) if queries and k else 0.0


def recall_by_distance(found: DataFrame, truth: DataFrame, k: int, slack: float = 1e-3) -> float:
    """Found rows no farther than the true K-th, so that ties count."""
    worst = truth.groupBy("q").agg(F.max("dist").alias("worst"))
    hits = found.join(worst, "q").where(F.col("dist") <= F.col("worst") + slack).count()
    queries = worst.count()
    return hits / (queries * k) if queries and k else 0.0


def percentile(values: list[float], p: float) -> float:
    """Nearest rank."""
    ordered = sorted(values)
    return ordered[max(0, -(-len(ordered) * p // 100) - 1).__int__()] if ordered else float("nan")


def summary(samples: DataFrame, column: str, *by: str) -> DataFrame:
    """min, mean, median, p95, p99 (nearest rank) and population deviation of a
    column, on the cluster, of all rows or of each group."""
    c = F.col(column)
    return samples.groupBy(*by).agg(
        F.min(c).alias("min"), F.avg(c).alias("mean"), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column})").alias("median"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {column})").alias("p95"), F.expr(f"percentile_disc(0.99) WITHIN GROUP (ORDER BY {column})").alias("p99"),
        F.stddev_pop(c).alias("stddev"),
    )


def timed(run: Callable[[], object], repeats: int = 3) -> dict[str, float]:
    """One warm-up, then the least, the median and the rate of several runs."""
    run()
    took = []
    for _ in range(repeats):
        began = time.perf_counter()
        run()
        took.append(time.perf_counter() - began)
    return {"min": min(took), "median": percentile(took, 50), "per_second": len(took) / sum(took)}

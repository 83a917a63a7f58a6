"""Reciprocal-rank fusion of ranked lists, and hybrid search."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bm25
from .knn import knn, knn_auto
from .schema import Schema

RRF_K = 60


def ranked(hits: DataFrame, *order: Any) -> DataFrame:
    """(id, rank): 1-based and never shared.  Lists are cut to a few rows before."""
    return hits.select("id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("rank"))


def fuse(lists: list[DataFrame], k: int, rrf_k: int = RRF_K) -> DataFrame:
    """(id, score) of (id, rank) lists: the sum of 1 / (rrf_k + rank)."""
    every = lists[0]
    for more in lists[1:]:
        every = every.unionByName(more)
    score = F.round(F.sum(1.0 / (F.lit(float(rrf_k)) + F.col("rank"))), 12).alias("score")
    return every.groupBy("id").agg(score).orderBy(F.desc("score"), "id").limit(k)


def search_hybrid(
    rows: DataFrame, index: bm25.Index, vec: list[float], query: str, k: int, pred: Any = None, schema: Schema | None = None, metric: str = "l2", depth: int = 0, rrf_k: int = RRF_K
) -> DataFrame:
    """Vector and text lists of ``depth`` (0: K) rows each, fused.  A predicate
    narrows both lists before they are ranked."""
    depth = depth or k
    near = knn(rows, vec, depth, metric) if pred is None else knn_auto(rows, vec, depth, pred, schema, metric)
    allowed = rows.where(pred.column(schema)).select("id") if pred is not None else None
    text = bm25.search_text(index, query, depth, allowed)
    return fuse([ranked(near, "dist", "id"), ranked(text, F.desc("score"), "id")], k, rrf_k)

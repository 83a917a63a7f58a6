"""Experiments over generated inputs (B1-B11): recall against exact search, and time.

Every function returns a table of its measurements.  ``python -m
skeinlake.plans.experiments NAME`` runs one at its full size.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distance as D
from ..operators import bm25, graph, hybrid, index, ivf, knn, planner, workloads
from ..operators.evaluate import recall, summary, timed
from ..operators.predicate import Eq
from ..operators.schema import Attr, Config, Schema
from ..sources import vecs
from ..sources.scratch import folder


def _settled(df: DataFrame, what: str) -> DataFrame:
    spark, path = df.sparkSession, folder(df.sparkSession, what)
    df.write.parquet(path)
    return spark.read.parquet(path)


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _queries(spark: SparkSession, n: int, dim: int, clusters: int = 0) -> DataFrame:
    """Queries (q, qvec) of the same kind as the rows, but none of them."""
    return workloads.vectors(spark, n, dim, "q" if not clusters else "v", clusters).select((F.col("id") + (1 << 40)).alias("q"), F.col("vec").alias("qvec"))


def _first(queries: DataFrame, n: int) -> list[tuple[int, list[float]]]:
    return [(r["q"], list(r["qvec"])) for r in queries.orderBy("q").limit(n).collect()]


def _run(df: DataFrame) -> Callable[[], None]:
    return lambda: df.write.format("noop").mode("overwrite").save()


def distances(spark: SparkSession, dims: Sequence[int] = (64, 128, 512, 1024), n: int = 4096, repeats: int = 3) -> DataFrame:
    """B1: distance computations a second, by metric and dimension."""
    out = []
    for dim in dims:
        rows = _settled(workloads.vectors(spark, n, dim), "vectors")
        q = knn.literal(_first(_queries(spark, 1, dim), 1)[0][1])
        for name in D.METRICS:
            took = timed(_run(rows.agg(F.min(D.metric(name)(F.col("vec"), q)))), repeats)
            out.append((dim, name, took["min"], n / took["min"]))
    return _rows(spark, out, "dim int, metric string, seconds double, per_second double")


def brute(spark: SparkSession, sizes: Sequence[int] = (1_000, 10_000, 50_000), dim: int = 128, k: int = 10, queries: int = 64, repeats: int = 3) -> DataFrame:
    """B2: exact search of a block of queries, by table size."""
    out, q = [], _queries(spark, queries, dim)
    for n in sizes:
        took = timed(_run(knn.knn_bulk(_settled(workloads.vectors(spark, n, dim), "vectors"), q, k)), repeats)
        out.append((n, took["min"], queries / took["min"]))
    return _rows(spark, out, "n int, seconds double, queries_per_second double")


def cells(spark: SparkSession, n: int = 50_000, dim: int = 128, k: int = 10, queries: int = 200, nlist: int = 224, nprobes: Sequence[int] = (1, 2, 4, 8, 16, 32, 64), iterations: int = 25, clusters: int = 0, seed: int = 42) -> DataFrame:
    """Recall and time of an inverted file, by the number of probed cells."""
    rows, q = _settled(workloads.vectors(spark, n, dim, clusters=clusters), "vectors"), _settled(_queries(spark, queries, dim, clusters), "queries")
    centres = ivf.train(rows, nlist, iterations, seed=seed)
    dealt, truth, out = ivf.build(rows, centres, folder(spark, "cells")), _settled(knn.knn_bulk(rows, q, k), "truth"), []
    for p in nprobes:
        found = ivf.search_batch(dealt, centres, q, k, p)
        took = timed(_run(found), 1)
        out.append((p, recall(found, truth, k), took["min"], queries / took["min"]))
    return _rows(spark, out, "nprobe int, recall double, seconds double, queries_per_second double")


def graphs(spark: SparkSession, n: int = 10_000, dim: int = 128, k: int = 10, queries: int = 200, efs: Sequence[int] = (10, 20, 40, 80, 160), clusters: int = 0, quantize: str | None = None, rows_per_shard: int = 2_500) -> DataFrame:
    """Recall and time of graph search, by the width of its beam."""
    rows, q = _settled(workloads.vectors(spark, n, dim, clusters=clusters), "vectors"), _queries(spark, queries, dim, clusters)
    built, truth, out = _settled(graph.build(rows, rows_per_shard=rows_per_shard, quantize=quantize), "graphs"), _settled(knn.knn_bulk(rows, q, k), "truth"), []
    for ef in efs:
        found = graph.search(built, _first(q, queries), k, ef)
        took = timed(_run(found), 1)
        out.append((ef, recall(found, truth, k), took["min"], queries / took["min"]))
    return _rows(spark, out, "ef int, recall double, seconds double, queries_per_second double")


def frontier(spark: SparkSession, n: int = 20_000, dim: int = 128, queries: int = 200, clusters: int = 100, nprobes: Sequence[int] = (1, 4, 16, 64), efs: Sequence[int] = (10, 40, 160)) -> DataFrame:
    """Recall against rate of all kinds of index, on uniform and clustered rows."""
    parts = []
    for data, c in (("uniform", 0), ("clustered", clusters)):
        a = cells(spark, n, dim, queries=queries, nlist=max(2, int(n**0.5)), nprobes=nprobes, iterations=10, clusters=c)
        b = graphs(spark, n, dim, queries=queries, efs=efs, clusters=c)
        parts += [x.select(F.lit(data).alias("data"), F.lit(kind).alias("kind"), F.col(knob).alias("knob"), "recall", "queries_per_second") for kind, knob, x in (("ivf", "nprobe", a), ("graph", "ef", b))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def seeds(spark: SparkSession, n: int = 20_000, dim: int = 64, nlist: int = 141, nprobe: int = 8, seeds: Sequence[int] = (1, 2, 3, 4, 5), queries: int = 100) -> DataFrame:
    """How much recall depends on the starting centroids."""
    runs = [(s, cells(spark, n, dim, queries=queries, nlist=nlist, nprobes=(nprobe,), iterations=10, clusters=100, seed=s).first()["recall"]) for s in seeds]
    return summary(_rows(spark, runs, "seed int, recall double"), "recall")


def files(spark: SparkSession, base: str, query: str, truth: str, k: int = 10, nlist: int = 1024, nprobes: Sequence[int] = (1, 8, 32, 128), efs: Sequence[int] = (10, 64, 256), queries: int = 2_000) -> DataFrame:
    """Recall on vector files with their own truth (fvecs, fvecs, ivecs)."""
    rows = vecs.read_fvecs(spark, base)
    q = vecs.read_fvecs(spark, query).where(F.col("id") < queries).select(F.col("id").alias("q"), F.col("vec").alias("qvec"))
    want = vecs.read_ivecs(spark, truth).where(F.col("id") < queries)
    want = want.select(F.col("id").alias("q"), F.explode(F.slice(F.col("vec").cast("array<bigint>"), 1, k)).alias("id"))
    centres, out = ivf.train(rows, nlist), []
    dealt, built = ivf.build(rows, centres, folder(spark, "cells")), _settled(graph.build(rows), "graphs")
    out += [("ivf", p, recall(ivf.search_batch(dealt, centres, q, k, p), want, k)) for p in nprobes]
    out += [("graph", e, recall(graph.search(built, _first(q, queries), k, e), want, k)) for e in efs]
    return _rows(spark, out, "kind string, knob int, recall double")


def threads(spark: SparkSession, n: int = 20_000, dim: int = 32, counts: Sequence[int] = (1, 2, 4, 8), queries: int = 16) -> DataFrame:
    """Rate of single searches from several threads of one session."""
    rows, out = _settled(workloads.vectors(spark, n, dim), "vectors"), []
    asked = _first(_queries(spark, queries, dim), queries)
    one = lambda v: [r["id"] for r in knn.knn(rows, v, 10).collect()]
    alone = [one(v) for _, v in asked]
    for c in counts:
        with ThreadPoolExecutor(c) as pool:
            found: list[Any] = []
            took = timed(lambda: found.append(list(pool.map(one, [v for _, v in asked]))), 1)  # noqa: B023
        out.append((c, all(f == alone for f in found), took["min"], queries / took["min"]))
    return _rows(spark, out, "threads int, same boolean, seconds double, queries_per_second double")


SHARES = (0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.975, 0.99, 0.995, 0.999)


def crossover(spark: SparkSession, n: int = 100_000, dim: int = 128, k: int = 10, shares: Sequence[float] = SHARES, kind: str = "ivf", repeats: int = 2, **params: Any) -> tuple[DataFrame, planner.Calibration]:
    """Both ways to filter, by the share of matches, and the two costs
    fitted to their times on this cluster (R9)."""
    schema = Schema(tuple(Attr(f"share_{i}", "bool") for i in range(len(shares))))
    rows = _settled(workloads.labelled(workloads.vectors(spark, n, dim), list(shares)), "vectors")
    built = index.make(Config(dim, kind=kind, schema=schema), rows, **params).save(folder(spark, kind))
    wide = {"ivf": {"nprobe": 1 << 30}, "graph": {"ef": n}}.get(kind, {})
    q, out, scans, searches = _first(_queries(spark, 1, dim), 1)[0][1], [], [], []
    for i, s in enumerate(shares):
        pred = Eq(f"share_{i}", True)
        pre = timed(lambda: knn.knn_pre(rows, q, k, pred, schema).collect(), repeats)["min"]  # noqa: B023
        post = timed(lambda: built.search(q, k, pred).collect(), repeats)["min"]  # noqa: B023
        full = [r["id"] for r in built.search(q, k, pred, **wide).collect()]
        out.append((s, pre, post, full == [r["id"] for r in knn.knn_pre(rows, q, k, pred, schema).collect()]))
        scans.append((n * s * dim, pre * 1e6))
        searches.append((k + n * (1 - s), post * 1e6))
    return _rows(spark, out, "share double, pre_seconds double, post_seconds double, same_at_full_width boolean"), planner.calibrate(scans, searches)


def hybrid_tiers(spark: SparkSession, n: int = 50_000, dim: int = 64, k: int = 10, depths: Sequence[int] = (1, 4), vocabulary: int = 5_000, words: int = 40, tiers: Sequence[tuple[str, str]] = (("common", "w0 w1"), ("middle", "w50 w90"), ("rare", "w3000 w4500"))) -> DataFrame:
    """Hybrid search by how common the words are and how deep the lists;
    recall against lists of all rows."""
    rows = _settled(workloads.vectors(spark, n, dim).join(workloads.documents(spark, n, words, vocabulary), "id"), "rows")
    text, q, out = bm25.Index.build(rows).write(folder(spark, "text")), _first(_queries(spark, 1, dim), 1)[0][1], []
    for name, query in tiers:
        want = {r["id"] for r in hybrid.search_hybrid(rows, text, q, query, k, depth=n).collect()}
        for depth in depths:
            found = hybrid.search_hybrid(rows, text, q, query, k, depth=depth * k)
            took = timed(_run(found), 1)
            out.append((name, depth, len(want & {r["id"] for r in found.collect()}) / max(len(want), 1), took["min"]))
    return _rows(spark, out, "tier string, depth int, recall double, seconds double")


if __name__ == "__main__":
    session = SparkSession.builder.getOrCreate()
    result = globals()[sys.argv[1]](session, *sys.argv[2:])
    result, *more = result if isinstance(result, tuple) else (result,)
    result.show(100, False)
    print(*more)

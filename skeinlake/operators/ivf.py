"""Inverted-file index: k-means cells and probed search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.distance import metric as metric_of
from .knn import CHUNK_ROWS, QUERY_ROWS, best_of_pairs, distances, kinds_of, literal, matrix, packed

NLIST, NPROBE, ITERATIONS = 100, 8, 25
#: Files a cell is written to at most, so that a large cell is not one task.
FILES = 16
_ROWS = 4096


def assign(rows: DataFrame, centroids: DataFrame, metric: str = "l2") -> DataFrame:
    """``rows`` with the nearest ``cell``, the lowest on ties.

    The centroids are model parameters, as many as ``nlist`` says: one array,
    broadcast.  Rows meet it by matrix products in Arrow batches, a bounded
    number at a time, without a join or a shuffle.
    """
    metric_of(metric)
    cells = centroids.orderBy("cell").collect()
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())])
    if not cells:
        return rows.sparkSession.createDataFrame([], schema)
    names, compare, step, stack = np.array([c["cell"] for c in cells], np.int32), distances, _ROWS, matrix
    sent = rows.sparkSession.sparkContext.broadcast(np.array([c["centroid"] for c in cells], np.float64))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [names[compare(stack(batch.column("vec").slice(i, step)), sent.value, metric).argmin(0)] for i in range(0, batch.num_rows, step)]
            cell = pa.array(np.concatenate(near) if near else names[:0], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, cell], [*batch.schema.names, "cell"])

    return rows.mapInArrow(work, schema)


def sampled_rows(rows: DataFrame, nlist: int, seed: int = 42) -> DataFrame:
    """Starting centroids: the rows whose seeded hash of the id is least, so
    that runs agree and ids that follow some order do not matter."""
    some = rows.select("id", "vec").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(nlist)
    cell = (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("id")) - 1).cast("int")
    return some.select(cell.alias("cell"), F.transform("vec", lambda x: x.cast("double")).alias("centroid"))


def lloyd_step(rows: DataFrame, centroids: DataFrame, metric: str = "l2") -> DataFrame:
    """Means of the assigned rows; an empty cell keeps its centroid."""
    stack = matrix

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's number and sum of each cell's vectors."""
        found: dict[int, list] = {}
        for batch in batches:
            v, cells = stack(batch.column(0)), np.asarray(batch.column(1))
            for c in np.unique(cells).tolist():
                mine = found.setdefault(c, [0, 0.0])
                mine[0] += int((cells == c).sum())
                mine[1] = mine[1] + v[cells == c].sum(0)
        if found:
            values = [list(found), [n for n, _ in found.values()], [x.tolist() for _, x in found.values()]]
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(values, kinds, strict=True)], ["cell", "n", "total"])

    at = assign(rows.select("id", "vec"), centroids, metric).select("vec", "cell").mapInArrow(sums, "cell int, n bigint, total array<double>")
    parts = at.select("cell", "n", F.posexplode("total").alias("i", "x")).groupBy("cell", "i").agg(F.round(F.sum("x") / F.sum("n"), 12).alias("x"))
    means = parts.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    return centroids.join(means, "cell", "left").select("cell", F.coalesce("mean", "centroid").alias("centroid"))


def train(rows: DataFrame, nlist: int = NLIST, iterations: int = ITERATIONS, metric: str = "l2", seed: int = 42) -> DataFrame:
    """(cell, centroid) after a fixed number of Lloyd rounds.  A round is one
    pass; only ``nlist`` centroids come to the driver, which cuts the lineage."""
    spark = rows.sparkSession
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("centroid", T.ArrayType(T.DoubleType()))])
    now = spark.createDataFrame([tuple(r) for r in sampled_rows(rows, nlist, seed).collect()], schema)
    for _ in range(iterations):
        now = spark.createDataFrame([tuple(r) for r in lloyd_step(rows, now, metric).collect()], schema)
    return now


def spread(cells: DataFrame) -> DataFrame:
    """Rows with a ``cell``, dealt so that each cell is written to a few files."""
    return cells.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(FILES)))


def build(rows: DataFrame, centroids: DataFrame, path: str, metric: str = "l2") -> DataFrame:
    """Write the rows as one folder a cell: a probe then reads its folders only."""
    spread(assign(rows, centroids, metric)).write.mode("overwrite").partitionBy("cell").parquet(path)
    return rows.sparkSession.read.parquet(path)


def probes(centroids: DataFrame, query: list[float], nprobe: int = NPROBE, metric: str = "l2") -> list[int]:
    near = centroids.select("cell", metric_of(metric)(F.col("centroid"), literal(query)).alias("d")).orderBy("d", "cell").limit(nprobe)
    return [r["cell"] for r in near.collect()]


def at_cells(cells: DataFrame, chosen: list[int]) -> DataFrame:
    """The rows of the chosen cells; literal cells prune folders."""
    return cells.where(F.col("cell").isin(chosen) if chosen else F.lit(False))


def search(cells: DataFrame, centroids: DataFrame, query: list[float], k: int, nprobe: int = NPROBE, metric: str = "l2") -> DataFrame:
    """(id, dist) of the K best in the nearest cells."""
    at = at_cells(cells, probes(centroids, query, nprobe, metric))
    return at.select("id", metric_of(metric)(F.col("vec"), literal(query)).alias("dist")).orderBy("dist", "id").limit(k)


def search_batch(cells: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, nprobe: int = NPROBE, metric: str = "l2") -> DataFrame:
    """(q, id, dist, rank) for a table of queries (q, qvec): blocks of a cell's
    rows, dealt to ``FILES`` parts, meet blocks of the queries that probe it."""
    near = queries.crossJoin(F.broadcast(centroids)).select("q", "qvec", "cell", metric_of(metric)(F.col("centroid"), F.col("qvec")).alias("d"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "cell"))
    probed = near.withColumn("r", rank).where(F.col("r") <= nprobe).select("q", "qvec", "cell")
    asked = packed(probed.repartition("cell"), "q", "qvec", QUERY_ROWS, "cell").toDF("qids", "qvecs", "cell")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(FILES - 1))))
    held = packed(cells.select("id", "vec", "cell"), "id", "vec", CHUNK_ROWS, "cell").withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(FILES)).cast("int"))
    return best_of_pairs(held.join(asked, ["cell", "part"]), k, metric, kinds_of(cells, queries))

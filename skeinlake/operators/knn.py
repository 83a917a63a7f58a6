"""Exact nearest neighbours, plain and filtered.

Rows have ``id``, ``vec`` and attributes.  Results are ordered by distance,
ties by id.  The top K is chosen over (id, dist) only; payloads and attributes
are joined for the survivors (``enrich``), so that wide columns are never
sorted or shuffled.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import metric as metric_of
from .predicate import matching
from .schema import Schema

#: Queries that are broadcast, or met by one task, at most.
QUERY_BLOCK = 4096
#: Queries and rows of one block of bulk search: a product has 1 million cells.
QUERY_ROWS, CHUNK_ROWS = 512, 2048
#: Candidates whose distances are summed at a time.
CANDIDATES = 1 << 18
#: Blocks of queries that a task keeps results of at a time.
HELD = 64
#: Bytes of one Arrow batch of blocks, at most (but for one block that is larger).
BATCH_BYTES = 8 << 20
#: Rows that a task's heap may be asked to hold.
HEAP = 1_000_000


def literal(vec: list[float]) -> Column:
    """A vector as one parsed expression, which the optimiser folds; a column
    object a number would take longer to make than a small search runs."""
    if not all(map(math.isfinite, vec)):
        return F.array(*[F.lit(float(x)).cast("float") for x in vec])
    return F.expr(f"array({', '.join(f'{float(x)!r}D' for x in vec)})").cast("array<float>")


def knn(rows: DataFrame, query: list[float], k: int, metric: str = "l2") -> DataFrame:
    """(id, dist) of the K nearest rows; fewer if there are fewer.  Planned as
    one scan with a bounded heap a task and one merge; a K of more than
    ``HEAP``, if no row is left out by it, as a distributed sort."""
    if k < 0:
        raise ValueError("k must not be negative")
    hits = rows.select("id", metric_of(metric)(F.col("vec"), literal(query)).alias("dist")).orderBy("dist", "id")
    return hits if k > HEAP and rows.count() <= k else hits.limit(k)


def knn_batch(rows: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(q, id, dist, rank) for a table of queries (q, qvec): ``knn_bulk``, whose
    distances are those of single searches to the bit."""
    return knn_bulk(rows, queries, k, metric)


def distances(vecs: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows of ``vecs`` (n, d) from ``queries`` (m, d), as (m, n)."""
    if metric == "l2":
        return np.maximum((queries**2).sum(1)[:, None] - 2 * queries @ vecs.T + (vecs**2).sum(1)[None], 0)
    if metric == "ip":
        return -(queries @ vecs.T)
    if metric == "cosine":
        both = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(vecs, axis=1)[None]
        return np.where(both == 0, 0.0, 1.0 - np.divide(queries @ vecs.T, both, out=np.zeros_like(both), where=both > 0))
    raise ValueError(f"unknown metric {metric!r}")


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of vectors of one length as an (n, d) array of doubles."""
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def exact(vecs: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Distances of pairs, row by row, summed left to right like the native
    columns: both agree to the bit."""

    def total(terms: Iterator[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(vecs))
        for t in terms:
            out += t
        return out

    pairs = list(zip(vecs.T.astype(np.float64), queries.T.astype(np.float64), strict=True))
    with np.errstate(invalid="ignore", over="ignore"):
        if metric == "l2":
            return total((x - y) * (x - y) for x, y in pairs)
        dot = total(x * y for x, y in pairs)
        if metric == "ip":
            return -dot
        both = np.sqrt(total(x * x for x, _ in pairs)) * np.sqrt(total(y * y for _, y in pairs))
        return np.where(both == 0, 0.0, np.maximum(0.0, 1.0 - np.divide(dot, both, out=np.zeros_like(both), where=both != 0)))


class Best:
    """The K best rows so far, by (dist, id), of each query of one block.

    A matrix product tells which rows may be among them, with room for its
    rounding; only their distances are summed exactly.
    """

    def __init__(self, names: np.ndarray, queries: np.ndarray, k: int, metric: str) -> None:
        self.names, self.queries, self.k, self.metric = names, queries, k, metric
        self.wide = queries.astype(np.float64)
        self.q, self.id, self.dist = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.bar = np.full(len(names), np.inf)

    def meet(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        if not self.k or not len(ids) or not len(self.names):
            return
        wide = vecs.astype(np.float64)
        with np.errstate(invalid="ignore", over="ignore"):
            d = distances(wide, self.wide, self.metric)
            room = self._room(wide)
            bar = self.bar + room
            if np.isinf(bar).any() or (d <= bar[:, None]).sum() > 8 * self.k * len(d):
                most = min(self.k, len(ids))
                here = np.partition(d, most - 1, axis=1)[:, most - 1] + 2 * room if most == self.k else np.inf
                bar = np.fmin(bar, here)
            q, n = np.nonzero(~(d > bar[:, None]))
        for i in range(0, len(q), CANDIDATES):
            self._add(q[i : i + CANDIDATES], n[i : i + CANDIDATES], ids, vecs)

    def _room(self, wide: np.ndarray) -> np.ndarray:
        """How far a product may be from the exact sum, for each query."""
        square = (wide**2).sum(1)
        longest, own = np.max(square, initial=0.0, where=np.isfinite(square)), (self.wide**2).sum(1)
        scale = {"l2": own + longest, "ip": np.sqrt(own * longest), "cosine": np.ones(len(own))}[self.metric]
        return 8 * (wide.shape[1] + 4) * np.finfo(np.float64).eps * scale

    def _add(self, q: np.ndarray, n: np.ndarray, ids: np.ndarray, vecs: np.ndarray) -> None:
        dist = exact(vecs[n], self.queries[q], self.metric)
        near = ~(dist > self.bar[q])
        q, i, dist = (np.concatenate(x) for x in ((self.q, q[near]), (self.id, ids[n[near]]), (self.dist, dist[near])))
        order = np.lexsort((i, dist, q))
        q, i, dist = q[order], i[order], dist[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        self.q, self.id, self.dist = (x[place < self.k] for x in (q, i, dist))
        self.bar[q[place == self.k - 1]] = dist[place == self.k - 1]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.names[self.q]), pa.array(self.id), pa.array(self.dist)], ["q", "id", "dist"])


def bounded(df: DataFrame) -> DataFrame:
    """Rows that hold whole blocks: a session's Arrow batches have a bound of
    bytes, lowered to ``BATCH_BYTES``."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(conf.get(key)).lower().rstrip("b")
    if now.isdigit() and int(now) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def packed(rows: DataFrame, id_col: str, vec_col: str, size: int, cell: str | None = None) -> DataFrame:
    """(ids, vecs): rows of at most ``size`` vectors, as arrays; with ``cell``
    after it, each of rows of one cell.  A row without a vector is near nothing."""
    stack = matrix
    kind = np.float64 if rows.schema[vec_col].dataType.elementType.typeName() == "double" else np.float32

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vecs, cells in gathered(batches, size):
            for c in np.unique(cells):
                at = np.flatnonzero(cells == c)
                for i in range(0, len(at), size):
                    part = at[i : i + size]
                    pair = [pa.array([x.tobytes()], pa.binary()) for x in (ids[part], vecs[part].astype(kind))]
                    yield pa.RecordBatch.from_arrays([*pair, pa.array([c], pa.int32())], ["ids", "vecs", "cell"])

    def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Batches together, so that blocks are full: up to 16 blocks at a time."""
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
            if held and (batch is None or sum(b.num_rows for b in held) >= 16 * size):
                ids, cells = (np.concatenate([np.asarray(b.column(c)) for b in held]) for c in (0, 2))
                yield ids.astype(np.int64), np.concatenate([stack(b.column(1)) for b in held]), cells
                held = []

    group = F.col(cell).cast("int") if cell else F.lit(0)
    given = rows.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long"), vec_col, group.alias("cell"))
    packed = given.mapInArrow(work, "ids binary, vecs binary, cell int")
    return packed if cell else packed.drop("cell")


def best_of_pairs(pairs: DataFrame, k: int, metric: str, kinds: tuple[type, type]) -> DataFrame:
    """(q, id, dist, rank) of pairs of blocks (ids, vecs, qids, qvecs): a task
    keeps the K best of each block of queries that it meets, and sends them once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[bytes, Best] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                ids, vecs, names, queries = (batch.column(c)[i].as_buffer() for c in range(4))
                key = names.to_pybytes() + queries.to_pybytes()
                if key not in met:
                    name = np.frombuffer(names, np.int64).copy()
                    met[key] = Best(name, np.frombuffer(queries, kinds[1]).reshape(len(name), -1).copy(), k, metric)
                number = np.frombuffer(ids, np.int64)
                met[key].meet(number, np.frombuffer(vecs, kinds[0]).reshape(len(number), -1))
                if len(met) > HELD:
                    yield from (best.batch() for best in met.values())
                    met.clear()
        for best in met.values():
            yield best.batch()

    found = bounded(pairs.select("ids", "vecs", "qids", "qvecs")).mapInArrow(work, "q bigint, id bigint, dist double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("dist", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def kinds_of(rows: DataFrame, queries: DataFrame) -> tuple[type, type]:
    """How blocks of both sides hold their numbers."""
    return tuple(np.float64 if d.schema[c].dataType.elementType.typeName() == "double" else np.float32 for d, c in ((rows, "vec"), (queries, "qvec")))


def knn_bulk(rows: DataFrame, queries: DataFrame, k: int, metric: str = "l2", broadcast_most: int = QUERY_BLOCK) -> DataFrame:
    """(q, id, dist, rank) for many queries (q, qvec), exactly.

    Rows and queries are packed into blocks; every block of rows meets every
    block of queries once, by one bounded matrix product.  The packed rows are
    dealt to all cores, however few files they came from.  The query blocks
    are broadcast after their number was checked, else dealt out, so many to a
    task; nothing passes through the driver.
    """
    metric_of(metric)
    if k < 0:
        raise ValueError("k must not be negative")
    n = queries.count()
    blocks = packed(queries, "q", "qvec", QUERY_ROWS).toDF("qids", "qvecs")
    side = F.broadcast(blocks) if n <= broadcast_most else blocks.repartition(-(-n // QUERY_BLOCK))
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    pairs = packed(rows, "id", "vec", CHUNK_ROWS).repartition(tasks).crossJoin(side)
    return best_of_pairs(pairs, k, metric, kinds_of(rows, queries))


def knn_pre(rows: DataFrame, query: list[float], k: int, pred: Any, schema: Schema, metric: str = "l2", strict: bool = True) -> DataFrame:
    """Filter, then compare the matches only (exact)."""
    return knn(matching(rows, pred, schema, strict), query, k, metric)


def over_fetch(k: int, matches: int, total: int) -> int:
    """How many hits to fetch at first for K matches among them."""
    return -(-3 * k * total // (2 * matches)) if matches else total


def knn_post(rows: DataFrame, query: list[float], k: int, pred: Any, schema: Schema, metric: str = "l2", strict: bool = True, matches: int | None = None, total: int | None = None) -> DataFrame:
    """Search first and filter then: as many hits as should hold K matches by
    their share, then twice as many as long as fewer than K match.  Over an
    exact index the result equals ``knn_pre``, which reads less; this is the
    plan of an index that can't filter itself.

    ``K + rows - matches`` hits always hold K matches if there are K, so that
    is where the doubling ends.
    """
    if total is None or matches is None:
        total, matches = rows.agg(F.count(F.lit(1)), F.count(F.when(pred.column(schema, strict), 1))).first()
    enough, want = min(k, matches), over_fetch(k, matches, total)
    allowed = matching(rows, pred, schema, strict).select("id")
    while True:
        want = min(want, k + total - matches)
        hits = knn(rows, query, want, metric).join(allowed, "id", "left_semi").orderBy("dist", "id").limit(k)
        if want >= k + total - matches or hits.count() >= enough:
            return hits
        want *= 2


def knn_auto(rows: DataFrame, query: list[float], k: int, pred: Any, schema: Schema, metric: str = "l2", strict: bool = True) -> DataFrame:
    """A scan is exact whichever way, and one that filters first compares less:
    no counting scan, no choice.  ``index.Index.search_auto`` chooses where
    there is an index to search."""
    return knn_pre(rows, query, k, pred, schema, metric, strict)


def enrich(hits: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """Payload or attributes for a few hits: the hits (K rows) meet the table late."""
    return hits.join(rows.select("id", *columns), "id", "left")

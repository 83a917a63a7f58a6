"""Layered proximity graphs, one a shard (V10-V18, SC7).

Rows are dealt to shards by a hash of their id; a shard is bounded by
``rows_per_shard``, so a table of any size has more shards and not larger
ones.  Each shard builds its own graph (Malkov & Yashunin) in one Arrow group
and keeps it as a row of arrays; a search visits all shards in parallel and
merges their best.  Distances can run on byte codes with a final rescaling.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import int8_scale, metric as metric_of
from .knn import bounded, distances, exact

M, EF_BUILD, EF_SEARCH, ROWS_PER_SHARD = 16, 200, 50, 20_000
#: Nodes that are linked, and queries that walk, at a time; nodes that a query visits in one step.
BLOCK, QUERIES, STEP = 128, 256, 8
#: Nodes of a shard whose links are a matrix while it is searched, at most.
DENSE = 1024


class ShardGraph:
    """A graph over the vectors of one shard.

    ``adj[layer]`` has the links of each node, padded with -1.  Nodes are
    linked and searched many at a time: a node's links are picked among its
    ``ef`` nearest of the layer, and the queries of a block walk in step.
    """

    def __init__(self, vecs: np.ndarray, metric: str, m: int = M, ef: int = EF_BUILD, seed: int = 42) -> None:
        self.v, self.metric, self.m, self.ef = vecs, metric, m, ef
        self.adj: list[np.ndarray] = []
        self.levels = np.zeros(len(vecs), np.int64)
        self.entry, self.rng = -1, np.random.default_rng(seed)

    def build(self) -> ShardGraph:
        n = len(self.v)
        if n:
            self.levels = np.minimum(-np.log(1.0 - self.rng.random(n)) / math.log(self.m), 200).astype(np.int64)
            self.entry = int(self.levels.argmax())
            self.adj = [self._layer(np.flatnonzero(self.levels >= layer), 2 * self.m if layer == 0 else self.m) for layer in range(int(self.levels.max()) + 1)]
        return self

    def _layer(self, at: np.ndarray, most: int) -> np.ndarray:
        """Links to the nearest that lie apart, and back; and along the nodes'
        order, so that a layer is always connected."""
        n, width = len(at), min(self.ef, len(at) - 1)
        out = np.full((len(self.v), most + 2), -1, np.int32)
        if n == 1:
            return out
        near, far = np.empty((n, width), np.int64), np.empty((n, width))
        for i in range(0, n, BLOCK):
            d = distances(self.v[at], self.v[at[i : i + BLOCK]], self.metric)
            d[np.arange(len(d)), i + np.arange(len(d))] = np.inf
            some = np.sort(np.argpartition(d, width - 1, axis=1)[:, :width], axis=1)
            order = np.take_along_axis(d, some, 1).argsort(1, kind="stable")
            near[i : i + BLOCK] = np.take_along_axis(some, order, 1)
            far[i : i + BLOCK] = np.take_along_axis(d, near[i : i + BLOCK], 1)
        pos = self._apart(at, near, far, self.m)
        own, col = np.nonzero(pos >= 0)
        to, d = near[own, pos[own, col]], far[own, pos[own, col]]
        pairs = np.unique(np.concatenate([own * n + to, to * n + own]), return_index=True)
        own, to, d = *np.divmod(pairs[0], n), np.concatenate([d, d])[pairs[1]]
        order = np.lexsort((to, d, own))
        own, to, d = own[order], to[order], d[order]
        place = np.arange(len(own)) - np.searchsorted(own, own)
        width = min(int(place.max()) + 1, 2 * most)
        keep = place < width
        near, far = np.zeros((n, width), np.int64), np.full((n, width), np.inf)
        near[own[keep], place[keep]], far[own[keep], place[keep]] = to[keep], d[keep]
        pos = self._apart(at, near, far, most)
        out[at, : pos.shape[1]] = np.where(pos >= 0, at[np.take_along_axis(near, np.maximum(pos, 0), 1)], -1)
        out[at[1:], most], out[at[:-1], most + 1] = at[:-1], at[1:]
        return out

    def _apart(self, at: np.ndarray, near: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
        """Places of ``near`` to link: nearest first, those nearer to a chosen
        one (or equal to it) put off; refilled from them; -1 where there are no more."""
        n, width = near.shape
        out = np.full((n, min(most, width)), -1, np.int64)
        for i in range(0, n, BLOCK):
            v, d = self.v[at[near[i : i + BLOCK]]], far[i : i + BLOCK]
            among, square = v @ v.transpose(0, 2, 1), (v**2).sum(2)
            if self.metric == "l2":
                among = np.maximum(square[:, :, None] + square[:, None] - 2 * among, 0)
            elif self.metric == "ip":
                among = -among
            else:
                both = np.sqrt(square[:, :, None] * square[:, None])
                among = np.where(both == 0, 0.0, 1.0 - among / np.where(both == 0, 1.0, both))
            same = -np.inf if self.metric == "ip" else 1e-12 * (square.max() if self.metric == "l2" else 1.0)
            chosen, least = np.zeros(d.shape, bool), np.full(d.shape, np.inf)
            for j in range(width):
                take = (chosen.sum(1) < most) & np.isfinite(d[:, j]) & ~((least[:, j] < d[:, j]) | (least[:, j] <= same))
                chosen[take, j] = True
                least[take] = np.minimum(least[take], among[take, j])
            order = np.where(chosen, 0, width) + np.arange(width) + np.where(np.isfinite(d), 0, 2 * width)
            pos = order.argsort(1)[:, :most]
            out[i : i + BLOCK] = np.where(np.isfinite(np.take_along_axis(d, pos, 1)), pos, -1)
        return out

    def search(self, q: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        d, at = self.search_many(np.asarray(q, np.float64)[None], k, ef)
        return [(float(x), int(n)) for x, n in zip(d[0], at[0], strict=True) if n >= 0]

    def search_many(self, queries: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances and nodes of the K best found for each query, by both; where
        fewer were found, infinity and -1."""
        k = min(k, len(self.v))
        if self.entry < 0 or not k:
            return np.empty((len(queries), 0)), np.empty((len(queries), 0), np.int64)
        parts = [self._walk(queries[i : i + QUERIES], k, min(max(ef, k), len(self.v))) for i in range(0, len(queries), QUERIES)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _walk(self, queries: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        far, every, n = distances(self.v, queries, self.metric), np.arange(len(queries)), len(self.v)
        now = np.full(len(queries), self.entry)
        for links in self.adj[:0:-1]:
            go = every
            while len(go):
                to = np.where(links[now[go]] >= 0, links[now[go]], now[go][:, None])
                best = to[np.arange(len(go)), far[go[:, None], to].argmin(1)]
                better = far[go, best] < far[go, now[go]]
                go = go[better]
                now[go] = best[better]
        if n <= DENSE:
            return self._rounds(far, now, k, ef)
        at, d, new = (np.full((len(queries), ef), x) for x in (-1, np.inf, False))
        at[:, 0], d[:, 0], new[:, 0] = now, far[every, now], True
        seen = np.zeros((len(queries), len(self.v) + 1), bool)
        seen[every, now], seen[:, -1] = True, True
        go, step = every, min(STEP, ef)
        while len(go):
            wait = np.where(new[go], d[go], np.inf)
            col = np.argpartition(wait, step - 1, axis=1)[:, :step]
            real = np.take_along_axis(wait, col, 1) < np.inf
            some = real.any(1)
            go, col, real = go[some], col[some], real[some]
            if not len(go):
                break
            row = go[:, None]
            to = np.where(real[:, :, None], self.adj[0][at[row, col]], -1).reshape(len(go), -1)
            new[row, col] &= ~real
            use = np.nonzero((far[row, to] < d[go].max(1)[:, None]) & ~seen[row, to])
            which, node = np.divmod(np.unique(use[0] * n + to[use]), n)
            if not len(which):
                continue
            seen[go[which], node] = True
            place = np.arange(len(which)) - np.searchsorted(which, which)
            more_at, more_d = (np.full((len(go), place.max() + 1), x) for x in (-1, np.inf))
            more_at[which, place], more_d[which, place] = node, far[go[which], node]
            both = np.concatenate([d[go], more_d], 1)
            keep = np.argpartition(both, ef - 1, axis=1)[:, :ef]
            d[go] = np.take_along_axis(both, keep, 1)
            at[go] = np.take_along_axis(np.concatenate([at[go], more_at], 1), keep, 1)
            new[go] = np.take_along_axis(np.concatenate([new[go], more_at >= 0], 1), keep, 1)
        order = np.lexsort((at, d), axis=-1)[:, :k]
        return np.take_along_axis(d, order, 1), np.take_along_axis(at, order, 1)


    def _rounds(self, far: np.ndarray, now: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The walk over a small shard, whose links are a matrix: in a round all
        nodes among a query's ``ef`` nearest so far are visited together."""
        linked = np.zeros((far.shape[1], far.shape[1]), np.float32)
        row, col = np.nonzero(self.adj[0] >= 0)
        linked[row, self.adj[0][row, col]] = 1
        seen, done = np.zeros(far.shape, bool), np.zeros(far.shape, bool)
        seen[np.arange(len(now)), now] = True
        go = np.arange(len(now))
        while len(go):
            here = np.where(seen[go], far[go], np.inf)
            ahead = (here <= np.partition(here, ef - 1, axis=1)[:, ef - 1 : ef]) & seen[go] & ~done[go]
            some = ahead.any(1)
            go, ahead = go[some], ahead[some]
            done[go] |= ahead
            seen[go] |= ahead.astype(np.float32) @ linked > 0
        here = np.where(seen, far, np.inf)
        at = np.sort(np.argpartition(here, k - 1, axis=1)[:, :k], axis=1) if k < far.shape[1] else np.broadcast_to(np.arange(k), (len(now), k))
        d = np.take_along_axis(here, at, 1)
        order = d.argsort(1, kind="stable")
        d = np.take_along_axis(d, order, 1)
        return d, np.where(d < np.inf, np.take_along_axis(at, order, 1), -1)


def _frozen(g: ShardGraph) -> tuple[bytes, bytes, bytes]:
    """Layers a node, links a layer and the links themselves, as whole numbers."""
    places = [np.nonzero(links >= 0) for links in g.adj]
    node = np.concatenate([p[0] for p in places] or [np.empty(0, np.int64)])
    layer = np.concatenate([np.full(len(p[0]), i) for i, p in enumerate(places)] or [np.empty(0, np.int64)])
    links = np.concatenate([a[p] for a, p in zip(g.adj, places, strict=True)] or [np.empty(0, np.int32)])
    first = np.concatenate([[0], np.cumsum(g.levels + 1)])
    sizes = np.bincount(first[node] + layer, minlength=first[-1]).astype(np.uint16)
    return (g.levels + 1).astype(np.uint8).tobytes(), sizes.tobytes(), links[np.lexsort((layer, node))].astype(np.int32).tobytes()


def _thawed(g: ShardGraph, layers: bytes, sizes: bytes, links: bytes) -> ShardGraph:
    g.levels = np.frombuffer(layers, np.uint8).astype(np.int64) - 1
    sizes, links = np.frombuffer(sizes, np.uint16).astype(np.int64), np.frombuffer(links, np.int32)
    first, cuts = np.concatenate([[0], np.cumsum(g.levels + 1)]), np.concatenate([[0], np.cumsum(sizes)])
    for layer in range(int(g.levels.max(initial=-1)) + 1):
        at = np.flatnonzero(g.levels >= layer)
        part = first[at] + layer
        place = np.arange(sizes[part].max(initial=1))
        there = place < sizes[part][:, None]
        adj = np.full((len(g.levels), len(place)), -1, np.int32)
        if len(links):
            adj[at] = np.where(there, links[np.where(there, cuts[part][:, None] + place, 0)], -1)
        g.adj.append(adj)
    return g


def _codes(v: np.ndarray, scale: float) -> np.ndarray:
    """Codes of -127 to 127, halves away from zero."""
    v = np.clip(v / scale, -127, 127)
    return (np.sign(v) * np.floor(np.abs(v) + 0.5)).astype(np.int8)


SHARD = "shard int, ids binary, vecs binary, layers binary, sizes binary, links binary, entry int, scale double, coded boolean, metric string"


def build(rows: DataFrame, metric: str = "l2", m: int = M, ef: int = EF_BUILD, rows_per_shard: int = ROWS_PER_SHARD, quantize: str | None = None) -> DataFrame:
    """One row a shard: ids, vectors and links as packed numbers.

    ``quantize="int8"`` stores a byte a value in place of four, by a scale that
    is fitted to the table first.  The table of shards can be written as
    Parquet and searched as it is read: nothing is built again.
    """
    metric_of(metric)
    if quantize not in (None, "int8"):
        raise ValueError(f"unknown quantization {quantize!r}")
    if quantize and metric != "l2":
        raise ValueError("codes are compared by squared distance only")
    shards = max(1, math.ceil(rows.count() / rows_per_shard))
    scale = float(int8_scale(rows)) if quantize else 1.0
    graph, codes, frozen = ShardGraph, _codes, _frozen

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        v = np.stack(pdf["vec"].to_numpy()).astype(np.float32)
        v = codes(v.astype(np.float64), scale) if quantize else v
        g = graph(v.astype(np.float64), metric, m, ef).build()
        layers, sizes, links = frozen(g)
        row = (int(pdf["shard"].iloc[0]), pdf["id"].to_numpy(np.int64).tobytes(), v.tobytes(), layers, sizes, links, g.entry, scale, bool(quantize), metric)
        return pd.DataFrame([row], columns=[c.split()[0] for c in SHARD.split(", ")])

    dealt = rows.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))
    tasks = min(shards, 4 * rows.sparkSession.sparkContext.defaultParallelism)
    return dealt.repartition(tasks, "shard").groupBy("shard").applyInPandas(one, SHARD)


def search(graphs: DataFrame, queries: list[tuple[int, list[float]]], k: int, ef: int = EF_SEARCH) -> DataFrame:
    """(q, id, dist, rank): each shard's K best a query, merged.  A shard is
    unpacked once for all queries of the call, and a task sends the K best of
    all its shards; distances of vectors are those of an exact search."""
    graph, codes, thawed = ShardGraph, _codes, _thawed
    context = graphs.sparkSession.sparkContext
    sent = context.broadcast((np.array([q for q, _ in queries], np.int64), np.array([v for _, v in queries], np.float64).reshape(len(queries), -1)))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, qs = sent.value
        best, who = np.empty((len(names), 0)), np.empty((len(names), 0), np.int64)
        for pdf in batches:
            for row in pdf.itertuples():
                ids = np.frombuffer(row.ids, np.int64)
                v = np.frombuffer(row.vecs, np.int8 if row.coded else np.float32).reshape(len(ids), -1)
                g = thawed(graph(v.astype(np.float64), row.metric), row.layers, row.sizes, row.links)
                g.entry = row.entry
                d, at = g.search_many(codes(qs, row.scale).astype(np.float64) if row.coded else qs, k, ef)
                if row.coded:
                    d = d * row.scale**2
                elif at.size:
                    q, c = np.nonzero(at >= 0)
                    d[q, c] = exact(v[at[q, c]], qs[q], row.metric)
                best, who = np.concatenate([best, d], 1), np.concatenate([who, ids[at]], 1)
                order = np.lexsort((who, best), axis=-1)[:, :k]
                best, who = np.take_along_axis(best, order, 1), np.take_along_axis(who, order, 1)
        q, c = np.nonzero(best < np.inf)
        yield pd.DataFrame({"q": names[q], "id": who[q, c], "dist": best[q, c]})

    dealt = bounded(graphs).repartition(2 * context.defaultParallelism)
    hits = dealt.mapInPandas(each, "q bigint, id bigint, dist double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("dist", "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)

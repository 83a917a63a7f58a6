"""One interface over the kinds of index, with a factory, files and a cache (V1, V19, SC20, SC24).

An index answers ``search`` with (id, dist) by distance, ties by id, and takes
a predicate:

* ``flat`` compares the matching rows, exactly;
* ``ivf`` keeps the attributes with the vectors of its cells, so the predicate
  narrows the probed cells' scan; it probes twice as many cells as long as
  fewer than K rows match;
* ``graph`` searches for as many as should hold K matches and drops what does
  not match, then for twice as many as long as there may be more.

``search_auto`` compares the matches only where that is cheaper by the cost
model, else it searches the index.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph, ivf, planner
from .knn import knn, over_fetch
from .predicate import matching
from .schema import Config


@dataclass
class Index:
    """What the kinds share: the rows (id, vec, attributes) and the table's facts."""

    config: Config
    rows: DataFrame
    params: dict[str, Any] = field(default_factory=dict)
    _size: int | None = None

    @property
    def dim(self) -> int:
        return self.config.dim

    def size(self) -> int:
        if self._size is None:
            self._size = self.rows.count()
        return self._size

    def train(self) -> Index:
        return self

    def parts(self) -> dict[str, DataFrame]:
        """The tables that make up the index on disk, beside the rows."""
        return {}

    def search(self, query: list[float], k: int, pred: Any = None, strict: bool = True, **params: int) -> DataFrame:
        raise NotImplementedError

    def search_auto(self, query: list[float], k: int, pred: Any, strict: bool = True, calibration: planner.Calibration | None = None) -> DataFrame:
        """The cheaper of both by the exact share of matches."""
        matches = matching(self.rows, pred, self.config.schema, strict)
        n, total = matches.count(), self.size()
        if planner.choose(n / total if total else 0.0, total, self.dim, k, calibration) == "pre":
            return knn(matches, query, k, self.config.metric)
        return self.search(query, k, pred, strict)

    def save(self, path: str) -> Index:
        """Tables and then the facts, whose file makes the index count."""
        spark = self.rows.sparkSession
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        for name, table in self.parts().items():
            writer = table.write.mode("overwrite")
            (writer.partitionBy("cell") if name == "cells" else writer).parquet(f"{path}/{name}")
        c = self.config
        facts = {"dim": c.dim, "metric": c.metric, "kind": c.kind, "quantize": c.quantize, "fingerprint": c.schema.fingerprint(), "params": self.params, "size": self.size()}
        spark.createDataFrame([(json.dumps(facts),)], "facts string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")
        return load(spark, path, self.config)


class Flat(Index):
    def search(self, query, k, pred=None, strict=True, **params):
        rows = self.rows if pred is None else matching(self.rows, pred, self.config.schema, strict)
        return knn(rows, query, k, self.config.metric)


class Cells(Index):
    """An inverted file: centroids and the rows by cell."""

    centroids: DataFrame | None = None
    cells: DataFrame | None = None

    def train(self):
        p, metric = self.params, self.config.metric
        self.centroids = ivf.train(self.rows, p.setdefault("nlist", ivf.NLIST), p.setdefault("iterations", ivf.ITERATIONS), metric)
        return self._dealt()

    def _dealt(self):
        self.cells = ivf.spread(ivf.assign(self.rows, self.centroids, self.config.metric))
        return self

    def parts(self):
        return {"cells": self.cells, "centroids": self.centroids}

    def add(self, rows: DataFrame, path: str) -> Index:
        """Append rows to the written cells; the centroids stay."""
        more = ivf.assign(rows, self.centroids, self.config.metric)
        ivf.spread(more).write.mode("append").partitionBy("cell").parquet(f"{path}/cells")
        rows.write.mode("append").parquet(f"{path}/rows")
        return load(rows.sparkSession, path, self.config)

    def search(self, query, k, pred=None, strict=True, nprobe=None):
        order = ivf.probes(self.centroids, query, 1 << 30, self.config.metric)
        nprobe = nprobe or self.params.get("nprobe", ivf.NPROBE)
        while True:
            at = ivf.at_cells(self.cells, order[:nprobe])
            hits = knn(at if pred is None else matching(at, pred, self.config.schema, strict), query, k, self.config.metric)
            if pred is None or nprobe >= len(order) or hits.count() >= k:
                return hits
            nprobe *= 2


class Graph(Index):
    """Proximity graphs, one a shard, on vectors or on byte codes."""

    graphs: DataFrame | None = None

    def train(self):
        p = self.params
        self.graphs = graph.build(self.rows, self.config.metric, p.get("m", graph.M), p.get("ef_build", graph.EF_BUILD), p.get("rows_per_shard", graph.ROWS_PER_SHARD), self.config.quantize)
        return self

    def parts(self):
        return {"graphs": self.graphs}

    def search(self, query, k, pred=None, strict=True, ef=None):
        ef, want, total = ef or self.params.get("ef", graph.EF_SEARCH), k, self.size()
        allowed = None if pred is None else matching(self.rows, pred, self.config.schema, strict).select("id")
        if allowed is not None:
            matches = allowed.count()
            want = min(over_fetch(k, matches, total), total)
        while True:
            hits = graph.search(self.graphs, [(0, query)], want, max(ef, want)).select("id", "dist")
            if allowed is not None:
                hits = hits.join(allowed, "id", "left_semi")
            hits = hits.orderBy("dist", "id").limit(k)
            if allowed is None or want >= total or hits.count() >= min(k, matches):
                return hits
            want = min(2 * want, total)


KINDS = {"flat": Flat, "ivf": Cells, "graph": Graph}


def make(config: Config, rows: DataFrame, **params: Any) -> Index:
    """The index of the kind that ``config`` names, built over ``rows``."""
    if config.kind not in KINDS:
        raise ValueError(f"unknown index {config.kind!r}; one of {sorted(KINDS)}")
    if config.quantize and config.kind != "graph":
        raise ValueError("only graphs are kept as codes")
    return KINDS[config.kind](config, rows, dict(params)).train()


def load(spark: SparkSession, path: str, config: Config) -> Index:
    """The index as it was saved, without building; another table's raises."""
    facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
    for name in ("dim", "metric", "kind", "quantize"):
        if facts[name] != getattr(config, name):
            raise ValueError(f"the index has {name} {facts[name]!r}, not {getattr(config, name)!r}")
    if facts["fingerprint"] != config.schema.fingerprint():
        raise ValueError("the index has another schema")
    index = KINDS[config.kind](config, spark.read.parquet(f"{path}/rows"), facts["params"])
    for name in {"ivf": ("cells", "centroids"), "graph": ("graphs",)}.get(config.kind, ()):
        setattr(index, name, spark.read.parquet(f"{path}/{name}"))
    return index


def cached(path: str, config: Config, rows: DataFrame, **params: Any) -> Index:
    """The saved index if there is one for this table and these parameters, else
    a new one, saved."""
    spark = rows.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/facts/_SUCCESS")
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        index = load(spark, path, config)
        if all(index.params.get(k) == v for k, v in params.items()):
            return index
    return make(config, rows, **params).save(path)

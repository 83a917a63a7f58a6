"""The seven calls of a text-and-vector service, and its query line."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import remove
from ..sources.store import Store
from . import bm25
from .hybrid import search_hybrid
from .knn import enrich, knn, knn_auto
from .predicate import Eq
from .schema import Attr, Config, Schema

SCHEMA = Schema((Attr("description", "text"), Attr("category", "tag")))


class Service:
    """Rows have a description and a category; an empty category means any.
    Unset text is stored as an empty string, as on the wire.

    Vectors are compared with the live rows, so answers are exact at once after
    a write; texts are searched through an index that is written for a state of
    the table and read until the next write.
    """

    def __init__(self, spark: SparkSession, path: str, dim: int = 128, metric: str = "l2") -> None:
        self.store = Store(spark, path, Config(dim, metric, schema=SCHEMA))
        self._text: tuple[int, bm25.Index] | None = None

    def _text_index(self) -> bm25.Index:
        """Written once for a state of the table, and read until the next write."""
        if self._text is None or self._text[0] != self.store.lsn:
            folder = f"{self.store.path}/text"
            for name in self.store._names("text"):  # of earlier states
                if name != f"{self.store.lsn:020d}":
                    remove(self.store.spark, f"{folder}/{name}")
            self._text = self.store.lsn, bm25.Index.cached(self.store.current(), f"{folder}/{self.store.lsn:020d}", "description")
        return self._text[1]

    def _rows(self, category: str) -> tuple[DataFrame, Any]:
        return self.store.current(), Eq("category", category) if category else None

    def _out(self, hits: DataFrame) -> list[dict[str, Any]]:
        order = F.asc("dist") if "dist" in hits.columns else F.desc("score")
        return [r.asDict() for r in enrich(hits, self.store.current(), *[a.name for a in SCHEMA.attrs], "payload").orderBy(order, "id").collect()]

    def run(self, line: str) -> list[dict[str, Any]]:
        """Answer a query line: by words, by vector, or by both."""
        q = parse(line)
        if q.vec and q.text:
            return self.search_hybrid(q.vec, q.text, q.k, q.category)
        return self.search_vector(q.vec, q.k, q.category) if q.vec else self.search_text(q.text, q.k, q.category)

    def insert(self, vec: list[float], description: str = "", category: str = "", payload: bytes = b"") -> int:
        return self.store.insert(vec, [description, category], payload)

    def remove(self, row_id: int) -> bool:
        return self.store.remove(row_id)

    def search_vector(self, vec: list[float], k: int, category: str = "") -> list[dict[str, Any]]:
        rows, pred = self._rows(category)
        vec, metric = self.store.config.check(vec), self.store.config.metric
        return self._out(knn(rows, vec, k, metric) if pred is None else knn_auto(rows, vec, k, pred, SCHEMA, metric))

    def search_text(self, query: str, k: int, category: str = "") -> list[dict[str, Any]]:
        rows, pred = self._rows(category)
        return self._out(bm25.search_attr(rows, "description", SCHEMA, query, k, pred, self._text_index()))

    def search_hybrid(self, vec: list[float], query: str, k: int, category: str = "", depth: int = 0, rrf_k: int = 60) -> list[dict[str, Any]]:
        rows, pred = self._rows(category)
        vec = self.store.config.check(vec)
        return self._out(search_hybrid(rows, self._text_index(), vec, query, k, pred, SCHEMA, self.store.config.metric, depth, rrf_k))

    def get_metadata(self, row_id: int) -> dict[str, Any] | None:
        row = self.store.get(row_id)
        return None if row is None else {k: row[k] for k in ("description", "category", "payload")}

    def stats(self) -> dict[str, int]:
        return {"size": self.store.current().count(), "deleted": self.store.tombstones(), "dim": self.store.config.dim}


@dataclass
class Line:
    text: str = ""
    category: str = ""
    vec: list[float] = field(default_factory=list)
    k: int = 5


def parse(line: str) -> Line:
    """``words... [--cat NAME] [--vec 1,2,3] [--k N]``."""
    out, words, parts = Line(), [], iter(line.split())
    for p in parts:
        if p == "--cat":
            out.category = next(parts)
        elif p == "--vec":
            out.vec = [float(x) for x in next(parts).split(",")]
        elif p == "--k":
            out.k = int(next(parts))
        else:
            words.append(p)
    out.text = " ".join(words)
    return out

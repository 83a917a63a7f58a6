"""Typed predicates: one equality or one closed range.

Checks are eager: Spark would coerce a wrong type without a word.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import Schema


@dataclass(frozen=True)
class Eq:
    attr: str
    value: Any

    def column(self, schema: Schema, strict: bool = True) -> Column:
        kind = schema[self.attr].type
        want = {"tag": str, "bool": bool}.get(kind)
        if want is None:
            raise ValueError(f"equality is for tags and booleans; {self.attr!r} is {kind}")
        if type(self.value) is not want:
            raise ValueError(f"{self.attr!r} is {kind}; {self.value!r} is not")
        return F.col(self.attr) == F.lit(self.value)


@dataclass(frozen=True)
class Range:
    attr: str
    low: Any
    high: Any

    def column(self, schema: Schema, strict: bool = True) -> Column:
        """``strict`` refuses attributes that are not indexed; Spark can scan them."""
        attr = schema[self.attr]
        want = {"int64": int, "float64": float}.get(attr.type)
        if want is None:
            raise ValueError(f"ranges are for numbers; {self.attr!r} is {attr.type}")
        if type(self.low) is not want or type(self.high) is not want:
            raise ValueError(f"{self.attr!r} is {attr.type}; so must be both bounds")
        if strict and not attr.indexed:
            raise ValueError(f"{self.attr!r} is not indexed, so its range can't be resolved")
        return F.col(self.attr).between(self.low, self.high)


@dataclass(frozen=True)
class Both:
    """Beyond the reference's one predicate: both must hold."""

    left: Any
    right: Any

    def column(self, schema: Schema, strict: bool = True) -> Column:
        return self.left.column(schema, strict) & self.right.column(schema, strict)


@dataclass(frozen=True)
class Either:
    left: Any
    right: Any

    def column(self, schema: Schema, strict: bool = True) -> Column:
        return self.left.column(schema, strict) | self.right.column(schema, strict)


@dataclass(frozen=True)
class Not:
    part: Any

    def column(self, schema: Schema, strict: bool = True) -> Column:
        return ~self.part.column(schema, strict)


def matching(rows: DataFrame, pred: Any, schema: Schema, strict: bool = True) -> DataFrame:
    """The live rows that match; null never does.  Reads the current values, so
    it is exact after any update."""
    return rows.where(pred.column(schema, strict))


def selectivity(rows: DataFrame, pred: Any, schema: Schema, strict: bool = True) -> float:
    """Share of rows that match, exactly; 0 for no rows.  One scan."""
    n, k = rows.agg(F.count(F.lit(1)), F.count(F.when(pred.column(schema, strict), 1))).first()
    return k / n if n else 0.0


def selectivities(rows: DataFrame, attr: str) -> DataFrame:
    """(value, n, selectivity) of every value of an attribute, null too: its
    share of all rows.  One pass; the values meet their total by a broadcast row."""
    counted = rows.groupBy(F.col(attr).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("_all"))
    return counted.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("_all")).alias("selectivity"))

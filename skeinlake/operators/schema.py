"""Attribute schemas, records and configuration."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = {"int64": T.LongType(), "float64": T.DoubleType(), "bool": T.BooleanType(), "tag": T.StringType(), "text": T.StringType()}
_CODES = {"int64": 1, "float64": 2, "bool": 3, "tag": 4, "text": 5}
_PYTHON = {"int64": int, "float64": float, "bool": bool, "tag": str, "text": str}


@dataclass(frozen=True)
class Attr:
    name: str
    type: str
    indexed: bool = False

    def __post_init__(self) -> None:
        if self.type not in TYPES:
            raise ValueError(f"attribute {self.name!r}: no such type: {self.type!r}")
        if self.indexed and self.type not in ("int64", "float64"):
            raise ValueError(f"attribute {self.name!r}: only numbers can be indexed")


    def value(self, v: Any) -> Column:
        """A value of this attribute as a typed column; null for none."""
        if v is not None and type(v) is not _PYTHON[self.type]:
            raise ValueError(f"attribute {self.name!r} holds {self.type}, not {type(v).__name__}")
        return F.lit(v).cast(TYPES[self.type])


@dataclass(frozen=True)
class Schema:
    attrs: tuple[Attr, ...] = ()

    def __getitem__(self, name: str) -> Attr:
        for a in self.attrs:
            if a.name == name:
                return a
        raise ValueError(f"no attribute {name!r}")

    def fingerprint(self) -> int:
        """64-bit FNV-1a of names, types and flags in order."""
        h = 0xCBF29CE484222325
        for a in self.attrs:
            for byte in (*a.name.encode(), 0, _CODES[a.type], int(a.indexed)):
                h = ((h ^ byte) * 0x100000001B3) & (1 << 64) - 1
        return h

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(a.name, TYPES[a.type], True, {"attr_type": a.type, "indexed": a.indexed}) for a in self.attrs])

    def validate(self, values: list[Any] | None) -> list[Any]:
        """A row of values for the schema: none at all means all null."""
        if not values:
            return [None] * len(self.attrs)
        if len(values) != len(self.attrs):
            raise ValueError(f"{len(values)} values for {len(self.attrs)} attributes")
        for a, v in zip(self.attrs, values, strict=True):
            if v is not None and type(v) is not _PYTHON[a.type]:
                raise ValueError(f"attribute {a.name!r} holds {a.type}, not {type(v).__name__}")
        return list(values)


@dataclass(frozen=True)
class Config:
    dim: int
    metric: str = "l2"
    kind: str = "graph"
    schema: Schema = field(default_factory=Schema)
    quantize: str | None = None

    def check(self, vec: list[float]) -> list[float]:
        if len(vec) != self.dim:
            raise ValueError(f"a vector of {len(vec)} in a table of {self.dim}")
        return [float(x) for x in vec]

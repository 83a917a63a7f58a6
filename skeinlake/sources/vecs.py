"""Readers and writers of vector files (SC10, SC11, SC22-SC24).

A record is a little-endian int32 length and as many float32 (fvecs) or int32
(ivecs) values.  Files are cut at record boundaries, whose size the first
record tells, and read and decoded in parallel, a batch of records at a time.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH = 8192


def _read(spark: SparkSession, path: str, dim: int | None, limit: int | None, kind: str, spark_type: str) -> DataFrame:
    head = spark.read.format("binaryFile").load(path).where("length > 0").select("path").limit(1).collect()
    if dim is None:
        if not head:
            return spark.createDataFrame([], f"id bigint, vec array<{spark_type}>")
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(head[0][0])
        stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
        dim = struct.unpack("<i", bytes(stream.read() for _ in range(4)))[0]
        stream.close()
    size = 4 + 4 * dim
    raw = spark.createDataFrame(spark.sparkContext.binaryRecords(path, size).map(lambda r: (bytearray(r),)), "raw binary")
    rows = raw.select("raw", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4").reshape(batch.num_rows, 1 + dim)
            if (both[:, 0] != dim).any():
                raise ValueError(f"{path} holds records that are not of dimension {dim}")
            flat = pa.array(np.ascontiguousarray(both[:, 1:]).view(kind).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dim), flat)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), lists], ["p", "m", "vec"])

    # Numbers by place: rows of earlier partitions, then the place in its own.
    sizes = {r["p"]: r["n"] for r in rows.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, bases = 0, {}
    for p in sorted(sizes):
        bases[p] = before
        before += sizes[p]
    base = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in bases.items() for x in kv]), F.col("p").cast("long")) if bases else F.lit(0)
    out = rows.mapInArrow(decode, f"p int, m bigint, vec array<{spark_type}>").select((base + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("id"), "vec")
    return out if limit is None else out.where(F.col("id") < limit)


def read_fvecs(spark: SparkSession, path: str, dim: int | None = None, limit: int | None = None) -> DataFrame:
    """(id, vec array<float>), ids by place; with ``limit`` the first so many."""
    return _read(spark, path, dim, limit, "<f4", "float")


def read_ivecs(spark: SparkSession, path: str, dim: int | None = None, limit: int | None = None) -> DataFrame:
    """(id, vec array<int>)."""
    return _read(spark, path, dim, limit, "<i4", "int")


def encode(vectors: list[list[float]], kind: str = "<f4") -> bytes:
    return b"".join(struct.pack("<i", len(v)) + np.asarray(v, kind).tobytes() for v in vectors)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        table.append(n)
    return table


_CRC = _crc_table()


def crc32c(data: bytes) -> int:
    """Castagnoli checksum, for exchange with other binary logs."""
    c = 0xFFFFFFFF
    for b in data:
        c = _CRC[(c ^ b) & 255] ^ c >> 8
    return c ^ 0xFFFFFFFF


def crc32c_column(data: pd.Series) -> pd.Series:
    """For use as a pandas UDF."""
    return data.map(crc32c)

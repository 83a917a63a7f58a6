"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import sys
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import remove, shared_dir

#: ASCII white space, as the result contracts spell it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class _Open(threading.local):
    """The lists of paths that the scratch blocks around a call remove."""

    def __init__(self) -> None:
        self.blocks: list[list[str]] = []


_OPEN = _Open()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is settled inside is removed at the end, but for what is kept: that
    is left to the block around this one, if there is one.  So are the shuffle
    files of what was computed inside and is not referred to any more."""
    paths: list[str] = []
    _OPEN.blocks.append(paths)
    try:
        yield
    finally:
        _OPEN.blocks.pop()
        for path in paths:
            remove(spark, path)
        release(spark)


def release(spark: SparkSession) -> None:
    """Spark deletes shuffle files when the driver collects the objects that
    stand for them, which a driver with little to do may put off for half an
    hour while disks fill up; so collect them now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _place(spark: SparkSession, name: str, keep: bool = False) -> str:
    path = f"{shared_dir(spark)}/skeinlake/{name}"
    blocks = _OPEN.blocks[:-1] if keep else _OPEN.blocks
    if blocks:
        blocks[-1].append(path)
    return path


def settle(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs tasks, not the stages before, and
    what several branches read is computed once.  The files stay as long as
    the result may be read; a ``scratch`` block removes those written in it,
    unless they are to ``keep``.
    """
    spark = df.sparkSession
    path = _place(spark, f"{tag}-{uuid.uuid4().hex}", keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_by(df: DataFrame, key: str, tag: str, whole: bool = True) -> DataFrame:
    """``settle``, laid out by the hash of ``key``, so that a join or a window
    on it moves the other side only, or nothing.  ``df`` should come from a
    join or an aggregate on ``key``: its tasks then hold ``whole`` buckets, and
    there is one file a bucket.  Where ``key`` is the number of the task, each
    task has one bucket; twice as many of them keep two tasks mostly apart.
    """
    spark = df.sparkSession
    name = f"skeinlake_{tag}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions")) * (1 if whole else 2)
    df.write.bucketBy(buckets, key).option("path", _place(spark, name)).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved: the files stay, the name need not
    spark.sql(f"DROP TABLE {name}")
    return out


#: Bytes of one Arrow batch, at most (but for a single row that is longer).
BATCH_BYTES = 8 << 20
#: Rows of a small table that is broadcast; one of more rows is shuffled.
SMALL_ROWS = 100_000


def map_arrow(df: DataFrame, work, schema) -> DataFrame:
    """``mapInArrow`` in batches of bounded bytes: rows carry whole texts, and
    the usual bound of 10,000 rows may be gigabytes.  A session whose bound is
    smaller keeps it."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(conf.get(key)).lower().rstrip("b")
    if now.isdigit() and int(now) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))

    def tidy(batches):
        """A worker waits for its next task with what its last one has freed;
        give that back to the machine."""
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
            if trim:  # of glibc
                trim(0)

    return df.mapInArrow(tidy, schema)


def small_side(table: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A settled table as one side of a join with large rows: broadcast if it
    has at most ``most`` rows, else sorted and merged."""
    return F.broadcast(table) if table.count() <= most else table.hint("merge")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))

"""Folders for what is written on the way."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only a session on one
    machine (tests, a laptop) gets one of its own where that is unset; on a
    cluster a local folder would be read by nobody else, so this raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[[^,]*\])?$", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="skeinlake-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def folder(spark: SparkSession, what: str) -> str:
    """A new name in the shared folder."""
    return f"{shared_dir(spark)}/skeinlake/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_KEPT: dict[tuple[str, str, str], Any] = {}


def kept(spark: SparkSession, source: str, what: str, make: Callable[[str], Any]) -> Any:
    """What ``make`` returns for a new folder: once an application, source and kind."""
    key = (spark.sparkContext.applicationId, source, what)
    if key not in _KEPT:
        _KEPT[key] = make(folder(spark, what))
    return _KEPT[key]

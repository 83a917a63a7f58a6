"""A semi-join reducer of bounded size.

A join of long texts with a list of keys shuffles all texts, those without a
partner too.  A bitmap of ``1 << BITS`` slots, built by a distributed
aggregate, tells most of the latter apart before the shuffle.  It is at most
4,096 rows of 4 KB (16 MB) whatever the input, so it is safe to broadcast; the
exact join follows, so it changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 27
_PAGE = 32_768  # bits of one bitmap row


def _page(key: Column) -> Column:
    return F.floor(F.pmod(key, F.lit(1 << BITS)) / _PAGE).cast("int")


def bitmap(keys: DataFrame, key: Column) -> DataFrame:
    """(_page, _bits): the slots of a column of 64-bit hashes."""
    slots = keys.select(_page(key).alias("_page"), F.pmod(key, F.lit(_PAGE)).alias("_bit"))
    return slots.groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def thinned(rows: DataFrame, slots: DataFrame, key: Column) -> DataFrame:
    """The rows whose slot is set, and by chance a few more."""
    rows = rows.withColumn("_key", key)
    rows = rows.withColumn("_page", _page(F.col("_key"))).join(F.broadcast(slots), "_page")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.pmod("_key", F.lit(_PAGE)) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, F.pmod("_key", F.lit(8)).cast("int"))
    return rows.where(bit.bitwiseAND(F.lit(1)) == 1).drop("_page", "_bits", "_key")

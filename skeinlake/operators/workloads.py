"""Generated inputs for experiments (F10-F12): the same rows on every run and
on any number of tasks, as each value is a hash of its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(*place: Column) -> Column:
    """A number in [0, 1) for each place, 32 bits of its MD5."""
    digits = F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in place])), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 32))


def vectors(spark: SparkSession, n: int, dim: int, seed: str = "v", clusters: int = 0, spread: float = 0.1) -> DataFrame:
    """(id, cluster, vec): uniform in a cube, or within ``spread`` of the
    uniform centre of a cluster."""
    rows = spark.range(n).select("id", (F.col("id") % F.lit(clusters) if clusters else F.lit(0).cast("long")).alias("cluster"))

    def value(j: Column) -> Column:
        own = uniform(F.lit(seed), F.col("id"), j) * 2 - 1
        return (uniform(F.lit(f"{seed}-centre"), F.col("cluster"), j) * 2 - 1 + own * spread if clusters else own).cast("float")

    return rows.select("id", "cluster", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), value).alias("vec"))


def zipf_rank(u: Column, vocabulary: int) -> Column:
    """Rank from 0: the k-th is about 1 / (k + 1) times as frequent as the first."""
    return F.floor(F.pow(F.lit(float(vocabulary + 1)), u)).cast("long") - 1


def documents(spark: SparkSession, n: int, words: int, vocabulary: int, seed: str = "d") -> DataFrame:
    """(id, text) of Zipf-distributed words w0, w1 ...; lengths from ``words`` / 2 up to 1.5 times."""
    rows = spark.range(n).withColumn("len", (F.lit(words // 2) + F.floor(uniform(F.lit(f"{seed}-len"), F.col("id")) * words)).cast("int"))
    word = lambda j: F.concat(F.lit("w"), zipf_rank(uniform(F.lit(seed), F.col("id"), j), vocabulary).cast("string"))
    return rows.select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.col("len"), F.lit(1))), word), " ").alias("text"))


def labelled(rows: DataFrame, shares: list[float], seed: str = "s") -> DataFrame:
    """``rows`` with a column ``share_<i>`` for each share: true for that part of
    them, and of the smaller shares' rows all."""
    return rows.withColumns({f"share_{i}": uniform(F.lit(seed), F.col("id")) < F.lit(s) for i, s in enumerate(shares)})

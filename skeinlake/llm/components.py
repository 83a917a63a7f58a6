"""Connected components of a table of links, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Nodes whose minimum is broadcast, at most: those with this share of all links.
HUBS = 10_000


def components(links: DataFrame, a: str, b: str, hubs: int = HUBS) -> DataFrame:
    """(node, root): the smallest node reachable, for every node but the roots.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until
    the links are stars around the smallest nodes, however many rounds that
    takes.  Both steps are group-bys whose minimum combines on the map side,
    and each round is written and read back.  Links to oneself and repeated
    links are harmless; no links give an empty result.

    Skew: a node with at least ``1 / hubs`` of the links is a hub.  There are
    at most ``hubs`` of them, so their minima are broadcast and their links stay
    where they are; the links of other nodes are shuffled to their minima.
    """
    links = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = settle(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while (found := _unsettled(now))[0]:
        most = -(-2 * found[1] // hubs)  # a step has at most twice the rows of the round
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, most).where("v > u").select(F.col("v").alias("u"), F.least("u", "_m").alias("v")).distinct()
        small = _with_least(large, most)
        small = small.select(F.when(F.col("v") == F.col("_m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("_m").alias("v"))
        now = settle(small.distinct(), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _unsettled(links: DataFrame) -> tuple[int, int]:
    """Nodes that keep the links, each from a node down to a smaller one, from
    being stars (with two links down, or with links both ways), and all ends."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("down")).unionByName(links.select(F.col("v").alias("x"), F.lit(0).alias("down")))
    nodes = ends.groupBy("x").agg(F.sum("down").alias("down"), F.count(F.lit(1)).alias("all"))
    odd = (F.col("down") > 1) | ((F.col("down") > 0) & (F.col("all") > F.col("down")))
    row = nodes.agg(F.count(F.when(odd, 1)), F.coalesce(F.sum("all"), F.lit(0))).first()
    return row[0], row[1] // 2


def _with_least(rows: DataFrame, most: int) -> DataFrame:
    """Rows (u, v) with ``_m``, the least v of their u."""
    least = rows.groupBy("u").agg(F.min("v").alias("_m"), F.count(F.lit(1)).alias("_k"))
    hub = F.broadcast(least.where(F.col("_k") >= most).drop("_k"))
    rest = least.where(F.col("_k") < most).drop("_k")
    return rows.join(hub, "u").unionByName(rows.join(hub.select("u"), "u", "left_anti").join(rest, "u"))

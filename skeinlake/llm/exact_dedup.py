"""Exact dedup by a content sort (operator 4).

Sampled splitters range-partition the normalised texts, an external sort puts
the equal texts of a range side by side, and each row is compared in full with
its left neighbour; the smallest identifier of a run of equals stays.

Splitters are bounded whatever the texts hold: they are cut from the first 64
characters, where many texts begin alike from the digest, and where many texts
are the same from the identifier.  So the run of a frequent text is split over
as many ranges as its rows fill.  Only the first and the last run of a range
can go on in another; these ends, two a range, are compared in full across
ranges and their runs merged.

The ranges are written once, by the number of their task, and sorted and
compared as they are read: the texts are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, scratch, settle, settle_by, small_side, text_or_empty

HEAD = 64


def _runs(docs: DataFrame, id_col: str, text_col: str, ranges: int | None) -> DataFrame:
    """(_range, _run, _id, _sha, _norm, _keep, _n): rows with the run that they
    are in; texts only of the first row of a range's first and last run."""
    base = docs.select(F.col(id_col).alias("_id"), F.regexp_replace(text_or_empty(text_col), SPACE, " ").alias("_norm"))
    base = base.withColumn("_sha", F.sha2("_norm", 256)).withColumn("_head", F.substring("_norm", 1, HEAD))
    splitters = ("_head", "_sha", "_id")
    dealt = base.repartitionByRange(ranges, *splitters) if ranges else base.repartitionByRange(*splitters)
    dealt = settle_by(dealt.drop("_head").withColumn("_range", F.spark_partition_id()), "_range", "ranges", whole=False)

    sort = Window.partitionBy("_range").orderBy(F.substring("_norm", 1, HEAD), "_sha", "_norm", "_id")
    new = F.when(F.lag("_norm").over(sort) == F.col("_norm"), 0).otherwise(1)
    runs = dealt.withColumn("_new", new).withColumn("_run", F.sum("_new").over(sort.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("_last", F.sum("_new").over(Window.partitionBy("_range")))
    end = (F.col("_new") == 1) & ((F.col("_run") == 1) | (F.col("_run") == F.col("_last")))
    rows = runs.select("_range", "_run", "_id", "_sha", F.when(end, F.col("_norm")).alias("_norm"))  # from here on without the texts
    run = Window.partitionBy("_range", "_run")
    return settle(rows.withColumn("_keep", F.min("_id").over(run)).withColumn("_n", F.count(F.lit(1)).over(run)), "runs", keep=True)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    Texts are equal when identical after each run of ASCII white space became
    one space.  Null texts count as empty and so form a group with the empty
    ones.  Null identifiers sort out of the way: a group keeps its smallest
    identifier that is not null; a group of null identifiers only has a null
    ``keep_id`` and its rows are all kept.  Rows that repeat an identifier and
    a text share their fate.  An empty table gives an empty result; further
    columns are ignored.  ``ranges`` sets their number, else the session does.
    """
    with scratch(docs.sparkSession):
        rows = _runs(docs, id_col, text_col, ranges)
    ends = rows.where("_norm is not null").select("_range", "_run", "_sha", "_norm", "_keep", "_n")
    whole = ends.groupBy("_sha", "_norm").agg(F.min("_keep").alias("_k"), F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_parts")).where("_parts > 1")
    ends = settle(ends.join(whole, ["_sha", "_norm"]).select("_range", "_run", "_k", "_all"), "ends")  # two rows a range at most
    out = rows.join(small_side(ends), ["_range", "_run"], "left")
    keep = F.when(F.col("_all").isNotNull(), F.col("_k")).otherwise(F.col("_keep"))
    return out.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_all", "_n").cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )

"""Mixing sources to target weights (operator 3).

Every row gets a hash-random key.  Within each source rows are range-sorted by
that key, token counts are summed up to each row in two levels (a prefix of
the key names a slice of a source; sums of slices, then sums inside a slice),
and each source is cut at its exact budget of tokens.  A budget beyond the
source's size takes whole epochs first.

Only identifiers, keys and sizes are sorted.  A source's cut is one place in
the order of keys, so what a row gives follows from its own key: a map over
the rows, whose texts and other columns are never shuffled.

Skew: keys are uniform and slices are as many as the rows ask for, about
``SLICE_ROWS`` rows of a source that holds them all, so a source with a third
of all rows is spread over a third of the slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, scratch, settle, small_side, text_or_empty

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-0"
SLICE_ROWS = 1 << 16


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of sources: ``sizes`` (source, source_size) gains weight and target.

    Sources by code point, null last, take ``weights`` in turn.  They share the
    sum of all sizes by weight, none above ``max_epochs`` times its size; what
    capped sources leave is shared again.  As many sources as web hosts do: a
    source's place is its place in its range of names and the sizes of the
    ranges before, and the level at which sources are capped rises by one
    aggregate a step until it caps no more.
    """
    named = sizes.repartitionByRange(F.col("source").isNull(), "source").withColumn("_range", F.spark_partition_id())
    named = settle(named, "sources")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ranges = named.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").isNull(), "source")) - 1 + F.col("_base")
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    t = named.join(ranges, "_range").withColumn("weight", F.element_at(cycle, (place % len(weights) + 1).cast("int")).cast("long"))
    t = settle(t.select("source", "source_size", "weight", (F.col("source_size") * max_epochs).alias("_cap")), "weights")

    every, heavy = t.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    capped, rest, full = 0, heavy, F.lit(False)
    while True:
        # What the others leave to a weight of one is no less than the cap by weight.
        full = F.col("weight").cast("decimal(38,0)") * F.lit(every - capped) >= F.col("_cap").cast("decimal(38,0)") * F.lit(rest)
        c, w = t.agg(F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if (c, w) == (capped, rest) or not w:
            break
        capped, rest = c, w
    capped, rest = c, w
    share = F.lit(every - capped).cast("double") * F.col("weight").cast("double") / F.lit(float(rest or 1))
    return t.select("source", "source_size", "weight", F.when(full, F.col("_cap").cast("double")).otherwise(share).alias("target"))


def _source_key(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), c))


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, *more: Column) -> DataFrame:
    """``more`` and (_id, source, size, _key, _tie, _src) of every row."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("_tie"), *more)
    rows = rows.withColumn("_key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("")))))
    return rows.withColumn("_src", _source_key(F.col("source")))


def _place() -> Column:
    return F.struct("_key", "_id", "size", "_tie")


def source_cuts(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row a source: (_src, source_size, target, _epochs, _cut, _share).

    Rows before the place ``_cut`` are taken once more than ``_epochs`` times;
    each of the rows at it gives ``_share`` words more.  ``sized`` is read
    several times.
    """
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.expr("CAST(floor(target) AS BIGINT) div source_size")).otherwise(F.lit(0))
    sources = sources.select(_source_key(F.col("source")).alias("_src"), "source_size", "target", epochs.alias("_epochs"))
    sources = sources.withColumn("_left", F.floor("target") - F.col("_epochs") * F.col("source_size"))

    digits, n = 3, sized.count()
    while SLICE_ROWS << 4 * digits < n:
        digits += 1
    rows = sized.select("_src", F.substring("_key", 1, digits).alias("_slice"), "_key", "_id", "size", "_tie")
    slices = rows.groupBy("_src", "_slice").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("_src").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("_src", "_slice", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    order = Window.partitionBy("_src", "_slice").orderBy("_key", "_id", "size", "_tie")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.repartitionByRange("_src", "_slice").withColumn("_before", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("_upto", F.sum("size").over(upto))
    rows = rows.join(slices, ["_src", "_slice"]).join(sources.select("_src", "_left"), "_src")
    at = rows.where("_base + _before <= _left and _base + _upto > _left")
    cut = at.groupBy("_src").agg(F.min(F.struct((F.col("_base") + F.col("_before")).alias("from"), (F.col("_base") + F.col("_upto")).alias("to"), _place().alias("place"))).alias("_c"))
    same = F.greatest(F.expr("(_c.to - _c.from) div _c.place.size"), F.lit(1))
    out = sources.join(cut, "_src", "left").withColumn("_same", same)
    return out.select("_src", "source_size", "target", "_epochs", F.col("_c.place").alias("_cut"), F.expr("(_left - _c.from) div _same").alias("_share"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(id, source, size, source_size, target, taken) for every row of ``docs``,
    and the columns named by ``carry``.

    ``size`` counts words, 0 for a null text.  ``taken`` is how many of a row's
    words the mix takes, repeats counted; they sum to the whole part of the
    source's target, and the row at the cut gives only what is still wanted.
    Keys come from the identifier and the seed alone, so reruns agree; rows
    with equal or null identifiers are told apart by size and text.  Rows alike
    in all of these share a place: if the cut falls there, they share evenly
    what is still wanted, and its remainder, less than a word a row, is left.
    Null sources are a source of their own.  A source of empty texts, or an
    empty table, takes nothing.  Columns of the result's names among ``carry``
    would clash and are the caller's to leave out.
    """
    with scratch(docs.sparkSession):
        sized = settle(_measured(docs, id_col, text_col, source_col, seed), "sizes", keep=not carry)
        cuts = settle(source_cuts(sized, weights, max_epochs), "cuts", keep=True)  # one row a source
    rows = _measured(docs, id_col, text_col, source_col, seed, *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)]) if carry else sized
    rows = rows.join(small_side(cuts), "_src")
    part = F.when(_place() < F.col("_cut"), F.col("size")).when(_place() == F.col("_cut"), F.col("_share")).otherwise(F.lit(0))
    return rows.select(
        F.col("_id").alias(id_col),
        "source",
        "size",
        "source_size",
        "target",
        (F.col("_epochs") * F.col("size") + part).cast("long").alias("taken"),
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
    )

"""Spans of regular expressions as native columns.

Spark has no function that gives the places of all matches.  ``split`` and
``regexp_extract_all`` scan alike (leftmost, not overlapping), so the pieces
between matches and the matches themselves interleave, and running sums of
their lengths give the places in code points.

Long lists: a running sum inside ``aggregate`` would copy its list at each
step.  Lengths are summed by blocks instead, so n matches cost about
n * (BLOCK / 2) additions and (n / BLOCK) ** 2 / 2 more, and no list copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, v: a + v)


def _block_sums(steps: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(steps) / BLOCK).cast("int")), lambda b: _total(F.slice(steps, b * BLOCK + 1, BLOCK)))


def _sums_before(sums: Column) -> Column:
    return F.transform(sums, lambda _, i: _total(F.slice(sums, F.lit(1), i)))


def _places(matches: Column, pieces: Column, steps: Column, sums: Column, context: int) -> Column:
    def place(x: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        start = sums[block] + _total(F.slice(steps, block * BLOCK + 1, i - block * BLOCK)) + F.char_length(pieces[i])
        return F.struct(start.alias("start"), x.alias("m"), F.right(pieces[i], F.lit(context)).alias("before"), F.left(pieces[i + 1], F.lit(context)).alias("after"))

    return F.transform(matches, place)


def with_matches(df: DataFrame, text: str, kinds: dict[str, tuple[str, Column]], context: int = 0) -> DataFrame:
    """``df`` with a column ``_at_<kind>`` for each kind: its matches in order,
    as array<struct<start, stop, m, before, after>> (code points from 0, end
    exclusive; up to ``context`` characters of text before and after, no
    further than the neighbouring matches).  A kind is (pattern, guard); rows
    whose guard is false are not searched.  The steps are separate projections
    so that none is computed twice.
    """
    none = F.array().cast("array<string>")
    for kind, (pattern, guard) in kinds.items():
        df = df.withColumn(f"_m_{kind}", F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    for kind, (pattern, _) in kinds.items():
        df = df.withColumn(f"_p_{kind}", F.when(F.size(f"_m_{kind}") > 0, F.split(text, pattern, -1)).otherwise(none))
    for kind in kinds:
        step = F.zip_with(f"_p_{kind}", f"_m_{kind}", lambda p, m: F.coalesce(F.char_length(p), F.lit(0)) + F.coalesce(F.char_length(m), F.lit(0)))
        df = df.withColumn(f"_s_{kind}", step)
    for kind in kinds:
        df = df.withColumn(f"_b_{kind}", _block_sums(F.col(f"_s_{kind}")))
    for kind in kinds:
        df = df.withColumn(f"_c_{kind}", _sums_before(F.col(f"_b_{kind}")))
    for kind in kinds:
        df = df.withColumn(f"_at_{kind}", _places(*[F.col(f"_{x}_{kind}") for x in "mpsc"], context))
    return df.drop(*[f"_{x}_{kind}" for kind in kinds for x in "mpsbc"])


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def symbols(c: Column) -> Column:
    """The characters of a short string."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = F.transform(symbols(F.reverse(number)), lambda x, i: F.when(i % 2 == 1, x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)).otherwise(x.cast("int")))
    return _total(doubled) % 10 == 0


def mod97(code: Column) -> Column:
    """Remainder by 97 of an IBAN-like code: its first four characters go last,
    letters count from 10."""
    value = F.transform(symbols(F.concat(F.substring(code, 5, 1000), F.substring(code, 1, 4))), lambda x: F.when(x >= "A", F.ascii(x) - 55).otherwise(F.ascii(x) - 48))
    return F.aggregate(value, F.lit(0), lambda a, v: (a * F.when(v >= 10, 100).otherwise(10) + v) % 97)


def joined(spans: Column) -> Column:
    """``kind:start:stop`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

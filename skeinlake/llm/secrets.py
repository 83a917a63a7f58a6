"""Secrets in texts, natively (operator 9).

The base kinds are fixed forms: assignments to telling names, access key ids
and long hexadecimal runs.  The method adds ``random``: any long run of token
characters that a battery of tests takes for drawn at random.

The alphabet of a run is inferred first (hexadecimal, base 32, lower-case
alphanumeric, base 64).  Then

* a chi-squared statistic of its symbols against uniformity is compared with
  what prose of that length gives: ``p`` is the chance that prose looks as
  uniform, so a short run needs to be more even than a long one;
* a runs test (upper against lower half of the alphabet) and the serial
  correlation of neighbours ask for an order that chance would not give:
  sequences such as ``abcdefgh`` are even but not random.

A document's runs are two families of tests, each under the Benjamini-Hochberg
rule.  Those whose evenness is no chance of prose are found with a share of
false discoveries of ``RATE``; of these, the ones found orderly by the second
family, of two tests a run, with a share of ``ORDER_RATE``, are let go.

One scan, no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .spans import joined, symbols, with_matches

BASE = ("assign", "access", "hex")
RATE = 0.05
ORDER_RATE = 0.002
_NAMES = "password|passwd|secret|token|api_?key"
ASSIGN = rf"((?i:{_NAMES}))[\"']?+\x20*+[:=]\x20*+[\"']?+([A-Za-z0-9+/_.=-]++)"
PATTERNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]++", "hex": r"[0-9a-f]{16,}+", "random": r"[A-Za-z0-9+/=_-]{20,}+"}
#: Inferred encodings: pattern, symbols, coincidence rate of prose, its spread.
ENCODINGS = (
    ("^(?:[0-9a-f]+|[0-9A-F]+)$", 16, 0.1, 0.005),
    ("^[A-Z2-7]+$", 32, 0.066, 0.001),
    ("^[0-9a-z]+$", 36, 0.066, 0.001),
    ("", 64, 0.066, 0.001),
)


def _choose(x: Column, place: int) -> Column:
    out = F.lit(ENCODINGS[-1][place])
    for e in reversed(ENCODINGS[:-1]):
        out = F.when(x.rlike(e[0]), F.lit(e[place])).otherwise(out)
    return out


def _code(a: Column, size: Column) -> Column:
    """Number of a symbol (given by its ASCII code) in an alphabet of ``size``."""
    upper, lower, digit = a.between(65, 90), a.between(97, 122), a.between(48, 57)
    hexa = F.when(digit, a - 48).when(upper, a - 55).otherwise(a - 87)
    base32 = F.when(upper, a - 65).otherwise(a - 24)
    base36 = F.when(digit, a - 48).otherwise(a - 87)
    base64 = F.when(upper, a - 65).when(lower, a - 71).when(digit, a + 4).when(a.isin(43, 45), 62).otherwise(63)
    return F.when(size == 16, hexa).when(size == 32, base32).when(size == 36, base36).otherwise(base64)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _inferred(found: Column) -> Column:
    """The matches with the constants of their inferred encoding."""
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["m"].alias("m"), _choose(x["m"], 1).alias("a"), _choose(x["m"], 2).alias("ic"), _choose(x["m"], 3).alias("sp")))


def _with_codes(x: Column) -> Column:
    codes = F.transform(symbols(x["m"]), lambda s: _code(F.ascii(s), x["a"]))
    return F.struct(*[x[k].alias(k) for k in ("start", "m", "a", "ic", "sp")], codes.alias("c"), F.size(codes).cast("double").alias("n"))


def _with_sums(x: Column) -> Column:
    c, n, a = x["c"], x["n"], x["a"]
    squares = _sum(F.transform(F.sequence(F.lit(0), a - 1), lambda k: F.pow(F.size(F.filter(c, lambda v: v == k)).cast("double"), 2.0)))
    high = _sum(F.transform(c, lambda v: F.when(v * 2 >= a, 1.0).otherwise(0.0)))
    pairs = F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda u, v: F.struct(u.alias("u"), v.alias("v")))
    turns = _sum(F.transform(pairs, lambda q: F.when((q["u"] * 2 >= a) != (q["v"] * 2 >= a), 1.0).otherwise(0.0)))
    total = _sum(F.transform(c, lambda v: v.cast("double")))
    power = _sum(F.transform(c, lambda v: (v * v).cast("double")))
    products = _sum(F.transform(pairs, lambda q: (q["u"] * q["v"]).cast("double")))
    ends = (c[0] + F.element_at(c, -1)).cast("double")
    return F.struct(
        x["start"].alias("start"), x["m"].alias("m"), a.cast("double").alias("a"), x["ic"].alias("ic"), x["sp"].alias("sp"), n.alias("n"),
        squares.alias("squares"), high.alias("high"), (turns + 1.0).alias("runs"), total.alias("total"), power.alias("power"), products.alias("products"), ends.alias("ends"),
    )


def _with_scores(x: Column) -> Column:
    n, a = x["n"], x["a"]
    chi = a / n * x["squares"] - n
    prose = n * (a * x["ic"] - 1.0) + a - 1.0
    spread = F.sqrt(4.0 * n * a * a * x["sp"] + 2.0 * (a - 1.0))
    z = (chi - prose) / spread
    p = 1.0 / (1.0 + F.exp(-(1.5976 * z + 0.070565 * z * z * z)))
    both = 2.0 * x["high"] * (n - x["high"])
    var = both * (both - n) / (n * n * (n - 1.0))
    z_runs = F.when(var > 0, (x["runs"] - both / n - 1.0) / F.sqrt(var)).otherwise(99.0)
    mean = x["total"] / n
    under = x["power"] - n * mean * mean
    over = x["products"] - mean * (2.0 * x["total"] - x["ends"]) + (n - 1.0) * mean * mean
    z_serial = F.when(under > 0, over / under * F.sqrt(n)).otherwise(99.0)

    def chance(z: Column) -> Column:
        """How often chance gives a z as large, on either side."""
        return 2.0 / (1.0 + F.exp(1.5976 * F.abs(z) + 0.070565 * F.abs(z) * F.abs(z) * F.abs(z)))

    return F.struct(x["start"].alias("start"), x["m"].alias("m"), p.alias("p"), chance(z_runs).alias("p_runs"), chance(z_serial).alias("p_serial"))


def _discovered(ps: str, rate: float) -> Column:
    """Benjamini-Hochberg: the largest of a sorted list of p that stays under
    its rank's share, or -1."""
    under = F.filter(F.transform(ps, lambda p, i: F.when(p <= (i + 1).cast("double") * rate / F.size(ps).cast("double"), p)), lambda p: p.isNotNull())
    return F.coalesce(F.array_max(under), F.lit(-1.0))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for every row: spans by start, then by kind, each a struct of
    start, rank, kind, stop and text; places in code points, the end exclusive.

    Null and empty texts have no spans.  Whole texts are searched, whatever
    their length.  Identifiers may be null or repeat: rows are independent.
    Other columns are ignored, and an empty table gives an empty result.
    """
    text, always = F.col("_text"), F.lit(True)
    guards = {"access": F.contains(text, F.lit("AKIA"))}
    base = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    found = with_matches(base, "_text", {k: (v, guards.get(k, always)) for k, v in PATTERNS.items()})
    for step in (None, _with_codes, _with_sums, _with_scores):
        found = found.withColumn("_at_random", _inferred(F.col("_at_random")) if step is None else F.transform("_at_random", step))
    orders = F.concat(F.transform("_at_random", lambda x: x["p_runs"]), F.transform("_at_random", lambda x: x["p_serial"]))
    found = found.withColumn("_ps", F.array_sort(F.transform("_at_random", lambda x: x["p"]))).withColumn("_os", F.array_sort(orders))
    found = found.withColumn("_cut", _discovered("_ps", RATE)).withColumn("_odd", _discovered("_os", ORDER_RATE))
    chosen = F.filter("_at_random", lambda x: (x["p"] <= F.col("_cut")) & (x["p_runs"] > F.col("_odd")) & (x["p_serial"] > F.col("_odd")))
    kept = {
        "assign": F.filter("_at_assign", lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 12),
        "access": F.filter("_at_access", lambda x: F.length(x["m"]) >= 18),
        "hex": F.col("_at_hex"),
        "random": chosen,
    }
    spans = [_span(v, k, r) for r, (k, v) in enumerate(kept.items())]
    return found.select(F.col("_id").alias(id_col), F.array_sort(F.concat(*spans)).alias("spans"))


def _span(found: Column, kind: str, rank: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (x["start"] + F.char_length(x["m"])).alias("stop"), x["m"].alias("text")))


def secret_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, a digest of the base spans and all spans as a string."""

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(id_col, *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("random"))

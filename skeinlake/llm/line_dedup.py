"""Line dedup by a deletion-neighbourhood join, natively (operator 1).

A line goes if an earlier line (by document, then by place) is the same or lies
within its edit bound.  An edit is one word put in, left out or replaced: a
typing error or another number changes one word, wherever it is, and a line has
as many variants as words.  The bound is one edit in a line, of at least
``WORDS`` words: of fewer, one word makes too much of a difference (``page 3``
is not a copy of ``page 4``), so for those the bound is none.

* Same lines meet by a 128-bit key; only keys and places are shuffled.
* A line's variants are what is left without one of its words.  Two lines of a
  length that share a variant at a place are one replacement apart; a line
  that equals another's variant is one omission apart.  Variants are keyed by
  an order-sensitive hash of neighbouring words which a word's removal changes
  in O(1), so a line of n words costs n, not n squared.
* Lines without any near partner need no variants: one edit leaves either the
  first or the last half of a line as it was, so only lines that share a half
  with another are candidates.  Nothing is lost by that.
* Candidates' texts come from a second scan, which a bitmap of their places,
  of bounded size, thins out before lines are looked at; the exact join follows.
* Pairs (each line with the earliest that shares its variant, never all pairs)
  are verified word by word.

Skew: groups are reduced by aggregates that combine on the map side; the rows
that are joined back to them are spread by adaptive skew handling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, scratch, settle, text_or_empty
from .reduce import bitmap, thinned

WORDS = 8


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_d, _r, _lines): identifier, hash of the row's text, lines."""
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("_d"), F.xxhash64(text).alias("_r"), F.split(text, "\n", -1).alias("_lines"))


def _normal(line: Column) -> Column:
    """One space for each run of white space, none at the ends.  Most lines
    have single spaces only, which a byte search tells faster than a pattern."""
    odd = F.contains(line, F.lit("  "))
    for c in "\t\x0b\x0c\r":
        odd = odd | F.contains(line, F.lit(c))
    return F.trim(F.when(odd, F.regexp_replace(line, SPACE, " ")).otherwise(line))


def _raw_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_d, _r, _no, _line): lines as they are."""
    return _rows(docs, id_col, text_col).select("_d", "_r", F.posexplode("_lines").alias("_no", "_line"))


def _keyed(raw: DataFrame) -> DataFrame:
    """(_d, _r, _no, line, k1, k2): lines that are not blank, normalised, with their keys."""
    lines = raw.select("_d", "_r", "_no", _normal(F.col("_line")).alias("line")).where("line <> ''")
    return lines.withColumn("k1", F.xxhash64("line")).withColumn("k2", F.xxhash64(F.lit(7), "line"))


def _half_keys(line: Column, n: Column) -> Column:
    """Hashes of a line's first and last h words.  h is the largest power of two
    within half of the line; lines of exactly 2h words, whose shorter
    neighbours have a smaller h, also give those of h / 2."""
    h = F.expr("shiftleft(1, length(bin(n div 2)) - 1)")

    def keys(k: Column) -> list[Column]:
        return [F.xxhash64(F.lit(side), k, F.call_function("substring_index", line, F.lit(" "), k * side)) for side in (1, -1)]

    return F.when(n == 2 * h, F.array(*keys(h), *keys((h / 2).cast("int")))).otherwise(F.array(*keys(h)))


def _variants(texts: DataFrame) -> DataFrame:
    """(k1, k2, v, len, p): each line's own key (p = -1) and those of its
    variants without word p.  Keys xor the hashes of neighbouring words."""
    ends = F.concat(F.array(F.lit("")), F.col("w"), F.array(F.lit("")))
    t = texts.select("k1", "k2", F.size("w").alias("n"), ends.alias("e"))
    t = t.withColumn("m", F.transform(F.slice("e", F.lit(1), F.col("n") + 1), lambda x, i: F.xxhash64(x, F.col("e")[i + 1])))
    t = t.withColumn("all", F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x)))
    without = F.transform(
        F.slice("m", F.lit(1), F.col("n")), lambda x, i: F.struct(F.col("all").bitwiseXOR(x).bitwiseXOR(F.col("m")[i + 1]).bitwiseXOR(F.xxhash64(F.col("e")[i], F.col("e")[i + 2])).alias("v"), i.alias("p"))
    )
    own = F.array(F.struct(F.col("all").alias("v"), F.lit(-1).alias("p")))
    t = t.select("k1", "k2", "n", F.explode(F.concat(own, without)).alias("x"))
    return t.select("k1", "k2", F.col("x.v").alias("v"), F.when(F.col("x.p") < 0, F.col("n")).otherwise(F.col("n") - 1).alias("len"), F.col("x.p").alias("p"))


def _near(firsts: DataFrame, raw: DataFrame) -> DataFrame:
    """(k1, k2): lines that are within one edit of an earlier line."""
    keyed = firsts.where(f"n >= {WORDS}").select("k1", "k2", "pos", F.explode("halves").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo <> hi").select("key")
    found = settle(keyed.join(shared, "key").select("k1", "k2", "pos").distinct(), "candidates")
    lines = _keyed(thinned(raw, bitmap(found, F.xxhash64("pos._d", "pos._r", "pos._no")), F.xxhash64("_d", "_r", "_no")))
    lines = lines.select("k1", "k2", F.struct("_d", "_r", "_no").alias("pos"), F.split("line", " ").alias("w"))
    texts = settle(lines.join(found, ["k1", "k2", "pos"]).dropDuplicates(["k1", "k2"]), "candidate-lines")

    rows = _variants(texts)
    met = rows.groupBy("v", "len").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo <> hi").select("v", "len")
    rows = rows.join(met, ["v", "len"]).join(texts.select("k1", "k2", "pos"), ["k1", "k2"])
    rows = settle(rows, "variants")
    least = rows.groupBy("v", "len", "p").agg(F.min(F.struct("pos", "k1", "k2")).alias("c"))
    members = rows.join(least, ["v", "len", "p"]).where("p >= 0 and pos > c.pos")
    replaced = members.select("k1", "k2", F.col("c.k1").alias("c1"), F.col("c.k2").alias("c2"), F.lit(-1).alias("p"))
    whole = rows.where("p < 0").select("v", "len", F.col("pos").alias("ypos"), F.col("k1").alias("y1"), F.col("k2").alias("y2"))
    left_out = rows.where("p >= 0").join(whole, ["v", "len"]).select(F.col("k1").alias("x1"), F.col("k2").alias("x2"), "pos", "p", "y1", "y2", "ypos")

    long, short = texts.select(F.col("k1").alias("x1"), F.col("k2").alias("x2"), F.col("w").alias("wx")), texts.select(F.col("k1").alias("y1"), F.col("k2").alias("y2"), F.col("w").alias("wy"))
    replaced = replaced.toDF("x1", "x2", "y1", "y2", "p").drop("p").distinct().join(long, ["x1", "x2"]).join(short, ["y1", "y2"])
    differ = F.aggregate(F.zip_with("wx", "wy", lambda a, b: F.when(a == b, 0).otherwise(1)), F.lit(0), lambda a, x: a + x)
    replaced = replaced.where((F.size("wx") == F.size("wy")) & (differ <= 1)).select(F.col("x1").alias("k1"), F.col("x2").alias("k2"))
    left_out = left_out.join(long, ["x1", "x2"]).join(short, ["y1", "y2"])
    left_out = left_out.where(F.concat(F.slice("wx", F.lit(1), F.col("p")), F.slice("wx", F.col("p") + 2, F.size("wx"))) == F.col("wy"))
    later = F.when(F.col("pos") > F.col("ypos"), F.struct(F.col("x1").alias("k1"), F.col("x2").alias("k2"))).otherwise(F.struct(F.col("y1").alias("k1"), F.col("y2").alias("k2")))
    return replaced.unionByName(left_out.select(later.alias("z")).select("z.k1", "z.k2")).distinct()


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_d, _r, kept): for each row with kept lines, those as a map from
    ``line number div 64`` to bits."""
    with scratch(docs.sparkSession):
        return settle(_kept(docs, id_col, text_col), "kept-lines", keep=True)


def _kept(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    raw = _raw_lines(docs, id_col, text_col)
    lines = _keyed(raw).withColumn("n", (F.char_length("line") - F.char_length(F.replace("line", F.lit(" "), F.lit(""))) + 1).cast("int"))
    halves = F.when(F.col("n") >= WORDS, _half_keys(F.col("line"), F.col("n")))
    keyed = lines.select("k1", "k2", F.struct("_d", "_r", "_no").alias("pos"), "n", halves.alias("halves"))
    firsts = keyed.groupBy("k1", "k2").agg(F.min("pos").alias("pos"), F.first("n").alias("n"), F.first("halves").alias("halves"))
    firsts = settle(firsts, "first-lines")
    kept = firsts.join(_near(firsts, raw), ["k1", "k2"], "left_anti").select("pos.*")
    bits = kept.groupBy("_d", "_r", F.expr("_no div 64").cast("int").alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, _no % 64)")).alias("bits"))
    return bits.groupBy("_d", "_r").agg(F.map_from_entries(F.collect_list(F.struct("block", "bits"))).alias("kept"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` rid of repeated lines, and two counts more:
    ``n_lines`` and ``n_kept``, of lines that are not blank.

    Lines are parted by newlines and compared with runs of ASCII white space
    as one space and none at the ends; blank lines are no lines and stay where
    they are.  Null texts have no lines and stay null.  Null identifiers come
    first in the order.  Rows that repeat an identifier and a text are one
    place in the order and keep the same lines.  Rows stay, even if all their
    lines go.  Other columns pass, whatever their names, but for those named
    as the two counts, which give way.  An empty table gives an empty result.
    """
    places = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows, id_at, text_at = docs.toDF(*places.values()), places[id_col], places[text_col]
    kept = kept_lines(rows, id_at, text_at).select(F.col("_d").alias("_kd"), F.col("_r").alias("_kr"), "kept")
    text = text_or_empty(text_at)
    rows = rows.withColumn("_lr", F.xxhash64(text))
    rows = rows.join(kept, (F.col("_lr") == F.col("_kr")) & F.col(id_at).eqNullSafe(F.col("_kd")), "left").withColumnRenamed("kept", "_kept")
    rows = rows.withColumn("_lines", F.split(text, "\n", -1))
    blocks = F.transform(F.sequence(F.lit(0), F.expr("CAST((size(_lines) - 1) div 64 AS INT)")), lambda b: F.struct(b.alias("b"), F.coalesce(F.element_at("_kept", b), F.lit(0).cast("long")).alias("bits")))
    rows = rows.withColumn("_blocks", blocks)

    def some(s: Column) -> Column:
        return F.filter(F.slice("_lines", s["b"] * 64 + 1, 64), lambda x, i: F.call_function("getbit", s["bits"], i).cast("int").eqNullSafe(F.lit(1)) | ~x.rlike(r"[^\x20\x09-\x0D]"))

    rows = rows.withColumn("_out", F.flatten(F.transform("_blocks", some)))
    full = lambda c: F.size(F.filter(c, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    out = {c: F.col(p) for c, p in places.items() if c not in ("n_lines", "n_kept")}
    out[text_col] = F.when(F.col(text_at).isNotNull(), F.array_join("_out", "\n"))
    return rows.select(*[v.alias(k) for k, v in out.items()], full("_lines").alias("n_lines"), full("_out").alias("n_kept"))

"""Personal data in texts, natively (operator 6).

Regular expressions propose spans; validators (Luhn for cards, the remainder
by 97 for account numbers, ranges for addresses, digit counts for phones, the
parts that are never given out for identity numbers) confirm them; whole words
near a span raise its score.  The base kinds are always reported; the added
kinds (``iban``, ``idno``) only from ``LEAST`` points on.

One scan of the texts, no shuffle, no Python.  The patterns are the plain ones
with possessive repeats and anchors, under which they match the same spans but
take linear time on long runs of letters or digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .spans import digits, joined, luhn, mod97, with_matches

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "idno")
CONTEXT = 40
LEAST = 50

_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    # A match starts where its run of characters does, or where the last match ended.
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)",
    "idno": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
#: Points of a confirmed span, and more if a context word is near.
POINTS = {"email": (90, 5), "ip": (60, 30), "card": (80, 15), "phone": (70, 20), "iban": (85, 10), "idno": (30, 40)}
WORDS = {
    "email": "e?mails?|contact|write|kontakt|correo|courriel",
    "ip": "addr|address|servers?|hosts?|login|clients?",
    "card": "cards?|visa|master|mastercard|credit|payments?|karte|carte|tarjeta",
    "phone": "phones?|calls?|tel|telephone|telefon|telefono|mobile|fax|ruf",
    "iban": "iban|accounts?|bank|konto|compte|cuenta",
    "idno": "ssn|social|security|identity|tax",
}
#: Whole words of ASCII letters only: ``tel`` is not in ``hotel``.
NEAR = {k: f"(?:^|[^a-z])(?:{w})(?:[^a-z]|$)" for k, w in WORDS.items()}
#: Identity numbers whose parts are all in use: no 000, 666 or 9.. before, no zeros after.
IDNO = r"^(?:00[1-9]|0[1-9][0-9]|[1-578][0-9]{2}|6(?:[0-57-9][0-9]|6[0-57-9]))-(?:0[1-9]|[1-9][0-9])-(?:000[1-9]|00[1-9][0-9]|0[1-9][0-9]{2}|[1-9][0-9]{3})$"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(r"^" + r"\.".join([r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"] * 4) + "$")
    if kind == "card":
        return F.length(digits(m)).between(14, 19) & luhn(F.when(F.length(digits(m)).between(14, 19), digits(m)).otherwise(""))
    if kind == "phone":
        return F.length(digits(m)).between(10, 15)
    if kind == "iban":
        return F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34) & (mod97(F.replace(m, F.lit(" "), F.lit(""))) == 1)
    return m.rlike(IDNO) if kind == "idno" else F.lit(True)


def _spans(kind: str, order: int) -> Column:
    sure, more = POINTS[kind]

    def span(x: Column) -> Column:
        near = F.translate(F.concat(x["before"], F.lit("\n"), x["after"]), _CAPITALS, _SMALL)
        points = F.lit(sure) + F.when(near.rlike(NEAR[kind]), more).otherwise(0)
        stop = x["start"] + F.char_length(x["m"])
        return F.struct(x["start"].alias("start"), F.lit(order).alias("rank"), F.lit(kind).alias("kind"), stop.alias("stop"), x["m"].alias("text"), points.alias("points"))

    found = F.transform(F.filter(f"_at_{kind}", lambda x: _valid(kind, x["m"])), span)
    return F.filter(found, lambda s: s["points"] >= LEAST) if kind in ADDED else found


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for every row: spans by start, then by kind, each a struct of
    start, rank, kind, stop, text and points; places in code points, the end
    exclusive.

    Null and empty texts have no spans.  Whole texts are searched, whatever
    their length.  Identifiers may be null or repeat: rows are independent.
    Other columns are ignored, and an empty table gives an empty result.
    """
    text = F.col("_text")
    has_digit = text.rlike("[0-9]")
    guards = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "iban": text.rlike("[A-Z]{2}[0-9]{2}")}
    base = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).withColumn("_digit", has_digit)
    found = with_matches(base, "_text", {k: (PATTERNS[k], guards.get(k, F.col("_digit"))) for k in (*BASE, *ADDED)}, CONTEXT)
    spans = F.array_sort(F.concat(*[_spans(k, i) for i, k in enumerate((*BASE, *ADDED))]))
    return found.select(F.col("_id").alias(id_col), spans.alias("spans"))


def pii_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, a digest of the base spans and all spans as a string."""

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    points = F.coalesce(F.array_max(F.transform("spans", lambda s: s["points"])), F.lit(0)).cast("long")
    return found.select(id_col, *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), *[count(k) for k in ADDED], points.alias("top_points"))

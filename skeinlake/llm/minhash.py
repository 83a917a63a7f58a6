"""Near-duplicate documents by one-permutation MinHash (operator 7).

A document's set of word shingles is hashed once; the top bits of a hash name
one of ``BINS`` bins, and a bin keeps its smallest hash.  An empty bin borrows
from a bin drawn for it (optimal densification: each empty bin has an order of
its own, the same in every document, so that borrowed values collide with the
probability of the similarity).  Bins are cut into bands; documents that agree
in a band share a bucket.

Pairs stay linear in the documents: a bucket elects one centre, drawn anew for
each bucket, and every other member is paired with it only.  A pair that is
similar but whose centre is not meets again in the other bands, under other
centres, and in the finer buckets of two bands, which bad centres rarely
reach.  Equal sets are folded into one representative first.

Links are confirmed on the full sets, natively: first the best centre of each
document; then, of the pairs that these links do not already connect, the
rest.  Components are the classes.  Then turns follow over finer buckets, of
two bands each, which bad centres rarely reach.  Only buckets whose members
lie in several components take part, and a centre is paired only with members
of other components than its own, so a document that has found its class costs
nothing more.  The first turn draws these centres anew; later ones take them
from the documents that the last turn has linked, through which others may be
reached.  Turns end when one finds no link, however many it takes.

At a similarity of 0.8 a band of 4 is shared with probability 0.41 and all 32
are missed with 5e-8; two bands are shared with probability 0.17 and the 64
finer buckets are missed with 7e-6.  No count of partners, centres or turns is
limited.  What is not guaranteed is that a similar pair meets: a bucket never
emits all its pairs, so a link that no centre hits, in no bucket and turn, is
lost if nothing else connects its ends.  The README has the recall of links
against brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SMALL_ROWS, map_arrow, scratch, settle, small_side
from .components import components
from .kernels import Powers, _mix, byte_classes, chain, chunks, lower_values, string_buffers, word_hashes, word_spans

BINS = 128
ROWS = 4
BANDS = BINS // ROWS
SHINGLE = 5
SIMILAR = 80  # of 100
#: How far from each other the two bands of a finer bucket are.
APART = (1, 2)
#: Centres that a finer bucket draws in the first turn.
DRAWS = 2


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text, in order."""
    offsets, data = string_buffers(texts)
    powers, values, is_word = Powers(), lower_values(), byte_classes("space")
    for a, b in chunks(offsets):
        part, rel = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = word_spans(part, rel, is_word)
        h = word_hashes(part, starts, ends, powers, values)
        s = h
        for k in range(1, size):
            s = chain(s[:-1], h[k:]) if len(s) > 1 else s[:0]
        for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if j - i >= size:
                yield np.unique(s[i : j - size + 1])
            elif j > i:
                whole = h[i : i + 1] + np.uint64(j - i)
                for k in range(i + 1, j):
                    whole = chain(whole, h[k : k + 1])
                yield whole
            else:
                yield h[:0]


class Signer:
    """Band hashes of shingle sets."""

    def __init__(self, bins: int = BINS, rows: int = ROWS) -> None:
        self.bins, self.rows = bins, rows
        self.shift = np.uint64(64 - (bins - 1).bit_length())
        self.edges = np.arange(bins, dtype=np.uint64) << self.shift
        order = np.random.default_rng(7).random((bins, bins))
        self.donors = np.argsort(order, axis=1)
        self.band_salt = _mix(np.arange(1, bins // rows + 1, dtype=np.uint64))

    def bands(self, s: np.ndarray) -> np.ndarray:
        at = np.searchsorted(s, self.edges)
        have = np.append(at[1:], len(s)) > at
        low = s[np.minimum(at, len(s) - 1)]
        empty = np.flatnonzero(~have)
        if len(empty):
            donors = self.donors[empty]
            low[empty] = low[donors[np.arange(len(empty)), have[donors].argmax(1)]]
        low = low.reshape(-1, self.rows)
        out = self.band_salt
        for k in range(self.rows):
            out = chain(out, low[:, k])
        return out


def signatures(docs: DataFrame, size: int, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """(_id, n, f1, f2, bands): set size, set fingerprint and band hashes of each (_id, _text)."""
    schema = f"_id {docs.schema['_id'].dataType.simpleString()}, n bigint, f1 bigint, f2 bigint, bands array<bigint>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bins, rows)
        for batch in batches:
            n, f1, f2, bands, cuts = [], [], [], [], [0]
            for s in shingle_sets(batch.column(1), size):
                n.append(len(s))
                f1.append(np.bitwise_xor.reduce(_mix(s)) if len(s) else np.uint64(0))
                f2.append(np.add.reduce(_mix(s + np.uint64(99))) if len(s) else np.uint64(0))
                if len(s):
                    bands.append(signer.bands(s))
                cuts.append(cuts[-1] + (bins // rows if len(s) else 0))
            flat = np.concatenate(bands) if bands else np.zeros(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat.view(np.int64)))
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (f1, f2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *longs, lists], ["_id", "n", "f1", "f2", "bands"])

    return map_arrow(docs, work, schema)


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """(_id, s): the whole shingle set of each (_id, _text)."""
    schema = f"_id {docs.schema['_id'].dataType.simpleString()}, s array<bigint>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                sets = list(shingle_sets(part.column(1), size))
                cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))], ["_id", "s"])

    return map_arrow(docs, work, schema)


def _keys(nodes: DataFrame, buckets: Column, *also: str) -> DataFrame:
    return nodes.select("_id", *also, F.explode(buckets).alias("key"))


class _Draw:
    """Random orders of the members of a bucket, whose least is its centre.

    A whole-number identifier is xor-ed with a hash of the bucket and the
    draw's number, which can be undone, so that a draw is a minimum of one
    long; others are ordered by a hash.
    """

    def __init__(self, nodes: DataFrame, number: int) -> None:
        self.whole, self.salt = nodes.schema["_id"].dataType.typeName() == "long", F.xxhash64("key", F.lit(number))
        self.order = F.col("_id").bitwiseXOR(self.salt) if self.whole else F.struct(F.xxhash64("_id", self.salt), F.col("_id").alias("i"))

    def member(self, least: str) -> Column:
        return F.col(least).bitwiseXOR(self.salt) if self.whole else F.col(f"{least}.i")


def _star_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b, shared): pairs of a bucket's centre and its members, with the
    number of buckets that pair them.  One bucket a band."""
    keys, draw = _keys(nodes, F.col("bands")), _Draw(nodes, -1)
    centres = keys.groupBy("key").agg(F.min(draw.order).alias("lo"), F.max(draw.order).alias("hi")).where("hi <> lo")
    centres = settle(centres.select("key", draw.member("lo").alias("c")), "star-centres")  # so that the join can split a large bucket
    pairs = keys.join(centres, "key").where("_id <> c")
    return pairs.groupBy(F.least("_id", "c").alias("a"), F.greatest("_id", "c").alias("b")).agg(F.count(F.lit(1)).alias("shared"))


def _twos(nodes: DataFrame) -> DataFrame:
    """(key, _id): the buckets of two bands, ``APART`` bands from each other."""
    of = "transform(sequence(0, size(bands) - 1), i -> xxhash64(bands[i], bands[(i + {0}) % size(bands)], i, {0}))"
    return _keys(nodes, F.concat(*[F.expr(of.format(k)) for k in APART]))


def _mixed(keys: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``keys`` in buckets of several components."""
    rows = keys.join(known.drop("n"), "_id")
    buckets = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return settle(keys.join(settle(buckets, "buckets"), "key"), "keys")


def _turn_pairs(keys: DataFrame, known: DataFrame, turn: int, ends: DataFrame | None) -> DataFrame:
    """(a, b): centres of buckets, each with the members of other components
    than its own.  The first turn draws ``DRAWS`` of all members, later ones
    one of the ``ends`` (_id, root) of the links found last.  A draw is the
    least of its members, component by component first, so that it combines on
    the map side."""
    rows = keys.join(known.drop("n"), "_id")
    drawn_from = rows if ends is None else keys.join(small_side(ends), "_id")
    draws = {f"d{i}": _Draw(keys, turn * DRAWS + i) for i in range(DRAWS if ends is None else 1)}
    parts = drawn_from.groupBy("key", "root").agg(*[F.min(d.order).alias(x) for x, d in draws.items()])
    centres = parts.groupBy("key").agg(*[F.min(F.struct(x, "root")).alias(f"m_{x}") for x in draws])
    centres = centres.select("key", *[F.col(f"m_{x}.{x}").alias(x) for x in draws], *[F.col(f"m_{x}.root").alias(f"of_{x}") for x in draws])
    each = F.array_distinct(F.array(*[F.struct(d.member(x).alias("c"), F.col(f"of_{x}").alias("of")) for x, d in draws.items()]))
    centres = settle(centres.select("key", F.explode(each).alias("e")).select("key", "e.c", "e.of"), "centres")
    met = rows.join(centres, "key").where("root <> of")
    return met.select(F.least("_id", "c").alias("a"), F.greatest("_id", "c").alias("b")).distinct()


def _apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b) of two components, with what is known of both."""
    for x in ("a", "b"):
        pairs = pairs.join(known.select(F.col("_id").alias(x), F.col("root").alias(f"r{x}"), F.col("n").alias(f"n{x}")), x)
    return pairs.where("ra <> rb")


def _confirmed(pairs: DataFrame, known: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b), not connected so far, whose full sets are similar
    enough; pairs whose sizes rule that out never meet their sets, and sets
    without a pair stay behind if a broadcast can tell them.

    Skew: the centre of a large bucket has as many pairs as that has members.
    Each join is of two shuffled sides, of which Spark splits a large part."""
    hundred, least = F.lit(100), F.lit(similar)
    fit = hundred * F.least("na", "nb") >= least * F.greatest("na", "nb")
    pairs = settle(_apart(pairs.select("a", "b"), known).where(fit | F.isnull("na") | F.isnull("nb")).select("a", "b"), "pairs")
    met = settle(pairs.select(F.col("a").alias("_id")).unionByName(pairs.select(F.col("b").alias("_id"))).distinct(), "met")
    if met.count() <= SMALL_ROWS:
        sets = sets.join(F.broadcast(met), "_id", "left_semi")
    for x in ("b", "a"):
        pairs = pairs.join(sets.select(F.col("_id").alias(x), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}")), x)
    pairs = pairs.withColumn("_in", F.size(F.array_intersect("sa", "sb")))
    return pairs.where(hundred * F.col("_in") >= least * (F.col("na") + F.col("nb") - F.col("_in"))).select("a", "b")


def _joined(known: DataFrame, links: DataFrame) -> DataFrame:
    """(_id, root, n) after more links: components of components."""
    merged = components(_apart(links, known).select("ra", "rb"), "ra", "rb")
    known = known.join(merged.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left")
    return settle(known.select("_id", F.coalesce("_to", "root").alias("root"), "n"), "roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    Words are split at ASCII white space, A-Z lower-cased; a text of fewer than
    ``size`` words is one shingle; null, empty and blank texts have none and
    link with nothing.  Rows that share an identifier are one document: their
    texts are linked with each other, each row comes back once with its own
    ``n_shingles``, and they are kept together.  Identifiers may be of any
    ordered type.  A row whose identifier is null links with nothing, has a
    null ``component_id`` and is kept.  An empty table gives an empty result;
    further columns are ignored.

    Sets are compared as sets of 64-bit shingle hashes, all of them; sets count
    as equal when their sizes and 128 bits of two order-free sums of these
    hashes agree.
    """
    with scratch(docs.sparkSession):
        return settle(_classes(docs, id_col, text_col, size, similar), "classes", keep=True)


def _classes(docs: DataFrame, id_col: str, text_col: str, size: int, similar: int) -> DataFrame:
    kind = docs.schema[id_col].dataType
    key = F.col(id_col).cast("long") if isinstance(kind, T.IntegralType) else F.col(id_col)
    base = docs.select(key.alias("_id"), F.col(text_col).cast("string").alias("_text"))
    signed = settle(signatures(base, size), "signatures")
    nodes = signed.where("n > 0 and _id is not null").groupBy("f1", "f2", "n").agg(F.min("_id").alias("_id"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("rows"))
    nodes = settle(nodes, "nodes")
    folded = nodes.where("rows > 1").select("f1", "f2", "n", F.col("_id").alias("_rep"))
    rows = settle(signed.drop("bands").join(folded, ["f1", "f2", "n"], "left").select("_id", "n", F.coalesce("_rep", "_id").alias("_node")), "rows")

    # Texts of one identifier are linked, whatever their sets: by bearing its name, or here.
    own = rows.where("n > 0 and _id is not null")
    twins = own.groupBy("_id").agg(F.min("_node").alias("a"), F.max("_node").alias("_hi")).where("a <> _hi").select("_id", "a")
    twins = settle(own.join(twins, "_id").where("_node <> a").select("a", F.col("_node").alias("b")).distinct(), "twins")

    stars = settle(_star_pairs(nodes), "stars")
    wanted = stars.select(F.col("a").alias("_id")).unionByName(stars.select(F.col("b").alias("_id"))).distinct()
    wanted = settle(wanted, "wanted")
    # As many texts as have a partner: this join is sorted and merged at any size.
    sets = full_sets(base.join(wanted.hint("merge"), "_id"), size).where("size(s) > 0").withColumn("n", F.size("s").cast("long"))
    sets = settle(sets.withColumn("h", F.xxhash64("s")).dropDuplicates(["_id", "n", "h"]).drop("h"), "sets")

    close = settle(nodes.join(wanted, "_id").select("_id", "bands"), "close")
    # What is known of a node: its component and, if it has one text, its size.
    sizes = sets.groupBy("_id").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("_k")).select("_id", F.when(F.col("_k") == 1, F.col("n")).alias("n"))
    known = wanted.unionByName(twins.select(F.col("a").alias("_id"))).unionByName(twins.select(F.col("b").alias("_id"))).distinct()
    known = settle(known.join(sizes, "_id", "left").select("_id", F.col("_id").alias("root"), "n"), "roots")
    first = stars.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("m")).select("m.a", "b")
    known = _joined(known, settle(_confirmed(first, known, sets, similar).unionByName(twins), "confirmed"))
    known = _joined(known, settle(_confirmed(stars, known, sets, similar), "confirmed"))
    keys, ends, turn = _mixed(_twos(close), known), None, 0
    while True:
        links = settle(_confirmed(_turn_pairs(keys, known, turn, ends), known, sets, similar), "confirmed")
        if links.isEmpty():
            break
        known, turn = _joined(known, links), turn + 1
        both = links.select(F.col("a").alias("_id")).unionByName(links.select(F.col("b").alias("_id"))).distinct()
        ends = settle(both.join(known, "_id").select("_id", "root"), "ends")

    out = rows.join(known.select(F.col("_id").alias("_node"), "root"), "_node", "left")
    component = F.when(F.col("_id").isNotNull() & (F.col("n") > 0), F.coalesce("root", "_node")).otherwise(F.col("_id"))
    return out.select(
        F.col("_id").cast(kind).alias(id_col),
        F.col("n").alias("n_shingles"),
        component.cast(kind).alias("component_id"),
        component.eqNullSafe(F.col("_id")).alias("kept"),
    )

"""Quality by an n-gram language model of trusted text (operator 5).

An interpolated modified Kneser-Ney model over four symbols (UTF-16 code
units; digits and white space are folded) is counted on all trusted texts.
Documents are scored by bits a symbol; a document goes if it needs more bits
than nearly all held-out trusted texts of its language, with some room for
short texts.

All counts are tables that grow with the corpus, and none is collected or
broadcast.  Documents are packed into compressed blocks of about ``BLOCK``
bytes of text (a longer text is a block of its own).  A block asks once for
each of its distinct n-grams; the asked n-grams join the sharded counts of
four orders and their contexts; the answers go back by block, where the
documents are scored.  So what is shuffled is the distinct n-grams of a block
and not each of its positions, and a worker holds the answers and the texts of
one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, release, scratch, settle, small_side
from .reduce import bitmap, thinned

BLOCK = 32 << 20
PIECE = 1 << 18
QUANTILE = 0.99
MARGIN = 0.1
SHORT = 4.0
HELD_OUT = 5
VOCABULARY = 1 << 16
NO_ESTIMATE = (0.5, 0.75, 0.9)

_SYMBOL = np.arange(1 << 16, dtype=np.uint16)
_SYMBOL[ord("0") : ord("9") + 1] = ord("0")
_SYMBOL[9:14] = 32
_SYMBOL[0xA0] = 32


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 4-grams at the positions of texts joined by three blanks, and where
    each text starts and ends among them."""
    a = _SYMBOL[np.frombuffer(("   " + "   ".join(texts) + " ").encode("utf-16-le", "surrogatepass"), np.uint16)].astype(np.uint64)
    g = (a[:-4] << np.uint64(48)) | (a[1:-3] << np.uint64(32)) | (a[2:-2] << np.uint64(16)) | a[3:-1]
    sizes = np.array([len(t) if t.isascii() else len(t.encode("utf-16-le", "surrogatepass")) // 2 for t in texts], np.int64)
    starts = np.cumsum(np.concatenate([[0], sizes[:-1] + 3])) if len(texts) else sizes
    return g.view(np.int64), starts, starts + sizes


def _inside(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int8)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:n]) > 0


def _pieces(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``PIECE`` characters, with the number of the first."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= PIECE:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def count_grams(texts: DataFrame) -> DataFrame:
    """(g, c): all 4-grams of a one-column table of texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for _, part in _pieces(_texts(batch.column(0))):
                g, starts, ends = grams(part)
                codes, found = pd.factorize(g[_inside(len(g), starts, ends)])
                known = np.concatenate([known, found])
                counts = np.concatenate([counts, np.bincount(codes, minlength=len(found))])
            known, back = np.unique(known, return_inverse=True)
            counts = np.bincount(back, counts, minlength=len(known)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(counts)], ["g", "c"])

    return map_arrow(texts, work, "g bigint, c bigint").groupBy("g").agg(F.sum("c").alias("c"))


class Model:
    """Sharded counts of the four orders, with their contexts and discounts."""

    def __init__(self, counts: DataFrame) -> None:
        self.orders = {4: settle(counts, "order-4")}
        for n in (3, 2, 1):
            lower = self.orders[n + 1].groupBy(F.col("g").bitwiseAND(F.lit((1 << 16 * n) - 1)).alias("g"))
            self.orders[n] = settle(lower.agg(F.count(F.lit(1)).alias("c")), f"order-{n}")
        once = None
        for n, t in self.orders.items():
            row = t.agg(F.lit(n).alias("n"), *[F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)])
            once = row if once is None else once.unionByName(row)
        self.discounts = {r["n"]: self._discounts([r[f"n{i}"] for i in (1, 2, 3, 4)]) for r in once.collect()}
        one = self.orders[1].agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum(self.discount(1)), F.lit(0.0))).first()
        self.total, self.spare = float(one[0]), float(one[1])

    @staticmethod
    def _discounts(n: list[int]) -> tuple[float, float, float]:
        """D1, D2, D3+ from the numbers of n-grams seen once to four times.

        The estimates divide by these numbers.  Where one is 0 (a corpus of a
        few texts), the discounts are ``NO_ESTIMATE``."""
        if not all(n):
            return NO_ESTIMATE
        y = n[0] / (n[0] + 2 * n[1])
        return tuple(min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.05), i + 0.95) for i in range(3))

    def discount(self, n: int) -> Column:
        d = self.discounts[n]
        return F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])

    def bits(self, asked: DataFrame) -> DataFrame:
        """(g, bits) of distinct 4-grams (g): surprise of the last symbol after the others."""
        base = 1.0 / VOCABULARY
        out = asked.select("g", F.col("g").bitwiseAND(F.lit(0xFFFF)).alias("s"))
        one = self.orders[1].select(F.col("g").alias("s"), ((F.col("c") - self.discount(1)) / F.lit(self.total)).alias("own"))
        left = self.spare / self.total * base if self.total else base
        out = out.join(one, "s", "left").select("g", (F.coalesce("own", F.lit(0.0)) + F.lit(left)).alias("p"))
        for n in (2, 3, 4):
            t = self.orders[n].withColumn("d", self.discount(n))
            own = t.select(F.col("g").alias("s"), (F.col("c") - F.col("d")).alias("own"))
            after = t.groupBy(F.call_function("shiftrightunsigned", F.col("g"), F.lit(16)).alias("h")).agg(F.sum("c").alias("all"), F.sum("d").alias("spare"))
            s = F.col("g") if n == 4 else F.col("g").bitwiseAND(F.lit((1 << 16 * n) - 1))
            out = out.withColumn("s", s).withColumn("h", F.call_function("shiftrightunsigned", F.col("s"), F.lit(16)))
            out = out.join(own, "s", "left").join(after, "h", "left")
            p = F.when(F.col("all").isNull(), F.col("p")).otherwise((F.coalesce("own", F.lit(0.0)) + F.col("spare") * F.col("p")) / F.col("all"))
            out = out.select("g", p.alias("p"))
        return out.select("g", (-F.log2("p")).cast("float").alias("bits"))


def _packed(docs: DataFrame, text_at: int) -> DataFrame:
    """(block, rows, asks): compressed blocks of whole rows with their distinct
    4-grams, numbered by partition and place in it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, size, number = [], 0, TaskContext.get().partitionId() << 32
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))

        def flush() -> pa.RecordBatch:
            nonlocal held, size, number
            sink, asks = pa.BufferOutputStream(), np.zeros(0, np.int64)
            with pa.ipc.new_stream(sink, held[0].schema, options=options) as out:
                for b in held:
                    out.write_batch(b)
                    for _, t in _pieces(_texts(b.column(text_at))):
                        asks = pd.unique(np.concatenate([asks, pd.unique(grams(t)[0])]))
            rows = pa.array([sink.getvalue().to_pybytes()], pa.binary())
            row = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), rows, pa.array([asks], pa.list_(pa.int64()))], ["block", "rows", "asks"])
            held, size, number = [], 0, number + 1
            return row

        for batch in batches:
            at = 0
            sizes = np.asarray(pc.utf8_length(batch.column(text_at)).fill_null(0), np.int64)
            while at < len(sizes):
                n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), BLOCK - size, "right")))
                held.append(batch.slice(at, n))
                size += int(sizes[at : at + n].sum())
                at += n
                if size >= BLOCK or at < len(sizes):
                    yield flush()
        if held:
            yield flush()

    return map_arrow(docs, work, "block bigint, rows binary, asks array<bigint>")


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``symbols`` (bigint) and ``bits`` (double, a symbol; null
    without symbols).  Columns of ``docs`` by these names give way."""
    docs = docs.drop("symbols", "bits")
    at = docs.columns.index(text_col)
    blocks = settle(_packed(docs, at), "blocks")
    asks = blocks.select("block", F.explode("asks").alias("g"))
    answers = model.bits(asks.select("g").distinct())
    # A block's answers come first, its rows last: one sorted stream, nothing gathered.
    answers = asks.join(answers, "g").select("block", F.lit(None).cast("binary").alias("rows"), "g", "bits")
    rows = blocks.select("block", "rows", F.lit(None).cast("bigint").alias("g"), F.lit(None).cast("float").alias("bits"))
    stream = answers.unionByName(rows).repartition("block").sortWithinPartitions("block", F.col("rows").isNotNull())
    schema = T.StructType([*docs.schema.fields, T.StructField("symbols", T.LongType()), T.StructField("bits", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            last = 0
            for i in [*np.flatnonzero(np.asarray(batch.column(1).is_valid())).tolist(), batch.num_rows]:
                held.append(tuple(np.array(batch.column(k).slice(last, i - last)) for k in (2, 3)))
                last = i + 1
                if i == batch.num_rows:
                    break
                g, bits = (np.concatenate([h[k] for h in held]) for k in (0, 1))
                held = []
                order = np.argsort(g)
                g, bits = g[order], np.append(bits[order], np.float32(0))
                for b in pa.ipc.open_stream(batch.column(1)[i].as_buffer()):
                    n, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
                    for first, texts in _pieces(_texts(b.column(at))):
                        codes, starts, ends = grams(texts)
                        which, found = pd.factorize(codes)
                        sums = np.concatenate([[0.0], np.cumsum(bits[np.searchsorted(g, found)].astype(np.float64)[which])])
                        n[first : first + len(texts)] = ends - starts
                        total[first : first + len(texts)] = sums[ends] - sums[starts]
                    mean = pa.array(total / np.maximum(n, 1), pa.float64(), mask=n == 0)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n), mean], [*b.schema.names, "symbols", "bits"])

    return map_arrow(stream, work, schema)


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", quantile: float = QUANTILE) -> DataFrame:
    """``docs`` with ``symbols``, ``bits`` and ``accepted``; columns of ``docs``
    by these names give way, others pass through.

    Trusted texts are those that ``labels`` mark 1.  Four in five of them (by
    the identifier's hash) train the model; the rest set each language's limit
    at their ``quantile`` of bits, plus ``MARGIN`` and ``SHORT`` over the root
    of the symbols.  The trusted texts that trained the model are judged by it
    too: they are known to be good, and it favours them; only the held-out
    fifth tells how often good texts are rejected.  Languages without held-out
    text, and null, take the highest limit.  Without any trusted text nothing
    is rejected but texts without symbols (null or empty), which have no bits
    and never pass.  Rows stay apart whatever their identifiers; a null
    identifier has no label.  Repeated labels count once.  An empty table
    gives an empty result.
    """
    docs = docs.drop("symbols", "bits", "accepted")
    ids = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("_l")).where("_l is not null").distinct()
    slots = bitmap(ids, F.xxhash64("_l"))
    some = docs.select(F.col(id_col).alias("_l"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def trusted(held: bool) -> DataFrame:
        """Trusted texts on one side of the split; only these are shuffled."""
        side = (F.crc32(F.col("_l").cast("string")) % HELD_OUT == 0) == F.lit(held)
        return thinned(some.where(side), slots, F.xxhash64("_l")).join(ids.where(side).hint("merge"), "_l").select("text", "lang")

    model = Model(count_grams(trusted(False).select("text")))
    release(docs.sparkSession)  # the trusted texts have been shuffled and counted
    with scratch(docs.sparkSession):
        seen = score(trusted(True), model).where("bits is not null").groupBy("lang", F.floor(F.col("bits") * 100).alias("bin")).count()
        upto = Window.partitionBy("lang").orderBy("bin")
        seen = seen.withColumn("_upto", F.sum("count").over(upto)).withColumn("_all", F.sum("count").over(Window.partitionBy("lang")))
        limits = seen.where(F.col("_upto") >= F.lit(quantile) * F.col("_all")).groupBy("lang").agg(((F.min("bin") + 1) / 100 + F.lit(MARGIN)).alias("_limit"))
        limits = settle(limits, "limits", keep=True)  # one row a language
    rest = limits.agg(F.coalesce(F.max("_limit"), F.lit(float("inf")))).first()[0]
    places = [f"c{i}" for i in range(len(docs.columns))]
    scored = score(docs.toDF(*places), model, places[docs.columns.index(text_col)])
    lang = places[docs.columns.index(lang_col)]
    judged = scored.join(small_side(limits.where("lang is not null")), F.col(lang) == F.col("lang"), "left")
    accepted = F.coalesce(F.col("bits") <= F.coalesce("_limit", F.lit(rest)) + F.lit(SHORT) / F.sqrt("symbols"), F.lit(False))
    return judged.select(*[F.col(p).alias(c) for p, c in zip(places, docs.columns, strict=True)], "symbols", "bits", accepted.alias("accepted"))

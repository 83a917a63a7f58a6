"""Toxicity by averaged subword embeddings (operator 2).

A text is the bag of the character n-grams of its words, hashed into
``1 << BITS`` buckets.  Bucket embeddings, averaged over the bag, feed a linear
softmax; both are trained together in numpy, so a misspelling that was never
seen is placed by the n-grams that it shares with known words.

Training runs on the driver over a bounded sample of labelled rows
(``MAX_ROWS`` rows of ``MAX_CHARS`` characters together, half of each label
where there are so many, by hash of the identifier); the intercept is then set
back to the labels' true rate.  As the average and the last layer are linear, a
trained model is one number a bucket: it is broadcast (2 MB, fixed) and texts
are scored in Arrow batches, vectorised over their code points, in one pass
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, settle
from .kernels import LOWER, byte_classes

BITS = 19
SIZES = (4, 5, 6)
DIM = 8
EPOCHS = 8
#: n-grams of fewer training texts have no weight.
SEEN = 3
#: What an average of many small parts is multiplied by, so that steps fit its size.
SCALE = 10.0
BATCH = 64
RATE = 0.6
#: What a bucket's gradients start from: the more, the less is learnt from n-grams that are seldom seen.
CALM = 1e-2
MAX_ROWS = 6_000
MAX_CHARS = 40_000_000
FOLDS = 5
PIECE = 1 << 18


_ASCII = np.where(byte_classes("alnum"), LOWER, 0).astype(np.uint32)[:128]


def _symbols(text: str) -> np.ndarray:
    """Code points, lower-cased, with all ASCII that parts words as 0."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(a < 128, _ASCII[np.minimum(a, 127)], a)


def subwords(b: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, buckets) of the n-grams of words in symbols that start and end
    with a separator; a word's edges count as one symbol each."""
    upto = np.concatenate([[0], np.cumsum(b != 0, dtype=np.int32)])
    wide = b.astype(np.uint64)
    for n in SIZES:
        m = len(b) - n + 1
        if m <= 0:
            continue
        at = np.flatnonzero(upto[n - 1 : n - 1 + m] - upto[1 : 1 + m] == n - 2)
        code = np.full(len(at), n, np.uint64)
        for k in range(n):
            code = code * np.uint64(0x9E3779B97F4A7C15) + wide[at + k]
            code ^= code >> np.uint64(29)
        yield at, ((code * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int64)


def _pieces(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, symbols, starts) of runs of texts, a separator around each."""
    at, gap = 0, np.zeros(1, np.uint32)
    while at < len(texts):
        raw, size, end = [gap], 0, at
        starts = [0]
        while end < len(texts) and (end == at or size < PIECE):
            some = _symbols(texts[end])
            raw += [some, gap]
            size += len(some) + 1
            starts.append(size)
            end += 1
        yield at, end, np.concatenate(raw), np.array(starts)
        at = end


def bags(texts: list[str], bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, shares) of each text; shares sum to 1."""
    for first, end, data, starts in _pieces(texts):
        parts = list(subwords(data, bits))
        cuts = [np.searchsorted(at, starts) for at, _ in parts]
        for i in range(end - first):
            found = np.concatenate([b[c[i] : c[i + 1]] for (_, b), c in zip(parts, cuts, strict=True)]) if parts else np.zeros(0, np.int64)
            u, n = np.unique(found, return_counts=True)
            yield u, (n / max(len(found), 1)).astype(np.float32)


class Model:
    """One weight a bucket and an intercept."""

    def __init__(self, weights: np.ndarray, intercept: float, bits: int) -> None:
        self.weights, self.intercept, self.bits = weights, intercept, bits

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        for first, end, data, starts in _pieces(texts):
            total, count = np.zeros(end - first), np.zeros(end - first)
            for at, buckets in subwords(data, self.bits):
                cut = np.searchsorted(at, starts)
                upto = np.concatenate([[0.0], np.cumsum(self.weights[buckets].astype(np.float64))])
                total += upto[cut[1:]] - upto[cut[:-1]]
                count += np.diff(cut)
            out[first:end] = total / np.maximum(count, 1)
        return 1.0 / (1.0 + np.exp(-np.clip(out + self.intercept, -30, 30)))


def train(texts: list[str], labels: np.ndarray, rate: float, bits: int = BITS, seed: int = 5) -> Model:
    """Fit embeddings and softmax by adaptive gradient steps; ``rate`` is the
    true share of label 1.  Without both labels the score is that share."""
    labels = np.asarray(labels, np.int64)
    share = float(labels.mean()) if len(labels) else 0.5
    prior = np.log(max(rate, 1e-6) / max(1 - rate, 1e-6))
    if not 0 < share < 1:
        return Model(np.zeros(1 << bits, np.float32), float(prior), bits)
    rng = np.random.default_rng(seed)
    count = np.zeros(1 << bits, np.int32)
    for b, _ in bags(texts, bits):  # twice over the texts: most n-grams are too rare, and only the others are held
        count[b] += 1
    used = np.flatnonzero(count >= SEEN)
    place = np.full(1 << bits, -1, np.int32)
    place[used] = np.arange(len(used))
    rows = [(place[b][place[b] >= 0], v[place[b] >= 0] * np.float32(SCALE)) for b, v in bags(texts, bits)]
    emb = (rng.standard_normal((len(used), DIM)) * 0.05).astype(np.float32)
    out = (rng.standard_normal((DIM, 2)) * 0.3).astype(np.float32)
    bias = np.array([0.0, np.log(share / (1 - share))], np.float32)
    g_emb, g_out, g_bias = np.full(len(used), CALM, np.float32), np.full(out.shape, 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    filled = [i for i, (b, _) in enumerate(rows) if len(b)]
    for epoch in range(EPOCHS):
        step = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(filled)
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            idx, val = np.concatenate([rows[p][0] for p in pick]), np.concatenate([rows[p][1] for p in pick])
            sizes = np.array([len(rows[p][0]) for p in pick])
            cut = np.concatenate([[0], np.cumsum(sizes[:-1])])
            hidden = np.stack([np.add.reduceat(emb[idx, d] * val, cut) for d in range(DIM)], 1)
            logits = hidden @ out + bias
            p1 = np.exp(logits - logits.max(1, keepdims=True))
            p1 /= p1.sum(1, keepdims=True)
            p1[np.arange(len(pick)), labels[pick]] -= 1
            grad = p1 @ out.T
            seen, back = np.unique(idx, return_inverse=True)  # a step moves the n-grams of its texts only
            sums = np.stack([np.bincount(back, np.repeat(grad[:, d], sizes) * val, len(seen)) for d in range(DIM)], 1).astype(np.float32)
            g_emb[seen] += (sums**2).mean(1)
            emb[seen] -= step * sums / np.sqrt(g_emb[seen])[:, None]
            d_out, d_bias = hidden.T @ p1, p1.sum(0)
            g_out += d_out**2
            g_bias += d_bias**2
            out -= step * 0.3 * d_out / np.sqrt(g_out)
            bias -= step * 0.3 * d_bias / np.sqrt(g_bias)
    weights = np.zeros(1 << bits, np.float32)
    weights[used] = (emb @ (out[:, 1] - out[:, 0])) * SCALE
    return Model(weights, float(bias[1] - bias[0] + prior - np.log(share / (1 - share))), bits)


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> tuple[DataFrame, float]:
    """(_t, _y) of the rows to train on, and the share of label 1 among all
    labels that are not held out.

    Labels of one identifier that disagree do not count; repeated ones count
    once.  Of rows that share an identifier the smallest text is taken.  Of
    each label at most half of ``max_rows`` identifiers are taken, in the order
    of a hash, and of their texts, shortest first, as many as have ``max_chars``
    characters together.  Texts are taken whole.
    """
    known = labels.select(F.col(id_col).alias("_l"), F.col(label_col).cast("int").alias("_y")).where("_l is not null and _y in (0, 1)")
    known = known.where(F.crc32(F.col("_l").cast("string")) % FOLDS != 0)
    known = known.groupBy("_l").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z").drop("_z")
    n, ones = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("_y"), F.lit(0))).first()
    picked = [known.where(F.col("_y") == y).orderBy(F.md5(F.concat(F.lit("tox"), F.col("_l").cast("string"))), "_l").limit(max_rows // 2) for y in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # at most max_rows rows
    rows = docs.select(F.col(id_col).alias("_l"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t")).join(chosen, "_l")
    rows = settle(rows.groupBy("_l", "_y").agg(F.min("_t").alias("_t")).withColumn("_n", F.char_length("_t")), "training")
    upto = Window.orderBy("_n", "_l").rowsBetween(Window.unboundedPreceding, 0)  # lengths of at most max_rows rows
    fit_in = rows.select("_l", "_n").withColumn("_upto", F.sum("_n").over(upto)).where(F.col("_upto") <= max_chars)
    rows = rows.join(F.broadcast(fit_in.select("_l")), "_l")
    return rows.orderBy("_l").select("_t", "_y"), ones / n if n else 0.5


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model:
    """Train on a bounded ``sample`` of the rows whose hash is not held out."""
    rows, rate = sample(docs, labels, id_col, text_col, label_col, max_rows, max_chars)
    rows = rows.collect()
    return train([r[0] for r in rows], np.array([r[1] for r in rows]), rate)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row: 0 to 1, higher for label 1; texts without
    words (null and empty too) score the labels' rate.  Rows are independent;
    identifiers may be null or repeat; further columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept, model.bits))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = Model

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = kind(*sent.value)
        for batch in batches:
            found = ready.scores([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["_id", "score"])

    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, score double"
    return map_arrow(rows, work, schema).withColumnRenamed("_id", id_col)

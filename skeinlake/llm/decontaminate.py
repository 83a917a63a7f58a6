"""Benchmark decontamination by a generalised suffix automaton (operator 10).

The normalised benchmark items build one suffix automaton over words.  Each
document's words stream through it; the state after a word stands for the
longest stretch ending there that occurs in some item (tracked up to the
window: more tells nothing).  Where that stretch reaches the window, or a
whole shorter item ends, the words of the window are hit and the state names
the items.

Streaming is exact but costs a step of Python a word, so a task first finds,
vectorised, the stretches in which every pair of neighbouring words occurs in
the benchmark: outside of those no window of two or more words can lie.  Only
such stretches pass through the automaton.

Size: a benchmark is as large as its test items, not as the corpus.  It passes
the driver row by row and is broadcast in blocks of at most ``BLOCK_WORDS``
words (8 bytes each, so 16 MB a block, whatever the benchmark holds).  A worker
has the automaton of one block in memory at a time; with several, it takes a
whole Arrow batch of texts through one block after the other, so that an
automaton is built once a batch and block.  The documents are read once,
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .kernels import Powers, byte_classes, chunks, lower_values, string_buffers, word_hashes, word_spans

WINDOW = 13
COVERAGE = 20
BLOCK_WORDS = 2_000_000


class WordAutomaton:
    """Generalised suffix automaton over numbered words."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        #: state of a window -> items with it; state -> [(words, items)] of whole short items
        self.full: dict[int, set[str]] = {}
        self.short: dict[int, dict[int, set[str]]] = {}
        for item, words in items:
            size = min(window, len(words))
            s = 0
            for n, w in enumerate(words, 1):
                s = self._trim(self.next[s][w], size)
                if n >= size == window:
                    self.full.setdefault(s, set()).add(item)
            if 0 < size < window:
                self.short.setdefault(s, {}).setdefault(size, set()).add(item)
        #: nearest state up the links where a short item ends
        self.near = [0] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[s]
            self.near[s] = up if up in self.short else self.near[up]

    def _trim(self, s: int, size: int) -> int:
        """The state of the last ``size`` words of what ``s`` stands for."""
        while s and self.length[self.link[s]] >= size:
            s = self.link[s]
        return s

    def _add(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        copy = self._add(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new = self._add(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def stream(self, words: list[int], hit: np.ndarray, found: set[str]) -> None:
        """Mark the hit words in ``hit`` and add the items to ``found``."""
        s = n = 0
        for i, w in enumerate(words):
            while s and w not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            t = self.next[s].get(w)
            if t is None:
                s = n = 0
                continue
            n = min(n + 1, self.window)
            s = self._trim(t, self.window) if n == self.window else t
            if n == self.window and s in self.full:
                hit[i + 1 - n : i + 1] = True
                found |= self.full[s]
            up = s if s in self.short else self.near[s]
            while up:
                for m, names in self.short[up].items():
                    if m <= n:
                        hit[i + 1 - m : i + 1] = True
                        found |= names
                up = self.near[up]


class Block:
    """One block of items, ready to scan texts."""

    def __init__(self, names: list[str], sizes: np.ndarray, words: np.ndarray, window: int) -> None:
        self.words = np.unique(words)
        codes = np.searchsorted(self.words, words)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        inner = np.ones(max(len(codes) - 1, 0), bool)
        inner[cuts[1:-1] - 1] = False
        self.pairs = np.unique(codes[:-1][inner] * len(self.words) + codes[1:][inner])
        items = [(name, codes[a:b].tolist()) for name, a, b in zip(names, cuts[:-1], cuts[1:], strict=True)]
        self.least = int(min(window, sizes.min())) if len(sizes) else window
        self.automaton = WordAutomaton(items, window)

    def scan(self, h: np.ndarray, first: np.ndarray, hit: np.ndarray, found: dict[int, set[str]]) -> None:
        """``h``: word hashes of consecutive texts, ``first``: their first words."""
        if not len(h) or not len(self.words):
            return
        codes = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        known = self.words[codes] == h
        joined = np.zeros(len(h) + 1, bool)  # joined[i]: words i-1 and i may lie in one window
        at = np.flatnonzero(known[:-1] & known[1:]) if len(h) > 1 else np.zeros(0, int)
        if len(at) and len(self.pairs):
            p = codes[at] * len(self.words) + codes[at + 1]
            k = np.minimum(np.searchsorted(self.pairs, p), len(self.pairs) - 1)
            joined[at[self.pairs[k] == p] + 1] = True
        joined[first] = False
        starts = np.flatnonzero(known & ~joined[:-1])
        ends = np.flatnonzero(known & ~joined[1:]) + 1
        for a, b in zip(*(x[ends - starts >= self.least].tolist() for x in (starts, ends)), strict=True):
            names: set[str] = set()
            self.automaton.stream(codes[a:b].tolist(), hit[a:b], names)
            if names:
                found.setdefault(int(np.searchsorted(first, a, "right")) - 1, set()).update(names)


_READY: dict[int, Block] = {}


def _block(sent, window: int) -> Block:
    """The block's automaton, built once a worker; only the last one is kept."""
    if sent._jid_of not in _READY:
        _READY.clear()
        _READY[sent._jid_of] = Block(*sent.value, window)
    return _READY[sent._jid_of]


class _Sent:
    """A broadcast block with a key that workers can cache it by."""

    def __init__(self, broadcast) -> None:
        self.broadcast, self._jid_of = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "_jid_of": self._jid_of}

    @property
    def value(self):
        return self.broadcast.value


def _send(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> list[_Sent]:
    powers, values, is_word = Powers(), lower_values(), byte_classes("alnum")
    sent, names, sizes, words, held = [], [], [], [], 0

    def flush() -> None:
        nonlocal held
        value = (list(names), np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, np.uint64))
        sent.append(_Sent(benchmark.sparkSession.sparkContext.broadcast(value)))
        names.clear(), sizes.clear(), words.clear()
        held = 0

    for item, text in benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        data = np.frombuffer((text or "").encode(), np.uint8)
        starts, ends, _ = word_spans(data, np.array([0, len(data)]), is_word)
        if not len(starts):
            continue
        if held and held + len(starts) > block_words:
            flush()
        names.append(item if item is not None else "")
        sizes.append(len(starts))
        words.append(word_hashes(data, starts, ends, powers, values))
        held += len(starts)
    flush()
    return sent


def _scan(texts: pa.Array, blocks: list[_Sent], window: int) -> Iterator[tuple]:
    """(rows from, first words, hits, items by row, word starts, word ends, bytes) by chunk."""
    offsets, data = string_buffers(texts)
    powers, values, is_word = Powers(), lower_values(), byte_classes("alnum")

    def ready(a: int, b: int) -> tuple:
        part, rel = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = word_spans(part, rel, is_word)
        h = word_hashes(part, starts, ends, powers, values)
        return h, (a, first, np.zeros(len(h), bool), {}, starts, ends, part)

    together: list[tuple] = []
    for a, b in chunks(offsets):
        together.append(ready(a, b))
        if len(blocks) == 1 or b == len(offsets) - 1:
            for sent in blocks:
                for h, (_, first, hit, found, *_) in together:
                    _block(sent, window).scan(h, first[:-1], hit, found)
            yield from (out for _, out in together)
            together = []


def scan_benchmark(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(id, n_words, n_hit, items) for every row of ``docs``, one row each.

    Null and empty texts have no words and no hits; so do all texts if the
    benchmark is empty.  Items without words match nothing; items with a null
    id are named by an empty string; items that repeat an id or a text count
    by their ids.  Repeated rows each get their row.
    """
    blocks = _send(benchmark, item_col, item_text_col, block_words)
    ids = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    schema = f"_id {ids.schema['_id'].dataType.simpleString()}, n_words bigint, n_hit bigint, items array<string>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, hits, items = [], [], [None] * batch.num_rows
            for a, first, hit, found, *_ in _scan(batch.column(1), blocks, window):
                words.append(np.diff(first))
                upto = np.concatenate([[0], np.cumsum(hit)])
                hits.append(upto[first[1:]] - upto[first[:-1]])
                for row, names in found.items():
                    items[a + row] = sorted(names)
            empty: list[str] = []
            n = [pa.array(np.concatenate(x).astype(np.int64) if x else [], pa.int64()) for x in (words, hits)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *n, pa.array([x or empty for x in items], pa.list_(pa.string()))], ["_id", "n_words", "n_hit", "items"])

    return map_arrow(ids, work, schema).withColumnRenamed("_id", id_col)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, coverage: int = COVERAGE, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """``docs`` without benchmark material; columns and their types stay.

    A row goes if at least one word in ``coverage`` is hit.  Of other rows each
    stretch of hit words is cut, again until no window is left where the
    remaining parts meet.  Rows without hits are passed on as they are.
    """
    blocks = _send(benchmark, item_col, item_text_col, block_words)
    at = docs.columns.index(text_col)

    def cleaned(texts: dict[int, str]) -> dict[int, str]:
        """The texts of some rows, cut again as long as a cut makes new hits."""
        open_rows = list(texts)
        while open_rows:
            array, still = pa.array([texts[r] for r in open_rows], pa.string()), []
            for a, first, hit, _, starts, ends, part in _scan(array, blocks, window):
                cuts = np.concatenate([[0], np.cumsum([len(texts[r].encode()) for r in open_rows[a : a + len(first) - 1]])])
                for i in range(len(first) - 1):
                    words = slice(first[i], first[i + 1])
                    if hit[words].any():
                        texts[open_rows[a + i]] = _without(part[cuts[i] : cuts[i + 1]].tobytes(), _stretches(hit[words], starts[words] - cuts[i], ends[words] - cuts[i]))
                        still.append(open_rows[a + i])
            open_rows = still
        return texts

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, changed = np.ones(batch.num_rows, bool), {}
            for a, first, hit, *_ in _scan(batch.column(at), blocks, window):
                upto = np.concatenate([[0], np.cumsum(hit)])
                n_hit, n_words = upto[first[1:]] - upto[first[:-1]], np.diff(first)
                keep[a : a + len(n_hit)] = (n_hit == 0) | (coverage * n_hit < n_words)
                for row in np.flatnonzero((n_hit > 0) & keep[a : a + len(n_hit)]):
                    changed[a + int(row)] = batch.column(at)[a + int(row)].as_py()
            if changed:
                texts = batch.column(at).to_pylist()
                for row, text in cleaned(changed).items():
                    texts[row] = text
                columns = batch.columns
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch if keep.all() else batch.filter(pa.array(keep))

    return map_arrow(docs, work, docs.schema)


def _without(raw: bytes, spans: list[tuple[int, int]]) -> str:
    kept, last = [], 0
    for a, b in spans:
        kept.append(raw[last:a])
        last = b
    return b"".join([*kept, raw[last:]]).decode()


def _stretches(hit: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of maximal stretches of hit words."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [(int(starts[a]), int(ends[b - 1])) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]

"""Each stage of the pipeline on its own input, against another computation."""

import math
import zlib
from collections import Counter, defaultdict

import duckdb
import pandas as pd

import corpus_pipeline as P
from skeinlake.llm import quality as Q
from skeinlake.llm import queries
from skeinlake.llm.common import settle

SMALL = "/root/testdata/sf0.001"


def frame(df):
    return df.toPandas().astype(object).where(lambda x: x.notna(), None)


def folded(text):
    return "".join("0" if "0" <= c <= "9" else " " if c in "\t\n\x0b\x0c\r\xa0" else c for c in text)


def language_model(texts):
    """Bits of 4-grams by the definition, with sums by context kept."""
    counts = {4: Counter(g for t in texts for g in grams(t))}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cut, after = {}, {}
    for n, c in counts.items():
        m = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = m[0] / (m[0] + 2 * m[1])
        d = [min(max(i + 1 - (i + 2) * y * m[i + 1] / m[i], 0.05), i + 0.95) for i in range(3)]
        cut[n] = lambda v, d=d: d[min(v, 3) - 1]
        after[n] = defaultdict(lambda: [0, 0.0])
        for g, v in c.items():
            after[n][g[:-1]][0] += v
            after[n][g[:-1]][1] += cut[n](v)
    known = {}

    def p(g):
        if g not in known:
            n = len(g)
            lower = p(g[1:]) if n > 1 else 1 / Q.VOCABULARY
            if g[:-1] in after[n]:
                every, spare = after[n][g[:-1]]
                v = counts[n].get(g, 0)
                known[g] = ((v - cut[n](v) if v else 0.0) + spare * lower) / every
            else:
                known[g] = lower
        return known[g]

    return lambda g: -math.log2(p(g))


def grams(text):
    text = "   " + folded(text)
    return [text[i : i + 4] for i in range(len(text) - 3)]


def test_quality_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = frame(docs)
    labels = {r.doc_id: r.quality for r in frame(spark.read.parquet(f"{SMALL}/labels.parquet")).itertuples()}
    held = lambda i: zlib.crc32(str(i).encode()) % Q.HELD_OUT == 0
    good = [r for r in rows.itertuples() if labels.get(r.doc_id) == 1]
    bits = language_model([r.text or "" for r in good if not held(r.doc_id)])

    def mean(text):
        found = grams(text or "")
        return sum(map(bits, found)) / len(found) if found else None

    bins = defaultdict(list)
    for r in good:
        if held(r.doc_id) and r.text:
            bins[r.lang].append(math.floor(mean(r.text) * 100))
    limits = {k: (min(b for b in v if sum(x <= b for x in v) >= Q.QUANTILE * len(v)) + 1) / 100 + Q.MARGIN for k, v in bins.items()}
    got = {r.doc_id for r in frame(P.quality(spark, docs, SMALL)).itertuples()}
    for r in rows.itertuples():
        b = mean(r.text)
        room = -1.0 if b is None else limits.get(r.lang, max(limits.values())) + Q.SHORT / math.sqrt(len(r.text)) - b
        assert (r.doc_id in got) == (room >= 0) or abs(room) < 1e-2, (r.doc_id, room)
    assert len(got) < len(rows)


def test_lines_near_benchmark_and_mix_stages(spark):
    docs = settle(P.quality(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL), "test")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SMALL}/benchmark.parquet'")

    con.register("documents", frame(docs))
    want = con.execute("WITH " + queries.LINES_SQL.replace("{src}", "documents") + "SELECT doc_id, text FROM cleaned WHERE n_kept > 0 OR n_lines = 0").fetchall()
    docs = settle(P.lines(spark, docs, SMALL), "test")
    got = frame(docs)
    assert sorted(want) == sorted(zip(got.doc_id, got.text, strict=True)) and all(r.n_chars == len(r.text) for r in got.itertuples())

    sets = {r.doc_id: set(zip(*[(w := r.text.lower().split())[k:] for k in range(5)], strict=False)) or {tuple(w)} for r in got.itertuples()}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    docs = settle(P.near(spark, docs, SMALL), "test")
    assert sorted(r.doc_id for r in frame(docs).itertuples()) == [i for i in ids if find(i) == i]

    before = frame(docs)
    con.register("documents", before)
    hits = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, n_hit, contaminated FROM ({queries.OP10_SQL})").fetchall()}
    docs = settle(P.benchmark(spark, docs, SMALL), "test")
    after = frame(docs)
    kept = dict(zip(after.doc_id, after.text, strict=True))
    assert set(kept) == {i for i, (_, bad) in hits.items() if not bad}
    assert all(kept[r.doc_id] == r.text for r in before.itertuples() if hits[r.doc_id][0] == 0)
    con.register("documents", after)
    assert con.execute(f"SELECT count(*) FROM ({queries.OP10_SQL}) WHERE n_hit > 0").fetchone()[0] == 0

    want = con.execute(f"SELECT doc_id, size, taken FROM ({queries.OP3_SQL}) WHERE taken > 0").fetchall()
    got = frame(P.mix(spark, docs, SMALL))
    assert sorted(want) == sorted(zip(got.doc_id, got["size"], got.taken, strict=True))
    assert pd.Series(got.text).notna().all() and set(zip(got.doc_id, got.text, strict=True)) <= set(kept.items())

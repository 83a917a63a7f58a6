"""Awkward inputs, larger brute force and direct computations."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skeinlake.llm import toxicity
from skeinlake.llm.components import components
from skeinlake.llm.line_dedup import dedup_lines
from skeinlake.llm.minhash import near_duplicates
from skeinlake.llm.mixing import mix_sources
from skeinlake.llm.quality import NO_ESTIMATE, VOCABULARY, Model, count_grams, judge_quality

SMALL = "/root/testdata/sf0.001"
CLASH = "doc_id bigint, text string, lang string, source string, n_chars bigint, symbols string, bits string, accepted string, n_lines string, n_kept string, _lines string, taken string, _id string, s string"
ODD = [None, "", " \n\t ", "one", "one", "the quiet river runs under old stone bridges near the town", "x" * 50_000, "w " * 20_000]


def clashing(spark, texts, ids):
    more = ["own"] * 9
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, f"s{k % 2}" if k % 3 else None, None, *more) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], CLASH)


def parted(sets, similar=80):
    """Roots of a brute-force linking of all pairs."""
    root, seen = list(range(len(sets))), defaultdict(list)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in seen[g])
        for j, n in shared.items():
            if 100 * n >= similar * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for g in s:
            seen[g].append(i)
    return [find(i) for i in range(len(sets))]


def pairs_of_words(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)}


def test_near_duplicates_of_many_sizes_equal_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    common = [rng.choice(words) for _ in range(25)]
    texts = []
    for n in (1, 2, 3, 5, 9, 17, 40, 120, 200):
        base = [rng.choice(words) for _ in range(rng.randrange(30, 120))]
        for _ in range(n):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 9)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    texts += [" ".join(common + [rng.choice(words) for _ in range(rng.randrange(4, 40))]) for _ in range(300)]  # one passage in many
    rng.shuffle(texts)
    want = parted([pairs_of_words(t) for t in texts])
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(rows, size=2).collect()}
    assert len(got) == len(texts)
    assert all(want[got[i]] == want[i] for i in range(len(texts)))  # nothing is linked that is not similar
    assert sum(got[i] == want[i] for i in range(len(texts))) >= 0.99 * len(texts)


def test_near_duplicates_with_repeated_and_string_identifiers(spark):
    rng = random.Random(5)
    a, b = ([f"w{rng.randrange(9999)}" for _ in range(60)] for _ in range(2))
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "more"])), (3, " ".join([*b, "more"])), (1, ""), (None, " ".join(a)), (4, "alone here")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), size=2)
    found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect())
    assert found == [(-1, 59, None, True), (1, 0, 1, True), (1, 59, 1, True), (1, 59, 1, True), (2, 60, 1, False), (3, 60, 1, False), (4, 1, 4, True)]
    names = near_duplicates(spark.createDataFrame([(None if i is None else f"d{i}", t) for i, t in rows], "doc_id string, text string"), size=2)
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in names.collect()) == [("None", "None"), ("d1", "d1"), ("d1", "d1"), ("d1", "d1"), ("d2", "d1"), ("d3", "d1"), ("d4", "d4")]


@pytest.mark.parametrize("hubs", [10_000, 20])
def test_components_equal_union_find(spark, hubs):
    rng = random.Random(hubs)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(60)] + [(7, x) for x in range(250, 290)]
    root = list(range(300))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r[0]: r[1] for r in components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b", hubs=hubs).collect()}
    assert got == {i: find(i) for i in range(300) if find(i) != i}


def kneser_ney(texts):
    """Bits of a 4-gram, from the definition."""
    counts = {4: Counter(("   " + t)[i : i + 4] for t in texts for i in range(len(t)))}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discounts = {}
    for n, c in counts.items():
        m = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = m[0] / (m[0] + 2 * m[1]) if all(m) else 0
        discounts[n] = [min(max(i + 1 - (i + 2) * y * m[i + 1] / m[i], 0.05), i + 0.95) for i in range(3)] if all(m) else NO_ESTIMATE
    cut = lambda n, v: discounts[n][min(v, 3) - 1]

    def p(gram):
        n = len(gram)
        after = {g: v for g, v in counts[n].items() if g[:-1] == gram[:-1]}
        lower = p(gram[1:]) if n > 1 else 1 / VOCABULARY
        if not after:
            return lower
        own = counts[n][gram] - cut(n, counts[n][gram]) if gram in counts[n] else 0.0
        return (own + sum(cut(n, v) for v in after.values()) * lower) / sum(after.values())

    return lambda gram: -math.log2(p(gram))


@pytest.mark.parametrize("size", [3, 60])
def test_language_model_equals_direct_computation(spark, size):
    rng = random.Random(size)
    words = ["stone", "river", "tone", "rivet", "over", "stove", "lane", "ratio", "torn", "vat"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(size)]
    model = Model(count_grams(spark.createDataFrame([(t,) for t in texts], "text string")))
    wanted = ["ston", " sto", "   r", "qqqq", "e r ", "over", "xver", "verq"]
    number = lambda g: int.from_bytes(b"".join(ord(c).to_bytes(2, "big") for c in g), "big")
    got = {r["g"]: r["bits"] for r in model.bits(spark.createDataFrame([(number(g),) for g in wanted], "g bigint")).collect()}
    direct = kneser_ney(texts)
    assert all(abs(got[number(g)] - direct(g)) < 1e-3 for g in wanted)


def test_quality_replaces_its_own_columns_and_passes_others(spark):
    good = ["the quiet river runs under old stone bridges near the town"] * 30
    rows = clashing(spark, good + ODD, [*range(30), None, None, 5, 5, *range(40, 40 + len(ODD) - 4)])
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(3, 1), (None, 1)], "doc_id bigint, quality int")
    out = judge_quality(rows, labels)
    assert sorted(out.columns) == sorted(rows.columns) and out.schema["bits"].dataType.typeName() == "double"
    got = out.collect()
    assert len(got) == len(good) + len(ODD) and all(r["n_lines"] == "own" for r in got)
    assert all(r["bits"] is None and not r["accepted"] for r in got if not r["text"])
    assert judge_quality(rows.where("false"), labels).count() == 0


def test_lines_replace_their_own_columns_and_keep_nulls(spark):
    out = dedup_lines(clashing(spark, ODD, range(len(ODD))))
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(out.columns) == len(CLASH.split(",")) and got[0]["text"] is None and got[0]["n_lines"] == 0 and got[1]["text"] == ""
    assert got[3]["n_kept"] == 1 and got[4]["n_kept"] == 0 and got[4]["_lines"] == "own"


def test_mix_cuts_at_the_budget_whatever_repeats(spark):
    rows = [(i % 7 if i % 3 else None, "a b c d e"[: 1 + 2 * (i % 5)], "big" if i % 4 else "small") for i in range(200)] + [(3, "a b c", "big")] * 50 + [(9, "", "none"), (8, None, "none")]
    out = mix_sources(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    for some in by.values():
        wanted = int(some[0]["target"])
        assert wanted - 60 < sum(r["taken"] for r in some) <= wanted
    assert all(r["taken"] == 0 for r in by["none"])


def test_every_pipeline_stage_takes_odd_rows(spark):
    import corpus_pipeline as P

    rows = clashing(spark, ODD, [None, None, 5, 5, *range(20, 20 + len(ODD) - 4)])
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, rows, SMALL)
        assert out.columns == rows.columns and [f.dataType for f in out.schema] == [f.dataType for f in rows.schema], name
        got = out.collect()
        assert len(got) <= len(ODD) and all(r["bits"] == r["_id"] == r["n_kept"] == "own" for r in got), name
        if name != "quality":
            assert sum(not (r["text"] or "").strip() for r in got) == 3, name  # texts without words stay
        assert stage(spark, rows.where("false"), SMALL).count() == 0, name
    out = P.mix(spark, rows, SMALL)
    assert "bits" in out.columns and out.where("taken <= 0 or text is null").count() == 0
    assert P.mix(spark, rows.where("false"), SMALL).count() == 0


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels.select("doc_id", "toxic"), "doc_id")
    rows = scored.where(F.crc32(F.col("doc_id").cast("string")) % toxicity.FOLDS == 0).select("score", "toxic").collect()
    bad, fine = ([r["score"] for r in rows if r["toxic"] == y] for y in (1, 0))
    area = sum((b > f) + 0.5 * (b == f) for b in bad for f in fine) / (len(bad) * len(fine))
    assert area > 0.75, (area, len(bad), len(fine))


def test_toxicity_sample_is_bounded_and_settles_disagreements(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * (1 + i % 3)) for i in range(60)] + [(7, "another text of seven"), (None, "x")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(7, 0), (8, 0), (8, 0), (None, 1)], "doc_id bigint, toxic int")
    rows, rate = toxicity.sample(docs, labels, max_rows=20)
    got = rows.collect()
    assert len(got) <= 20 and 0.3 < rate < 0.7 and not any("seven" in r["_t"] or r["_t"].startswith("text 7 ") for r in got)
    few, _ = toxicity.sample(docs, labels, max_rows=20, max_chars=40)
    assert 0 < sum(len(r["_t"]) for r in few.collect()) <= 40


def test_several_blocks_of_templates_and_benchmarks_equal_one(spark):
    from skeinlake.llm.decontaminate import decontaminate, scan_benchmark
    from skeinlake.llm.licenses import scan_licenses

    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    items = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 60))) for _ in range(25)]
    texts = [" ".join([*rng.choices(words, k=30), rng.choice(items), *rng.choices(words, k=300), rng.choice(items)]) for _ in range(60)] + [None, "", items[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    key = lambda df: sorted(map(repr, df.collect()))
    one = scan_benchmark(docs, bench)
    assert key(one) == key(scan_benchmark(docs, bench, block_words=100)) and one.where("n_hit > 0").count() >= 60
    clean = decontaminate(docs, bench)
    assert key(clean) == key(decontaminate(docs, bench, block_words=100)) and scan_benchmark(clean, bench).where("n_hit > 0").count() == 0
    templates = spark.createDataFrame([(str(i), f"L{i % 5}", t) for i, t in enumerate(items)], "template string, license string, text string")
    flat = lambda df: sorted((r["doc_id"], m["template"], m["first_word"], m["end_word"], m["found"]) for r in df.collect() for m in r["matches"])
    whole = flat(scan_licenses(docs, templates))
    assert whole == flat(scan_licenses(docs, templates, block_words=100)) and len(whole) >= 60


def test_exact_runs_over_several_ranges_are_one_group(spark):
    from skeinlake.llm.exact_dedup import exact_dedup

    same = "the same long head of sixty-four characters and more, in every one of them "
    texts = ["hot   text"] * 300 + [f"{same}{i % 9}" for i in range(90)] + [None, "", " ", "hot text"]
    rows = spark.createDataFrame([(i * 7 % 1009, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    want: dict = {}
    for i, t in enumerate(texts):
        want.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i * 7 % 1009)
    for ranges in (1, 5, 40):
        got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup(rows, ranges=ranges).collect()}
        assert got == {i: (min(ids), len(ids)) for ids in want.values() for i in ids}


def test_targets_equal_a_sorted_sharing(spark):
    from fractions import Fraction

    from skeinlake.llm.mixing import WEIGHTS, source_targets

    rng = random.Random(6)
    for n in (1, 2, 7, 60):
        sizes = {f"s{i:03}": rng.choice([0, 1, 5, 40, 700, 9000]) + rng.randrange(3) for i in range(n - 1)} | {None: 50}
        names = sorted((k for k in sizes if k is not None)) + [None]
        weight = {k: WEIGHTS[i % 3] for i, k in enumerate(names)}
        left, heavy, target = sum(sizes.values()), sum(weight.values()), {}
        for k in sorted(names, key=lambda k: Fraction(3 * sizes[k], weight[k])):
            target[k] = min(Fraction(3 * sizes[k]), Fraction(left * weight[k], heavy) if heavy else Fraction(0))
            left, heavy = left - target[k], heavy - weight[k]
        got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
        assert set(got) == set(target) and all(abs(got[k] - float(target[k])) < 1e-6 * max(1, float(target[k])) for k in target)

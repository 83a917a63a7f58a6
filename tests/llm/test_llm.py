"""Training-data operators: SQL twins, brute force, held-out accuracy, edge cases."""

import re
from itertools import combinations

import pytest
from llm_oracle import same
from pyspark.sql import functions as F

from skeinlake.llm import queries as Q
from skeinlake.llm import toxicity
from skeinlake.llm.decontaminate import decontaminate, scan_benchmark
from skeinlake.llm.exact_dedup import exact_dedup
from skeinlake.llm.licenses import NOTICES, WHOLE, scan_licenses
from skeinlake.llm.line_dedup import dedup_lines
from skeinlake.llm.minhash import near_duplicates
from skeinlake.llm.mixing import mix_sources
from skeinlake.llm.pii import find_pii
from skeinlake.llm.quality import judge_quality
from skeinlake.llm.secrets import find_secrets

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, kept string, spans string"
ODD = [None, "", " \n\t ", "one", "one", "a b c d e f g h i j", "é à ü 0", "x" * 50_000, "w " * 30_000]


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en" if k % 2 else None, f"s{k % 3}" if k % 4 else None, None, "clash", "clash", "clash") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, name):
    same(spark, Q.QUERIES[name], Q.ORACLES[name], SMALL)


OPERATORS = {
    "lines": lambda d: dedup_lines(d.select("doc_id", "text", "size")),
    "mixing": mix_sources,
    "exact": exact_dedup,
    "pii": find_pii,
    "near": near_duplicates,
    "licenses": scan_licenses,
    "secrets": find_secrets,
    "benchmark": lambda d: scan_benchmark(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    "clean": lambda d: decontaminate(d, d.where("false").select(F.col("doc_id").alias("item_id"), "text")),
    "toxicity": lambda d: toxicity.score(d, toxicity.train(["you idiot fool", "kind words here"] * 5, [1, 0] * 5, 0.5)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_stay_and_empty_tables_work(spark, name):
    some = docs(spark, ODD, [None, None, *range(len(ODD) - 3), 0])
    assert OPERATORS[name](some).count() == len(ODD)
    assert OPERATORS[name](some.where("false")).count() == 0


def test_exact_groups_with_hot_texts(spark):
    texts = ["a  b", "a b", "c", "a\tb", None, "", "c"] + ["hot text"] * 40
    got = {r["doc_id"]: r for r in exact_dedup(docs(spark, texts)).collect()}
    assert [got[i]["keep_id"] for i in range(7)] == [0, 0, 2, 0, 4, 4, 2] and got[7]["group_size"] == 40 and got[46]["keep_id"] == 7


def test_near_duplicates_equal_brute_force(spark):
    import random

    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(12)]
    texts = []
    for b in base:
        for edits in (0, 1, 2, 3, 5, 9):
            t = list(b)
            for _ in range(edits):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t).upper() if edits == 1 else "  ".join(t))
    texts += ["", None, "lone", "LONE"]
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    got = {r["doc_id"]: r for r in near_duplicates(docs(spark, texts), size=2).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]


def test_toxicity_learns_and_places_misspellings(spark):
    import random

    rng = random.Random(1)
    plain = [f"{a}{b}" for a in ("lan", "mor", "tis", "vel", "rum") for b in ("da", "ke", "lio", "nar", "sto")]
    texts, labels = [], []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(30)]
        if i % 2:
            w[rng.randrange(30)] = rng.choice(["wretchedfool", "stupidclown"])
        texts.append(" ".join(w))
        labels.append(i % 2)
    model = toxicity.train(texts[:300], labels[:300], 0.5)
    right = ((model.scores(texts[300:]) >= 0.5) == [bool(y) for y in labels[300:]]).mean()
    assert right > 0.95
    clean = " ".join(plain)
    assert model.scores([clean + " stupiidclowns"])[0] > model.scores([clean + " lanternario"])[0]
    assert len(model.scores(["", clean])) == 2


def test_quality_separates_junk_from_trusted_language(spark):
    import random

    rng = random.Random(3)
    words = ["the", "river", "runs", "under", "old", "stone", "bridges", "and", "quiet", "fields", "near", "town"]
    good = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(200)]
    junk = ["".join(rng.choice("#%$&*qzxj ") for _ in range(300)) for _ in range(10)]
    table = docs(spark, good + junk + [None, ""])
    labels = spark.createDataFrame([(i, 1) for i in range(150)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r["accepted"] for r in judge_quality(table.select("doc_id", "text", "lang"), labels).collect()}
    assert all(got[i] for i in range(200)) and not any(got[i] for i in range(200, 212)) and len(got) == 212
    assert judge_quality(table.where("false").select("doc_id", "text", "lang"), labels.where("false")).count() == 0


def test_licenses_near_copies_and_overlaps(spark):
    mit = next(t for n, t in NOTICES if n == "MIT" and len(t) > 200)
    changed = mit.replace("furnished", "given").upper()
    got = [r["matches"] for r in scan_licenses(docs(spark, ["lorem ipsum " * 50 + mit + " dolor" * 50, changed, mit[: len(mit) // 2], "Licensed under CC BY 4.0."])).orderBy("doc_id").collect()]
    assert [m["license"] for m in got[0]] == ["MIT"] and got[0][0]["first_word"] == 100 and got[0][0]["found"] == got[0][0]["shingles"]
    assert [m["license"] for m in got[1]] == ["MIT"] and got[1][0]["found"] < got[1][0]["shingles"] and not got[2]
    assert [m["license"] for m in got[3]] == ["CC-BY-4.0"]
    whole = dict(WHOLE)["BSD-3-Clause"]
    found = scan_licenses(docs(spark, [whole.replace("copyright holder", "owner"), whole[:400]])).orderBy("doc_id").collect()
    longest = [max(r["matches"], key=lambda m: m["shingles"]) for r in found]
    assert longest[0]["license"] == "BSD-3-Clause" and longest[0]["shingles"] > 150 and longest[1]["shingles"] < 60


def test_mix_is_whole_and_carries(spark):
    table = docs(spark, ["a b c d"] * 30)
    rows = mix_sources(table, carry=["text"]).collect()
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    for some in by.values():
        assert sum(r["taken"] for r in some) == int(some[0]["target"]) and all(0 <= r["taken"] <= 3 * r["size"] for r in some)
    assert {r["text"] for r in rows} == {"a b c d"}


def test_decontamination_cuts_spans_and_drops_copies(spark):
    item = " ".join(f"b{i}" for i in range(20))
    long = " ".join(f"x{i}" for i in range(600))
    out = {r["doc_id"]: r["text"] for r in decontaminate(docs(spark, [item, f"{long} {item} {long}", long, None]), spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()}
    assert 0 not in out and "b5" not in out[1] and out[2] == long and out[3] is None


def test_lines_keep_the_earliest(spark):
    line = "one two three four five six seven eight nine"
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs(spark, [f"{line}\nown a", line.replace("five", "5"), line + " ten\n\nown b", "own  a"]).select("doc_id", "text")).collect()}
    assert got == {0: f"{line}\nown a", 1: "", 2: "\nown b", 3: ""}


def test_pipeline_takes_effect(spark):
    import corpus_pipeline as P

    mixed = P.run(spark, SMALL)
    assert [n for n, _ in P.STAGES] == ["quality", "lines", "near", "benchmark", "mix"]
    assert {"doc_id", "text", "taken"} <= set(mixed.columns) and 0 < mixed.count() <= 200 and mixed.where("taken <= 0").count() == 0

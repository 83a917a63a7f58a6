"""Registered queries over the driver's tables, and their DuckDB twins.

Vectors are ``embeddings`` (scaled by 1 + id % 5 where the metric would else
not matter: all have norm one), texts are ``documents``.  Identifiers in the
names of the inventory (V2, P10, R3 ...) are given where they are covered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions.text import tokens
from ..operators import bm25, graph, index, ivf, knn, planner, workloads
from ..operators.evaluate import recall, summary
from ..operators.hybrid import fuse, ranked, search_hybrid
from ..operators.predicate import Both, Eq, Not, Range, matching, selectivities
from ..operators.schema import Attr, Config, Schema
from ..sources import store
from ..sources.scratch import folder, kept, remove
from ..streaming import fold as streaming
from . import experiments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SCHEMA = Schema((Attr("label", "int64", True), Attr("tag", "tag"), Attr("even", "bool"), Attr("weight", "float64", True), Attr("maybe", "tag")))
TEXT_SCHEMA = Schema((Attr("text", "text"), Attr("lang", "tag"), Attr("n_chars", "int64", True)))
WORDS = "the onth Thing of, of reing zzzunknown"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# -- inputs ------------------------------------------------------------------


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str, scaled: bool = False) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").withColumnsRenamed({"vec_id": "id", "embedding": "vec"})
    if scaled:
        e = e.withColumn("vec", F.transform("vec", lambda x: (x * (F.col("id") % 5 + 1)).cast("float")))
    return e.select(
        "id", "vec", F.col("label").cast("long").alias("label"), F.concat(F.lit("t"), F.col("label").cast("string")).alias("tag"), (F.col("label") % 2 == 0).alias("even"),
        (F.col("id") % 97 / 4).alias("weight"), F.when(F.col("id") % 11 != 0, F.concat(F.lit("t"), F.col("label").cast("string"))).alias("maybe"),
    )


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    row = read(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row[0])


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source", "n_chars")


def out(hits: DataFrame, *more: str) -> DataFrame:
    return hits.select(*more, F.col("id"), F.round("dist", 9).alias("dist"))


_E = """e AS (SELECT vec_id AS id, embedding AS vec, CAST(label AS BIGINT) AS label, 't' || label AS tag, label % 2 = 0 AS even, vec_id % 97 / 4 AS weight,
  CASE WHEN vec_id % 11 <> 0 THEN 't' || label END AS maybe FROM embeddings)"""
_S = """e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x * (vec_id % 5 + 1) AS FLOAT)) AS vec, label FROM embeddings)"""
_Q = "q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0)"


def _fold(values: str) -> str:
    return f"list_reduce(list_prepend(0::DOUBLE, {values}), lambda s, v: s + v)"


def _dot(a: str, b: str) -> str:
    return _fold(f"list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)")


def _l2(a: str, b: str) -> str:
    return _fold(f"list_transform(list_zip({a}, {b}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))")


def _cos(a: str, b: str) -> str:
    both = f"(sqrt({_dot(a, a)}) * sqrt({_dot(b, b)}))"
    return f"CASE WHEN {both} = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - {_dot(a, b)} / {both}) END"


def _top(where: str = "true", k: int = 10, ctes: str = "", dist: str = "", rows: str = "e") -> str:
    dist = dist or _l2("vec", "qv")
    return f"WITH {ctes or _E}, {_Q} SELECT id, round(dist, 9) AS dist FROM (SELECT id, {dist} AS dist FROM {rows}, q WHERE {where}) ORDER BY dist, id LIMIT {k}"


# -- nearest neighbours: V2, V3, DF1-DF3, T1, S3, S6 ---------------------------


@query(_top())
def knn_l2(spark, sf_dir):
    return out(knn.knn(vectors(spark, sf_dir), first_vector(spark, sf_dir), 10))


@query(_top(ctes=_S, dist="-" + _dot("vec", "qv")))
def knn_ip(spark, sf_dir):
    return out(knn.knn(vectors(spark, sf_dir, True), first_vector(spark, sf_dir), 10, "ip"))


@query(_top(ctes=_S, dist=_cos("vec", "qv")))
def knn_cosine(spark, sf_dir):
    return out(knn.knn(vectors(spark, sf_dir, True), first_vector(spark, sf_dir), 10, "cosine"))


@query(f"""WITH {_E}, p AS (SELECT b.id AS q, a.id, {_l2("a.vec", "b.vec")} AS dist FROM e a, e b WHERE b.id % 50 = 0)
SELECT q, id, round(dist, 9) AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, id) AS rank FROM p) WHERE rank <= 5""")
def knn_batch(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    queries = rows.where("id % 50 = 0").select(F.col("id").alias("q"), F.col("vec").alias("qvec"))
    return knn.knn_batch(rows, queries, 5).select("q", "id", F.round("dist", 9).alias("dist"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_E}, p AS (SELECT b.id AS q, a.id, {_l2("a.vec", "b.vec")} AS dist FROM e a, e b WHERE b.id % 50 = 0)
SELECT q, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(dist, 9), id) AS rank FROM p) WHERE rank <= 10""")
def knn_bulk(spark, sf_dir):
    """Matrix products in Arrow batches for every vector whose id 50 divides."""
    rows = vectors(spark, sf_dir)
    queries = rows.where("id % 50 = 0").select(F.col("id").alias("q"), F.col("vec").alias("qvec"))
    return knn.knn_bulk(rows, queries, 10).select("q", "id", F.col("rank").cast("long").alias("rank"))


@query(_top(ctes=_S.replace("FROM embeddings", "FROM embeddings UNION ALL SELECT -1, list_transform(embedding, lambda x: 0::FLOAT), 0 FROM embeddings WHERE vec_id = 0"), dist=_cos("vec", "qv")))
def knn_cosine_zero_vector(spark, sf_dir):
    rows = vectors(spark, sf_dir, True).select("id", "vec")
    zero = rows.where("id = 0").select(F.lit(-1).cast("long").alias("id"), F.transform("vec", lambda x: F.lit(0.0).cast("float")).alias("vec"))
    return out(knn.knn(rows.unionByName(zero), first_vector(spark, sf_dir), 10, "cosine"))


@query(_top(k=10**9))
def knn_k_exceeds_n(spark, sf_dir):
    return out(knn.knn(vectors(spark, sf_dir), first_vector(spark, sf_dir), 10**9))


@query(_top(k=0))
def knn_k_zero(spark, sf_dir):
    return out(knn.knn(vectors(spark, sf_dir), first_vector(spark, sf_dir), 0))


# -- predicates: P4-P14, SC2, SC4, S7-S10 --------------------------------------


def _filtered(name: str, pred, where: str, how=knn.knn_pre):
    def run(spark, sf_dir):
        return out(how(vectors(spark, sf_dir), first_vector(spark, sf_dir), 10, pred, SCHEMA))

    run.__name__ = name
    return query(_top(where))(run)


filter_eq_tag = _filtered("filter_eq_tag", Eq("tag", "t3"), "tag = 't3'")
filter_eq_bool = _filtered("filter_eq_bool", Eq("even", True), "even")
filter_range_int = _filtered("filter_range_int", Range("label", 2, 5), "label BETWEEN 2 AND 5")
filter_range_float = _filtered("filter_range_float", Range("weight", 1.5, 9.25), "weight BETWEEN 1.5 AND 9.25")
filter_range_inverted = _filtered("filter_range_inverted", Range("label", 5, 2), "false")
filter_null_never_matches = _filtered("filter_null_never_matches", Eq("maybe", "t3"), "maybe = 't3'")
filter_unseen_tag_empty = _filtered("filter_unseen_tag_empty", Eq("tag", "none such"), "false")
filter_combined = _filtered("filter_combined", Both(Eq("even", True), Not(Eq("tag", "t4"))), "even AND tag <> 't4'")
postfilter_eq = _filtered("postfilter_eq", Eq("tag", "t3"), "tag = 't3'", knn.knn_post)
postfilter_range = _filtered("postfilter_range", Range("label", 2, 5), "label BETWEEN 2 AND 5", knn.knn_post)
auto_filter = _filtered("auto_filter", Eq("even", False), "NOT even", knn.knn_auto)


@query(f"WITH {_E} SELECT id, weight FROM e WHERE weight BETWEEN 3.0 AND 4.0")
def range_scan(spark, sf_dir):
    """In key order, as the secondary index gives it."""
    return matching(vectors(spark, sf_dir), Range("weight", 3.0, 4.0), SCHEMA).select("id", "weight").orderBy("weight", "id")


@query(f"""WITH {_E}, h AS ({_top().partition("SELECT id, round")[1] + _top().partition("SELECT id, round")[2]}) SELECT h.id, h.dist, e.label, e.tag FROM h JOIN e ON h.id = e.id""".replace(f"WITH {_E}, h", f"WITH {_E}, {_Q}, h"))
def enrich_hits(spark, sf_dir):
    """Attributes for the survivors only."""
    rows = vectors(spark, sf_dir)
    hits = out(knn.knn(rows, first_vector(spark, sf_dir), 10))
    return knn.enrich(hits, rows, "label", "tag")


@query(f"WITH {_E} SELECT id, label, tag, maybe FROM e WHERE id = 17")
def point_lookup(spark, sf_dir):
    return vectors(spark, sf_dir).where("id = 17").select("id", "label", "tag", "maybe")


@query(f"""WITH {_E} SELECT maybe AS value, count(*) AS n, count(*) / sum(count(*)) OVER () AS selectivity FROM e GROUP BY maybe""")
def selectivity_by_tag(spark, sf_dir):
    """Exact share of each value, of rows without one too (A1, A10)."""
    return selectivities(vectors(spark, sf_dir), "maybe")


_GRID = (0.001, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.92, 0.93, 0.95, 0.99, 0.999)


@query("SELECT s, round(1.859288 * (10 + 1000000 * (1 - s)), 6) AS post_us, round(0.001214 * 1000000 * s * 128, 6) AS pre_us, "
       "CASE WHEN 1.859288 * (10 + 1000000 * (1 - s)) < 0.001214 * 1000000 * s * 128 THEN 'post' ELSE 'pre' END AS choice "
       f"FROM (SELECT unnest([{', '.join(f'{s}::DOUBLE' for s in _GRID)}]) AS s)".replace("1.859288", "1.859288::DOUBLE").replace("0.001214", "0.001214::DOUBLE"))  # fmt: skip
def planner_choices(spark, sf_dir):
    c = planner.Calibration()
    rows = [(s, planner.post_cost(s, 10**6, 10, c), planner.pre_cost(s, 10**6, 128, c), planner.choose(s, 10**6, 128, 10)) for s in _GRID]
    found = spark.createDataFrame(rows, "s double, post_us double, pre_us double, choice string")
    return found.withColumn("post_us", F.round("post_us", 6)).withColumn("pre_us", F.round("pre_us", 6))


@query("""SELECT l_returnflag AS part, round(coalesce(sum(l_quantity * l_extendedprice) / nullif(sum(l_quantity * l_quantity), 0), 0), 6) AS slope FROM lineitem GROUP BY l_returnflag""")
def calibration_fit(spark, sf_dir):
    """Least squares through the origin over a table."""
    slope = planner.slope_column(F.col("l_quantity"), F.col("l_extendedprice"))
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("part")).agg(F.round(slope, 6).alias("slope"))


@query("""SELECT event_type, min(value) AS min, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99,
round(stddev_pop(value), 6) AS stddev FROM events GROUP BY event_type""")
def latency_summary(spark, sf_dir):
    """Nearest-rank percentiles and population deviation."""
    found = summary(read(spark, sf_dir, "events"), "value", "event_type")
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "stddev")})


# -- text: F1-F5, A3-A8, R3, R4, SC3 -------------------------------------------

_T = """d AS (SELECT doc_id AS id, lang, n_chars, list_transform(regexp_extract_all(text, '[0-9A-Za-z]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
l AS (SELECT id, lang, n_chars, len(w) AS len FROM d), p AS (SELECT id, unnest(w) AS term FROM d), pt AS (SELECT term, id, count(*) AS tf FROM p GROUP BY term, id)"""


def _bm25(words: str, k: int, where: str = "true", k1: str = "1.2000000476837158", b: str = "0.75") -> str:
    terms = ", ".join(f"'{t}'" for t in bm25.query_terms(words)) or "''"
    return f"""WITH {_T}, n AS (SELECT count(*) AS n, coalesce(avg(len), 0) AS avgdl FROM l), hit AS (SELECT * FROM pt WHERE term IN ({terms})),
df AS (SELECT term, count(*) AS df FROM hit GROUP BY term),
s AS (SELECT id, round(sum(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * ({k1}::DOUBLE + 1.0::DOUBLE))
  / (tf + {k1}::DOUBLE * ((1.0::DOUBLE - {b}::DOUBLE) + {b}::DOUBLE * CASE WHEN avgdl > 0 THEN len / avgdl ELSE 0.0::DOUBLE END))), 9) AS score
  FROM hit JOIN df USING (term) JOIN l USING (id), n GROUP BY id)
SELECT id, score FROM s JOIN l USING (id) WHERE {where} ORDER BY score DESC, id LIMIT {k}"""


@query(f"WITH {_T} SELECT id, len AS n_tokens FROM l")
def tokenize_counts(spark, sf_dir):
    return texts(spark, sf_dir).select("id", F.size(tokens("text")).cast("long").alias("n_tokens"))


@query(f"WITH {_T} SELECT term, count(*) AS df FROM pt GROUP BY term")
def doc_freq(spark, sf_dir):
    return bm25.Index.build(texts(spark, sf_dir)).document_frequency()


@query(f"WITH {_T} SELECT count(*) AS n, round(avg(len), 9) AS avgdl FROM l")
def text_stats(spark, sf_dir):
    return bm25.Index.build(texts(spark, sf_dir)).stats().select("n", F.round("avgdl", 9).alias("avgdl"))


@query(f"WITH {_T} SELECT term, id, tf FROM pt")
def postings(spark, sf_dir):
    return bm25.Index.build(texts(spark, sf_dir)).postings.select("term", "id", "tf")


def text_index(spark: SparkSession, sf_dir: str) -> bm25.Index:
    """Built and written once an application; queries read the terms they name."""
    return kept(spark, sf_dir, "text", lambda path: bm25.Index.cached(texts(spark, sf_dir), path))


def _texted(name: str, words: str, k: int, where: str = "true", pred=None, k1: float = bm25.K1, b: float = bm25.B, sql: dict | None = None):
    def run(spark, sf_dir):
        rows = texts(spark, sf_dir)
        return bm25.search_attr(rows, "text", TEXT_SCHEMA, words, k, pred, text_index(spark, sf_dir), k1=k1, b=b)

    run.__name__ = name
    return query(_bm25(words, k, where, **(sql or {})))(run)


bm25_topk = _texted("bm25_topk", "reing", 20)
bm25_multi_term = _texted("bm25_multi_term", WORDS, 20)
bm25_filtered = _texted("bm25_filtered", WORDS, 20, "lang = 'en'", Eq("lang", "en"))
bm25_filtered_range = _texted("bm25_filtered_range", WORDS, 20, "n_chars BETWEEN 100 AND 900", Range("n_chars", 100, 900))
bm25_params = _texted("bm25_params", WORDS, 20, k1=0.9, b=0.4, sql={"k1": "0.9", "b": "0.4"})
bm25_no_terms = _texted("bm25_no_terms", "zzzunknown !!", 20)


@query(_bm25(WORDS, 20).replace("WHERE text IS NOT NULL", "WHERE text IS NOT NULL AND doc_id % 7 <> 3"))
def bm25_after_deletes(spark, sf_dir):
    """Deleted documents leave the candidates and every statistic."""
    gone = texts(spark, sf_dir).where("id % 7 = 3").select("id")
    return bm25.search_text(text_index(spark, sf_dir).without(gone), WORDS, 20)


# -- fusion and hybrid: R5, R6, S15, S16 ---------------------------------------


def _hybrid_sql(words: str, k: int, depth: int, rrf: int, where: str = "true") -> str:
    text = _bm25(words, depth, where).removeprefix("WITH ").replace("FROM documents", "FROM documents JOIN embeddings ON doc_id = vec_id")
    return f"""WITH {_E}, {_Q}, dl AS (SELECT doc_id, lang FROM documents),
v AS (SELECT id, {_l2("vec", "qv")} AS dist FROM e JOIN dl ON dl.doc_id = e.id, q WHERE {where} ORDER BY dist, id LIMIT {depth}),
t AS (WITH {text}),
r AS (SELECT id, row_number() OVER (ORDER BY dist, id) AS rank FROM v UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) FROM t)
SELECT id, round(sum(1.0::DOUBLE / ({rrf}::DOUBLE + rank)), 12) AS score FROM r GROUP BY id ORDER BY score DESC, id LIMIT {k}"""


def _hybrid(name: str, k: int, depth: int = 0, rrf: int = 60, pred=None, where: str = "true"):
    def run(spark, sf_dir):
        both = texts(spark, sf_dir).join(vectors(spark, sf_dir).select("id", "vec"), "id")
        text = text_index(spark, sf_dir).within(vectors(spark, sf_dir))
        return search_hybrid(both, text, first_vector(spark, sf_dir), WORDS, k, pred, TEXT_SCHEMA, depth=depth, rrf_k=rrf)

    run.__name__ = name
    return query(_hybrid_sql(WORDS, k, depth or k, rrf, where))(run)


hybrid = _hybrid("hybrid", 10)
hybrid_filtered = _hybrid("hybrid_filtered", 10, pred=Eq("lang", "en"), where="lang = 'en'")
hybrid_depth = _hybrid("hybrid_depth", 10, depth=40, rrf=10)


@query("""WITH a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 20),
b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars % 1000 DESC, doc_id) AS rank FROM documents QUALIFY rank <= 20)
SELECT id, round(sum(1.0::DOUBLE / (60.0::DOUBLE + rank)), 12) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id ORDER BY score DESC, id LIMIT 25""")
def rrf_fuse(spark, sf_dir):
    d = texts(spark, sf_dir)
    a = d.orderBy(F.desc("n_chars"), "id").limit(20)
    b = d.withColumn("n_chars", F.col("n_chars") % 1000).orderBy(F.desc("n_chars"), "id").limit(20)
    return fuse([ranked(a, F.desc("n_chars"), "id"), ranked(b, F.desc("n_chars"), "id")], 25)


# -- operation log: M1-M14, J12, A1, A11, D1 -----------------------------------

ATTRS = ["category", "price"]


def op_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts of all vectors, then updates, attribute rows and deletes of some."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")

    def ops(rows: DataFrame, op: str, base: int, vec: Column, category: Column, price: Column, has_vec: bool, has_meta: bool) -> DataFrame:
        return rows.select(
            (F.col("id") + base + 1).alias("lsn"), F.lit(op).alias("op"), "id", vec.alias("vec"), category.cast("string").alias("category"), price.cast("long").alias("price"),
            F.lit(None).cast("binary").alias("payload"), F.lit(has_vec).alias("has_vec"), F.lit(has_meta).alias("has_meta"),
        )

    none = F.lit(None)
    no_vec = none.cast("array<float>")
    double = F.transform("vec", lambda x: (x * 2).cast("float"))
    log = ops(e, "insert", 0, F.col("vec"), F.concat(F.lit("c"), "label"), F.col("id") * 10, True, True)
    log = log.unionByName(ops(e.where("id % 5 = 0"), "update", 10**6, double, none, none, True, False))
    log = log.unionByName(ops(e.where("id % 3 = 0"), "set_meta", 2 * 10**6, no_vec, F.when(F.col("id") % 2 == 0, F.lit("moved")), F.col("id"), False, True))
    return log.unionByName(ops(e.where("id % 7 = 3"), "delete", 3 * 10**6, no_vec, none, none, False, False))


_STATE = """st AS (SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN list_transform(embedding, lambda x: CAST(x * 2 AS FLOAT)) ELSE embedding END AS vec,
  CASE WHEN vec_id % 3 = 0 THEN CASE WHEN vec_id % 2 = 0 THEN 'moved' END ELSE 'c' || label END AS category,
  CASE WHEN vec_id % 3 = 0 THEN vec_id ELSE vec_id * 10 END AS price,
  CASE WHEN vec_id % 3 = 0 THEN vec_id + 2000001 WHEN vec_id % 5 = 0 THEN vec_id + 1000001 ELSE vec_id + 1 END AS lsn FROM embeddings WHERE vec_id % 7 <> 3)"""
_STATE_SQL = f"WITH {_STATE} SELECT id, category, price, lsn, round({_dot('vec', 'vec')}, 6) AS square FROM st"


def _shown(state: DataFrame) -> DataFrame:
    return state.select("id", "category", "price", "lsn", F.round(D.dot("vec", "vec"), 6).alias("square"))


@query(_STATE_SQL)
def fold_current_state(spark, sf_dir):
    return _shown(store.fold(op_log(spark, sf_dir), ATTRS))


@query("""SELECT count(*) FILTER (vec_id % 7 <> 3) AS live, count(*) FILTER (vec_id % 7 = 3) + count(*) FILTER (vec_id % 5 = 0) AS tombstones, max(vec_id) + 1 AS next_id FROM embeddings""")
def live_and_tombstone_counts(spark, sf_dir):
    return store.counts(op_log(spark, sf_dir))


@query(f"WITH {_STATE} SELECT category AS value, count(*) AS n FROM st WHERE category IS NOT NULL GROUP BY category")
def attr_counts(spark, sf_dir):
    return store.attr_counts(store.fold(op_log(spark, sf_dir), ATTRS), "category")


@query(f"WITH {_STATE} SELECT category AS value, count(*) AS n FROM st WHERE category IS NOT NULL GROUP BY category")
def attr_counts_incremental(spark, sf_dir):
    """Counts of a snapshot, brought up to date with the log's tail (A2)."""
    log, cut = op_log(spark, sf_dir), 2 * 10**6 + 100
    before = store.fold(log.where(F.col("lsn") <= cut), ATTRS)
    return store.attr_counts_after(store.attr_counts(before, "category"), before, log.where(F.col("lsn") > cut), ATTRS, "category")


@query(_top("id % 7 <> 3"))
def knn_after_deletes(spark, sf_dir):
    log = op_log(spark, sf_dir).where("op IN ('insert', 'delete')")
    return out(knn.knn(store.fold(log, ATTRS), first_vector(spark, sf_dir), 10))


@query(f"WITH {_STATE}, {_Q} SELECT id, round(dist, 9) AS dist FROM (SELECT id, {_l2('vec', 'qv')} AS dist FROM st, q) ORDER BY dist, id LIMIT 10")
def knn_after_updates(spark, sf_dir):
    return out(knn.knn(store.fold(op_log(spark, sf_dir), ATTRS), first_vector(spark, sf_dir), 10))


@query(f"WITH {_STATE} SELECT id, price FROM st WHERE category = 'c3'")
def set_metadata_exact_eq(spark, sf_dir):
    """Equality sees current values only."""
    schema = Schema((Attr("category", "tag"), Attr("price", "int64", True)))
    return matching(store.fold(op_log(spark, sf_dir), ATTRS), Eq("category", "c3"), schema).select("id", "price")


@query(_STATE_SQL)
def compact_equivalence(spark, sf_dir):
    """A compacted state, folded again, is the same state."""
    compacted = store.as_log(store.fold(op_log(spark, sf_dir), ATTRS), ATTRS)
    return _shown(store.fold(compacted, ATTRS))


@query(_STATE_SQL)
def recover_snapshot_plus_tail(spark, sf_dir):
    """The snapshot at an lsn and the log after it give the whole log's state."""
    log, cut = op_log(spark, sf_dir), 2 * 10**6 + 100
    snapshot = store.as_log(store.fold(log.where(F.col("lsn") <= cut), ATTRS), ATTRS)
    return _shown(store.fold(snapshot.unionByName(log.where(F.col("lsn") > cut)), ATTRS))


@query(_STATE_SQL)
def stream_fold(spark, sf_dir):
    """The log as a stream of files, ingested in micro-batches."""
    at = folder(spark, "stream")
    log = op_log(spark, sf_dir)
    log.repartition(6).write.mode("overwrite").parquet(f"{at}/in")
    streaming.ingest(spark, f"{at}/in", log.schema, f"{at}/out").awaitTermination()
    return _shown(streaming.state(spark, f"{at}/out", ATTRS))


_STORED = Schema((Attr("number", "int64", True), Attr("category", "tag")))


@query(f"""SELECT vec_id AS number, CASE WHEN vec_id % 50 = 7 THEN 'moved' WHEN vec_id % 50 = 30 THEN NULL ELSE 'c' || label END AS category,
round(CASE WHEN vec_id % 50 = 1 THEN 4 ELSE 1 END * {_dot("embedding", "embedding")}, 6) AS square FROM embeddings WHERE vec_id % 50 <> 3""")
def store_recovery(spark, sf_dir):
    """A table on disk: bulk insert, updates, attribute rows and deletes around a
    checkpoint that cuts the log, then opened again (SC12-SC18, M1-M14)."""
    e, at = read(spark, sf_dir, "embeddings"), folder(spark, "store")
    config = Config(64, schema=_STORED)
    rows = e.select(F.col("embedding").alias("vec"), F.col("vec_id").cast("long").alias("number"), F.concat(F.lit("c"), "label").alias("category"), F.lit(None).cast("binary").alias("payload"))
    table = store.Store(spark, at, config)
    table.insert_rows(rows)
    some = table.current().where("number % 50 in (1, 3, 7, 30)").select("id", "number", "vec").orderBy("number").collect()
    table.append([{"op": "update", "id": r["id"], "vec": [2 * x for x in r["vec"]]} for r in some if r["number"] % 50 == 1] + [{"op": "delete", "id": r["id"]} for r in some if r["number"] % 50 == 3])
    table.checkpoint()
    table.append([{"op": "set_meta", "id": r["id"], "attrs": [r["number"], "moved" if r["number"] % 50 == 7 else None]} for r in some if r["number"] % 50 in (7, 30)])
    again = store.Store(spark, at, config)
    again.verify()
    if again.describe()["durable_lsn"] != table.lsn:
        raise RuntimeError("a durable operation is missing")
    return again.current().select("number", "category", F.round(D.dot("vec", "vec"), 6).alias("square"))


# -- inverted file: V4-V9, J8, J9, A12 -----------------------------------------

_CENTRES = """c AS (SELECT CAST(label AS INT) AS cell, list(m ORDER BY i) AS centroid FROM (SELECT label, i, round(avg(x), 12) AS m
  FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, i) GROUP BY label)"""
_ASSIGN = f"""a AS (SELECT id, vec, cell FROM (SELECT e.id, e.vec, c.cell, row_number() OVER (PARTITION BY e.id ORDER BY {_l2("e.vec", "c.centroid")}, c.cell) AS r FROM e, c) WHERE r = 1)"""


def label_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = vectors(spark, sf_dir).select(F.col("label").cast("int").alias("cell"), F.posexplode("vec").alias("i", "x"))
    parts = parts.groupBy("cell", "i").agg(F.round(F.avg(F.col("x").cast("double")), 12).alias("x"))
    return parts.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


@query(f"WITH {_E}, {_CENTRES}, {_ASSIGN} SELECT id, cell FROM a")
def ivf_assign(spark, sf_dir):
    return ivf.assign(vectors(spark, sf_dir), label_centres(spark, sf_dir)).select("id", "cell")


def cell_index(spark: SparkSession, sf_dir: str) -> index.Cells:
    """An inverted file around the labels' means, written once an application
    and read as it was written: a folder a cell."""

    def make(path: str) -> index.Cells:
        cells = index.Cells(Config(64, kind="ivf", schema=SCHEMA), vectors(spark, sf_dir))
        cells.centroids = label_centres(spark, sf_dir)
        return cells._dealt().save(path)

    return kept(spark, sf_dir, "cells", make)


@query(f"""WITH {_E}, {_Q}, {_CENTRES}, {_ASSIGN}, pr AS (SELECT cell FROM c, q ORDER BY {_l2("centroid", "qv")}, cell LIMIT 3)
SELECT id, round(dist, 9) AS dist FROM (SELECT id, {_l2("vec", "qv")} AS dist FROM a, q WHERE cell IN (SELECT cell FROM pr)) ORDER BY dist, id LIMIT 10""")
def ivf_search_nprobe(spark, sf_dir):
    return out(cell_index(spark, sf_dir).search(first_vector(spark, sf_dir), 10, nprobe=3))


@query(_top())
def ivf_full_probe_equals_exact(spark, sf_dir):
    return out(cell_index(spark, sf_dir).search(first_vector(spark, sf_dir), 10, nprobe=10**6))


@query(_top("tag = 't3'"))
def ivf_filtered_full_probe(spark, sf_dir):
    """The predicate narrows the scan of the cells themselves."""
    return out(cell_index(spark, sf_dir).search(first_vector(spark, sf_dir), 10, Eq("tag", "t3"), nprobe=10**6))


@query(_top("weight BETWEEN 3.0 AND 3.25"))
def ivf_filtered_probes_on(spark, sf_dir):
    """A rare range: cells are probed until K rows match or none is left."""
    found = cell_index(spark, sf_dir).search(first_vector(spark, sf_dir), 10**6, Range("weight", 3.0, 3.25), nprobe=1)
    return out(found.orderBy("dist", "id").limit(10))


@query(_top("NOT even"))
def index_auto_filter(spark, sf_dir):
    """The planner's choice over an index: half of the rows are compared, exactly."""
    return out(cell_index(spark, sf_dir).search_auto(first_vector(spark, sf_dir), 10, Eq("even", False)))


@query(f"""WITH {_E}, c AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INT) AS cell, list_transform(vec, lambda x: x::DOUBLE) AS centroid FROM e ORDER BY id LIMIT 8), {_ASSIGN}
SELECT cell, i, round(avg(x), 9) AS x FROM (SELECT cell, unnest(range(0, 64)) AS i, unnest(vec)::DOUBLE AS x FROM a) GROUP BY cell, i""")
def ivf_lloyd_step(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    cell = (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("id")) - 1).cast("int")
    first = rows.orderBy("id").limit(8).select(cell.alias("cell"), F.transform("vec", lambda x: x.cast("double")).alias("centroid"))
    step = ivf.lloyd_step(rows, first)
    return step.select("cell", F.posexplode("centroid").alias("i", "x")).select("cell", F.col("i").cast("long").alias("i"), F.round("x", 9).alias("x"))


#: Least recall of the approximate searches on these tables.
FLOOR = 0.8


@query("SELECT 'ivf 8 of 16' AS index, true AS enough")
def ivf_trained_recall(spark, sf_dir):
    """Whether 8 of 16 trained cells reach ``FLOOR`` against exact search."""
    rows = vectors(spark, sf_dir)
    centres = ivf.train(rows, 16, 5)
    queries = rows.where("id % 50 = 0").select(F.col("id").alias("q"), F.col("vec").alias("qvec"))
    found = ivf.search_batch(ivf.assign(rows, centres), centres, queries, 10, nprobe=8)
    reached = recall(found, knn.knn_bulk(rows, queries, 10), 10)
    return spark.createDataFrame([("ivf 8 of 16", reached >= FLOOR)], "index string, enough boolean")


# -- codes and graphs: DF7-DF9, V10-V18, A17 -----------------------------------


@query(f"""WITH {_E}, {_Q}, s AS (SELECT max(list_max(list_transform(vec, lambda x: abs(x::DOUBLE)))) / 127.0::DOUBLE AS sc FROM e),
k AS (SELECT id, list_transform(vec, lambda x: CAST(round(greatest(-127.0::DOUBLE, least(127.0::DOUBLE, x::DOUBLE / sc))) AS INT)) AS c FROM e, s),
z AS (SELECT list_transform(qv, lambda x: CAST(round(greatest(-127.0::DOUBLE, least(127.0::DOUBLE, x::DOUBLE / sc))) AS INT)) AS qc FROM q, s)
SELECT id, round(raw * sc * sc, 9) AS dist FROM (SELECT id, list_sum(list_transform(list_zip(c, qc), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS raw FROM k, z), s ORDER BY raw, id LIMIT 10""")
def int8_knn(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    scale = D.int8_scale(rows)
    codes = rows.select("id", D.int8_codes("vec", scale).alias("c"))
    raw = D.l2_int8(F.col("c"), D.int8_codes(knn.literal(first_vector(spark, sf_dir)), scale))
    return codes.select("id", raw.alias("raw")).orderBy("raw", "id").limit(10).select("id", F.round(F.col("raw") * scale * scale, 9).alias("dist"))


def graph_index(spark: SparkSession, sf_dir: str, quantize: str | None = None) -> index.Graph:
    config = Config(64, kind="graph", schema=SCHEMA, quantize=quantize)
    return kept(spark, sf_dir, f"graph-{quantize}", lambda path: index.cached(path, config, vectors(spark, sf_dir), ef_build=100, rows_per_shard=500))


@query("SELECT unnest(['graph', 'graph on codes']) AS index, true AS enough")
def graph_ann_recall(spark, sf_dir):
    """Whether graph search, on vectors and on codes, reaches ``FLOOR`` against
    exact search.  The graphs are written once and searched as they are read."""
    rows = vectors(spark, sf_dir)
    queries = [(r[0], list(r[1])) for r in rows.where("id % 50 = 0").select("id", "vec").collect()]
    truth = knn.knn_bulk(rows, rows.where("id % 50 = 0").select(F.col("id").alias("q"), F.col("vec").alias("qvec")), 10)
    found = []
    for name, codes in (("graph", None), ("graph on codes", "int8")):
        hits = graph.search(graph_index(spark, sf_dir, codes).graphs, queries, 10)
        found.append((name, recall(hits, truth, 10) >= FLOOR))
    return spark.createDataFrame(found, "index string, enough boolean")


@query(_top("tag = 't3'"))
def graph_filtered(spark, sf_dir):
    """The beam holds as many as a shard has, so the graph's answer is whole;
    more are fetched as long as fewer than K match."""
    return out(graph_index(spark, sf_dir).search(first_vector(spark, sf_dir), 10, Eq("tag", "t3"), ef=500))


# -- generated inputs and experiments: F10-F12, B1-B11 -------------------------

_U = "CAST(('0x' || substr(md5(concat_ws(':', {0})), 1, 8)) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE"


@query(f"""SELECT i AS id, list_transform(range(0, 4), lambda j: CAST(({_U.format("'v-centre', i % 5, j")} * 2 - 1) + ({_U.format("'v', i, j")} * 2 - 1) * 0.1::DOUBLE AS FLOAT)) AS v,
i % 5 AS cluster FROM range(0, 500) AS t(i)""".replace("SELECT i AS id, list", "SELECT id, cluster, round(list_sum(list_transform(v, lambda x: x::DOUBLE)), 5) AS total FROM (SELECT i AS id, list") + ")")
def generated_vectors(spark, sf_dir):
    rows = workloads.vectors(spark, 500, 4, clusters=5)
    return rows.select("id", "cluster", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@query(f"""SELECT rank, count(*) AS n FROM (SELECT CAST(floor(pow(101.0::DOUBLE, {_U.format("'z', i, 0")})) AS BIGINT) - 1 AS rank FROM range(0, 5000) AS t(i)) GROUP BY rank""")
def generated_zipf(spark, sf_dir):
    rank = workloads.zipf_rank(workloads.uniform(F.lit("z"), F.col("id"), F.lit(0)), 100)
    return spark.range(5000).select(rank.alias("rank")).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT count(*) FILTER (u < 0.01) AS n_1, count(*) FILTER (u < 0.5) AS n_50 FROM (SELECT {_U.format("'s', i")} AS u FROM range(0, 20000) AS t(i))""")
def generated_shares(spark, sf_dir):
    rows = workloads.labelled(spark.range(20_000), [0.01, 0.5])
    return rows.agg(F.count_if("share_0").alias("n_1"), F.count_if("share_1").alias("n_50"))


@query("SELECT unnest([0.01, 0.5, 0.95])::DOUBLE AS share, true AS same")
def filter_crossover(spark, sf_dir):
    """Both ways to filter return the same rows at full width."""
    found, _ = experiments.crossover(spark, 2_000, 16, shares=(0.01, 0.5, 0.95), repeats=1, nlist=8, iterations=2)
    return found.select("share", F.col("same_at_full_width").alias("same"))


@query("SELECT unnest([1, 4])::INT AS threads, true AS same")
def concurrent_search(spark, sf_dir):
    """Several threads get what one gets."""
    return experiments.threads(spark, 2_000, 16, (1, 4), 4).select("threads", "same")

"""Registered queries of the training-data operators, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .common import table
from .decontaminate import COVERAGE, scan_benchmark
from .exact_dedup import exact_dedup
from .licenses import SIMILAR, TEMPLATES, scan_licenses
from .line_dedup import dedup_lines
from .minhash import near_duplicates
from .mixing import mix_sources
from .pii import find_pii, pii_digest
from .quality import judge_quality
from .secrets import find_secrets, secret_digest
from .span_sql import OP6_SQL, OP9_SQL


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
  FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY norm)
"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix-0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
         3 * source_size AS cap FROM s),
r AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS t, CAST(sum(w) OVER () AS BIGINT) AS ws,
         CAST(coalesce(sum(cap) OVER o, 0) AS BIGINT) AS cb, CAST(coalesce(sum(w) OVER o, 0) AS BIGINT) AS wb,
         row_number() OVER (ORDER BY cap / w, source IS NULL, source) AS rk
  FROM w WINDOW o AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (
  SELECT *, min(CASE WHEN w * (t - cb) >= cap * (ws - wb) THEN 1 ELSE 0 END)
            OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS is_full FROM r),
c AS (
  SELECT *, CAST(coalesce(sum(CASE WHEN is_full = 1 THEN cap END) OVER (), 0) AS BIGINT) AS c,
         CAST(coalesce(sum(CASE WHEN is_full = 1 THEN w END) OVER (), 0) AS BIGINT) AS wc FROM f),
g AS (
  SELECT source, source_size, CASE WHEN is_full = 1 THEN CAST(cap AS DOUBLE)
         ELSE CAST(t - c AS DOUBLE) * CAST(w AS DOUBLE) / CAST(ws - wc AS DOUBLE) END AS target FROM c),
p AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, CAST(floor(g.target) AS BIGINT) AS b,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (b // source_size) * size
            + greatest(0, least(size, b - (b // source_size) * source_size - before)) END AS taken
FROM p
"""

def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (COVERAGE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM d, sizes, unnest(range(1, len(w) - m + 2)) AS u(i)),
hits AS (SELECT r, i, dw.m, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(find_pii(table(spark, sf_dir, "documents")))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(find_secrets(table(spark, sf_dir, "documents")))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_kept", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "lang", "symbols", "bits", F.pow(F.lit(2.0), "bits").alias("perplexity"), "accepted")


#: CTEs up to ``cleaned`` (doc_id, n_lines, n_kept, text); ``src`` has doc_id and text.
LINES_SQL = r"""
rows0 AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM {src}),
l0 AS (SELECT doc_id, r, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM rows0),
l AS (SELECT *, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm FROM l0),
f AS (SELECT norm, min(struct_pack(d := doc_id, i := i)) AS pos, string_split(norm, ' ') AS w FROM l WHERE norm <> '' GROUP BY norm),
fw AS (SELECT norm, pos, w, len(w) AS n FROM f WHERE len(w) >= 8),
v AS (SELECT norm, pos, n, p, array_to_string(list_concat(w[1:p - 1], w[p + 1:]), ' ') AS var FROM fw, unnest(range(1, n + 1)) AS u(p)),
near AS (
  SELECT norm FROM (SELECT norm, pos, min(pos) OVER (PARTITION BY n, p, var) AS least FROM v) WHERE pos > least
  UNION SELECT CASE WHEN v.pos > y.pos THEN v.norm ELSE y.norm END FROM v JOIN fw y ON v.var = y.norm),
marked AS (
  SELECT l.doc_id, l.r, l.i, l.line, l.norm <> '' AS full_line,
         l.norm = '' OR (f.pos = struct_pack(d := l.doc_id, i := l.i) AND NOT EXISTS (SELECT 1 FROM near WHERE near.norm = l.norm)) AS keep
  FROM l LEFT JOIN f ON l.norm = f.norm),
cleaned AS (
  SELECT r, doc_id, count(*) FILTER (full_line) AS n_lines, count(*) FILTER (full_line AND keep) AS n_kept,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keep), '') AS text
  FROM marked GROUP BY r, doc_id)"""

OP1_SQL = "WITH " + LINES_SQL.replace("{src}", "documents") + """
SELECT doc_id, n_lines, n_kept, sha256(text) AS text_sha256 FROM cleaned"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % toxicity.FOLDS == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
        F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["template"].cast("int")))), lambda t: t.cast("string")), ",").alias("templates"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["found"] / m["shingles"])), F.lit(0.0)).alias("containment"),
    )


def _licenses_sql() -> str:
    """Every window that starts at a match, for every template."""
    rows = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH t AS (SELECT t, license, {words.format(lower.format("x"))} AS w FROM (VALUES {rows}) AS v(t, license, x)),
z AS (SELECT t, license, w, least(5, len(w)) AS z, len(w) - least(5, len(w)) + 1 AS n FROM t),
ts AS (SELECT DISTINCT t, z, n + n // 4 AS width, array_to_string(w[i:i + z - 1], ' ') AS g FROM z, unnest(range(1, n + 1)) AS u(i)),
need AS (SELECT t, count(*) AS n FROM ts GROUP BY t),
d AS (SELECT doc_id, row_number() OVER () AS r, {words.format(lower.format("coalesce(text, '')"))} AS w FROM documents),
ds AS (SELECT r, k.z, i, array_to_string(w[i:i + k.z - 1], ' ') AS g FROM d, (SELECT DISTINCT z FROM ts) k, unnest(range(1, len(w) - k.z + 2)) AS u(i)),
m AS (SELECT r, t, i, ds.g, width FROM ds JOIN ts ON ds.z = ts.z AND ds.g = ts.g),
c AS (SELECT a.r, a.t, a.i, count(DISTINCT b.g) AS found FROM m a JOIN m b ON a.r = b.r AND a.t = b.t AND b.i >= a.i AND b.i < a.i + a.width GROUP BY a.r, a.t, a.i),
f AS (SELECT r, t, max(found / n) AS share FROM c JOIN need USING (t) WHERE 100 * found >= {SIMILAR} * n GROUP BY r, t),
o AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) AS templates, max(share) AS share FROM f JOIN z USING (t) GROUP BY r)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(templates, '') AS templates, coalesce(share, 0.0)::DOUBLE AS containment FROM d LEFT JOIN o USING (r)"""


OP8_SQL = _licenses_sql()

QUERIES = {"op1_line_dedup": op1_line_dedup, "op2_toxicity": op2_toxicity, "op3_mixing": op3_mixing, "op4_exact_dedup": op4_exact_dedup, "op5_quality": op5_quality, "op6_pii": op6_pii, "op7_minhash": op7_minhash, "op8_licenses": op8_licenses, "op9_secrets": op9_secrets, "op10_decontamination": op10_decontamination}
ORACLES = {"op1_line_dedup": OP1_SQL, "op3_mixing": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op6_pii": OP6_SQL, "op8_licenses": OP8_SQL, "op9_secrets": OP9_SQL, "op10_decontamination": OP10_SQL}

"""A training-data pipeline over ``documents``, counted as part of skeinlake.llm.

Each stage takes what its predecessor kept and returns the columns of
``documents``; the last adds what the mix takes of each document.
``run`` writes every stage as Parquet in the shared folder and reads it back,
so that a lost executor costs tasks and not stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlake.llm.common import remove, scratch, settle, table
from skeinlake.llm.decontaminate import decontaminate
from skeinlake.llm.line_dedup import dedup_lines
from skeinlake.llm.minhash import near_duplicates
from skeinlake.llm.mixing import mix_sources
from skeinlake.llm.quality import judge_quality


def _recounted(docs: DataFrame, was: DataFrame) -> DataFrame:
    """``n_chars`` of texts that a stage has changed, in the column's own type;
    a null text, and a table without the column, stay as they are."""
    if "n_chars" in was.columns:
        kind = was.schema["n_chars"].dataType
        docs = docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), "n_chars"))
    return docs.select(*was.columns)


def _placed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns named by their places, which no operator's own
    columns clash with, and these names."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _named(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*[F.col(p).alias(c) for c, p in names.items()])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model of trusted text accepts.

    Null, empty and blank texts have nothing to judge and go; a long text is
    judged whole; rows that repeat an identifier are judged one by one; columns
    of any name pass; an empty table stays empty.
    """
    placed, at = _placed(docs)
    judged = judge_quality(placed, table(spark, sf_dir, "labels").select(F.col("doc_id").alias(at["doc_id"]), "quality"), at["doc_id"], at["text"], at["lang"])
    return _named(judged.where("accepted"), at)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts rid of repeated lines; a document goes if all of its lines went.

    Texts without lines (null, empty, blank) stay as they are; rows that repeat
    an identifier and a text keep the same lines; columns of any name pass; an
    empty table stays empty.
    """
    placed, at = _placed(docs)
    cleaned = dedup_lines(placed, at["doc_id"], at["text"]).where("n_kept > 0 or n_lines = 0")
    return _recounted(_named(cleaned, at), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: its smallest identifier.

    Rows that repeat that identifier are the same document and stay together;
    texts without words, and rows without an identifier, are nobody's
    duplicates and stay; columns of any name pass; an empty table stays empty.
    """
    placed, at = _placed(docs)
    kept = near_duplicates(docs.select("doc_id", "text")).where("kept").select("doc_id").distinct()
    return _named(placed.join(kept.hint("merge"), F.col(at["doc_id"]).eqNullSafe(F.col("doc_id")), "left_semi"), at)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages: those mostly copied go, of others the passages.

    Texts without words (null, empty, blank) match nothing and stay; repeated
    rows are treated alike; columns of any name pass; an empty table, and an
    empty benchmark, change nothing.
    """
    return _recounted(decontaminate(docs, table(spark, sf_dir, "benchmark")), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes from, and how many of their words.

    Texts without words give nothing and go; null sources are a source; repeated
    rows share a place in the order; columns of any name pass but for ``MIXED``;
    an empty table stays empty.
    """
    return mix_sources(docs, carry=[c for c in docs.columns if c not in ("doc_id", "source", *MIXED)]).where("taken > 0")


#: Columns of the mix; a column of the input by such a name gives way.
MIXED = ("size", "source_size", "target", "taken")

STAGES = [("quality", quality), ("lines", lines), ("near", near), ("benchmark", benchmark), ("mix", mix)]

#: The language model's limits and the links of full shingle sets have no SQL twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark):
            docs = settle(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
        if before is not None:
            for path in {f.rpartition("/")[0] for f in before.inputFiles()}:
                remove(spark, path)
        before = docs
    return docs

"""The document pipeline: quality rules, near duplicates, benchmark
decontamination, personal data, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir),
works on all that its predecessor kept and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``. All but the last return
the columns of ``documents``:

* ``quality_rules`` drops the rows that fail the current policy (a null or
  empty text has too few words and goes).
* ``ngram_jaccard`` keeps one row of each group of similar texts, the one of the
  least id (one without an id only where all are).
* ``decontamination`` drops rows with a passage of ``benchmark``.
* ``pii`` masks personal data; ``n_chars`` follows the new text.
* ``byte_bpe`` returns doc_id, n_tokens, ids and the digests of both directions.

Every row gets its own verdict, also where ids are null or repeated. An empty
table passes through every stage.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textforge.llm import bpe, decontaminate, jaccard, pii, quality
from textforge.llm.registry import register, table
from textforge.llm.scratch import materialise
from textforge.session import ship_package


def _stage(fn):
    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, docs, sf_dir)
    return run_stage


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.apply_policy(docs)


@_stage
def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_per_group(docs)


@_stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs).withColumn(
        "n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


@_stage
def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("byte_bpe", bpe_stage),
]

#: Masking and tokenising cannot be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


register("pipeline", ORACLE_SQL)(run)

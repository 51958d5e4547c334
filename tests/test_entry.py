"""Driver contract: entry runs, registry is consistent, a sample of queries equals DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TABLES = "events documents embeddings pages labels conversations".split()


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert set(df.columns) == {"split", "n_rows", "n_headlines", "input_chars"} and len(rows) >= 1


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 100


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    def n(v):
        return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted(repr(tuple(n(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", ["prepare_corpus", "clean_text", "rouge_n", "latency_summary",
                                  "judge_first_valid_attempt", "request_metrics", "split_exact",
                                  "validate_requests", "running_mean_every_k"])
def test_against_duckdb(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    rel = con.sql(E.oracle_sql()[name])
    assert _norm(df.collect(), df.columns) == _norm(rel.fetchall(), rel.columns)


def test_invariants_of_preparation(spark):
    from pyspark.sql import functions as F

    from textforge.operators import corpus as C
    from textforge.sources import bindings as B
    prepared = C.prepare_corpus(B.articles(spark, SF_SMALL))
    n, distinct = prepared.agg(F.count(F.lit(1)), F.count_distinct("headline")).first()
    assert n == distinct > 0                                   # one row per headline
    split = C.split_hash(C.to_instruction(prepared, keep=["pos"]), "pos")
    parts = {r.split: r.n for r in C.split_report(split).collect()}
    assert parts["total"] == n == sum(v for k, v in parts.items() if k != "total")   # disjoint, covering

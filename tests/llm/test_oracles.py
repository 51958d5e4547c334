"""Queries with SQL against DuckDB, and every query on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TABLES = "documents pages benchmark labels".split()


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", ["op2_warc", "op6_ngram_jaccard", "op8_sharding", "op9_quality_rules", "op11_source_divergence",
                                  "op12_license_scan"])
def test_against_duckdb(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _norm(df.collect(), df.columns) == _norm(rel.fetchall(), rel.columns)


def test_each_operator_is_registered():
    names = E.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names

"""The registered queries: registry contract, and SQL twins for a sample at the smallest scale."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "keyword_topk", "token_frequency", "query_identifiers", "best_snippets", "chunk_documents", "edge_resolution",
    "coverage_first_cap", "verify_symbol_lines", "ranked_files", "weighted_rrf", "risk_state", "mode_stats",
    "missed_file_resolution", "suffix_dedup", "stale_packs",
)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in check_oracle.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, db, name):
    problem, _ = check_oracle.compare(entry.queries()[name](spark, SF), db.sql(entry.oracle_sql()[name]))
    assert problem == ""

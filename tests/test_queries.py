"""Registered queries: contract, whole-table inputs, a sample of results against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.check_queries import TABLES, compare
from tests.conftest import SF_DIR
from vulnlake.plans.views import VIEWS, view_sql

SAMPLE = ["T01_queue_rows", "D01_dedup_findings", "J02_second_order", "J09_neighbours", "E03_stuck_detection", "F01_F24_full_scan", "P14_session",
          "F27_secrets", "S05_cvss31", "S38_chain_matches", "B10_overdrawn", "E12_call_stacks", "J29_near_names", "G04_run_sessions"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"priority", "auth_level", "findings"} and df.count() > 0


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_views_read_whole_tables():
    for name, (base, _) in VIEWS.items():
        assert base in TABLES and view_sql(name).endswith(f" FROM {base}")


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_duckdb(spark, con, name):
    status, count, _, note = compare(spark, con, SF_DIR, name, entry.queries(), entry.oracle_sql())
    assert status in ("ok", "EMPTY"), note

"""Registered queries against their DuckDB oracle on the smallest driver tables."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from oracle_check import TABLES, compare  # noqa: E402

SF = os.environ.get("BASKETLENS_TEST_SF", "/root/testdata/sf0.001")
FULL = os.environ.get("BASKETLENS_FULL_ORACLE") == "1"
SAMPLE = ["d2_abc_viability_matrix", "w5_abc_classification_bucketed", "a3_membership_tier_profile",
          "a6_satisfaction_by", "a9_temporal_day_of_week", "a18_return_rate_by", "h4_mann_whitney_new_returning_stats",
          "h5_kruskal_payment_stats", "h3_chi_square_returns_stats", "d8_ltv_pipeline", "r3_spc_flags",
          "g1_validate_all", "v2_concentration_heatmap"]
NAMES = sorted(entry.oracle_sql()) if FULL else SAMPLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if Path(p).exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    res = duck.execute(entry.oracle_sql()[name])
    err = compare([tuple(r) for r in df.collect()], df.columns, res.fetchall(), [d[0] for d in res.description])
    assert err is None, err


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "recommendation" in df.columns


def test_every_query_has_callable():
    qs, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(qs)
    assert len(qs) >= 100

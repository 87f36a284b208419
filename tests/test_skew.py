"""Queries on tables where one key holds a third of all rows, with small segments."""

import duckdb
import pytest

import __spark_entry__ as entry
from forgeclock.operators import profile
from forgeclock.plans import lens
from tests.oracle import TABLES, compare, connect

SF = "/root/testdata/sf0.001"
HOT = {
    "events": "* REPLACE (CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS user_id)",
    "lineitem": """* REPLACE (CASE WHEN (l_suppkey + l_linenumber) % 3 = 0 THEN 5 ELSE l_partkey END AS l_partkey,
        CASE WHEN l_linenumber % 3 = 0 THEN 11 ELSE l_orderkey END AS l_orderkey, CASE WHEN l_linenumber = 2 THEN 1 ELSE l_suppkey END AS l_suppkey)""",
    "orders": "* REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 9 ELSE o_custkey END AS o_custkey)",
}
NAMES = [
    "c9_units", "c6_section_pairing", "b4_drop_private_events", "b5_prune_edges", "b9_attach_repository", "d3_serial_phase_share",
    "d4_section_totals", "d7_flag_census", "e8_symbol_resolution", "e8_latest_order", "e12_phase_counts", "f1_load_summary", "f9_config_layers",
    "j10_robust_stats", "j11_crossed_effects", "j12_toolchain_comparison", "j13_version_steps", "j18_wall_difference", "j21_concurrency",
    "j24_settings_distribution", "j26_wrapper_adoption", "a17_session_documents", "i2_quiescent_runs",
]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"COPY (SELECT {HOT.get(t, '*')} FROM read_parquet('{SF}/{t}.parquet')) TO '{folder}/{t}.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_hot_key(spark, skewed, monkeypatch, name):
    monkeypatch.setattr(lens, "EVENT_SEGMENT", 50)
    monkeypatch.setattr(profile, "ADDRESS_SEGMENT", 256)
    _, diff = compare(entry.queries()[name](spark, skewed), connect(skewed), entry.oracle_sql()[name])
    assert diff is None, diff

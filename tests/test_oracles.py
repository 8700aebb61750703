"""Named queries against their SQL.  CREWGRID_ALL=1 runs every query."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
FAST = [
    "metric_headcount", "metric_net_headcount_growth", "metric_span_of_control", "manager_chain_depth", "metric_voluntary_attrition", "metric_raw_pay_gap", "metric_time_to_resolution",
    "segment_voluntary_attrition_by_level", "headcount_series", "peer_screen", "comparison_groups", "benchmark_positions", "equity_expense_by_quarter", "equity_cost_forecast", "merit_refresher_grants",
    "ledger_chain_violations", "ledger_approval_rules", "lineage_source_closure", "lineage_cycles", "text_pii_scan", "name_roster_match", "contract_merit_population", "requisition_kpis", "pay_equity_eu_screen",
    "hazard_ranking_quality", "hazard_reliability", "hazard_segment_risk", "rtsr_performance", "pvp_cap_bridge", "stream_approval_rules",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("CREWGRID_ALL") else FAST


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0

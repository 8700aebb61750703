"""Refresher rows that fit the grant ledger, rankings that refuse missing prices, and panels that refuse protected columns."""

import pytest

from crewgrid.operators import merit, valuation as vl
from crewgrid.sources import contracts as ct, readers

LEDGER = ["grant_id", "plan_id", "emp_id", "participant_group", "grant_type", "award_type", "grant_date", "shares_granted", "psu_max_multiplier", "psu_share_basis", "stock_price_at_grant_usd", "strike_price_usd", "grant_date_fv_per_share_usd",
          "vest_start_date", "vest_months_total", "cliff_months", "vest_frequency", "performance_period_end"]


@pytest.mark.parametrize("ids,kind,want", [
    (["G-000007", "G-000012", "X-99", " G-000003 ", None], "string", ["G-000013", "G-000014"]), (["G-999999"], "string", ["G-1000000", "G-1000001"]), ([], "string", ["G-000001", "G-000002"]), ([5, 41, None], "bigint", [42, 43]),
])
def test_refreshers_continue_the_ledger(spark, ids, kind, want):
    grants = spark.createDataFrame([(i,) for i in ids], f"grant_id {kind}")
    plan = spark.createDataFrame([("e2", "staff", 1000.0), ("e1", "ceo", 0.4), ("e3", "staff", 0.0)], "emp_id string, participant_group string, equity_refresh_value double")
    got = merit.refreshers(plan, grants, plan="P-1")
    assert got.columns == LEDGER
    rows = sorted(got.collect(), key=lambda r: r.emp_id)
    assert [r.grant_id for r in rows] == want and [r.emp_id for r in rows] == ["e1", "e2"]
    assert rows[0].shares_granted == 1 and {r.grant_type for r in rows} == {"annual_refresh"} and {r.vest_frequency for r in rows} == {"monthly"}


def test_a_ranking_refuses_a_company_without_prices(spark):
    companies = spark.createDataFrame([("p", "AAAQ", "issuer", False, False), ("p", "BBBQ", "peer", True, True), ("p", "CCCQ", "peer", True, False)], "plan_id string, ticker string, role string, index_start boolean, index_end boolean")
    curve = [(25, 50), (50, 100), (75, 200)]
    full = spark.createDataFrame([("AAAQ", 1.2), ("BBBQ", 1.1)], "ticker string, ratio double")
    got = {r.ticker: r["rank"] for r in vl.relative_performance(companies, full, curve).collect()}
    assert got == {"AAAQ": 1, "BBBQ": 2} and vl.unranked(companies, full).count() == 0
    for part in (full.where("ticker = 'AAAQ'"), spark.createDataFrame([("AAAQ", 1.2), ("BBBQ", None)], "ticker string, ratio double")):
        assert [tuple(r) for r in vl.unranked(companies, part).collect()] == [("prices_missing", "p/BBBQ")]
        with pytest.raises(Exception, match="no full set of prices for BBBQ"):
            vl.relative_performance(companies, part, curve).collect()


def test_panel_reader(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text('emp_id,month,"pay, total"\ne1,2000-01-31,"1,5"\n')
    bad.write_text("emp_id,month,Date_Of_Birth\ne1,2000-01-31,1970-01-01\n")
    assert [tuple(r)[:3] for r in readers.panel(spark, str(good), ["emp_id", "month"]).collect()] == [("e1", "2000-01-31", "1,5")]
    with pytest.raises(ct.ContractError):
        readers.panel(spark, str(bad), ["emp_id", "month"])
    with pytest.raises(ct.ContractError):
        readers.panel(spark, str(good), ["emp_id", "month_index"])

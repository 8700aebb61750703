"""Equity ledger, forward cost and pay-cycle queries on the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewgrid.operators import equity as eq, merit as mr
from crewgrid.plans.catalog import add
from crewgrid.views import AS_OF, view

A = f"DATE '{AS_OF}'"
V = ["grants", "workers", "share_spine", "financials", "plans"]


def book(s, d):
    g = eq.with_terms(view(s, d, "grants"), view(s, d, "workers"))
    return eq.EquityBook(g, view(s, d, "share_spine"), view(s, d, "financials"), view(s, d, "plans"), AS_OF)


def mo(a, b):
    return f"greatest(0, (year({b}) - year({a})) * 12 + month({b}) - month({a}) - CASE WHEN day({b}) < day({a}) THEN 1 ELSE 0 END)"


def served(at):
    return f"least(1.0::DOUBLE, {mo('vest_start_date', at)} / vest_months_total::DOUBLE)"


def vf(at):
    return f"CASE WHEN {mo('vest_start_date', at)} < cliff_months THEN 0.0::DOUBLE ELSE {served(at)} END"


def cum(at):
    return (f"CASE WHEN {at} < vest_start_date THEN 0.0::DOUBLE WHEN term_date <= {at} THEN round_even(({vf('term_date')}) * fair_value, 6) "
            f"ELSE round_even({served(at)} * fair_value, 6) END")


BASE = f"""WITH g AS (SELECT grants.*, w.term_date, shares_granted * grant_date_fv_per_share_usd AS fair_value FROM grants LEFT JOIN workers w ON grants.emp_id = w.emp_id),
sp AS (SELECT * FROM share_spine WHERE period_end <= {A}),
sy AS (SELECT year(period_end) AS fy, avg(waso_basic) AS waso, arg_max(close_price_usd, period_end) AS price, arg_max(annualized_volatility, period_end) AS vol FROM sp GROUP BY 1),
ry AS (SELECT year(period_end) AS fy, CAST(sum(revenue_usd) AS BIGINT) AS revenue FROM financials WHERE period_end <= {A} GROUP BY 1),
gy AS (SELECT year(grant_date) AS fy, sum(shares_granted) AS granted, sum(shares_granted * CASE award_type WHEN 'option' THEN grant_date_fv_per_share_usd ELSE stock_price_at_grant_usd END) AS value,
  sum(CASE award_type WHEN 'option' THEN shares_granted ELSE 0 END) AS opt, sum(CASE award_type WHEN 'option' THEN 0 ELSE shares_granted END) AS fullv FROM g GROUP BY 1),
ty AS (SELECT year(term_date) AS fy, sum(shares_granted * (1 - ({vf('term_date')}))) AS back FROM g WHERE term_date IS NOT NULL GROUP BY 1),
fy AS (SELECT sy.*, revenue, coalesce(granted, 0) AS granted, coalesce(value, 0) AS value, coalesce(opt, 0) AS opt, coalesce(fullv, 0) AS fullv, coalesce(back, 0.0::DOUBLE) AS back
  FROM sy JOIN ry ON sy.fy = ry.fy LEFT JOIN gy ON gy.fy = sy.fy LEFT JOIN ty ON ty.fy = sy.fy),
t3 AS (SELECT round_even(avg(value / (waso * price)) * 100, 2) AS vabr3, round_even(avg(granted / waso) * 100, 2) AS gross3, avg(granted - back) AS net3 FROM (SELECT * FROM fy ORDER BY fy DESC LIMIT 3)),
qexp AS (SELECT s.period_end, round_even(CAST(sum(CAST({cum('s.period_end')} - {cum('s.before')} AS DECIMAL(28, 6))) AS DOUBLE), 2) AS sbc
  FROM (SELECT period_end, CAST(date_trunc('quarter', period_end) - INTERVAL 1 DAY AS DATE) AS before FROM sp) s CROSS JOIN g GROUP BY 1),
qx AS (SELECT q.period_end, sbc, f.revenue_usd AS revenue, round_even(sbc / f.revenue_usd * 100, 2) AS pct FROM qexp q JOIN financials f ON q.period_end = f.period_end),
live AS (SELECT *, vest_months_total - {mo('vest_start_date', A)} AS ml FROM g WHERE grant_date <= {A} AND (term_date IS NULL OR term_date > {A}) AND vest_months_total - {mo('vest_start_date', A)} > 0),
pool AS (SELECT sum(CASE WHEN grant_date > {A} THEN 0.0::DOUBLE WHEN award_type = 'option' THEN CASE WHEN term_date <= {A} THEN shares_granted * ({vf('term_date')}) ELSE shares_granted END
    WHEN term_date <= {A} THEN 0.0::DOUBLE ELSE shares_granted * (1 - ({vf(A)})) END) AS outs,
  sum(CASE WHEN grant_date > {A} OR plan_id <> 'P-A' THEN 0.0::DOUBLE ELSE shares_granted - CASE WHEN term_date <= {A} THEN shares_granted * (1 - ({vf('term_date')})) ELSE 0 END END) AS used FROM g),
snap AS (SELECT outs, (SELECT initial_pool_shares FROM plans WHERE plan_id = 'P-A') - used AS avail, net3, vabr3, common_shares_outstanding AS cso, close_price_usd AS px FROM pool, t3, (SELECT * FROM share_spine WHERE period_end = {A}))
"""


def q(name, fn, sql):
    add(name, lambda s, d: fn(book(s, d)), V, BASE + sql)


q("equity_expense_by_quarter", eq.expense_by_quarter, "SELECT * FROM qx")
q("equity_expense_ttm_pct", eq.expense_ttm_pct, "SELECT round_even(sum(sbc) / sum(revenue) * 100, 2) AS ttm_pct FROM (SELECT * FROM qx ORDER BY period_end DESC LIMIT 4)")
q("equity_unamortized", eq.unamortized, "SELECT round_even(sum(fair_value * ml / vest_months_total::DOUBLE), 2) AS backlog_usd, round_even(sum(fair_value * ml * ml / vest_months_total::DOUBLE) / sum(fair_value * ml / vest_months_total::DOUBLE) / 12, 2) AS weighted_years FROM live")
q("equity_burn_rates", eq.burn_rates, """SELECT fy, round_even(granted / waso * 100, 2) AS gross_pct, round_even((granted - back) / waso * 100, 2) AS net_pct, round_even(value / (waso * price) * 100, 2) AS vabr_pct,
round_even((opt + fullv * CASE WHEN vol >= 0.546::DOUBLE THEN 1.5::DOUBLE WHEN vol >= 0.361::DOUBLE THEN 2 WHEN vol >= 0.249::DOUBLE THEN 2.5 WHEN vol >= 0.165::DOUBLE THEN 3 WHEN vol >= 0.079::DOUBLE THEN 3.5 ELSE 4 END) / waso * 100, 2) AS legacy_adjusted_pct,
revenue, round_even(waso, 6) AS waso, price, round_even(back, 6) AS forfeited_shares FROM fy""")
q("equity_three_year_averages", lambda b: eq.three_year_averages(b).withColumn("net_granted_avg", F.bround("net_granted_avg", 4)),
  "SELECT vabr3 AS vabr_3yr_pct, gross3 AS gross_burn_3yr_pct, round_even(net3, 4) AS net_granted_avg FROM t3")
q("equity_pool_snapshot", lambda b: eq.pool_snapshot(b, "P-A"), """SELECT round_even(outs, 4) AS outstanding_shares, round_even(avail, 0) AS pool_available, round_even((outs + avail) / cso * 100, 2) AS overhang_pct, round_even(outs / cso * 100, 2) AS dilution_pct,
round_even(avail / net3, 2) AS pool_longevity_years, round_even(cso * px, 0) AS market_cap FROM snap""")
q("equity_value_per_recipient", lambda b: eq.value_per_recipient(b, 2000), "SELECT participant_group, round_even(CAST(sum(fair_value) AS DOUBLE), 0) AS value, count(DISTINCT emp_id) AS recipients, round_even(sum(fair_value) / count(DISTINCT emp_id), 0) AS per_recipient FROM g WHERE year(grant_date) = 2000 GROUP BY 1")
q("equity_plan_readiness", lambda b: eq.plan_readiness(b, "P-A", 2.75), "SELECT true AS minimum_vesting, true AS no_repricing, true AS no_unvested_dividends, false AS no_discretionary_acceleration, true AS strict_recycling, true AS no_evergreen, CAST(5 AS INTEGER) AS features_passed, vabr3 AS vabr_3yr_pct, vabr3 <= 2.75 AS burn_pass, round_even(2.75::DOUBLE - vabr3, 2) AS headroom_pct, round_even((outs + avail) / cso * 100, 2) AS overhang_pct FROM snap")

_SV = lambda d: f"CASE WHEN {d} < vest_start_date THEN 0 ELSE least(vest_months_total, {mo('vest_start_date', d)}) END"
_YRS = [AS_OF.year + k for k in range(1, 5)]
_RAW = ", ".join(f"greatest(0, sum(fair_value * ({_SV(f'''DATE '{y}-12-31' ''')} - {_SV(f'''DATE '{y - 1}-12-31' ''')}) / vest_months_total::DOUBLE)) AS g{i}" for i, y in enumerate(_YRS))
FC = f""", raw AS (SELECT {_RAW}, sum(fair_value * ml / vest_months_total::DOUBLE) AS rest FROM live),
ct AS (SELECT CAST(round_even(rest * 100, 0) AS BIGINT) AS bc, CAST(round_even(greatest(0, rest - g0 - g1 - g2 - g3) * 100, 0) AS BIGINT) AS oc, [CAST(round_even(g0 * 100, 0) AS BIGINT), CAST(round_even(g1 * 100, 0) AS BIGINT), CAST(round_even(g2 * 100, 0) AS BIGINT), CAST(round_even(g3 * 100, 0) AS BIGINT)] AS g FROM raw),
yr AS (SELECT k, bc, oc, g[k + 1] + CASE WHEN list_position(g, list_max(g)) = k + 1 THEN bc - oc - list_sum(g) ELSE 0 END AS c FROM ct CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k)),
fr AS (SELECT sum(fair_value) AS rr FROM g WHERE grant_date BETWEEN DATE '{AS_OF.year}-01-01' AND {A}),
tt AS (SELECT sum(revenue_usd) AS ttm FROM (SELECT * FROM financials WHERE period_end <= {A} ORDER BY period_end DESC LIMIT 4)),
ft AS (SELECT *, round_even(c / 100.0::DOUBLE * pow(0.94::DOUBLE, k), 2) AS lk, round_even(rr * 0.25::DOUBLE * (k + 1), 2) AS nw FROM yr, fr, tt)
SELECT CAST({_YRS[0]} + k AS INTEGER) AS fy, c / 100.0::DOUBLE AS gross_expense, CAST(sum(c) OVER (ORDER BY k) AS BIGINT) / 100.0::DOUBLE AS cumulative_gross, lk AS forfeiture_adj_expense, nw AS new_grants, round_even(lk + nw, 2) AS total,
  round_even((lk + nw) / ttm * 100, 2) AS pct_ttm_revenue, bc / 100.0::DOUBLE AS backlog_usd, oc / 100.0::DOUBLE AS beyond_horizon_usd FROM ft"""
q("equity_cost_forecast", eq.forecast, FC)

# ---- merit cycle; people with unusable ratings or hours are left to the contract
CLEAN = "rating IS NOT NULL AND scheduled_hours <= standard_full_time_hours"


def plan(s, d):
    return mr.plan(view(s, d, "workers").where(CLEAN), view(s, d, "bands"), view(s, d, "grants"))


def _case(col, d):
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {float(v)!r}::DOUBLE" for k, v in d.items()) + " END"


_MX = "CASE rating " + " ".join(f"WHEN '{r}' THEN {_case('cq', row)}" for r, row in mr.MATRIX.items()) + " END"
_RF = "CASE level " + " ".join(f"WHEN '{r}' THEN {_case('rating', row)}" for r, row in mr.REFRESH.items()) + " END"
MB = f"""WITH lg AS (SELECT emp_id, max(CASE participant_group WHEN 'staff' THEN 1 WHEN 'management' THEN 2 WHEN 'section16' THEN 3 WHEN 'ceo' THEN 4 END) AS r FROM grants GROUP BY 1),
e0 AS (SELECT w.*, base_salary::DOUBLE AS base, scheduled_hours / standard_full_time_hours AS fte, base_salary / range_mid AS compa, range_min, range_mid, range_max, r FROM workers w JOIN bands b ON w.band_id = b.band_id LEFT JOIN lg ON lg.emp_id = w.emp_id
  WHERE worker_type = 'employee' AND status <> 'terminated' AND {CLEAN}),
e1 AS (SELECT *, base * fte AS ab, CASE WHEN compa < 0.9 THEN 'q1' WHEN compa < 1 THEN 'q2' WHEN compa < 1.1 THEN 'q3' ELSE 'q4' END AS cq, CASE WHEN promoted_this_period = 'yes' THEN 0.1::DOUBLE ELSE 0 END AS pp,
  coalesce((['staff', 'management', 'section16', 'ceo'])[r], CASE WHEN is_people_manager = 'yes' AND level IN ('L5', 'L6', 'L7') THEN 'management' ELSE 'staff' END) AS pg FROM e0),
e2 AS (SELECT *, {_MX} AS mp FROM e1),
pl AS (SELECT *, base * (1 + mp + pp) AS nb, ab * mp AS ma, ab * pp AS pa, ab * {_case('level', mr.BONUS_TARGET)} * {_case('rating', mr.BONUS_FACTOR)} * 1.05::DOUBLE AS ba, {_RF} * fte AS rv FROM e2),
rf AS (SELECT (SELECT max(grant_id) FROM grants) + row_number() OVER (ORDER BY emp_id) AS grant_id, emp_id, pg AS participant_group, CAST(greatest(1, round_even(rv / 85.2::DOUBLE, 0)) AS BIGINT) AS shares_granted FROM pl WHERE rv > 0)
"""
MV = ["workers", "bands", "grants"]
add("merit_plan", lambda s, d: plan(s, d).select("emp_id", "participant_group", "merit_pct", *[F.bround(c, 7).alias(c) for c in ("compa_ratio", "range_penetration", "merit_amount", "promo_amount", "bonus_amount", "equity_refresh_value", "new_base_salary", "new_compa_ratio")]), MV,
    MB + """SELECT emp_id, pg AS participant_group, mp AS merit_pct, round_even(compa, 7) AS compa_ratio, round_even((base - range_min) / (range_max - range_min), 7) AS range_penetration, round_even(ma, 7) AS merit_amount, round_even(pa, 7) AS promo_amount,
round_even(ba, 7) AS bonus_amount, round_even(rv, 7) AS equity_refresh_value, round_even(nb, 7) AS new_base_salary, round_even(nb / range_mid, 7) AS new_compa_ratio FROM pl""")
add("merit_cycle_totals", lambda s, d: mr.totals(plan(s, d)), MV, MB + """SELECT count(*) AS eligible_headcount, count(*) FILTER (WHERE status = 'on_leave') AS on_leave_count, round_even(sum(ab), 0) AS payroll, round_even(sum(ab) * 0.035::DOUBLE, 0) AS merit_budget,
round_even(sum(ma), 0) AS merit_spend, round_even(100 * sum(ma) / sum(ab), 2) AS merit_spend_pct, sum(ma) <= sum(ab) * 0.035::DOUBLE + 1 AS within_budget, round_even(sum(ab) * 0.035::DOUBLE - sum(ma), 0) AS headroom, round_even(sum(pa), 0) AS promo_spend, round_even(sum(ba), 0) AS bonus_pool,
round_even(sum(rv), 0) AS refresh_value, count(*) FILTER (WHERE promoted_this_period = 'yes') AS promotions, round_even(avg(compa), 3) AS avg_compa_ratio, round_even(avg(nb / range_mid), 3) AS avg_new_compa_ratio, count(*) FILTER (WHERE nb > range_max) AS over_max_after_merit FROM pl""")
for _k in ("rating", "level"):
    add(f"merit_by_{_k}", lambda s, d, k=_k: mr.aggregate_by(plan(s, d), k), MV, MB + f"SELECT {_k}, count(*) AS n, round_even(sum(ma), 5) AS merit_amount, round_even(sum(ba), 5) AS bonus_amount, round_even(sum(ab), 5) AS actual_base FROM pl GROUP BY 1")
add("merit_refresher_grants", lambda s, d: mr.refreshers(plan(s, d), view(s, d, "grants")).select("grant_id", "emp_id", "participant_group", "shares_granted"), MV, MB + "SELECT * FROM rf")
add("merit_refresher_split", lambda s, d: mr.group_split(mr.refreshers(plan(s, d), view(s, d, "grants"))), MV, MB + "SELECT participant_group, count(*) AS grants, CAST(sum(shares_granted) AS BIGINT) AS shares FROM rf GROUP BY 1")

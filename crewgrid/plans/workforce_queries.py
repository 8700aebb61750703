"""Workforce, attrition, rewards, service and finance-linkage metrics on the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewgrid.functions.dates import quarter_ends
from crewgrid.operators import linkage as ln, rewards as rw, service as sv, workforce as w
from crewgrid.operators.population import Workforce, headcount_at, movements, turnover_series
from crewgrid.plans.catalog import add
from crewgrid.views import AS_OF, view

A = f"DATE '{AS_OF}'"
CLOCK = f"TIMESTAMP '{AS_OF} 18:00:00'"


def load(spark, sf, *names):
    get = lambda n: view(spark, sf, n) if n in names else None
    return Workforce(view(spark, sf, "workers"), AS_OF, get("bands"), get("benefits"), get("cases"), get("financials"))


EMP = f"""WITH emp AS (SELECT * FROM workers WHERE worker_type = 'employee'),
act AS (SELECT * FROM emp WHERE hire_date <= {A} AND (term_date IS NULL OR term_date > {A})),
months AS (SELECT CAST(DATE '2001-01-01' - to_months(CAST(i AS INTEGER)) - INTERVAL 1 DAY AS DATE) AS me FROM range(12) t(i)),
hc AS (SELECT avg(n) AS v FROM (SELECT me, count(emp_id) AS n FROM months LEFT JOIN emp
  ON hire_date <= me AND (term_date IS NULL OR term_date > me) GROUP BY me)),
done AS (SELECT *, date_diff('second', opened_at, resolved_at) / 3600.0 AS h FROM {{cases}} WHERE opened_at <= {CLOCK} AND resolved_at <= {CLOCK}),
pend AS (SELECT *, date_diff('second', opened_at, {CLOCK}) / 3600.0 AS age FROM {{cases}} WHERE opened_at <= {CLOCK} AND (resolved_at IS NULL OR resolved_at > {CLOCK}))
"""


def q(name, fn, sql, *names):
    names_all = ["workers", *names]
    head = EMP.replace("{cases}", "cases") if "cases" in names else EMP[: EMP.index(",\ndone AS")] + "\n"
    add(name, lambda spark, sf: fn(load(spark, sf, *names)), names_all, head + sql)


WIN = f"BETWEEN DATE '2000-01-02' AND {A}"
R = "coalesce(round_even(100.0 * ({0}) / nullif({1}, 0), {2}), 0)"


def r(a, b, d=0):
    return R.format(a, b, d)


C = "count(*) FILTER (WHERE {})"
c = C.format

q("metric_headcount", w.headcount, f"SELECT count(*) AS value, {c('''status = 'active' ''')} AS active, {c('''status = 'on_leave' ''')} AS on_leave FROM act")
q("metric_fte", w.fte, "SELECT round_even(sum(least(1.0, scheduled_hours / standard_full_time_hours)), 1) AS value FROM act")
q("metric_net_headcount_growth", w.net_headcount_growth, f"""
SELECT *, ending - beginning AS value, voluntary_exits + involuntary_exits AS total_exits,
  (ending - beginning) = hires - voluntary_exits - involuntary_exits AS bridge_reconciles FROM (
SELECT {c("hire_date <= DATE '2000-01-01' AND (term_date IS NULL OR term_date > DATE '2000-01-01')")} AS beginning,
  (SELECT count(*) FROM act) AS ending, {c(f"hire_date {WIN}")} AS hires,
  {c(f"term_type = 'voluntary' AND term_date {WIN}")} AS voluntary_exits,
  {c(f"term_type = 'involuntary' AND term_date {WIN}")} AS involuntary_exits FROM emp)""")
SPANS = "spans AS (SELECT a.manager_id, count(*) AS s FROM act a JOIN act m ON a.manager_id = m.emp_id GROUP BY 1)"
q("metric_span_of_control", w.span_of_control, f""", {SPANS}
SELECT round_even(sum(s) / count(*), 2) AS value, count(*) AS managers, round_even(avg(s), 2) AS mean, median(s) AS median, max(s) AS max,
{c("s BETWEEN 1 AND 2")} AS "span_1-2", {c("s = 3")} AS "span_3", {c("s BETWEEN 4 AND 6")} AS "span_4-6", {c("s BETWEEN 7 AND 9")} AS "span_7-9",
{c("s BETWEEN 10 AND 12")} AS "span_10-12", {c("s >= 13")} AS "span_13+" FROM spans""")
q("org_shape_by_level", w.org_shape, f"SELECT level, {c('''is_people_manager = 'yes' ''')} AS managers, {c('''is_people_manager <> 'yes' ''')} AS ics, count(*) AS total FROM act GROUP BY level")
q("metric_span_outlier_rate", w.span_outlier_rate, f""", {SPANS}
SELECT {r(c("s < 3 OR s > 10"), "count(*)")} AS value, {r(c("s < 3"), "count(*)")} AS sub_scale_pct, {r(c("s > 10"), "count(*)")} AS overloaded_pct, count(*) AS managers FROM spans""")
DEPTH = """, walk AS MATERIALIZED (SELECT a.emp_id, m.emp_id AS up FROM act a LEFT JOIN act m ON a.manager_id = m.emp_id),
climb AS (WITH RECURSIVE cl(emp_id, up, d) AS (SELECT emp_id, up, CASE WHEN up IS NULL THEN 0 ELSE 1 END FROM walk
  UNION ALL SELECT cl.emp_id, w.up, cl.d + 1 FROM cl JOIN walk w ON cl.up = w.emp_id WHERE w.up IS NOT NULL AND cl.d < 50) SELECT * FROM cl),
depths AS (SELECT emp_id, CAST(max(d) AS INTEGER) AS depth FROM climb GROUP BY 1)
"""
q("metric_management_layers", w.management_layers, DEPTH + "SELECT median(depth) AS value, max(depth) AS max_depth FROM depths")
q("management_layer_distribution", w.layer_distribution, DEPTH + "SELECT depth, count(*) AS people FROM depths GROUP BY 1")
q("manager_chain_depth", w.manager_depths, DEPTH + "SELECT emp_id, depth FROM depths")
q("metric_contingent_workforce_ratio", w.contingent_workforce_ratio, f"""SELECT {r("c", "c + e")} AS value, c AS contractors, e AS employees FROM (
SELECT {c("worker_type = 'contractor'")} AS c, {c("worker_type = 'employee'")} AS e FROM workers WHERE hire_date <= {A} AND (term_date IS NULL OR term_date > {A}))""")


def turn(pred, name, hc=True):
    tail = ", round_even((SELECT v FROM hc), 1) AS avg_headcount" if hc else ""
    return f"SELECT round_even(100.0 * {c(pred + ' AND term_date ' + WIN)} / (SELECT v FROM hc), 1) AS value, {c(pred + ' AND term_date ' + WIN)} AS {name}{tail} FROM emp"


q("metric_voluntary_attrition", w.voluntary_attrition, turn("term_type = 'voluntary'", "voluntary_exits"))
q("metric_total_turnover_rate", w.total_turnover_rate, turn("term_type IN ('voluntary', 'involuntary')", "all_exits"))
q("metric_involuntary_turnover_rate", w.involuntary_turnover_rate, turn("term_type = 'involuntary'", "involuntary_exits", False))
q("metric_regrettable_attrition", w.regrettable_attrition, f"""SELECT round_even(100.0 * x / (SELECT v FROM hc), 1) AS value, x AS regrettable_exits, {r("x", "v")} AS regrettable_share_of_voluntary_pct
FROM (SELECT {c(f"regrettable = 'yes' AND term_date {WIN}")} AS x, {c("term_type = 'voluntary'")} AS v FROM emp)""")


def cohort(days):
    return f"FROM (SELECT *, coalesce(term_date - hire_date < {days}, false) AS gone FROM emp WHERE hire_date <= CAST({A} - INTERVAL {days} DAY AS DATE))"


q("metric_new_hire_attrition", w.new_hire_attrition, f"""SELECT {r(c("gone"), "count(*)")} AS value, count(*) AS cohort, {c("gone")} AS left_within_12mo,
{c("gone AND term_type = 'voluntary'")} AS voluntary, {c("gone AND term_type = 'involuntary'")} AS involuntary {cohort(365)}""")
q("metric_early_attrition_90d", w.early_attrition_90d, f"SELECT {r(c('gone'), 'count(*)')} AS value, count(*) AS cohort, {c('gone')} AS left_within_90d {cohort(90)}")
q("metric_twelve_month_retention", w.twelve_month_retention, f"SELECT {r(c('NOT gone'), 'count(*)')} AS value, count(*) AS cohort, {c('NOT gone')} AS active_at_12mo {cohort(365)}")
q("metric_representation_by_level", w.representation_by_level, "SELECT level, gender_group, count(*) AS n, round_even(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY level), 0) AS share_pct FROM act WHERE gender_group IS NOT NULL GROUP BY 1, 2")
q("metric_leadership_diversity", w.leadership_diversity, "SELECT gender_group, count(*) AS n, round_even(100.0 * count(*) / sum(count(*)) OVER (), 0) AS share_pct FROM act WHERE gender_group IS NOT NULL AND is_people_manager = 'yes' GROUP BY 1")
q("metric_rating_distribution", w.rating_distribution, "SELECT " + ", ".join(f"{r(c(f'''rating = '{x}' '''), 'count(rating)')} AS {x}" for x in w.RATINGS) +
  f", count(rating) AS rated, {r(c('rating IS NULL'), 'count(*)')} AS unrated_share_pct FROM act")
PROMO = c("promoted_this_period = 'yes'")
q("metric_promotion_rate", w.promotion_rate, f"SELECT {r(PROMO, 'count(*)')} AS value, {PROMO} AS promoted, count(*) AS eligible_population, {r(PROMO, '(SELECT v FROM hc)')} AS enterprise_rate_pct FROM act WHERE promotion_eligible = 'yes'")
q("promotion_rate_by_level", w.promotion_rate_by_level, f"SELECT coalesce(level, 'all') AS level, count(*) AS eligible, {PROMO} AS promoted, {r(PROMO, 'count(*)')} AS rate_pct FROM act WHERE promotion_eligible = 'yes' GROUP BY ROLLUP (level)")
q("metric_nine_box", w.nine_box, """, pop AS (SELECT potential, CASE rating WHEN 'below' THEN 'Low' WHEN 'meets' THEN 'Med' ELSE 'High' END AS performance FROM act WHERE rating IS NOT NULL AND potential IS NOT NULL),
g AS (SELECT unnest(['Low', 'Med', 'High']) AS l)
SELECT p.l AS potential, f.l AS performance, count(pop.potential) AS n, round_even(100.0 * count(pop.potential) / (SELECT count(*) FROM pop), 0) AS pct
FROM g p CROSS JOIN g f LEFT JOIN pop ON pop.potential = p.l AND pop.performance = f.l GROUP BY 1, 2""")
q("segment_voluntary_attrition_by_level", lambda wf: w.segment_voluntary_attrition(wf, "level"), f""", seg AS (SELECT level, count(*) FILTER (WHERE term_type = 'voluntary' AND term_date {WIN}) AS x FROM emp GROUP BY 1),
sh AS (SELECT level, avg(n) AS v FROM (SELECT s.level, me, count(emp_id) AS n FROM seg s CROSS JOIN months LEFT JOIN emp e ON e.level = s.level AND hire_date <= me AND (term_date IS NULL OR term_date > me) GROUP BY 1, 2) GROUP BY 1)
SELECT seg.level, x AS exits, round_even(100.0 * x / CASE WHEN v = 0 THEN 1 ELSE v END, 1) AS value FROM seg JOIN sh ON seg.level = sh.level""")
q("attrition_hotspot_location", lambda wf: w.hotspot(w.segment_voluntary_attrition(wf, "location"), "location"), f""", seg AS (SELECT location, count(*) FILTER (WHERE term_type = 'voluntary' AND term_date {WIN}) AS x FROM emp GROUP BY 1),
sh AS (SELECT location, avg(n) AS v FROM (SELECT s.location, me, count(emp_id) AS n FROM seg s CROSS JOIN months LEFT JOIN emp e ON e.location = s.location AND hire_date <= me AND (term_date IS NULL OR term_date > me) GROUP BY 1, 2) GROUP BY 1)
SELECT seg.location AS segment, round_even(100.0 * x / CASE WHEN v = 0 THEN 1 ELSE v END, 1) AS value FROM seg JOIN sh ON seg.location = sh.location ORDER BY value DESC, segment LIMIT 1""")
SERIES = """, q AS (SELECT CAST(DATE '2000-10-01' - to_months(CAST(3 * i AS INTEGER)) - INTERVAL 1 DAY AS DATE) AS as_of FROM range(8) t(i)),
qm AS (SELECT as_of, CAST(date_trunc('month', as_of) - to_months(CAST(i - 1 AS INTEGER)) - INTERVAL 1 DAY AS DATE) AS me,
  CAST(date_trunc('month', as_of) - INTERVAL 11 MONTH AS DATE) AS ws FROM q CROSS JOIN range(12) t(i)),
"""
q("attrition_series_by_level", lambda wf: turnover_series(wf.employees, quarter_ends(wf.as_of, 8), ["level"]), SERIES + """
lv AS (SELECT DISTINCT level FROM emp WHERE level IS NOT NULL),
ah AS (SELECT level, as_of, avg(n) AS v FROM (SELECT lv.level, as_of, me, count(emp_id) AS n FROM qm CROSS JOIN lv LEFT JOIN emp e
  ON e.level = lv.level AND hire_date <= me AND (term_date IS NULL OR term_date > me) GROUP BY 1, 2, 3) GROUP BY 1, 2),
ex AS (SELECT e.level, as_of, count(*) FILTER (WHERE hire_date <= as_of AND (term_date IS NULL OR term_date > as_of)) AS headcount,
  count(*) FILTER (WHERE hire_date > ws AND hire_date <= as_of) AS hires,
  count(*) FILTER (WHERE term_date > ws AND term_date <= as_of AND term_type = 'voluntary') AS vx,
  count(*) FILTER (WHERE term_date > ws AND term_date <= as_of AND term_type = 'involuntary') AS ix,
  count(*) FILTER (WHERE term_date > ws AND term_date <= as_of AND regrettable = 'yes') AS rx
  FROM emp e CROSS JOIN (SELECT DISTINCT as_of, ws FROM qm) GROUP BY 1, 2)
SELECT ex.level, ex.as_of, headcount, hires, vx AS voluntary_exits, ix AS involuntary_exits, rx AS regrettable_exits, round_even(v, 6) AS avg_headcount,
  coalesce(round_even(100.0 * vx / nullif(v, 0), 1), 0) AS voluntary_pct, coalesce(round_even(100.0 * ix / nullif(v, 0), 1), 0) AS involuntary_pct,
  coalesce(round_even(100.0 * rx / nullif(v, 0), 1), 0) AS regrettable_pct, coalesce(round_even(100.0 * (vx + ix) / nullif(v, 0), 1), 0) AS total_pct
FROM ex JOIN ah ON ex.level = ah.level AND ex.as_of = ah.as_of""")
q("headcount_series", lambda wf: headcount_at(movements(wf.employees), quarter_ends(wf.as_of, 12)),
  """, q AS (SELECT CAST(DATE '2000-10-01' - to_months(CAST(3 * i AS INTEGER)) - INTERVAL 1 DAY AS DATE) AS as_of FROM range(12) t(i))
SELECT as_of, count(*) AS headcount FROM q JOIN emp ON hire_date <= as_of AND (term_date IS NULL OR term_date > as_of) GROUP BY 1""")

# ---- rewards
BAND = ", b AS (SELECT act.*, range_min AS lo, range_mid AS mid, range_max AS hi FROM act JOIN bands ON act.band_id = bands.band_id WHERE base_salary > 0)\n"
q("metric_compa_ratio", rw.compa_ratio, BAND + "SELECT round_even(sum(base_salary) / sum(mid), 3) AS value, round_even(avg(base_salary / mid), 3) AS mean_of_ratios, count(*) AS n FROM b", "bands")
q("segment_compa_ratio_by_family", lambda wf: rw.segment_compa_ratio(wf, "job_family"), BAND + "SELECT job_family, round_even(sum(base_salary) / sum(mid), 3) AS value FROM b GROUP BY 1", "bands")
q("metric_range_penetration", rw.range_penetration, BAND + "SELECT round_even(100.0 * sum(base_salary - lo) / sum(hi - lo), 0) AS value, count(*) AS n FROM b", "bands")
q("range_penetration_histogram", rw.penetration_histogram, BAND + """, lab AS (SELECT unnest(range(12)) AS slot, unnest(['<min', '0-10', '-20', '-30', '-40', '-50', '-60', '-70', '-80', '-90', '-100', '>max']) AS label),
h AS (SELECT CASE WHEN base_salary < lo THEN 0 WHEN base_salary > hi THEN 11 ELSE least(9, floor((100.0 * (base_salary - lo) / (hi - lo)) / 10)) + 1 END AS slot, count(*) AS n FROM b GROUP BY 1)
SELECT label, coalesce(n, 0) AS n FROM lab LEFT JOIN h ON lab.slot = h.slot""", "bands")
q("metric_out_of_band_rate", rw.out_of_band_rate, BAND + f"SELECT {r('below + above', 'n')} AS value, {r('below', 'n')} AS below_min_rate, {r('above', 'n')} AS above_max_rate, {r('n - below - above', 'n')} AS in_band_rate, below, above, n - below - above AS in_band, n FROM (SELECT {c('base_salary < lo')} AS below, {c('base_salary > hi')} AS above, count(*) AS n FROM b)", "bands")
q("metric_raw_pay_gap", rw.raw_pay_gap, BAND + """, m AS (SELECT coalesce(gender_group, '') AS grp, count(*) AS n, median(base_salary) AS median FROM b GROUP BY 1 HAVING count(*) >= 5),
g AS (SELECT *, round_even(100 * (median / max(median) OVER () - 1), 1) AS gap_pct FROM m)
SELECT *, min(gap_pct) OVER () AS value FROM g""", "bands")
q("metric_benefits_enrollment_rate", rw.benefits_enrollment_rate, f"SELECT coalesce(benefit, 'all') AS benefit, {c('''eligible = 'yes' ''')} AS eligible, {c('''eligible = 'yes' AND enrolled = 'yes' ''')} AS enrolled, {r(c('''eligible = 'yes' AND enrolled = 'yes' '''), c('''eligible = 'yes' '''))} AS value FROM benefits GROUP BY ROLLUP (benefit)", "benefits")
q("metric_benefits_cost_per_employee", rw.benefits_cost_per_employee, "SELECT round_even(sum(employer_cost_annual) / (SELECT v FROM hc), 0) AS value, CAST(sum(employer_cost_annual) AS BIGINT) AS total_employer_cost, round_even((SELECT v FROM hc), 1) AS avg_headcount FROM benefits WHERE enrolled = 'yes'", "benefits")

# ---- service desk
PER = f"FROM cases WHERE opened_at <= {CLOCK} AND opened_at > {CLOCK} - INTERVAL 90 DAY"
q("metric_case_volume", sv.case_volume, f"SELECT count(*) AS value, CAST(90 AS INTEGER) AS period_days, round_even(100.0 * count(*) / (SELECT round_even(sum(least(1.0, scheduled_hours / standard_full_time_hours)), 1) FROM act), 1) AS per_100_fte {PER}", "cases")
q("case_volume_by_category", sv.case_volume_by_category, f"SELECT category, count(*) AS n {PER} GROUP BY 1", "cases")
q("metric_sla_attainment", sv.sla_attainment, f"SELECT {r('w', 'd + o')} AS value, w AS within_sla, d AS resolved, o AS open_past_sla FROM (SELECT (SELECT {c('h <= sla_target_hours')} FROM done) AS w, (SELECT count(*) FROM done) AS d, (SELECT {c('age > sla_target_hours')} FROM pend) AS o)", "cases")
q("metric_time_to_resolution", sv.time_to_resolution, "SELECT round_even(median(h), 1) AS value, round_even((SELECT h FROM (SELECT h, row_number() OVER (ORDER BY h) - 1 AS i FROM done) WHERE i = (SELECT CAST(round_even(0.9 * (count(*) - 1), 0) AS BIGINT) FROM done)), 1) AS p90, count(*) AS n FROM done", "cases")
q("metric_reopen_rate", sv.reopen_rate, f"SELECT {r(c('''reopened = 'yes' '''), 'count(*)')} AS value, {c('''reopened = 'yes' ''')} AS reopened, count(*) AS resolved FROM done", "cases")
q("metric_first_contact_resolution", sv.first_contact_resolution, f"SELECT {r(c('''first_contact_resolution = 'yes' '''), 'count(*)')} AS value, {c('''first_contact_resolution = 'yes' ''')} AS fcr, count(*) AS resolved FROM done", "cases")
q("metric_case_csat", sv.case_csat, f"SELECT {r(c('csat >= 4'), 'count(csat)')} AS value, count(csat) AS responses, {c('csat >= 4')} AS satisfied_4_5, {r('count(csat)', 'count(*)')} AS response_rate_pct FROM done", "cases")
q("metric_open_case_backlog", sv.open_case_backlog, f"SELECT count(*) AS value, {c('age > sla_target_hours')} AS breached_open, " + ", ".join(f'{c(f"age >= {lo} AND age < {hi}")} AS "age_{n}"' for n, lo, hi in sv.AGE_BANDS) + " FROM pend", "cases")
q("open_backlog_by_category", sv.backlog_by_category, "SELECT category, count(*) AS n FROM pend GROUP BY 1", "cases")

# ---- finance linkage
TTM = f"(SELECT CAST(sum(revenue_usd) AS BIGINT) FROM (SELECT * FROM financials WHERE period_end <= {A} ORDER BY period_end DESC LIMIT 4))"
TTM0 = "(SELECT CAST(sum(revenue_usd) AS BIGINT) FROM (SELECT * FROM financials WHERE period_end <= DATE '1999-12-31' ORDER BY period_end DESC LIMIT 4))"
FTE = "sum(least(1.0, scheduled_hours / standard_full_time_hours))"
q("metric_ttm_revenue", ln.ttm_revenue, f"SELECT {TTM} AS ttm_revenue", "financials")
q("metric_revenue_per_fte", ln.revenue_per_fte, f"SELECT round_even({TTM} / {FTE}, 0) AS value, {TTM} AS ttm_revenue, round_even({FTE}, 1) AS fte FROM act", "financials")
q("metric_operating_leverage", ln.operating_leverage, f"""SELECT round_even(100 * (tn / fn - ty / fy) / (ty / fy), 1) AS value, round_even(tn / fn, 0) AS revenue_per_fte_now, round_even(ty / fy, 0) AS revenue_per_fte_year_ago,
round_even(100.0 * (tn - ty) / ty, 1) AS revenue_growth_pct, round_even(100.0 * (hn - hy) / hy, 1) AS headcount_growth_pct FROM (SELECT {TTM} AS tn, {TTM0} AS ty, (SELECT {FTE} FROM act) AS fn, (SELECT count(*) FROM act) AS hn,
{FTE} AS fy, count(*) AS hy FROM emp WHERE hire_date <= DATE '1999-12-31' AND (term_date IS NULL OR term_date > DATE '1999-12-31'))""", "financials")
q("metric_workforce_cost_ratio", ln.workforce_cost_ratio, f"SELECT round_even(100.0 * sum(base_salary) / {TTM}, 1) AS value, CAST(sum(base_salary) AS BIGINT) AS base_salary_total, {TTM} AS ttm_revenue FROM act", "financials")

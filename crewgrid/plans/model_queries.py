"""Pay-equity and exit-hazard queries on the views."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from crewgrid.operators import hazard as hz, payfit as pf
from crewgrid.plans.catalog import add
from crewgrid.plans.workforce_queries import load
from crewgrid.sources import rulesets as rs
from crewgrid.views import AS_OF, view

A = f"DATE '{AS_OF}'"
pop = lambda s, d: pf.population(view(s, d, "workers"), AS_OF)
PE = """WITH pop AS (SELECT *, base_salary / standard_full_time_hours AS hourly FROM workers WHERE worker_type = 'employee' AND status <> 'terminated' AND (gender_group IS NOT NULL OR ethnicity_group IS NOT NULL)),
"""
W = ["workers"]
add("pay_equity_exclusions", lambda s, d: pf.exclusions(view(s, d, "workers")), W, """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN worker_type <> 'employee' THEN 'not_employee' WHEN status = 'terminated' THEN 'not_employed_status'
WHEN gender_group IS NULL AND ethnicity_group IS NULL THEN 'missing_all_protected_class' END AS reason FROM workers) WHERE reason IS NOT NULL GROUP BY 1""")
for _k in ("gender_group", "ethnicity_group"):
    add(f"pay_equity_unadjusted_{_k}", lambda s, d, k=_k: pf.unadjusted(pop(s, d), k), W, PE + f"""g AS (SELECT {_k} AS grp, count(*) AS n, avg(hourly) AS m, median(hourly) AS md FROM pop WHERE {_k} IS NOT NULL GROUP BY 1),
r AS (SELECT grp AS rg, m AS rm, md AS rd FROM g WHERE n >= 5 ORDER BY m DESC LIMIT 1)
SELECT grp, n, n < 5 AS suppressed, CASE WHEN n >= 5 THEN round_even(m, 6) END AS mean_hourly, CASE WHEN n >= 5 THEN round_even(md, 6) END AS median_hourly, CASE WHEN n >= 5 THEN round_even((1 - m / rm) * 100, 6) END AS mean_gap_pct,
CASE WHEN n >= 5 THEN round_even((1 - md / rd) * 100, 6) END AS median_gap_pct, grp = rg AS is_reference FROM g, r""")
EU = PE + """s AS (SELECT level, gender_group AS g, count(*) AS n, avg(hourly) AS m, median(hourly) AS md FROM pop WHERE gender_group IS NOT NULL GROUP BY 1, 2),
l AS (SELECT level, CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (WHERE n >= 5) AS k, count(*) FILTER (WHERE n < 5) > 0 AS small, max(m) FILTER (WHERE n >= 5) AS hm, min(m) FILTER (WHERE n >= 5) AS lm, max(md) FILTER (WHERE n >= 5) AS hd, min(md) FILTER (WHERE n >= 5) AS ld,
  arg_max(g, m) FILTER (WHERE n >= 5) AS ag, arg_min(g, m) FILTER (WHERE n >= 5) AS dg FROM s GROUP BY 1),
eu AS (SELECT level, n, k >= 2 AS assessable, small, CASE WHEN k >= 2 THEN ag END AS advantaged, CASE WHEN k >= 2 THEN dg END AS disadvantaged, CASE WHEN k >= 2 THEN round_even((1 - lm / hm) * 100, 6) END AS mean_gap_pct, CASE WHEN k >= 2 THEN round_even((1 - ld / hd) * 100, 6) END AS median_gap_pct,
  k >= 2 AND (1 - lm / hm) * 100 >= 5 AS exceeds, k >= 2 AND (1 - lm / hm) * 100 < 5 AND (1 - ld / hd) * 100 >= 5 AS median_watch FROM l)
"""
add("pay_equity_eu_screen", lambda s, d: pf.eu_screen(pop(s, d), "gender_group"), W, EU + "SELECT * FROM eu")
add("pay_equity_eu_headline", lambda s, d: pf.eu_headline(pf.eu_screen(pop(s, d), "gender_group")), W, EU + "SELECT count(*) AS categories, count(*) FILTER (WHERE exceeds) AS flagged, count(*) FILTER (WHERE median_watch) AS median_watch, count(*) FILTER (WHERE exceeds) > 0 AS joint_assessment FROM eu")
# regressions need a matrix solve, which SQL lacks: checked against numpy in the tests
TEAM = lambda s, d: pf.population(view(s, d, "workers"), AS_OF, ["manager_id"])
# one control with a label per team: its effects are absorbed, and SQL takes out the same team means
add("pay_equity_team_gap", lambda s, d: pf.adjusted(TEAM(s, d), "gender_group", "A", ["B"], controls=["manager_id"], numeric=["tenure"]), W, PE + f"""k AS (SELECT CAST(manager_id AS VARCHAR) AS team, gender_group, hourly, date_diff('day', hire_date, {A}) / 365.25::DOUBLE AS tenure FROM pop WHERE gender_group IN ('A', 'B')),
p AS (SELECT coalesce(team, (SELECT min(team) FROM k)) AS team, ln(hourly) AS y, CASE WHEN gender_group = 'B' THEN 1::DOUBLE ELSE 0 END AS g, tenure AS t FROM k),
dm AS (SELECT team, y AS y0, y - avg(y) OVER w AS y, g - avg(g) OVER w AS g, t - avg(t) OVER w AS t FROM p WINDOW w AS (PARTITION BY team)),
s AS (SELECT sum(g * g) AS gg, sum(g * t) AS gt, sum(t * t) AS tt, sum(g * y) AS gy, sum(t * y) AS ty, sum(y * y) AS yy, count(*) AS n, count(DISTINCT team) AS teams, var_pop(y0) * count(*) AS tss FROM dm),
b AS (SELECT *, (tt * gy - gt * ty) / (gg * tt - gt * gt) AS bg, (gg * ty - gt * gy) / (gg * tt - gt * gt) AS bt FROM s),
e AS (SELECT *, yy - bg * gy - bt * ty AS rss, sqrt((yy - bg * gy - bt * ty) / (n - 2 - teams) * tt / (gg * tt - gt * gt)) AS se FROM b)
SELECT 'B' AS grp, 'A' AS reference, round_even(bg, 6) AS coef, round_even(se, 6) AS se, round_even((1 - exp(bg)) * 100, 6) AS adjusted_gap_pct, round_even((1 - exp(bg + 1.96::DOUBLE * se)) * 100, 6) AS ci_lo, round_even((1 - exp(bg - 1.96::DOUBLE * se)) * 100, 6) AS ci_hi,
  bg + 1.96::DOUBLE * se < 0 OR bg - 1.96::DOUBLE * se > 0 AS significant, n, round_even(1 - rss / tss, 6) AS r2 FROM e""")
# tenure held fixed within team and within site and level at once: several factors, taken out in turn
add("pay_equity_team_site_gap", lambda s, d: pf.absorbed_gap(TEAM(s, d), "gender_group", "A", ["B"], ["manager_id", "location", "level"], ["tenure"]))
add("pay_equity_report_gender", lambda s, d: pf.report(view(s, d, "workers"), AS_OF))
add("metric_adjusted_pay_gap", lambda s, d: pf.adjusted_pay_gap(load(s, d)))


def _fit_one(s, d):
    """ln(salary) on one 0/1 term, where the regression has a closed form."""
    p = load(s, d).active.where("base_salary > 0").select("base_salary", F.when(F.col("level").isin("L6", "L7"), "1").otherwise("0").alias("senior"))
    f = pf.fit(p, "base_salary", {"senior": ["1"]}, [])
    return s.createDataFrame([(t, round(float(b), 8), round(float(e), 8), f["n"], round(float(f["r2"]), 8)) for t, b, e in zip(f["terms"], f["beta"], f["se"])], "term string, coef double, se double, n long, r2 double")


add("ols_single_term", _fit_one, W, f"""WITH p AS (SELECT ln(base_salary) AS y, CASE WHEN level IN ('L6', 'L7') THEN 1.0 ELSE 0.0 END AS x FROM workers WHERE worker_type = 'employee' AND hire_date <= {A} AND (term_date IS NULL OR term_date > {A}) AND base_salary > 0),
r AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, count(*) AS n, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, avg(x) AS mx FROM p),
s AS (SELECT *, sqrt(syy * (1 - r2) / (n - 2)) AS sg FROM r)
SELECT 'intercept' AS term, round_even(a, 8) AS coef, round_even(sg * sqrt(1.0 / n + mx * mx / sxx), 8) AS se, n, round_even(r2, 8) AS r2 FROM s UNION ALL SELECT 'senior=1', round_even(b, 8), round_even(sg / sqrt(sxx), 8), n, round_even(r2, 8) FROM s""")

# ---- hazard: a pinned artifact for scoring and evaluation, a real fit for training
FEATURES = ["comp_ratio", "recent_orders", "order_trend", "tenure_window", "grade", "noise"]
NULLABLE = ["order_trend"]
PINNED = hz.HazardModel(
    [*FEATURES, "order_trend__missing"], -3.0,
    {"comp_ratio": -0.25, "recent_orders": -0.5, "order_trend": 0.125, "tenure_window": 0.375, "grade": 0.0625, "noise": 0.03125, "order_trend__missing": 0.25},
    {"comp_ratio": 0.75, "recent_orders": 0.5, "order_trend": 0.0, "tenure_window": 0.25, "grade": 2.0, "noise": 8.0, "order_trend__missing": 0.125},
    {"comp_ratio": 0.25, "recent_orders": 0.5, "order_trend": 0.5, "tenure_window": 0.5, "grade": 1.5, "noise": 4.0, "order_trend__missing": 0.375}, 50.0, platt=(0.9, -0.75)).check()


def scored(s, d, part="test"):
    x, _ = hz.design(view(s, d, "panel"), FEATURES, NULLABLE)
    score = F.bround(hz.logit(PINNED), 9)
    return x.where(F.col("part") == part).select("emp_id", "row_id", "month_index", "level", "job_family", "location", "event_next", "y", score.alias("score"), F.bround(hz.calibrated(PINNED), 9).alias("p"))


_Z = " + ".join(f"{PINNED.coef[f]!r}::DOUBLE * ((coalesce({f}, 0.0::DOUBLE) - {PINNED.mean[f]!r}::DOUBLE) / {PINNED.std[f]!r}::DOUBLE)" for f in FEATURES)
_M = f"0.25::DOUBLE * ((CASE WHEN order_trend IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END - 0.125::DOUBLE) / 0.375::DOUBLE)"
HZ = f"""WITH sc AS (SELECT *, -3.0::DOUBLE + {_Z} + {_M} AS z, CASE WHEN event_next = 'voluntary' THEN 1 ELSE 0 END AS y FROM panel),
sall AS (SELECT *, round_even(z, 9) AS score, round_even(1 / (1 + exp(-(0.9::DOUBLE * z - 0.75::DOUBLE))), 9) AS p FROM sc),
t AS (SELECT * FROM sall WHERE month_index > 29)
"""
P = ["panel"]
add("hazard_panel_design", lambda s, d: hz.design(view(s, d, "panel"), FEATURES, NULLABLE)[0].groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("events"), F.sum("order_trend__missing").cast("bigint").alias("missing")), P,
    "SELECT CASE WHEN month_index <= 23 THEN 'train' WHEN month_index <= 29 THEN 'calibration' ELSE 'test' END AS part, count(*) AS n, count(*) FILTER (WHERE event_next = 'voluntary') AS events, count(*) FILTER (WHERE order_trend IS NULL) AS missing FROM panel GROUP BY 1")
add("hazard_scores", lambda s, d: scored(s, d).select("row_id", "score", "p"), P, HZ + "SELECT row_id, score, p FROM t")
add("hazard_ranking_quality", lambda s, d: hz.ranking_quality(scored(s, d)).select("n_rows", *[F.bround(c, 8).alias(c) for c in ("roc_auc", "pr_auc", "base_rate")]), P, HZ + """, b AS (SELECT score, count(*) AS n, sum(y) AS pos FROM t GROUP BY 1),
c AS (SELECT *, sum(n) OVER (ORDER BY score) - n AS bn, sum(n) OVER () AS tn, sum(pos) OVER () AS tp, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn FROM b)
SELECT CAST(max(tn) AS BIGINT) AS n_rows, round_even((sum(pos * (bn + (n + 1) / 2.0::DOUBLE)) - max(tp) * (max(tp) + 1) / 2.0::DOUBLE) / (max(tp) * (max(tn) - max(tp))), 8) AS roc_auc, round_even(sum(pos * (cp / cn)) / max(tp), 8) AS pr_auc, round_even(max(tp) / max(tn), 8) AS base_rate FROM c""")
add("hazard_precision_at_top", lambda s, d: hz.precision_at_top(scored(s, d)).withColumn("precision", F.bround("precision", 8)), P, HZ + """, k AS (SELECT *, row_number() OVER (PARTITION BY month_index ORDER BY score DESC, row_id) AS rn, greatest(1, floor(count(*) OVER (PARTITION BY month_index) * 0.1::DOUBLE)) AS k FROM t),
f AS (SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS h FROM k WHERE rn <= k)
SELECT n AS n_flagged, h AS hits, CASE WHEN n >= 50 THEN round_even(h / n, 8) END AS precision, CASE WHEN n >= 50 THEN 'ok' ELSE 'insufficient_denominator' END AS status FROM f""")
add("hazard_brier", lambda s, d: hz.brier(scored(s, d)).withColumn("brier", F.bround("brier", 9)), P, HZ + "SELECT round_even(avg((p - y) * (p - y)), 9) AS brier, count(*) AS n FROM t")
add("hazard_test_outcomes", lambda s, d: hz.outcomes(scored(s, d)), P, HZ + "SELECT emp_id, max(p) AS risk, max(month_index) AS term_month, arg_max(event_next = 'voluntary', month_index) AS is_event FROM t GROUP BY 1")
add("hazard_concordance", lambda s, d: hz.concordance(hz.outcomes(scored(s, d))).withColumn("concordance", F.bround("concordance", 8)), P, HZ + """, o AS (SELECT emp_id, max(p) AS risk, max(month_index) AS tm, arg_max(event_next = 'voluntary', month_index) AS ev FROM t GROUP BY 1)
SELECT round_even(sum(CASE WHEN a.risk > b.risk THEN 1.0::DOUBLE WHEN a.risk = b.risk THEN 0.5::DOUBLE ELSE 0 END) / nullif(count(*), 0), 8) AS concordance, count(*) AS comparable_pairs FROM o a JOIN o b ON a.ev AND b.tm > a.tm""")
add("hazard_reliability", lambda s, d: hz.reliability(scored(s, d)), P, HZ + """, k AS (SELECT *, row_number() OVER (ORDER BY p, row_id) - 1 AS i, count(*) OVER () AS n FROM t),
b AS (SELECT b.b + 1 AS bin, p, y FROM k JOIN (SELECT unnest(range(10)) AS b) b ON i >= (b.b * n) // 10 AND i < ((b.b + 1) * n) // 10)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round_even(avg(p), 6) AS mean_pred, round_even(avg(y), 6) AS obs_freq, round_even(avg(p) - avg(y), 6) AS gap FROM b GROUP BY 1""")
BANDS = """, cal AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS i, count(*) OVER () AS n FROM sall WHERE month_index > 23 AND month_index <= 29),
bd AS (SELECT max(n) AS n_obs, max(p) FILTER (WHERE i = CAST(round_even(0.85::DOUBLE * (n - 1), 0) AS BIGINT)) AS elevated, max(p) FILTER (WHERE i = CAST(round_even(0.97::DOUBLE * (n - 1), 0) AS BIGINT)) AS high FROM cal)
"""
add("hazard_risk_bands", lambda s, d: hz.risk_bands(scored(s, d, "calibration")), P, HZ + BANDS + "SELECT * FROM bd")
add("hazard_tier_counts", lambda s, d: hz.tier_counts(scored(s, d), hz.risk_bands(scored(s, d, "calibration"))), P, HZ + BANDS + "SELECT CASE WHEN p >= high THEN 'high' WHEN p >= elevated THEN 'elevated' ELSE 'low' END AS tier, count(*) AS person_months FROM t, bd GROUP BY 1")
SEG = """, lg AS (SELECT emp_id, month_index, p, y, unnest(['level', 'job_family', 'location']) AS dim, unnest([level, job_family, location]) AS value FROM t),
mo AS (SELECT dim, value, month_index, avg(p) AS h, avg(y) AS r, count(*) AS n, row_number() OVER (PARTITION BY dim, value ORDER BY month_index) AS k FROM lg GROUP BY 1, 2, 3),
cv AS (SELECT dim, value, round_even(1 - product(CASE WHEN k <= 6 THEN 1 - h ELSE 1 END), 6) AS bu, round_even(1 - product(CASE WHEN k <= 6 THEN 1 - r ELSE 1 END), 6) AS td, CAST(sum(n) AS BIGINT) AS rows, count(*) AS mo FROM mo GROUP BY 1, 2),
sg AS (SELECT cv.*, e.n_emp, e.n_emp < 30 AS sup FROM cv JOIN (SELECT dim, value, count(DISTINCT emp_id) AS n_emp FROM lg GROUP BY 1, 2) e ON cv.dim = e.dim AND cv.value = e.value),
seg AS (SELECT dim, value, sup AS suppressed, CASE WHEN sup THEN CASE WHEN n_emp < 10 THEN '<10' ELSE '10-29' END END AS size_band, CASE WHEN NOT sup THEN n_emp END AS n_employees, CASE WHEN NOT sup THEN rows END AS n_rows, CASE WHEN NOT sup THEN bu END AS bottom_up, CASE WHEN NOT sup THEN td END AS top_down,
  CASE WHEN NOT sup THEN round_even(bu - td, 6) END AS gap, CASE WHEN NOT sup THEN abs(round_even(bu - td, 6)) > 0.02 END AS gap_flagged, CASE WHEN NOT sup THEN mo < 6 END AS incomplete_window FROM sg)
"""
segs = lambda s, d: hz.segment_risk(scored(s, d), ["level", "job_family", "location"])
add("hazard_segment_risk", segs, P, HZ + SEG + "SELECT * FROM seg")
add("hazard_reconciliation", lambda s, d: hz.reconciliation(segs(s, d)), P, HZ + SEG + "SELECT count(*) FILTER (WHERE NOT suppressed) AS n_segments, count(*) FILTER (WHERE suppressed) AS n_suppressed, count(*) FILTER (WHERE gap_flagged) AS n_flagged, coalesce(max(abs(gap)), 0) AS max_abs_gap FROM seg")
DIMS = ["level", "job_family", "location"]
SETS = [c for k in (1, 2) for c in itertools.combinations(DIMS, k)]
_said = lambda what: "concat_ws(' & ', " + ", ".join(f"CASE WHEN NOT g{i} THEN {what(c)} END" for i, c in enumerate(DIMS)) + ")"
COMBINED = f""", mg AS (SELECT {', '.join(DIMS)}, {', '.join(f'GROUPING({c}) = 1 AS g{i}' for i, c in enumerate(DIMS))}, month_index, avg(p) AS h, avg(y) AS r, count(*) AS n FROM t GROUP BY GROUPING SETS ({', '.join(f"({', '.join(c)}, month_index)" for c in SETS)})),
pg AS (SELECT {', '.join(DIMS)}, {', '.join(f'GROUPING({c}) = 1 AS g{i}' for i, c in enumerate(DIMS))}, count(DISTINCT emp_id) AS n_emp FROM t GROUP BY GROUPING SETS ({', '.join(f"({', '.join(c)})" for c in SETS)})),
mo AS (SELECT dim, value, h, r, n, row_number() OVER (PARTITION BY dim, value ORDER BY month_index) AS k FROM (SELECT *, {_said(lambda c: f"'{c}'")} AS dim, {_said(lambda c: f"'{c}=' || coalesce({c}, '(none)')")} AS value FROM mg)),
cv AS (SELECT dim, value, round_even(1 - product(CASE WHEN k <= 6 THEN 1 - h ELSE 1 END), 6) AS bu, round_even(1 - product(CASE WHEN k <= 6 THEN 1 - r ELSE 1 END), 6) AS td, CAST(sum(n) AS BIGINT) AS rows, count(*) AS mo FROM mo GROUP BY 1, 2),
sg AS (SELECT cv.*, e.n_emp, e.n_emp < 30 AS sup FROM cv JOIN (SELECT {_said(lambda c: f"'{c}'")} AS dim, {_said(lambda c: f"'{c}=' || coalesce({c}, '(none)')")} AS value, n_emp FROM pg) e ON cv.dim = e.dim AND cv.value = e.value),
""" + SEG[SEG.index("seg AS"):]
combined = lambda s, d: hz.combined_segment_risk(scored(s, d), DIMS)
add("hazard_combined_segments", combined, P, HZ + COMBINED + "SELECT * FROM seg")
add("hazard_extreme_segments", lambda s, d: hz.extreme_segments(combined(s, d)), P, HZ + COMBINED + """, sh AS (SELECT * FROM seg WHERE NOT suppressed), al AS (SELECT *, dim AS scope FROM sh UNION ALL SELECT *, 'all' FROM sh),
rk AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY bottom_up DESC, dim, value) AS hi, row_number() OVER (PARTITION BY scope ORDER BY bottom_up, dim, value) AS lo, row_number() OVER (PARTITION BY scope ORDER BY abs(gap) DESC, dim, value) AS wg FROM al)
SELECT scope AS dim, w AS which, value AS segment, n_employees, bottom_up, gap FROM rk, (VALUES ('highest'), ('lowest'), ('widest_gap')) v(w) WHERE CASE w WHEN 'highest' THEN hi WHEN 'lowest' THEN lo ELSE wg END = 1""")
CO = """, mo AS (SELECT month_index, avg(p) AS h, avg(y) AS r, count(*) AS n, row_number() OVER (ORDER BY month_index) AS k FROM t GROUP BY 1)
"""
add("hazard_company_risk", lambda s, d: hz.company_risk(scored(s, d)), P, HZ + CO + ", c AS (SELECT round_even(1 - product(1 - h), 6) AS bu, round_even(1 - product(1 - r), 6) AS td, CAST(sum(n) AS BIGINT) AS n, count(*) AS m FROM mo WHERE k <= 6) SELECT bu AS bottom_up, td AS top_down, round_even(bu - td, 6) AS gap, (SELECT count(DISTINCT emp_id) FROM t) AS n_employees, n AS n_rows, m AS months_observed FROM c")
add("hazard_company_survival", lambda s, d: hz.company_survival(scored(s, d)), P, HZ + CO + """, pt AS (SELECT CAST(i AS INTEGER) AS i, coalesce(h, (SELECT avg(h) FROM mo)) AS h, h IS NOT NULL AS ob FROM (SELECT unnest(range(1, 13)) AS i) g LEFT JOIN mo ON mo.k = g.i)
SELECT a.i AS month_ahead, round_even(product(1 - b.h), 6) AS survival, round_even(1 - product(1 - b.h), 6) AS p_exit, any_value(a.ob) AS observed FROM pt a JOIN pt b ON b.i <= a.i GROUP BY 1""")
add("hazard_top_contributions", lambda s, d: hz.design(view(s, d, "panel"), FEATURES, NULLABLE)[0].where("part = 'test'").select("row_id", F.inline(hz.top_contributions(PINNED, 2))).withColumn("contribution", F.bround("contribution", 7)), P,
    HZ + ", c AS (SELECT row_id, unnest(['comp_ratio', 'recent_orders', 'order_trend', 'tenure_window', 'grade', 'noise', 'order_trend__missing']) AS feature, unnest([" + ", ".join(f"{PINNED.coef[f]!r}::DOUBLE * (coalesce({f}, 0.0::DOUBLE) - {PINNED.mean[f]!r}::DOUBLE) / {PINNED.std[f]!r}::DOUBLE" for f in FEATURES) + f", {_M}]) AS contribution FROM t) SELECT row_id, feature, round_even(contribution, 7) AS contribution FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY -abs(contribution), feature) AS k FROM c) WHERE k <= 2")
add("contract_panel", lambda s, d: rs.panel(view(s, d, "panel").where("row_id % 1009 <> 5"), FEATURES, NULLABLE), P, """WITH q AS (SELECT * FROM panel WHERE row_id % 1009 <> 5), per AS (SELECT emp_id, min(month_index) AS a, max(month_index) AS b, count(*) AS n, max(month_index) FILTER (WHERE event_next <> 'none') AS tm FROM q GROUP BY 1)
SELECT 'person_months_gap' AS rule, CAST(emp_id AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS detail FROM per WHERE b - a + 1 <> n UNION ALL SELECT 'terminal_event_last', CAST(emp_id AS VARCHAR), NULL FROM per WHERE tm < b""")


def _fitted(s, d):
    """All train and calibration months; the fit and its intervals use no others, and no other columns."""
    months = view(s, d, "panel").where(F.col("month_index") <= hz.CALIBRATION_END).select("month_index", "event_next", *FEATURES)
    m, x = hz.train(months, FEATURES, NULLABLE)
    return hz.coefficient_intervals(m, x)


add("hazard_fit_intervals", _fitted)

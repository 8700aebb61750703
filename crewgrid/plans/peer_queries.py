"""Peer groups, pay-for-performance screens and pay benchmarking on the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewgrid.operators import benchmarking as bm, peers as pr, screens as sc
from crewgrid.plans.catalog import add
from crewgrid.views import view

SUBJECT = 5


def _c(s, d):
    return view(s, d, "companies")


def _screened(s, d, criteria=None, renormalise=False):
    return pr.screen(_c(s, d), SUBJECT, criteria, renormalise)


CLOSE = "CASE WHEN c.{0} > 0 AND s.{0} > 0 THEN greatest(0.0, 1 - abs(ln(CAST(c.{0} AS DOUBLE) / s.{0})) / ln(2)) ELSE 0 END"
FIT = "round_even(100.0 * (0.5 * " + CLOSE.format("revenue_usd") + " + 0.3 * " + CLOSE.format("market_cap_usd") + " + 0.2 * " + CLOSE.format("employees") + "), 1)"
SCR = f"""WITH scr AS (SELECT c.*, rv AS revenue_ok, mc AS market_cap_ok, g AS group_ok, CAST(rv AS INTEGER) + CAST(mc AS INTEGER) + CAST(g AS INTEGER) AS pass_count,
  rv AND mc AND g AS is_peer, fit, abs(c.revenue_usd - s_rev) AS revenue_distance
FROM (SELECT c.*, s.revenue_usd AS s_rev, c.revenue_usd BETWEEN s.revenue_usd * 0.5 AND s.revenue_usd * 2.0 AS rv,
   c.market_cap_usd BETWEEN s.market_cap_usd * 0.5 AND s.market_cap_usd * 2.0 AS mc, c.subindustry = s.subindustry AS g, {FIT} AS fit
  FROM companies c CROSS JOIN (SELECT * FROM companies WHERE ticker = {SUBJECT}) s WHERE c.ticker <> {SUBJECT}) c)
"""
PICK = ["ticker", "revenue_ok", "market_cap_ok", "group_ok", "pass_count", "is_peer", "fit", "revenue_distance"]
add("peer_screen", lambda s, d: pr.listing(_screened(s, d)).select(*PICK), ["companies"], SCR + f"SELECT {', '.join(PICK)} FROM scr")
add("peer_screen_two_of_three", lambda s, d: _screened(s, d, {"min_criteria": 2}).where("is_peer").select("ticker", "pass_count", "fit"), ["companies"],
    SCR + "SELECT ticker, pass_count, fit FROM scr WHERE pass_count >= 2")
add("peer_screen_generic", lambda s, d: _screened(s, d, {"group": "sector"}, True).select("ticker", "is_peer", "fit"), ["companies"],
    SCR + f"SELECT scr.ticker, revenue_ok AND market_cap_ok AND sector = (SELECT sector FROM companies WHERE ticker = {SUBJECT}) AS is_peer, fit FROM scr")
add("peer_core_and_watchlist", lambda s, d: pr.core_and_watchlist(_screened(s, d), 3).select("ticker", "fit", "part"), ["companies"],
    SCR + "SELECT ticker, fit, CASE WHEN row_number() OVER (ORDER BY fit DESC, ticker) <= 3 THEN 'core' ELSE 'watchlist' END AS part FROM scr WHERE is_peer")
add("peer_exclusions", lambda s, d: pr.exclusions(_screened(s, d)).select("ticker", "pass_count", "group_ok", "revenue_distance"), ["companies"],
    SCR + "SELECT ticker, pass_count, group_ok, revenue_distance FROM scr WHERE NOT is_peer")
add("peer_revenue_histogram", lambda s, d: pr.equal_width_histogram(_c(s, d), "revenue_usd", 5), ["companies"],
    """WITH b AS (SELECT least(floor((revenue_usd - min(revenue_usd) OVER ()) / ((max(revenue_usd) OVER () - min(revenue_usd) OVER ()) / 5.0::DOUBLE)), 4) AS k FROM companies)
SELECT CAST(i AS INTEGER) AS bucket, count(b.k) AS n FROM range(5) t(i) LEFT JOIN b ON b.k = i GROUP BY 1""")
add("first_degree_peers", lambda s, d: pr.first_degree(view(s, d, "peer_edges")), ["peer_edges"],
    """SELECT subject, peer, max(c) AS cited, max(n) AS citing FROM (SELECT src AS subject, dst AS peer, 1 AS c, 0 AS n FROM peer_edges UNION ALL SELECT dst, src, 0, 1 FROM peer_edges) GROUP BY 1, 2""")

REACH = """fd AS (SELECT subject, peer, max(c) AS cited, max(n) AS citing FROM (SELECT src AS subject, dst AS peer, 1 AS c, 0 AS n FROM peer_edges UNION ALL SELECT dst, src, 0, 1 FROM peer_edges) GROUP BY 1, 2),
cand AS (SELECT subject, ticker, max(f) AS first_degree, sum(h) AS citations FROM (
  SELECT subject, peer AS ticker, 1 AS f, cited + citing AS h FROM fd UNION ALL SELECT fd.subject, e.dst, 0, 1 FROM fd JOIN peer_edges e ON fd.peer = e.src) WHERE subject <> ticker GROUP BY 1, 2),
sized AS (SELECT cand.*, c.revenue_usd AS r, c.market_cap_usd AS m, c.sector, c.subindustry, s.revenue_usd AS sr, s.market_cap_usd AS sm, s.sector AS ss, s.subindustry AS si
  FROM cand JOIN companies c ON cand.ticker = c.ticker JOIN companies s ON cand.subject = s.ticker),
cmp AS (SELECT * FROM (SELECT subject, ticker, first_degree, CAST(row_number() OVER (PARTITION BY subject ORDER BY CASE WHEN subindustry = si THEN 0 WHEN sector = ss THEN 1 ELSE 2 END, first_degree DESC, abs(r - sr), ticker) AS INTEGER) AS rank_no
  FROM sized WHERE r / sr BETWEEN 0.4::DOUBLE AND 2.5::DOUBLE AND m / sm BETWEEN 0.25::DOUBLE AND 4.0::DOUBLE) WHERE rank_no <= 24),
coc AS (SELECT * FROM (SELECT subject, ticker, CAST(citations AS BIGINT) AS citations, CAST(row_number() OVER (PARTITION BY subject ORDER BY citations DESC, abs(m - sm), ticker) AS INTEGER) AS rank_no
  FROM sized WHERE m BETWEEN 0.33::DOUBLE * sm AND 3.0::DOUBLE * sm) WHERE rank_no <= 15)
"""
G = ["companies", "peer_edges"]


def _cmp(s, d):
    return pr.comparison_groups(_c(s, d), view(s, d, "peer_edges"))


def _coc(s, d):
    return pr.cocitation_groups(_c(s, d), view(s, d, "peer_edges"))


add("comparison_groups", _cmp, G, "WITH " + REACH + "SELECT * FROM cmp")
add("cocitation_groups", _coc, G, "WITH " + REACH + "SELECT * FROM coc")
add("peer_group_overlap", lambda s, d: pr.group_overlap(_cmp(s, d), _coc(s, d)), G,
    "WITH " + REACH + """SELECT coalesce(a.subject, b.subject) AS subject, count(a.ticker) AS left_n, count(b.ticker) AS right_n, count(a.ticker) FILTER (WHERE b.ticker IS NOT NULL) AS both_n
FROM cmp a FULL JOIN coc b ON a.subject = b.subject AND a.ticker = b.ticker GROUP BY 1""")


def _wls(vals, xs, ws):
    sw, swx, swxx = sum(ws), sum(w * x for w, x in zip(ws, xs)), sum(w * x * x for w, x in zip(ws, xs))
    swp = " + ".join(f"{w!r}::DOUBLE * {v}" for w, v in zip(ws, vals))
    swxp = " + ".join(f"{w * x!r}::DOUBLE * {v}" for w, x, v in zip(ws, xs, vals))
    return f"((({sw!r}::DOUBLE * ({swxp}) - {swx!r}::DOUBLE * ({swp})) / {sw * swxx - swx * swx!r}::DOUBLE) / (({swp}) / {sw!r}::DOUBLE))"


def _iss_sql(year):
    p = sc.ISS_POLICIES[year]
    b, k = p["bands"], p["rda_years"]
    pay = lambda n: "(" + " + ".join(f"pay_y{y}" for y in range(6 - n, 6)) + f") / {n}.0::DOUBLE"
    base = "100.0::DOUBLE" if k == 5 else f"tsrval_y{5 - k}"
    pt = _wls([f"pay_y{y}" for y in range(1, 6)], (1, 2, 3, 4, 5), sc.PAY_WEIGHTS)
    tt = _wls(["100.0::DOUBLE"] + [f"tsrval_y{y}" for y in range(1, 6)], (0, 1, 2, 3, 4, 5), sc.TSR_WEIGHTS)
    rk = lambda v: f"round_even(100.0::DOUBLE * (count(*) FILTER (WHERE m.{v} < s.{v}) + count(*) FILTER (WHERE m.{v} = s.{v}) / 2.0::DOUBLE) / count(*), 2)"
    mom = {(1,): "a1", (1, 3): "(a1 + a3) / 2.0::DOUBLE"}[p["mom_blend"]]
    lab = lambda c: f"(['Low', 'Medium', 'High'])[{c} + 1]"
    hi = lambda c, q: f"CASE WHEN {c} >= {b[q]['high']} THEN 2 WHEN {c} >= {b[q]['medium']} THEN 1 ELSE 0 END"
    lo = lambda c, q: f"CASE WHEN {c} <= {b[q]['high']} THEN 2 WHEN {c} <= {b[q]['medium']} THEN 1 ELSE 0 END"
    return "WITH " + REACH + f""", ms AS (SELECT ticker, {pay(1)} AS p1, {pay(3)} AS p3, round_even({pay(k)}, 9) AS pw, round_even(tsrval_y5 / {base} - 1, 9) AS tw, round_even(fin_eva, 9) AS fe, {pt} AS pt, {tt} AS tt FROM company_years),
iss0 AS (SELECT g.subject, count(*) AS n_group, any_value(s.p1) / median(m.p1) AS a1, any_value(s.p3) / median(m.p3) AS a3, {rk('pw')} AS pp, {rk('tw')} AS tp, {rk('fe')} AS fp, any_value(s.tt - s.pt) AS tr
  FROM cmp g JOIN ms m ON g.ticker = m.ticker JOIN ms s ON g.subject = s.ticker GROUP BY 1 HAVING count(*) >= 12),
iss1 AS (SELECT subject, n_group, pp, tp, fp, {mom} AS mom, round_even(tp - pp, 2) AS rda, round_even(tr * 100, 2) AS pta, round_even(fp - pp, 2) AS fpa FROM iss0),
iss2 AS (SELECT *, {hi('mom', 'mom')} AS mc, {lo('rda', 'rda')} AS rc, {lo('pta', 'pta')} AS pc,
  (mom >= {b['mom']['fpa_eligible']} AND mom < {b['mom']['medium']}) OR (rda > {b['rda']['medium']} AND rda <= {b['rda']['fpa_eligible']}) OR (pta > {b['pta']['medium']} AND pta <= {b['pta']['fpa_eligible']}) AS borders FROM iss1),
iss3 AS (SELECT *, CAST(mc = 2 AS INT) + CAST(rc = 2 AS INT) + CAST(pc = 2 AS INT) AS nh, CAST(mc = 1 AS INT) + CAST(rc = 1 AS INT) + CAST(pc = 1 AS INT) AS nm FROM iss2),
iss4 AS (SELECT *, CASE WHEN nh + nm >= 2 THEN 2 WHEN nh = 1 THEN CASE WHEN fpa > 20 THEN 1 ELSE 2 END WHEN nm = 1 THEN CASE WHEN fpa < -20 THEN 2 WHEN fpa > 20 THEN 0 ELSE 1 END
    WHEN borders AND fpa < -20 THEN 1 ELSE 0 END AS ov,
  CASE WHEN nh + nm >= 2 THEN false WHEN nh = 1 THEN fpa > 20 WHEN nm = 1 THEN fpa < -20 OR fpa > 20 ELSE borders AND fpa < -20 END AS ap FROM iss3),
iss AS (SELECT subject, n_group, round_even(mom, 3) AS mom, rda, pta, fpa, pp AS pay_pctile, tp AS tsr_pctile, fp AS fin_pctile, {lab('mc')} AS mom_band, {lab('rc')} AS rda_band, {lab('pc')} AS pta_band, borders, ap AS fpa_applied, {lab('ov')} AS concern,
  CASE WHEN ov = 0 THEN '' ELSE concat(CASE WHEN mom >= {b['mom']['fpa_eligible']} THEN 'magnitude;' ELSE '' END, CASE WHEN rda <= {b['rda']['fpa_eligible']} THEN 'relative_degree;' ELSE '' END,
    CASE WHEN pta <= {b['pta']['fpa_eligible']} THEN 'trend;' ELSE '' END, CASE WHEN fpa < 0 THEN 'financials;' ELSE '' END, 'incentive_design;problematic_practices;responsiveness') END AS triggers FROM iss4)
"""


def _iss(s, d, year=2026):
    return sc.iss_screen(view(s, d, "company_years"), _cmp(s, d), year)


for _year in (2025, 2026):
    add(f"iss_screen_{_year}", lambda s, d, y=_year: _iss(s, d, y), G + ["company_years"], _iss_sql(_year) + "SELECT * FROM iss")


def _gl_sql():
    av = lambda vals, ws: "(" + " + ".join(f"({v}) * {w}::DOUBLE" for v, w in zip(vals, ws)) + f") / {sum(ws)!r}::DOUBLE"
    w5, w3 = sc.YEAR_WEIGHTS_5, sc.YEAR_WEIGHTS_3
    ys = range(1, 6)
    gr = lambda n: av([f"{n}_y{y} / {n}_y{y - 1} - 1.0::DOUBLE" for y in (3, 4, 5)], w3)
    ix = ["100.0::DOUBLE"] + [f"tsrval_y{y}" for y in ys]
    raw = {"ceo": av([f"pay_y{y}" for y in ys], w5), "neo": av([f"pay_y{y} + neo_other_pay_y{y}" for y in ys], w5),
           "sti": av([f"sti_payout_y{y} / sti_target_y{y}" for y in ys], w5), "tsr": av([f"{ix[i]} / {ix[i - 1]} - 1.0::DOUBLE" for i in ys], w5),
           "rev_growth": gr("rev"), "eps_growth": gr("eps"), "ocf_growth": gr("ocf"),
           "roe": av([f"roe_y{y}" for y in (3, 4, 5)], w3), "roa": av([f"roa_y{y}" for y in (3, 4, 5)], w3)}
    meas = ", ".join(f"round_even({v}, 9) AS {k}" for k, v in raw.items())
    rk = ", ".join(f"round_even(100.0::DOUBLE * (count(*) FILTER (WHERE m.{v} < s.{v}) + (count(*) FILTER (WHERE m.{v} = s.{v})) / 2.0::DOUBLE) / count(*), 2) AS {v}_p" for v in raw)
    band = lambda c, bs: "CASE " + " ".join(f"WHEN {c} <= {h} THEN '{l}'" for h, l in bs[:-1]) + f" ELSE '{bs[-1][1]}' END"
    al = lambda a, p: f"greatest(0.0::DOUBLE, least(100.0::DOUBLE, 85.0::DOUBLE - 1.6::DOUBLE * ({a} - {p})))"
    comp = " + ".join(f"{k} * {w}::DOUBLE" for k, w in sc.TEST_WEIGHTS.items())
    sw = sum(sc.TEST_WEIGHTS.values())
    return f""", gm AS (SELECT ticker, {meas}, (cap_y1 + cap_y2 + cap_y3 + cap_y4 + cap_y5) / tsrval_y5 AS cr, round_even(prior_support_pct, 1) AS sup, responsiveness AS resp FROM company_years),
gl0 AS (SELECT g.subject, count(*) AS n_peers, {rk}, any_value(s.cr) AS scr, any_value(s.sup) AS sup, any_value(s.resp) AS resp, list(m.cr) AS crs
  FROM coc g JOIN gm m ON g.ticker = m.ticker JOIN gm s ON g.subject = s.ticker GROUP BY 1 HAVING count(*) >= 10),
gl1 AS (SELECT *, (rev_growth_p + eps_growth_p + ocf_growth_p + roe_p + roa_p) / 5 AS fin_p, scr / list_aggregate(list_append(crs, scr), 'median') AS ex FROM gl0),
gl2 AS (SELECT *, {al('ceo_p', 'tsr_p')} AS ceo_tsr, {al('ceo_p', 'fin_p')} AS ceo_fin, {al('sti_p', 'tsr_p')} AS sti_tsr, {al('neo_p', 'fin_p')} AS neo_fin,
  CASE WHEN ex <= 1.5 THEN 90.0::DOUBLE ELSE greatest(0.0::DOUBLE, 90.0::DOUBLE - (ex - 1.5::DOUBLE) * 80.0::DOUBLE) END AS cap_tsr, CASE WHEN sti_p > 60 AND tsr_p < 40 THEN 8.0::DOUBLE ELSE 0.0::DOUBLE END AS penalty FROM gl1),
gl3 AS (SELECT *, ({comp}) / {sw!r}::DOUBLE AS quant FROM gl2),
gl4 AS (SELECT *, round_even(greatest(0.0::DOUBLE, least(100.0::DOUBLE, quant - penalty)), 1) AS composite, round_even(ceo_tsr, 1) AS t_only, round_even((ceo_fin + neo_fin) / 2, 1) AS f_only FROM gl3),
gl AS (SELECT subject, n_peers, composite, {band('composite', sc.CONCERN_BANDS)} AS concern, round_even(quant, 1) AS quant_score, penalty,
  {", ".join(f"round_even({c}_p, 1) AS {c}_pctile" for c in ("ceo", "neo", "sti", "tsr", "fin"))}, round_even(ex, 2) AS cap_excess,
  {", ".join(f"round_even({k}, 1) AS {k}_score" for k in sc.TEST_WEIGHTS)}, {", ".join(band(f"round_even({k}, 1)", sc.TEST_BANDS) + f" AS {k}_band" for k in sc.TEST_WEIGHTS)},
  t_only AS tsr_only_score, {band('t_only', sc.CONCERN_BANDS)} AS tsr_only_concern, f_only AS fin_only_score, {band('f_only', sc.CONCERN_BANDS)} AS fin_only_concern,
  sup AS prior_support_pct, sup < 80 AS below_threshold, CASE WHEN sup >= 80 THEN 'none' WHEN resp = 'robust' THEN 'low' WHEN resp = 'limited' THEN 'elevated' ELSE 'high' END AS recommendation_concern FROM gl4)
"""


def _gl(s, d):
    return sc.gl_scorecard(view(s, d, "company_years"), _coc(s, d))


add("gl_scorecard", _gl, G + ["company_years"], "WITH " + REACH + _gl_sql() + "SELECT * FROM gl")
add("advisor_reconciliation", lambda s, d: sc.advisor_reconciliation(_iss(s, d), _gl(s, d)), G + ["company_years"], _iss_sql(2026) + _gl_sql() + """,
o AS (SELECT iss.subject, iss.concern AS iss_concern, gl.concern AS gl_concern, composite AS gl_composite, CASE iss.concern WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END AS i,
  CASE gl.concern WHEN 'Negligible' THEN 0 WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END AS g FROM iss JOIN gl ON iss.subject = gl.subject)
SELECT subject, iss_concern, gl_concern, gl_composite, CASE WHEN i = 0 AND g = 0 THEN 'CLEAN SWEEP' WHEN g = 0 THEN 'ISS-ONLY FLAG' WHEN i = 0 THEN 'GL-ONLY FLAG' WHEN i = 2 OR g = 2 THEN 'TWO-FRONT FIGHT' ELSE 'DUAL WATCH' END AS verdict,
  (i >= 1) = (g >= 1) AS agree, ([90.0::DOUBLE, 80, 72, 62, 52])[i + g + 1] AS support_lo, ([96.0::DOUBLE, 92, 86, 78, 74])[i + g + 1] AS support_hi FROM o""")

# ---- benchmarking: supplier 0 against all other suppliers
BSUB = 0
INC = f"""WITH t AS (SELECT *, salary + bonus + stock_awards + option_awards + non_equity_incentive + other_comp AS total, NOT regexp_matches(lower(title), 'former|outgoing|interim|retired') AS sitting FROM proxy_pay),
pick AS (SELECT *, row_number() OVER (PARTITION BY ticker, role ORDER BY sitting DESC, total DESC, title DESC, salary DESC, bonus DESC, stock_awards DESC, option_awards DESC, non_equity_incentive DESC, other_comp DESC, row_id DESC) AS rn
  FROM t WHERE ticker = {BSUB} OR (disclosure = 'def14a' AND NOT starts_with(row_caveat, 'EXCLUDE:'))),
inc AS (SELECT * FROM pick WHERE rn = 1),
el AS (SELECT ticker, role, unnest(['base', 'sti', 'total_cash', 'ltie', 'tdc']) AS element,
  unnest([salary::DOUBLE, (bonus + non_equity_incentive)::DOUBLE, (salary + bonus + non_equity_incentive)::DOUBLE, (stock_awards + option_awards)::DOUBLE, total::DOUBLE]) AS pay FROM inc WHERE role <> 'CTO'),
pos0 AS (SELECT p.role, p.element, s.pay AS subject_pay, count(*) AS peer_n, quantile_cont(p.pay, 0.25) AS p25, median(p.pay) AS median, quantile_cont(p.pay, 0.75) AS p75,
  round_even(100.0 * (count(*) FILTER (WHERE p.pay < s.pay) + 0.5 * count(*) FILTER (WHERE p.pay = s.pay)) / count(*), 1) AS percentile
  FROM el p JOIN el s ON s.ticker = {BSUB} AND p.ticker <> {BSUB} AND p.role = s.role AND p.element = s.element GROUP BY 1, 2, 3 HAVING count(*) >= 6),
pos1 AS (SELECT *, CASE element WHEN 'base' THEN 45.0::DOUBLE ELSE 50.0::DOUBLE END AS target_lo, CASE element WHEN 'base' THEN 55.0::DOUBLE WHEN 'sti' THEN 60 WHEN 'total_cash' THEN 60 ELSE 65 END AS target_hi FROM pos0),
pos AS (SELECT *, CASE WHEN percentile < target_lo THEN 'below' WHEN percentile > target_hi THEN 'above' ELSE 'within' END AS status,
  CASE WHEN percentile < target_lo THEN round_even(target_lo - percentile, 1) WHEN percentile > target_hi THEN round_even(percentile - target_hi, 1) ELSE 0 END AS gap FROM pos1)
"""


def _pos(s, d):
    return bm.positions(view(s, d, "proxy_pay"), BSUB)


add("benchmark_positions", _pos, ["proxy_pay"], INC + "SELECT * FROM pos")
add("benchmark_worst_gaps", lambda s, d: bm.worst_gaps(_pos(s, d)).select("role", "element", "gap"), ["proxy_pay"], INC + "SELECT role, element, gap FROM pos WHERE status = 'below'")
add("benchmark_gap_concentration", lambda s, d: bm.gap_concentration(_pos(s, d)), ["proxy_pay"], INC + """SELECT positions, below, equity_below, CASE WHEN below = 0 THEN 'none' WHEN equity_below = below THEN 'all equity' WHEN equity_below * 2 >= below THEN 'mostly equity' WHEN equity_below = 0 THEN 'all cash' ELSE 'spread' END AS concentration
FROM (SELECT count(*) AS positions, count(*) FILTER (WHERE status = 'below') AS below, count(*) FILTER (WHERE status = 'below' AND element IN ('ltie', 'tdc')) AS equity_below FROM pos)""")
add("benchmark_incumbents", lambda s, d: bm.incumbents(bm.comparable(bm.with_total(view(s, d, "proxy_pay")))).select("ticker", "role", "title", "total"), ["proxy_pay"],
    INC.replace(f"ticker = {BSUB} OR ", "") + "SELECT ticker, role, title, total FROM inc")
add("benchmark_exclusions", lambda s, d: bm.exclusion_counts(view(s, d, "proxy_pay")), ["proxy_pay"],
    "SELECT role, count(*) FILTER (WHERE disclosure <> 'def14a') AS foreign_rows, count(*) FILTER (WHERE disclosure = 'def14a' AND starts_with(row_caveat, 'EXCLUDE:')) AS marked_rows, count(*) AS rows FROM proxy_pay GROUP BY 1")

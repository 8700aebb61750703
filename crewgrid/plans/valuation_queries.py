"""Relative-return awards and pay versus performance on the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewgrid.operators import valuation as vl
from crewgrid.plans.catalog import add
from crewgrid.session import stored
from crewgrid.views import view

CURVE = [(25.0, 50.0), (55.0, 100.0), (75.0, 200.0)]
N = 20
returns = lambda s, d: vl.tsr(view(s, d, "unit_prices"), N)
RT = f"""WITH ob AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day, seq) AS a, row_number() OVER (PARTITION BY ticker ORDER BY day DESC, seq DESC) AS z FROM unit_prices),
tsr AS (SELECT ticker, round_even(avg(price) FILTER (WHERE a <= {N}), 6) AS start_avg, round_even(avg(price) FILTER (WHERE z <= {N}), 6) AS end_avg,
  CASE WHEN count(*) >= {N} THEN round_even(avg(price) FILTER (WHERE z <= {N}) / avg(price) FILTER (WHERE a <= {N}), 6) END AS ratio FROM ob GROUP BY 1)
"""
add("rtsr_returns", returns, ["unit_prices"], RT + "SELECT *, round_even((ratio - 1) * 100, 4) AS return_pct FROM tsr")
add("rtsr_performance", lambda s, d: vl.relative_performance(view(s, d, "plan_companies"), returns(s, d), CURVE), ["unit_prices", "plan_companies"], RT + """, x AS (SELECT p.plan_id, p.ticker, p.role, ratio, rank() OVER (PARTITION BY plan_id ORDER BY ratio DESC) AS rank, count(*) OVER (PARTITION BY plan_id) AS n,
  count(*) OVER (PARTITION BY plan_id, ratio) AS tie FROM plan_companies p JOIN tsr ON p.ticker = tsr.ticker WHERE ratio IS NOT NULL AND (role = 'issuer' OR (index_start AND index_end))),
y AS (SELECT *, round_even(100.0::DOUBLE * (n - rank - tie + 1 + (tie - 1) / 2.0::DOUBLE) / (n - 1), 4) AS percentile FROM x), z AS (SELECT *, round_even(percentile, 2) AS p2 FROM y)
SELECT plan_id, ticker, role, ratio, rank, percentile, CASE WHEN p2 < 25 THEN 0 WHEN p2 <= 55 THEN round_even(50 + (p2 - 25) * 50.0::DOUBLE / 30.0::DOUBLE, 4) WHEN p2 <= 75 THEN round_even(100 + (p2 - 55) * 100.0::DOUBLE / 20.0::DOUBLE, 4) ELSE 200 END AS payout_pct, n AS n_ranked FROM z""")


def awards(s, d):
    """One award per plan: issuer and peers with spot, volatility and yield from their own prices."""
    st = view(s, d, "unit_prices").groupBy("ticker").agg(F.avg("price").alias("spot"), F.greatest(F.lit(0.1), F.least(F.lit(0.8), F.stddev_pop("price") / F.avg("price"))).alias("vol"))
    m = view(s, d, "plan_companies").join(st, "ticker")
    g = m.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("ticker", "spot", "vol"))).alias("m"))  # at most 25 names a plan
    n = F.size("m")
    corr = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.when(i == j, 1.0).otherwise(0.4))))
    return g.where(n > 1).select(
        F.col("plan_id").cast("string").alias("award_id"), F.lit(0).alias("issuer"), F.lit(3.0).alias("years"), F.lit(0.04).alias("rate"), F.lit(5000).alias("paths"), F.lit(11).alias("seed"),
        F.transform("m", lambda x: x["spot"]).alias("spots"), F.transform("m", lambda x: x["vol"]).alias("vols"), F.transform("m", lambda x: F.lit(0.01)).alias("yields"), corr.alias("corr"),
        F.array(*[F.lit(x) for x, _ in CURVE]).alias("curve_x"), F.array(*[F.lit(y) for _, y in CURVE]).alias("curve_y"))


# simulated values have no SQL counterpart: checked against closed forms in the tests
add("rtsr_monte_carlo", lambda s, d: vl.valuation(awards(s, d)))
add("rtsr_path_distribution", lambda s, d: vl.path_distribution(vl.simulate(awards(s, d)), "payout_pct"))

YEARS = [1997, 1998, 1999, 2000]


def _market(t, vol):
    return t.select("company_id").distinct().select("company_id", F.lit(0.04).alias("rate"), F.lit(vol).alias("vol"), F.lit(0.01).alias("dividend"), F.lit(0.4).alias("off_diagonal"))


def _tranches(s, d):
    """The tranches, sorted out once: prices, officers and awards are all read from them."""
    return stored(view(s, d, "tranches"))


def _values(s, d, t, vol=0.0):
    measured = vl.measurements(t, vl.fiscal_calendar(s, YEARS))
    return vl.valued(measured, view(s, d, "company_prices", tranches=t), _market(t, vol))


def bridge(s, d, vol=0.0, t=None):
    t = _tranches(s, d) if t is None else t
    return vl.bridge(view(s, d, "officer_pay", tranches=t), vl.used(_values(s, d, t, vol)), view(s, d, "officer_pension", tranches=t), digits=6)


def table_(s, d):
    t = _tranches(s, d)
    return vl.pvp_table(bridge(s, d, t=t), vl.company_return(view(s, d, "company_prices", tranches=t), vl.fiscal_calendar(s, YEARS), "1996-12-31"), digits=6)


PV = ["tranches", "company_prices", "officer_pay", "officer_pension"]
PQ = """WITH cal AS (SELECT y AS fy, make_date(y, 12, 31) AS ye, make_date(y - 1, 12, 31) AS pye, make_date(y, 1, 1) AS ys FROM (SELECT unnest([1997, 1998, 1999, 2000]) AS y)),
x AS (SELECT t.*, cal.*, grant_fy = fy AS isnew, NOT forfeited AND vest_date BETWEEN ys AND ye AS vested, forfeited AND forfeit_date BETWEEN ys AND ye AS lost FROM tranches t CROSS JOIN cal
  WHERE grant_date <= ye AND NOT coalesce((NOT forfeited AND vest_date < ys) OR (forfeited AND forfeit_date < ys), false)),
tm AS (SELECT *, 'forfeited' AS comp, pye AS m, -1 AS sg FROM x WHERE lost AND NOT isnew UNION ALL SELECT *, 'vest_new', vest_date, 1 FROM x WHERE vested AND isnew UNION ALL SELECT *, 'vest_prior', vest_date, 1 FROM x WHERE vested AND NOT isnew
  UNION ALL SELECT *, 'vest_prior', pye, -1 FROM x WHERE vested AND NOT isnew UNION ALL SELECT *, 'new_at_year_end', ye, 1 FROM x WHERE NOT vested AND NOT lost AND vest_date > ye AND isnew
  UNION ALL SELECT *, 'prior_unvested', ye, 1 FROM x WHERE NOT vested AND NOT lost AND vest_date > ye AND NOT isnew UNION ALL SELECT *, 'prior_unvested', pye, -1 FROM x WHERE NOT vested AND NOT lost AND vest_date > ye AND NOT isnew),
fv AS (SELECT tm.company_id, neo_id, fy, comp, tm.tranche_id, tm.m, sg, round_even(shares * CASE type WHEN 'rsu' THEN price::DOUBLE WHEN 'psu_rtsr' THEN price * earned_pct / 100 ELSE round_even(CASE WHEN expiry <= tm.m THEN greatest(0, price - strike)::DOUBLE
    ELSE greatest(0, price * exp(-0.01::DOUBLE * ((expiry - tm.m) / 365.0::DOUBLE)) - strike * exp(-0.04::DOUBLE * ((expiry - tm.m) / 365.0::DOUBLE))) END, 6) END, 6) AS v FROM tm JOIN company_prices p ON p.company_id = tm.company_id AND p.day = tm.m),
cp AS (SELECT company_id, neo_id, fy, """ + ", ".join(f"coalesce(CAST(sum(CAST(sg * v AS DECIMAL(28, 6))) FILTER (WHERE comp = '{c}') AS DOUBLE), 0) AS {c}" for c in vl.COMPONENTS) + """ FROM fv GROUP BY 1, 2, 3),
br0 AS (SELECT o.*, """ + ", ".join(f"coalesce(cp.{c}, 0) AS {c}" for c in vl.COMPONENTS) + """, coalesce(p.pension, 0) AS pension FROM officer_pay o LEFT JOIN cp ON o.neo_id = cp.neo_id AND o.company_id = cp.company_id AND o.fy = cp.fy LEFT JOIN officer_pension p ON p.neo_id = o.neo_id AND p.company_id = o.company_id AND p.fy = o.fy),
br AS (SELECT company_id, neo_id, is_peo, fy, total::DOUBLE AS sct_total, -(stock_awards + option_awards)::DOUBLE AS less_sct_equity, """ + ", ".join(f"round_even({c}, 6) AS {c}" for c in vl.COMPONENTS) + """, 0.0::DOUBLE AS dividends, pension,
  round_even(-(stock_awards + option_awards) + """ + " + ".join(vl.COMPONENTS) + """, 6) AS equity_adjustment, round_even(total - (stock_awards + option_awards) + """ + " + ".join(vl.COMPONENTS) + """ + pension, 6) AS cap FROM br0),
ct AS (SELECT e.company_id, year(e.day) AS fy, round_even(100.0::DOUBLE * e.price / b.price, 2) AS company_tsr_value FROM company_prices e JOIN company_prices b ON b.company_id = e.company_id AND b.day = DATE '1996-12-31' WHERE e.day IN (SELECT ye FROM cal)),
pt AS (SELECT br.company_id, br.fy, max(sct_total) FILTER (WHERE is_peo) AS peo_sct_total, max(cap) FILTER (WHERE is_peo) AS peo_cap, round_even(avg(sct_total) FILTER (WHERE NOT is_peo), 6) AS avg_other_sct_total, round_even(avg(cap) FILTER (WHERE NOT is_peo), 6) AS avg_other_cap, any_value(company_tsr_value) AS company_tsr_value
  FROM br LEFT JOIN ct ON ct.company_id = br.company_id AND ct.fy = br.fy GROUP BY 1, 2)
"""
add("pvp_fair_values", lambda s, d: _values(s, d, _tranches(s, d)).select("company_id", "tranche_id", "at", "fair_value"), PV, PQ + 'SELECT DISTINCT company_id, tranche_id, m AS "at", v AS fair_value FROM fv')
add("pvp_cap_bridge", bridge, PV, PQ + "SELECT * FROM br")
add("pvp_table", table_, PV, PQ + "SELECT * FROM pt")
add("pvp_alignment", lambda s, d: vl.alignment(table_(s, d)), PV, PQ + """, a AS (SELECT company_id, arg_min(peo_cap, fy) AS c0, arg_max(peo_cap, fy) AS c1, arg_min(company_tsr_value, fy) AS t0, arg_max(company_tsr_value, fy) AS t1 FROM pt GROUP BY 1),
m AS (SELECT company_id, CASE WHEN c1 > c0 * 1.02::DOUBLE THEN 'up' WHEN c1 < c0 * 0.98::DOUBLE THEN 'down' ELSE 'flat' END AS cap_direction, CASE WHEN t1 > t0 * 1.02::DOUBLE THEN 'up' WHEN t1 < t0 * 0.98::DOUBLE THEN 'down' ELSE 'flat' END AS tsr_direction FROM a)
SELECT *, cap_direction = tsr_direction OR cap_direction = 'flat' OR tsr_direction = 'flat' AS aligned FROM m""")
add("pvp_relationship_series", lambda s, d: vl.relationship_series(table_(s, d)).select("company_id", F.array_join(F.transform("peo_cap", lambda v: F.bround(v, 0).cast("bigint").cast("string")), ",").alias("peo_cap")), PV, PQ + "SELECT company_id, string_agg(CAST(CAST(round_even(peo_cap, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY fy) AS peo_cap FROM pt GROUP BY 1")
add("pvp_option_values", lambda s, d: bridge(s, d, 0.42).groupBy("fy").agg(F.bround(F.sum("cap"), 2).alias("cap")))


# ---- open relative-return awards.  Without volatility every name grows alike, so all tie in the middle of the ranking and the
# simulated value has a closed form that SQL can state; pvp_psu_values is the same query with real volatilities.
PEERS = lambda s, d: view(s, d, "pay_peers")


def _open(s, d, tranches):
    """Open awards, each on the dates it is measured on, and the prices."""
    t = view(s, d, "open_tranches", tranches=tranches)
    return t, vl.measurements(t, vl.fiscal_calendar(s, YEARS)), view(s, d, "company_prices", tranches=tranches)


def psu_inputs(s, d, vol=0.3, tranches=None):
    t, measured, prices = _open(s, d, _tranches(s, d) if tranches is None else tranches)
    return vl.period_inputs(vl.open_periods(measured.where("type = 'psu_rtsr'")), prices, _market(t, vol), PEERS(s, d))


def psu_values(s, d, vol=0.3, paths=500, tranches=None):
    return vl.psu_values(psu_inputs(s, d, vol, tranches), CURVE, paths)


def open_bridge(s, d, vol=0.0, paths=2, tranches=None):
    tranches = _tranches(s, d) if tranches is None else tranches
    t, measured, prices = _open(s, d, tranches)
    values = vl.valued(measured, prices, _market(t, vol), psu_values(s, d, vol, paths, tranches))
    dividends = vl.live_dividends(t, view(s, d, "award_dividends", tranches=tranches), vl.fiscal_calendar(s, YEARS))
    return vl.bridge(view(s, d, "officer_pay", tranches=tranches), vl.used(values), view(s, d, "officer_pension", tranches=tranches), dividends, digits=6)


def performance(s, d):
    t = _tranches(s, d)
    returns = vl.company_return(view(s, d, "company_prices", tranches=t), vl.fiscal_calendar(s, YEARS), "1996-12-31")
    return vl.performance_table(open_bridge(s, d, tranches=t), returns, vl.peer_return(returns, PEERS(s, d), digits=6), view(s, d, "filer_results"), digits=6)


MIDDLE = "(50::DOUBLE + 25 * 50::DOUBLE / 30)"  # payout at the 50th percentile of CURVE
OPEN_YEARS = "((performance_end - tm.m) / 365.0::DOUBLE)"
OV = ["open_tranches", "company_prices", "officer_pay", "officer_pension", "award_dividends", "pay_peers", "filer_results"]
OQ = PQ.replace("FROM tranches t CROSS", "FROM open_tranches t CROSS")
OQ = OQ.replace("price * earned_pct / 100 ", f"CASE WHEN performance_end <= tm.m THEN price * earned_pct / 100 ELSE round_even(price * exp(0.03::DOUBLE * {OPEN_YEARS}) * {MIDDLE} / 100 * exp(-0.04::DOUBLE * {OPEN_YEARS}), 4) END ")
OQ = OQ.replace("br0 AS (SELECT o.*, ", """dv AS (SELECT t.company_id, neo_id, a.fy, sum(amount) AS amount FROM award_dividends a JOIN open_tranches t USING (company_id, tranche_id) JOIN cal ON cal.fy = a.fy
  WHERE grant_date <= ye AND CASE WHEN forfeited THEN forfeit_date ELSE vest_date END >= ys GROUP BY 1, 2, 3),
br0 AS (SELECT o.*, coalesce(dv.amount, 0) AS dividends, """).replace("LEFT JOIN officer_pension p", "LEFT JOIN dv ON dv.neo_id = o.neo_id AND dv.company_id = o.company_id AND dv.fy = o.fy LEFT JOIN officer_pension p")
OQ = OQ.replace("0.0::DOUBLE AS dividends, pension", "dividends, pension").replace(" + forfeited, 6) AS equity", " + forfeited + dividends, 6) AS equity").replace(" + forfeited + pension, 6) AS cap", " + forfeited + dividends + pension, 6) AS cap")
OQ = OQ.rstrip() + """,
pr AS (SELECT p.company_id, ct.fy, round_even(CAST(sum(CAST(company_tsr_value AS DECIMAL(16, 4))) AS DOUBLE) / count(*), 6) AS peer_tsr_value FROM pay_peers p JOIN ct ON ct.company_id = p.peer GROUP BY 1, 2),
ft AS (SELECT pt.*, peer_tsr_value, round_even(net_income_usd, 6) AS net_income_usd, round_even(csm_usd, 6) AS csm_usd FROM pt LEFT JOIN pr ON pr.company_id = pt.company_id AND pr.fy = pt.fy LEFT JOIN filer_results f ON f.company_id = pt.company_id AND f.fy = pt.fy)
"""
add("pvp_psu_inputs", lambda s, d: psu_inputs(s, d).select("company_id", "at", "performance_end", "n_tranches", "shares", "spot", F.bround("years", 9).alias("years"), F.size("peer_spots").alias("n_peers"), F.array_join("peer_spots", ",").alias("peer_spots")), OV, OQ + """,
op AS (SELECT DISTINCT company_id, tranche_id, m, performance_end, shares, price FROM (SELECT tm.*, p.price FROM tm JOIN company_prices p ON p.company_id = tm.company_id AND p.day = tm.m) WHERE type = 'psu_rtsr' AND performance_end > m),
pg AS (SELECT company_id, count(*) AS n_peers, string_agg(CAST(spot AS VARCHAR), ',' ORDER BY peer) AS peer_spots FROM pay_peers GROUP BY 1)
SELECT op.company_id, m AS "at", performance_end, count(*) AS n_tranches, CAST(sum(shares) AS BIGINT) AS shares, price::DOUBLE AS spot, round_even((performance_end - m) / 365.0::DOUBLE, 9) AS years, CAST(any_value(n_peers) AS INT) AS n_peers, any_value(peer_spots) AS peer_spots
FROM op JOIN pg ON pg.company_id = op.company_id GROUP BY op.company_id, m, performance_end, price""")
add("pvp_psu_values", psu_values)
add("pvp_open_bridge", open_bridge, OV, OQ + "SELECT * FROM br")
add("pvp_performance_table", performance, OV, OQ + "SELECT * FROM ft")
add("pvp_performance_violations", lambda s, d: vl.performance_violations(performance(s, d)), OV, OQ + "SELECT rule, key FROM (SELECT unnest([" + ", ".join(
    f"CASE WHEN {c} IS NULL THEN '{c}_missing' END" for c in [*vl.PERFORMANCE, "peo_cap", "avg_other_cap"]) + "]) AS rule, company_id || '/' || fy AS key FROM ft) WHERE rule IS NOT NULL")
_whole = lambda c: F.array_join(F.transform(c, lambda v: F.coalesce(F.bround(v, 0).cast("bigint").cast("string"), F.lit("-"))), ",").alias(c)
RC = ["peo_cap", "avg_other_cap", *vl.PERFORMANCE]
add("pvp_relationship_graphics", lambda s, d: vl.relationship_graphics(performance(s, d)).select("company_id", F.array_join("years", ",").alias("years"), *[_whole(c) for c in RC]), OV, OQ + "SELECT company_id, string_agg(CAST(fy AS VARCHAR), ',' ORDER BY fy) AS years, " + ", ".join(
    f"string_agg(coalesce(CAST(CAST(round_even({c}, 0) AS BIGINT) AS VARCHAR), '-'), ',' ORDER BY fy) AS {c}" for c in RC) + " FROM ft GROUP BY 1")

"""Equity ledger: vesting, expense, burn, pool and forward cost."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from crewgrid.functions.dates import whole_months
from crewgrid.functions.numeric import half_even, ratio, step_down
from crewgrid.operators.population import day

MAX_SPINE = 2000


@dataclass
class EquityBook:
    grants: DataFrame  # with term_date and fair_value
    shares: DataFrame  # quarter spine up to as_of
    financials: DataFrame
    plans: DataFrame
    as_of: dt.date

    @property
    def share_rows(self):
        return self.shares.where(F.col("period_end") <= day(self.as_of))

    def quarters(self):
        """Quarter ends on the driver: one row per quarter of the calendar, so a small fixed set."""
        rows = self.share_rows.select("period_end").distinct().orderBy("period_end").limit(MAX_SPINE + 1).collect()
        if len(rows) > MAX_SPINE:
            raise ValueError("quarter spine is longer than any calendar allows")
        return [r[0] for r in rows]

    def fiscal_years(self):
        return sorted({q.year for q in self.quarters()})


def with_terms(grants, workers):
    """Holder's last day (null for people outside the worker table) and total grant value."""
    terms = workers.select("emp_id", "term_date")
    g = grants.join(terms, "emp_id", "left")
    return g.withColumn("fair_value", F.col("shares_granted") * F.col("grant_date_fv_per_share_usd"))


def elapsed_share(at):
    """Served share of the vesting period, 0..1, cliff ignored."""
    return F.least(F.lit(1.0), whole_months("vest_start_date", at) / F.col("vest_months_total"))


def vested_fraction(at):
    """0 before the cliff, then whole months served over total, at most 1."""
    return F.when(whole_months("vest_start_date", at) < F.col("cliff_months"), 0.0).otherwise(elapsed_share(at))


def gone_by(at):
    return F.coalesce(F.col("term_date") <= at, F.lit(False))


def cumulative_expense(at, digits=6):
    """Expense recognised up to a date; unvested cost reverses when the holder leaves."""
    raw = F.when(at < F.col("vest_start_date"), 0.0).when(gone_by(at), vested_fraction(F.col("term_date")) * F.col("fair_value")).otherwise(
        elapsed_share(at) * F.col("fair_value"))
    return raw if digits is None else F.bround(raw, digits)


def expense_by_quarter(book):
    """Quarterly expense against revenue.

    Cumulative expense is summed per quarter end and only then differenced, so a
    grant is evaluated once per date.  What depends on the grant alone is computed
    before the dates are attached.  Amounts are whole millionths, summed as
    dollars and millionths apart: exact, independent of task order, no overflow."""
    qs = book.quarters()
    first = qs[0]
    seed = dt.date(first.year, (first.month - 1) // 3 * 3 + 1, 1) - dt.timedelta(days=1)
    dates = F.array(*[F.struct(F.lit(k).alias("k"), day(d).alias("at"), F.lit(d.year * 12 + d.month).alias("m"), F.lit(d.day).alias("d")) for k, d in enumerate([seed] + qs)])
    start = F.col("vest_start_date")
    g = book.grants.select(
        "vest_start_date", "term_date", "vest_months_total", F.col("fair_value").cast("double").alias("fv"), (F.year(start) * 12 + F.month(start)).alias("sm"), F.day(start).alias("sd"),
        (F.coalesce(vested_fraction(F.col("term_date")), F.lit(0.0)) * F.col("fair_value")).alias("settled"))
    x = g.select("*", F.inline(dates))
    served = F.greatest(F.lit(0), F.col("m") - F.col("sm") - F.when(F.col("d") < F.col("sd"), 1).otherwise(0))
    running = F.least(F.lit(1.0), served / F.col("vest_months_total")) * F.col("fv")
    value = F.when(F.col("at") < start, 0.0).when(gone_by(F.col("at")), F.col("settled")).otherwise(running)
    x = x.select("k", "at", F.rint(value * 1e6).cast("bigint").alias("u"))
    q = x.groupBy("k", "at").agg(F.sum(F.expr("u div 1000000")).alias("usd"), F.sum(F.col("u") % 1000000).alias("micro"))
    total = F.col("usd").cast("decimal(28,6)") + F.col("micro").cast("decimal(28,6)") / 1000000
    w = Window.partitionBy(F.lit(0)).orderBy("k")  # one row per quarter
    q = q.withColumn("_t", total).withColumn("_s", F.col("_t") - F.lag("_t").over(w)).where("k > 0").withColumnRenamed("at", "period_end")
    rev = book.financials.select("period_end", "revenue_usd")
    q = q.join(rev, "period_end").withColumn("sbc", half_even("_s", 2))
    return q.select("period_end", "sbc", F.col("revenue_usd").alias("revenue"), half_even(F.col("sbc") / F.col("revenue_usd") * 100, 2).alias("pct"))


def expense_ttm_pct(book):
    last = expense_by_quarter(book).orderBy(F.desc("period_end")).limit(4)
    return last.agg(half_even(F.sum("sbc") / F.sum("revenue") * 100, 2).alias("ttm_pct"))


def live_grants(book, at):
    """Granted, holder still here, months left to recognise."""
    left = F.greatest(F.lit(0), F.col("vest_months_total") - whole_months("vest_start_date", at))
    g = book.grants.where((F.col("grant_date") <= at) & ~gone_by(at)).withColumn("months_left", left)
    return g.where("months_left > 0")


def unamortized(book, at=None):
    """Unrecognised cost and its weighted remaining years.  Sums stay whole per
    vesting length before the division, so they are exact for whole amounts."""
    at = day(at or book.as_of)
    v, m = F.col("fair_value"), F.col("months_left")
    per = live_grants(book, at).groupBy("vest_months_total").agg(F.sum(v * m).alias("_c"), F.sum(v * m * m).alias("_w"))
    a = per.agg(F.sum(F.col("_c") / F.col("vest_months_total")).alias("c"), F.sum(F.col("_w") / F.col("vest_months_total")).alias("w"))
    return a.select(half_even(F.coalesce("c", F.lit(0.0)), 2).alias("backlog_usd"), half_even(ratio("w", "c", 0) / 12.0, 2).alias("weighted_years"))


# Retired volatility multiplier table.
LEGACY_MULTIPLIER = [(0.546, 1.5), (0.361, 2.0), (0.249, 2.5), (0.165, 3.0), (0.079, 3.5), (0.0, 4.0)]


def share_years(book):
    """Average basic shares, closing price, volatility and revenue per fiscal year."""
    s = book.share_rows.groupBy(F.year("period_end").alias("fy")).agg(
        F.avg("waso_basic").alias("waso"), F.max_by("close_price_usd", "period_end").alias("price"), F.max_by("annualized_volatility", "period_end").alias("vol"))
    r = book.financials.where(F.col("period_end") <= day(book.as_of)).groupBy(F.year("period_end").alias("fy")).agg(F.sum("revenue_usd").alias("revenue"))
    return s.join(r, "fy")


def share_flows(book):
    """Shares granted by grant year and returned by leaving year, from one pass over the ledger."""
    option = F.col("award_type") == "option"
    n = F.col("shares_granted")
    grant = F.struct(
        F.year("grant_date").alias("fy"), n.alias("granted"), F.lit(0.0).alias("returned"),
        F.when(option, n * F.col("grant_date_fv_per_share_usd")).otherwise(n * F.col("stock_price_at_grant_usd")).alias("value"),
        F.when(option, n).otherwise(0).alias("options"), F.when(option, 0).otherwise(n).alias("full_value"))
    back = F.struct(
        F.year("term_date").alias("fy"), F.lit(0).cast("bigint").alias("granted"), (n * (1.0 - vested_fraction(F.col("term_date")))).alias("returned"),
        F.lit(0).cast("bigint").alias("value"), F.lit(0).cast("bigint").alias("options"), F.lit(0).cast("bigint").alias("full_value"))
    x = book.grants.select(F.explode(F.filter(F.array(grant, back), lambda s: s["fy"].isNotNull())).alias("m"))
    return x.groupBy("m.fy").agg(*[F.sum(f"m.{c}").alias(c) for c in ("granted", "returned", "value", "options", "full_value")])


def burn_rates(book):
    """Gross, net, value-adjusted and retired volatility-adjusted burn per fiscal year."""
    x = share_years(book).join(share_flows(book), "fy", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    pct = lambda e: half_even(e * 100, 2)
    legacy = zero("options") + zero("full_value") * step_down("vol", LEGACY_MULTIPLIER, 4.0)
    return x.select(
        "fy", pct(zero("granted") / F.col("waso")).alias("gross_pct"), pct((zero("granted") - zero("returned")) / F.col("waso")).alias("net_pct"),
        pct(zero("value") / (F.col("waso") * F.col("price"))).alias("vabr_pct"), pct(legacy / F.col("waso")).alias("legacy_adjusted_pct"),
        "revenue", half_even("waso", 6).alias("waso"), "price", half_even(zero("returned"), 6).alias("forfeited_shares"))


def three_year_averages(book):
    """Means over the three latest fiscal years; null when there are fewer."""
    x = share_years(book).join(share_flows(book), "fy", "left")
    last = x.orderBy(F.desc("fy")).limit(3)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    full = F.count(F.lit(1)) == 3
    return last.agg(
        F.when(full, half_even(F.avg(zero("value") / (F.col("waso") * F.col("price"))) * 100, 2)).alias("vabr_3yr_pct"),
        F.when(full, half_even(F.avg(zero("granted") / F.col("waso")) * 100, 2)).alias("gross_burn_3yr_pct"),
        F.when(full, F.avg(zero("granted") - zero("returned"))).alias("net_granted_avg"))


def outstanding_expr(at):
    """Unvested full-value shares plus options still alive, per grant."""
    n = F.col("shares_granted")
    option = F.when(gone_by(at), n * vested_fraction(F.col("term_date"))).otherwise(n.cast("double"))
    full = F.when(gone_by(at), 0.0).otherwise(n * (1.0 - vested_fraction(at)))
    return F.when(F.col("grant_date") > at, 0.0).when(F.col("award_type") == "option", option).otherwise(full)


def used_expr(at):
    n = F.col("shares_granted")
    back = F.when(gone_by(at), n * (1.0 - vested_fraction(F.col("term_date")))).otherwise(0.0)
    return F.when(F.col("grant_date") > at, 0.0).otherwise(n - back)


def pool_snapshot(book, plan_id, at=None):
    """Outstanding, available, overhang, dilution and pool life.  One pass over
    the ledger; everything joined to it is one row."""
    d = at or book.as_of
    at = day(d)
    led = book.grants.agg(F.sum(outstanding_expr(at)).alias("outstanding"), F.sum(F.when(F.col("plan_id") == plan_id, used_expr(at)).otherwise(0.0)).alias("used"))
    plan = book.plans.where(F.col("plan_id") == plan_id).select("initial_pool_shares")
    cso = book.shares.where(F.col("period_end") == at).select("common_shares_outstanding", "close_price_usd")
    x = led.crossJoin(plan).crossJoin(cso).crossJoin(three_year_averages(book))
    x = x.withColumn("available", F.col("initial_pool_shares") - F.col("used"))
    x = x.withColumn("available", F.when(F.col("available") < 0, F.raise_error(F.lit("pool overdrawn"))).otherwise(F.col("available")))
    c = F.col("common_shares_outstanding")
    return x.select(
        half_even("outstanding", 4).alias("outstanding_shares"), half_even("available", 0).alias("pool_available"),
        half_even((F.col("outstanding") + F.col("available")) / c * 100, 2).alias("overhang_pct"), half_even(F.col("outstanding") / c * 100, 2).alias("dilution_pct"),
        F.when(F.col("net_granted_avg") > 0, half_even(F.col("available") / F.col("net_granted_avg"), 2)).otherwise(float("inf")).alias("pool_longevity_years"),
        half_even(c * F.col("close_price_usd"), 0).alias("market_cap"))


def value_per_recipient(book, fy):
    """Grant value and recipients by participant group.  Holders are reduced to
    one row each first, so distinct counting needs no expansion."""
    per = book.grants.where(F.year("grant_date") == fy).groupBy("participant_group", "emp_id").agg(F.sum("fair_value").alias("v"))
    g = per.groupBy("participant_group").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("recipients"))
    return g.select("participant_group", half_even("v").alias("value"), "recipients", half_even(F.col("v") / F.col("recipients")).alias("per_recipient"))


PLAN_FEATURES = {
    "minimum_vesting": "min_vesting_months >= 12", "no_repricing": "permits_repricing = 'no'", "no_unvested_dividends": "dividends_on_unvested = 'no'",
    "no_discretionary_acceleration": "discretionary_acceleration = 'no'", "strict_recycling": "share_recycling = 'strict'", "no_evergreen": "evergreen = 'none'",
}


def plan_readiness(book, plan_id, cap_pct):
    """Six plan rules, three-year burn against a cap, and the overhang gauge."""
    p = book.plans.where(F.col("plan_id") == plan_id).select(*[F.expr(e).alias(n) for n, e in PLAN_FEATURES.items()])
    passed = sum((F.col(n).cast("int") for n in PLAN_FEATURES), F.lit(0))
    b = three_year_averages(book).select("vabr_3yr_pct")
    o = pool_snapshot(book, plan_id).select("overhang_pct")
    return p.crossJoin(b).crossJoin(o).select(
        *PLAN_FEATURES, passed.alias("features_passed"), "vabr_3yr_pct", (F.col("vabr_3yr_pct") <= cap_pct).alias("burn_pass"),
        half_even(cap_pct - F.col("vabr_3yr_pct"), 2).alias("headroom_pct"), "overhang_pct")


# ---- forward cost -----------------------------------------------------------

FORFEITURE_RATE = 0.06
NEW_GRANT_MONTHS = 48
HORIZON = 4


def forecast(book, horizon=HORIZON, forfeiture=FORFEITURE_RATE, vest_months=NEW_GRANT_MONTHS):
    """Locked-in run-off per fiscal year in whole cents, forfeiture and new-grant overlays.

    Gross run-off assumes continued service.  Cents are assigned so that the
    years and the tail add up to the backlog exactly; the rest goes to the largest year.
    After the first aggregate only (years x vesting lengths) rows remain."""
    if (book.as_of.month, book.as_of.day) != (12, 31):
        raise ValueError("the forecast is anchored at a 31 December close")
    at = day(book.as_of)
    y0 = book.as_of.year
    years = [y0 + k for k in range(1, horizon + 1)]
    served = lambda d: F.least(F.col("vest_months_total"), whole_months("vest_start_date", d))
    before = lambda d: F.when(d < F.col("vest_start_date"), 0).otherwise(served(d))
    cells = []
    for y in years:
        a, b = day(dt.date(y - 1, 12, 31)), day(dt.date(y, 12, 31))
        cells.append(F.sum(F.col("fair_value") * (before(b) - before(a))).alias(f"y{y}"))
    fv = F.col("fair_value")
    live = live_grants(book, at).groupBy("vest_months_total").agg(*cells, F.sum(fv * F.col("months_left")).alias("rest"))
    cols = [f"y{y}" for y in years] + ["rest"]
    one = live.agg(*[F.coalesce(F.sum(F.col(c) / F.col("vest_months_total")), F.lit(0.0)).alias(c) for c in cols])
    cents = lambda e: F.bround(e * 100, 0).cast("bigint")
    gross = F.array(*[cents(F.greatest(F.lit(0.0), F.col(f"y{y}"))) for y in years])
    raw_sum = sum((F.greatest(F.lit(0.0), F.col(f"y{y}")) for y in years), F.lit(0.0))
    x = one.select("rest", cents(F.col("rest")).alias("backlog_c"), cents(F.greatest(F.lit(0.0), F.col("rest") - raw_sum)).alias("beyond_c"), gross.alias("g"))
    total = F.aggregate("g", F.lit(0).cast("bigint"), lambda s, v: s + v)
    x = x.withColumn("residual", F.col("backlog_c") - F.col("beyond_c") - total).withColumn("top", F.array_position("g", F.array_max("g")) - 1)
    new = book.grants.where((F.col("grant_date") >= day(dt.date(y0, 1, 1))) & (F.col("grant_date") <= at)).agg(F.coalesce(F.sum("fair_value"), F.lit(0)).alias("run_rate"))
    rev = book.financials.where(F.col("period_end") <= at).orderBy(F.desc("period_end")).limit(4).agg(
        F.when(F.count(F.lit(1)) == 4, F.sum("revenue_usd")).alias("ttm"))
    rows = x.crossJoin(new).crossJoin(rev).select("*", F.posexplode("g").alias("k", "c"))
    rows = rows.withColumn("c", F.col("c") + F.when(F.col("k") == F.col("top"), F.col("residual")).otherwise(0))
    w = Window.partitionBy(F.lit(0)).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # one row per forecast year
    locked = half_even(F.col("c") / 100.0 * F.pow(F.lit(1.0 - forfeiture), F.col("k")), 2)
    vintages = F.least(F.col("k") + 1, F.lit(vest_months // 12))
    fresh = half_even(F.col("run_rate") * (12.0 / vest_months) * vintages, 2)
    return rows.select(
        (F.lit(years[0]) + F.col("k")).alias("fy"), (F.col("c") / 100.0).alias("gross_expense"), (F.sum("c").over(w) / 100.0).alias("cumulative_gross"),
        locked.alias("forfeiture_adj_expense"), fresh.alias("new_grants"), half_even(locked + fresh, 2).alias("total"),
        half_even((locked + fresh) / F.col("ttm") * 100.0, 2).alias("pct_ttm_revenue"),
        (F.col("backlog_c") / 100.0).alias("backlog_usd"), (F.col("beyond_c") / 100.0).alias("beyond_horizon_usd"))


def forecast_violations(rows):
    """Cents must reconcile exactly and adjusted cost never exceeds gross."""
    c = lambda n: F.bround(F.col(n) * 100, 0).cast("bigint")
    tie = rows.groupBy("backlog_usd", "beyond_horizon_usd").agg(F.sum(c("gross_expense")).alias("s")).where(F.col("s") + c("beyond_horizon_usd") != c("backlog_usd"))
    high = rows.where(F.col("forfeiture_adj_expense") > F.col("gross_expense") + 0.005)
    return tie.select(F.lit("cents_reconcile").alias("rule"), F.lit("backlog").alias("key")).unionByName(
        high.select(F.lit("adjusted_not_above_gross").alias("rule"), F.col("fy").cast("string").alias("key")))

"""Workforce against finance: revenue, cost and leverage."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window, functions as F

from crewgrid.functions.numeric import half_even, ratio
from crewgrid.operators.population import active_at, day
from crewgrid.operators.workforce import fte_expr


def ttm_revenue(wf, as_of=None, name="ttm_revenue"):
    """Sum of the four latest quarters at or before as_of; null when there are fewer."""
    past = wf.financials.where((F.col("period_end") <= day(as_of or wf.as_of)) & F.col("revenue_usd").isNotNull())
    last = past.orderBy(F.desc("period_end")).limit(4)
    return last.agg(F.when(F.count(F.lit(1)) == 4, F.sum("revenue_usd")).alias(name))


def year_ago(d):
    """Same day a year back; 29 February falls back to the 28th."""
    try:
        return d.replace(year=d.year - 1)
    except ValueError:
        return d.replace(year=d.year - 1, day=28)


def revenue_per_fte(wf):
    f = wf.active.agg(fte_expr().alias("_f"))
    return ttm_revenue(wf).crossJoin(f).select(half_even(ratio("ttm_revenue", "_f", 0)).alias("value"), "ttm_revenue", half_even("_f", 1).alias("fte"))


def operating_leverage(wf):
    before = year_ago(wf.as_of)

    def people(d, tag):
        share = F.least(F.lit(1.0), ratio("scheduled_hours", "standard_full_time_hours"))
        on = active_at(d)
        return [F.sum(F.when(on, share)).alias(f"fte_{tag}"), F.count_if(on).alias(f"hc_{tag}")]

    p = wf.employees.agg(*people(wf.as_of, "now"), *people(before, "ya"))
    x = p.crossJoin(ttm_revenue(wf, name="t_now")).crossJoin(ttm_revenue(wf, before, "t_ya"))
    x = x.withColumn("r_now", ratio("t_now", "fte_now")).withColumn("r_ya", ratio("t_ya", "fte_ya"))
    growth = lambda a, b: half_even(100 * ratio(F.col(a) - F.col(b), b, 0), 1)
    return x.select(growth("r_now", "r_ya").alias("value"), half_even("r_now").alias("revenue_per_fte_now"),
                    half_even("r_ya").alias("revenue_per_fte_year_ago"), growth("t_now", "t_ya").alias("revenue_growth_pct"),
                    growth("hc_now", "hc_ya").alias("headcount_growth_pct"))


def workforce_cost_ratio(wf):
    b = wf.active.agg(F.coalesce(F.sum("base_salary"), F.lit(0)).alias("base_salary_total"))
    return b.crossJoin(ttm_revenue(wf)).select(half_even(100 * ratio("base_salary_total", "ttm_revenue", 0), 1).alias("value"), "base_salary_total", "ttm_revenue")

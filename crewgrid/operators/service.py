"""Service-desk metrics recomputed from open and resolve timestamps at a snapshot time."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from crewgrid.functions.dates import hours_between
from crewgrid.functions.numeric import half_even, pct, ratio
from crewgrid.functions.ranking import quantiles
from crewgrid.operators.population import stamp
from crewgrid.operators.workforce import fte_expr

PERIOD_DAYS = 90


def exists_at(wf):
    return F.col("opened_at") <= stamp(wf.clock)


def resolved_at_snapshot(wf):
    return exists_at(wf) & F.coalesce(F.col("resolved_at") <= stamp(wf.clock), F.lit(False))


def open_at_snapshot(wf):
    return exists_at(wf) & (F.col("resolved_at").isNull() | (F.col("resolved_at") > stamp(wf.clock)))


def in_period(wf, days=PERIOD_DAYS):
    return exists_at(wf) & (F.col("opened_at") > stamp(wf.clock - dt.timedelta(days=days)))


def resolution_hours():
    return hours_between("opened_at", "resolved_at")


def open_age_hours(wf):
    return hours_between(F.col("opened_at"), stamp(wf.clock))


def case_volume(wf):
    n = wf.cases.where(in_period(wf)).agg(F.count(F.lit(1)).alias("value"))
    f = wf.active.agg(half_even(fte_expr(), 1).alias("_fte"))
    return n.crossJoin(f).select("value", F.lit(PERIOD_DAYS).alias("period_days"), half_even(100 * ratio("value", "_fte", 0), 1).alias("per_100_fte"))


def case_volume_by_category(wf):
    return wf.cases.where(in_period(wf)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def sla_attainment(wf):
    done = resolved_at_snapshot(wf)
    sla = F.col("sla_target_hours").cast("double")
    a = wf.cases.agg(
        F.count_if(done & (resolution_hours() <= sla)).alias("within_sla"), F.count_if(done).alias("resolved"),
        F.count_if(open_at_snapshot(wf) & (open_age_hours(wf) > sla)).alias("open_past_sla"))
    return a.select(pct("within_sla", F.col("resolved") + F.col("open_past_sla")).alias("value"), "*")


def time_to_resolution(wf):
    t = wf.cases.where(resolved_at_snapshot(wf)).select(resolution_hours().alias("h"))
    p50 = quantiles(t, "h", {"p50": 0.5})
    p90 = quantiles(t, "h", {"p90": 0.9}, method="nearest").drop("n_obs")
    return p50.crossJoin(p90).select(half_even("p50", 1).alias("value"), half_even("p90", 1).alias("p90"), F.col("n_obs").alias("n"))


def _resolved_share(wf, flag, name):
    a = wf.cases.where(resolved_at_snapshot(wf)).agg(F.count_if(flag).alias(name), F.count(F.lit(1)).alias("resolved"))
    return a.select(pct(name, "resolved").alias("value"), name, "resolved")


def reopen_rate(wf):
    return _resolved_share(wf, F.col("reopened") == "yes", "reopened")


def first_contact_resolution(wf):
    return _resolved_share(wf, F.col("first_contact_resolution") == "yes", "fcr")


def case_csat(wf):
    a = wf.cases.where(resolved_at_snapshot(wf)).agg(
        F.count("csat").alias("responses"), F.count_if(F.col("csat") >= 4).alias("satisfied_4_5"), F.count(F.lit(1)).alias("_r"))
    return a.select(pct("satisfied_4_5", "responses").alias("value"), "responses", "satisfied_4_5", pct("responses", "_r").alias("response_rate_pct"))


AGE_BANDS = [("<24h", 0, 24), ("1-3d", 24, 72), ("4-7d", 72, 168), ("8-14d", 168, 336), ("15d+", 336, 10 ** 9)]


def open_case_backlog(wf):
    age = open_age_hours(wf)
    return wf.cases.where(open_at_snapshot(wf)).agg(
        F.count(F.lit(1)).alias("value"), F.count_if(age > F.col("sla_target_hours")).alias("breached_open"),
        *[F.count_if((age >= lo) & (age < hi)).alias(f"age_{n}") for n, lo, hi in AGE_BANDS])


def backlog_by_category(wf):
    return wf.cases.where(open_at_snapshot(wf)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))

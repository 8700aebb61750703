"""Annual pay cycle: merit, promotion, bonus and equity refreshers per person."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from crewgrid.functions.numeric import half_even, ratio
from crewgrid.functions.ranking import row_numbers

# Illustrative cycle policy.
MATRIX = {
    "outstanding": {"q1": 0.070, "q2": 0.060, "q3": 0.050, "q4": 0.040},
    "exceeds": {"q1": 0.055, "q2": 0.045, "q3": 0.035, "q4": 0.025},
    "meets": {"q1": 0.040, "q2": 0.030, "q3": 0.025, "q4": 0.015},
    "below": {"q1": 0.010, "q2": 0.005, "q3": 0.000, "q4": 0.000},
}
BUDGET = 0.035
BONUS_TARGET = {"L3": 0.08, "L4": 0.10, "L5": 0.15, "L6": 0.25, "L7": 0.40}
BONUS_FACTOR = {"below": 0.50, "meets": 1.00, "exceeds": 1.20, "outstanding": 1.50}
ATTAINMENT = 1.05
PROMOTION = 0.10
REFRESH = {
    "L3": {"below": 0, "meets": 18000, "exceeds": 28000, "outstanding": 40000},
    "L4": {"below": 0, "meets": 30000, "exceeds": 45000, "outstanding": 65000},
    "L5": {"below": 0, "meets": 55000, "exceeds": 80000, "outstanding": 115000},
    "L6": {"below": 0, "meets": 110000, "exceeds": 160000, "outstanding": 230000},
    "L7": {"below": 0, "meets": 240000, "exceeds": 340000, "outstanding": 480000},
}
REFRESH_PRICE = 85.20
REFRESH_MONTHS, REFRESH_CLIFF = 48, 12
GROUPS = ["staff", "management", "section16", "ceo"]  # junior to senior


def _map(d):
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _grid(d):
    return _map({f"{a}|{b}": float(v) for a, row in d.items() for b, v in row.items()})


def compa_band(c):
    return F.when(c < 0.90, "q1").when(c < 1.00, "q2").when(c < 1.10, "q3").otherwise("q4")


def eligible(workers):
    """Employees by status (leave included), not by dates."""
    return workers.where("worker_type = 'employee' and status in ('active', 'on_leave')")


def senior_group(grants):
    """Most senior participant group each holder has had."""
    rank = F.array_position(F.array(*[F.lit(g) for g in GROUPS]), F.col("participant_group"))
    best = grants.groupBy("emp_id").agg(F.max(rank).alias("r")).where("r > 0")
    return best.select("emp_id", F.element_at(F.array(*[F.lit(g) for g in GROUPS]), F.col("r").cast("int")).alias("ledger_group"))


def plan(workers, bands, grants=None):
    b = bands.select("band_id", "range_min", "range_mid", "range_max")
    x = eligible(workers).join(b, "band_id")
    if grants is not None:
        x = x.join(senior_group(grants), "emp_id", "left")
    else:
        x = x.withColumn("ledger_group", F.lit(None).cast("string"))
    base = F.col("base_salary").cast("double")
    lead = (F.col("is_people_manager") == "yes") & F.col("level").isin("L5", "L6", "L7")
    x = x.select(
        "emp_id", "level", "rating", "band_id", "range_max", base.alias("base_salary"), (F.col("promoted_this_period") == "yes").alias("promoted"),
        (F.col("scheduled_hours") / F.col("standard_full_time_hours")).alias("fte"), (base / F.col("range_mid")).alias("compa_ratio"),
        ((base - F.col("range_min")) / (F.col("range_max") - F.col("range_min"))).alias("range_penetration"), "range_mid", "status",
        F.coalesce("ledger_group", F.when(lead, "management").otherwise("staff")).alias("participant_group"))
    x = x.withColumn("actual_base", F.col("base_salary") * F.col("fte"))
    x = x.withColumn("merit_pct", _grid(MATRIX)[F.concat_ws("|", "rating", compa_band(F.col("compa_ratio")))])
    promo = F.when(F.col("promoted"), PROMOTION).otherwise(0.0)
    x = x.withColumn("new_base_salary", F.col("base_salary") * (1.0 + F.col("merit_pct") + promo))
    return x.select(
        "*", (F.col("new_base_salary") / F.col("range_mid")).alias("new_compa_ratio"), (F.col("actual_base") * F.col("merit_pct")).alias("merit_amount"),
        (F.col("actual_base") * promo).alias("promo_amount"),
        (F.col("actual_base") * _map(BONUS_TARGET)[F.col("level")] * _map(BONUS_FACTOR)[F.col("rating")] * ATTAINMENT).alias("bonus_amount"),
        (_grid(REFRESH)[F.concat_ws("|", "level", "rating")] * F.col("fte")).alias("equity_refresh_value"))


def totals(p):
    s = lambda c: F.sum(c)
    a = p.agg(
        F.count(F.lit(1)).alias("eligible_headcount"), F.count_if(F.col("status") == "on_leave").alias("on_leave_count"), s("actual_base").alias("_pay"), s("merit_amount").alias("_merit"),
        s("promo_amount").alias("_promo"), s("bonus_amount").alias("_bonus"), s("equity_refresh_value").alias("_refresh"), F.count_if("promoted").alias("promotions"),
        F.avg("compa_ratio").alias("_c"), F.avg("new_compa_ratio").alias("_nc"), F.count_if(F.col("new_base_salary") > F.col("range_max")).alias("over_max_after_merit"))
    budget = F.col("_pay") * BUDGET
    return a.select(
        "eligible_headcount", "on_leave_count", half_even("_pay").alias("payroll"), half_even(budget).alias("merit_budget"), half_even("_merit").alias("merit_spend"),
        half_even(100 * ratio("_merit", "_pay"), 2).alias("merit_spend_pct"), (F.col("_merit") <= budget + 1.0).alias("within_budget"), half_even(budget - F.col("_merit")).alias("headroom"),
        half_even("_promo").alias("promo_spend"), half_even("_bonus").alias("bonus_pool"), half_even("_refresh").alias("refresh_value"), "promotions",
        half_even("_c", 3).alias("avg_compa_ratio"), half_even("_nc", 3).alias("avg_new_compa_ratio"), "over_max_after_merit")


def aggregate_by(p, key, fields=("merit_amount", "bonus_amount", "actual_base")):
    return p.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[half_even(F.sum(f), 5).alias(f) for f in fields])


def refresher_shares(value):
    return F.greatest(F.lit(1), F.bround(value / REFRESH_PRICE, 0)).cast("bigint")


def refreshers(p, grants, year=2026, plan="P-A"):
    """Grant rows, with all columns of the grant ledger, ready to append to it: ids continue after the ledger's highest, in employee order.

    Ids of a ledger are numbers or texts 'G-######'; new ones are of the same kind.  Texts of another form cannot collide and do not count."""
    r = row_numbers(p.where("equity_refresh_value > 0"), "emp_id", out="seq")
    texts = isinstance(grants.schema["grant_id"].dataType, StringType)
    number = F.regexp_extract(F.trim("grant_id"), "^G-([0-9]+)$", 1).try_cast("bigint") if texts else F.col("grant_id").cast("bigint")
    top = grants.agg(F.coalesce(F.max(number), F.lit(0)).alias("_top"))
    d = F.to_date(F.lit(f"{year}-02-15"))
    new = F.col("_top") + F.col("seq")
    none = lambda t: F.lit(None).cast(t)
    return r.crossJoin(F.broadcast(top)).select(
        (F.concat(F.lit("G-"), F.lpad(new.cast("string"), F.greatest(F.lit(6), F.length(new.cast("string"))), F.lit("0"))) if texts else new).alias("grant_id"), F.lit(plan).alias("plan_id"), "emp_id", "participant_group",
        F.lit("annual_refresh").alias("grant_type"), F.lit("rsu").alias("award_type"), d.alias("grant_date"), refresher_shares(F.col("equity_refresh_value")).alias("shares_granted"), F.lit(1.0).alias("psu_max_multiplier"),
        none("string").alias("psu_share_basis"), F.lit(REFRESH_PRICE).alias("stock_price_at_grant_usd"), none("double").alias("strike_price_usd"), F.lit(REFRESH_PRICE).alias("grant_date_fv_per_share_usd"), d.alias("vest_start_date"),
        F.lit(REFRESH_MONTHS).alias("vest_months_total"), F.lit(REFRESH_CLIFF).alias("cliff_months"), F.lit("monthly").alias("vest_frequency"), none("date").alias("performance_period_end"))


def group_split(rows):
    return rows.groupBy("participant_group").agg(F.count(F.lit(1)).alias("grants"), F.sum("shares_granted").alias("shares"))


def split_violations(rows, published):
    """Recompute the split and list rows that differ either way."""
    now = group_split(rows)
    return now.exceptAll(published).unionByName(published.exceptAll(now)).select(F.lit("group_split").alias("rule"), F.col("participant_group").alias("key"))


def reconciliation(p):
    """Totals against the sums of their splits; empty when all agree."""
    by = lambda k: p.groupBy(k).agg(F.sum("merit_amount").alias("m"), F.sum("bonus_amount").alias("b"), F.count(F.lit(1)).alias("n"))
    tot = p.agg(F.sum("merit_amount").alias("M"), F.sum("bonus_amount").alias("B"), F.count(F.lit(1)).alias("N"))
    out = None
    for k in ("rating", "level"):
        x = by(k).agg(F.sum("m").alias("m"), F.sum("b").alias("b"), F.sum("n").alias("n")).crossJoin(tot)
        bad = x.where((F.abs(F.col("m") - F.col("M")) > 0.5) | (F.abs(F.col("b") - F.col("B")) > 0.5) | (F.col("n") != F.col("N")))
        row = bad.select(F.lit("split_adds_up").alias("rule"), F.lit(k).alias("key"))
        out = row if out is None else out.unionByName(row)
    return out

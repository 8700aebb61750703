"""Pay position, pay gaps and benefits."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from crewgrid.functions.numeric import half_even, pct, ratio
from crewgrid.functions.ranking import quantiles
from crewgrid.operators.population import average_headcount_expr


def banded(wf):
    """Active people with a salary and a pay band.  The band table has one row
    per level, family and site; the session's own size limit decides on broadcast."""
    cols = ["band_id", "range_min", "range_mid", "range_max"]
    return wf.active.where("base_salary > 0").join(wf.bands.select(*cols), "band_id")


def compa_ratio(wf):
    a = banded(wf).agg(
        F.sum("base_salary").alias("_b"), F.sum("range_mid").alias("_m"),
        F.avg(F.col("base_salary") / F.col("range_mid")).alias("_r"), F.count(F.lit(1)).alias("n"))
    return a.select(half_even(ratio("_b", "_m", 0), 3).alias("value"), half_even(F.coalesce("_r", F.lit(0.0)), 3).alias("mean_of_ratios"), "n")


def segment_compa_ratio(wf, by):
    a = banded(wf).groupBy(by).agg(F.sum("base_salary").alias("_b"), F.sum("range_mid").alias("_m"))
    return a.select(by, half_even(ratio("_b", "_m"), 3).alias("value"))


def range_penetration(wf):
    a = banded(wf).agg(F.sum(F.col("base_salary") - F.col("range_min")).alias("_n"),
                       F.sum(F.col("range_max") - F.col("range_min")).alias("_d"), F.count(F.lit(1)).alias("n"))
    return a.select(pct("_n", "_d").alias("value"), "n")


PENETRATION_LABELS = ["<min", "0-10", "-20", "-30", "-40", "-50", "-60", "-70", "-80", "-90", "-100", ">max"]


def penetration_histogram(wf):
    p = 100.0 * (F.col("base_salary") - F.col("range_min")) / (F.col("range_max") - F.col("range_min"))
    slot = F.when(p < 0, 0).when(p > 100, 11).otherwise(F.least(F.lit(9), F.floor(p / 10)) + 1).cast("int")
    h = banded(wf).where("range_max > range_min").groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    frame = h.sparkSession.createDataFrame(list(enumerate(PENETRATION_LABELS)), "slot int, label string")
    return frame.join(h, "slot", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def out_of_band_rate(wf):
    a = banded(wf).agg(
        F.count_if(F.col("base_salary") < F.col("range_min")).alias("below"),
        F.count_if(F.col("base_salary") > F.col("range_max")).alias("above"), F.count(F.lit(1)).alias("n"))
    ok = F.col("n") - F.col("below") - F.col("above")
    return a.select(pct(F.col("below") + F.col("above"), "n").alias("value"), pct("below", "n").alias("below_min_rate"),
                    pct("above", "n").alias("above_max_rate"), pct(ok, "n").alias("in_band_rate"), "below", "above", ok.alias("in_band"), "n")


def raw_pay_gap(wf, group_field="gender_group", floor=5):
    """Median pay per group against the highest median; groups under the floor stay out."""
    m = quantiles(banded(wf).withColumn("grp", F.coalesce(F.col(group_field), F.lit(""))), "base_salary", {"median": 0.5}, ["grp"])
    m = m.where(F.col("n_obs") >= floor)
    w = Window.partitionBy(F.lit(0))  # one row per group label
    out = m.withColumn("gap_pct", half_even(100 * (F.col("median") / F.max("median").over(w) - 1), 1))
    out = out.withColumn("value", F.min("gap_pct").over(w)).withColumn("_k", F.count(F.lit(1)).over(w))
    ok = F.col("_k") >= 2
    return out.select("grp", F.col("n_obs").alias("n"), "median", F.when(ok, F.col("gap_pct")).alias("gap_pct"), F.when(ok, F.col("value")).alias("value"))


def benefits_enrollment_rate(wf):
    """Overall row ('all') and one row per benefit, from one rollup."""
    e = wf.benefits.rollup("benefit").agg(
        F.count_if(F.col("eligible") == "yes").alias("eligible"),
        F.count_if((F.col("eligible") == "yes") & (F.col("enrolled") == "yes")).alias("enrolled"))
    return e.select(F.coalesce("benefit", F.lit("all")).alias("benefit"), "eligible", "enrolled", pct("enrolled", "eligible").alias("value"))


def benefits_cost_per_employee(wf):
    cost = wf.benefits.where("enrolled = 'yes'").agg(F.sum("employer_cost_annual").alias("total_employer_cost"))
    hc = wf.employees.agg(average_headcount_expr(wf.as_of).alias("_hc"))
    return cost.crossJoin(hc).select(half_even(ratio("total_employer_cost", "_hc", 0)).alias("value"),
                                     "total_employer_cost", half_even("_hc", 1).alias("avg_headcount"))

"""Headcount, organisation shape, attrition, talent and diversity metrics."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from crewgrid.functions.dates import trailing_year
from crewgrid.functions.numeric import half_even, pct, ratio
from crewgrid.functions.ranking import quantiles
from crewgrid.operators.population import (
    active_at, average_headcount_expr, day, matured, turnover, within,
)
from crewgrid.session import ensure_checkpoint_dir

LONGEST_CHAIN = 50


def fte_expr():
    share = F.least(F.lit(1.0), ratio(F.coalesce(F.col("scheduled_hours"), F.lit(0)), "standard_full_time_hours"))
    return F.coalesce(F.sum(share), F.lit(0.0))


def headcount(wf):
    return wf.active.agg(
        F.count(F.lit(1)).alias("value"),
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") == "on_leave").alias("on_leave"),
    )


def fte(wf):
    return wf.active.agg(half_even(fte_expr(), 1).alias("value"))


def net_headcount_growth(wf):
    start, end = trailing_year(wf.as_of)
    left = within("term_date", start, end)
    a = wf.employees.agg(
        F.count_if(active_at(start)).alias("beginning"),
        F.count_if(active_at(end)).alias("ending"),
        F.count_if(within("hire_date", start, end)).alias("hires"),
        F.count_if(left & (F.col("term_type") == "voluntary")).alias("voluntary_exits"),
        F.count_if(left & (F.col("term_type") == "involuntary")).alias("involuntary_exits"),
    )
    net = F.col("ending") - F.col("beginning")
    gone = F.col("voluntary_exits") + F.col("involuntary_exits")
    return a.select("*", net.alias("value"), gone.alias("total_exits"),
                    (net == F.col("hires") - gone).alias("bridge_reconciles"))


def report_counts(wf):
    """Direct reports per active manager.  Counting first leaves one row per
    manager, so the self-join never carries a manager's whole team."""
    counts = wf.active.where("manager_id is not null").groupBy("manager_id").agg(F.count(F.lit(1)).alias("reports"))
    ids = wf.active.select(F.col("emp_id").alias("manager_id"))
    return counts.join(ids, "manager_id", "left_semi")


# Bands of direct reports.
SPAN_BANDS = [("1-2", 1, 2), ("3", 3, 3), ("4-6", 4, 6), ("7-9", 7, 9), ("10-12", 10, 12), ("13+", 13, 1 << 30)]


def span_of_control(wf):
    spans = report_counts(wf)
    bands = [F.count_if(F.col("reports").between(lo, hi)).alias(f"span_{n}") for n, lo, hi in SPAN_BANDS]
    stats = spans.agg(
        F.count(F.lit(1)).alias("managers"), F.sum("reports").alias("_r"), F.max("reports").alias("max"), *bands
    )
    med = quantiles(spans, "reports", {"median": 0.5}, splits=[])  # span sizes are small whole numbers
    return stats.crossJoin(med.select("median")).select(
        half_even(ratio("_r", "managers", 0), 2).alias("value"), "managers",
        half_even(ratio("_r", "managers", 0), 2).alias("mean"),
        "median", "max", *[f"span_{n}" for n, *_ in SPAN_BANDS],
    )


def org_shape(wf):
    """Managers and individual contributors per level."""
    m = F.count_if(F.col("is_people_manager") == "yes")
    n = F.count(F.lit(1))
    return wf.active.groupBy("level").agg(m.alias("managers"), (n - m).alias("ics"), n.alias("total"))


def span_outlier_rate(wf, low=3, high=10):
    a = report_counts(wf).agg(
        F.count(F.lit(1)).alias("managers"),
        F.count_if(F.col("reports") < low).alias("sub"), F.count_if(F.col("reports") > high).alias("over"),
    )
    return a.select(
        pct(F.col("sub") + F.col("over"), "managers").alias("value"),
        pct("sub", "managers").alias("sub_scale_pct"), pct("over", "managers").alias("overloaded_pct"), "managers",
    )


def manager_depths(wf, limit=LONGEST_CHAIN):
    """Steps from each active person up to the top of the active tree, at most `limit`.

    Pointer doubling: after round k every person knows the manager 2^k steps
    up and how many real steps that took, so 50 levels need six joins instead of fifty.
    People caught in a cycle never reach a top and keep `limit`.  Joins are
    one row per person on the unique id side, so a manager with a third of all
    people only repeats a lookup key; it never multiplies rows."""
    ids = wf.active.select("emp_id", "manager_id")
    known = ids.select(F.col("emp_id").alias("manager_id"), F.lit(True).alias("_known"))
    cur = (
        ids.join(known, "manager_id", "left")
        .select("emp_id", F.when(F.col("_known"), F.col("manager_id")).alias("up"))
        .withColumn("depth", F.col("up").isNotNull().cast("int"))
    )
    ensure_checkpoint_dir(ids.sparkSession)
    step = 1
    while step < limit:
        hop = cur.select(F.col("emp_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        cur = cur.join(hop, "up", "left").select(
            "emp_id", F.col("up2").alias("up"),
            F.least(F.lit(limit), F.col("depth") + F.coalesce(F.col("depth2"), F.lit(0))).alias("depth"),
        )
        step *= 2
        cur = cur.checkpoint()  # one stored copy: the next round joins it with itself
        if cur.where("up is not null").isEmpty():
            break
    return cur.select("emp_id", "depth")


def management_layers(wf):
    d = manager_depths(wf)
    q = quantiles(d, "depth", {"value": 0.5}, splits=[])  # at most 51 distinct depths
    return q.select("value").crossJoin(d.agg(F.max("depth").alias("max_depth")))


def layer_distribution(wf):
    return manager_depths(wf).groupBy("depth").agg(F.count(F.lit(1)).alias("people"))


def contingent_workforce_ratio(wf):
    kind = F.col("worker_type")
    a = wf.workers.where(active_at(wf.as_of)).agg(
        F.count_if(kind == "contractor").alias("contractors"), F.count_if(kind == "employee").alias("employees"))
    return a.select(pct("contractors", F.col("contractors") + F.col("employees")).alias("value"), "contractors", "employees")


def _rate(wf, predicate, name, extra=True):
    t = turnover(wf, predicate, name=name)
    cols = [F.col("rate_pct").alias("value"), name]
    if extra:
        cols.append(half_even("avg_headcount", 1).alias("avg_headcount"))
    return t.select(*cols)


def voluntary_attrition(wf):
    return _rate(wf, F.col("term_type") == "voluntary", "voluntary_exits")


def total_turnover_rate(wf):
    return _rate(wf, F.col("term_type").isin("voluntary", "involuntary"), "all_exits")


def involuntary_turnover_rate(wf):
    return _rate(wf, F.col("term_type") == "involuntary", "involuntary_exits", extra=False)


def regrettable_attrition(wf):
    """Windowed regrettable exits; the share divides by ALL voluntary exits on record."""
    start, end = trailing_year(wf.as_of)
    a = wf.employees.agg(
        F.count_if((F.col("regrettable") == "yes") & within("term_date", start, end)).alias("regrettable_exits"),
        F.count_if(F.col("term_type") == "voluntary").alias("_all_vol"),
        average_headcount_expr(wf.as_of).alias("_hc"),
    )
    return a.select(half_even(100 * ratio("regrettable_exits", "_hc", 0), 1).alias("value"), "regrettable_exits",
                    pct("regrettable_exits", "_all_vol").alias("regrettable_share_of_voluntary_pct"))


def _cohort(wf, days):
    gone = F.coalesce(F.date_diff("term_date", "hire_date") < days, F.lit(False))
    return wf.employees.where(matured(wf.as_of, days)), gone


def new_hire_attrition(wf):
    c, gone = _cohort(wf, 365)
    a = c.agg(
        F.count(F.lit(1)).alias("cohort"), F.count_if(gone).alias("left_within_12mo"),
        F.count_if(gone & (F.col("term_type") == "voluntary")).alias("voluntary"),
        F.count_if(gone & (F.col("term_type") == "involuntary")).alias("involuntary"),
    )
    return a.select(pct("left_within_12mo", "cohort").alias("value"), "*")


def early_attrition_90d(wf):
    c, gone = _cohort(wf, 90)
    a = c.agg(F.count(F.lit(1)).alias("cohort"), F.count_if(gone).alias("left_within_90d"))
    return a.select(pct("left_within_90d", "cohort").alias("value"), "*")


def twelve_month_retention(wf):
    c, gone = _cohort(wf, 365)
    a = c.agg(F.count(F.lit(1)).alias("cohort"), F.count_if(~gone).alias("active_at_12mo"))
    return a.select(pct("active_at_12mo", "cohort").alias("value"), "*")


def _share_within(df, keys, group, out):
    """Share of each group inside its keys; groups are counted before the window sees them."""
    g = df.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return g.withColumn(out, pct("n", F.sum("n").over(w)))


def representation_by_level(wf, group_field="gender_group"):
    pop = wf.active.where(F.col(group_field).isNotNull())
    return _share_within(pop, ["level"], group_field, "share_pct")


def leadership_diversity(wf, group_field="gender_group"):
    pop = wf.active.where(F.col(group_field).isNotNull() & (F.col("is_people_manager") == "yes"))
    return _share_within(pop, [], group_field, "share_pct")


RATINGS = ["below", "meets", "exceeds", "outstanding"]


def rating_distribution(wf):
    n = F.count("rating")
    a = wf.active.agg(
        n.alias("rated"), F.count_if(F.col("rating").isNull()).alias("_un"),
        *[F.count_if(F.col("rating") == r).alias(r) for r in RATINGS],
    )
    return a.select(*[pct(r, "rated").alias(r) for r in RATINGS], "rated",
                    pct("_un", F.col("_un") + F.col("rated")).alias("unrated_share_pct"))


def promotion_rate(wf):
    elig = active_at(wf.as_of) & (F.col("promotion_eligible") == "yes")
    a = wf.employees.agg(
        F.count_if(elig).alias("eligible_population"),
        F.count_if(elig & (F.col("promoted_this_period") == "yes")).alias("promoted"),
        average_headcount_expr(wf.as_of).alias("_hc"),
    )
    return a.select(pct("promoted", "eligible_population").alias("value"), "promoted", "eligible_population",
                    pct("promoted", "_hc").alias("enterprise_rate_pct"))


def promotion_rate_by_level(wf):
    """Total and per-level rows from one rollup."""
    p = wf.active.where("promotion_eligible = 'yes'").rollup("level").agg(
        F.count(F.lit(1)).alias("eligible"), F.count_if(F.col("promoted_this_period") == "yes").alias("promoted"))
    return p.select(F.coalesce("level", F.lit("all")).alias("level"), "eligible", "promoted", pct("promoted", "eligible").alias("rate_pct"))


PERFORMANCE_BAND = {"below": "Low", "meets": "Med", "exceeds": "High", "outstanding": "High"}
GRID = ["Low", "Med", "High"]


def nine_box(wf):
    """Performance x potential counts; all nine cells appear and add up to n."""
    pairs = F.create_map(*[F.lit(x) for kv in PERFORMANCE_BAND.items() for x in kv])
    pop = wf.active.where("rating is not null and potential is not null").withColumn("performance", pairs[F.col("rating")])
    cells = pop.groupBy("potential").pivot("performance", GRID).count().na.fill(0)
    frame = pop.sparkSession.createDataFrame([(p,) for p in GRID], "potential string")
    full = frame.join(cells, "potential", "left").na.fill(0)
    long = full.unpivot(["potential"], GRID, "performance", "n")
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # nine rows
    return long.withColumn("pct", pct("n", total))


def count_by(df, field):
    return df.groupBy(field).agg(F.count(F.lit(1)).alias("n"))


def segment_voluntary_attrition(wf, by):
    """Voluntary rate per segment; a segment with no average headcount divides by 1."""
    t = turnover(wf, F.col("term_type") == "voluntary", [by], "exits").where(F.col(by).isNotNull())
    hc = F.when(F.col("avg_headcount") != 0, F.col("avg_headcount")).otherwise(1.0)
    return t.select(by, "exits", half_even(100 * F.col("exits") / hc, 1).alias("value"))


def hotspot(segments, by, value="value"):
    """Segment with the highest value (ties: first in name order)."""
    return segments.agg(
        F.min_by(by, F.struct((-F.col(value)).alias("v"), F.col(by).alias("k"))).alias("segment"),
        F.max(value).alias("value"),
    )

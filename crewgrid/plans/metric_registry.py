"""Metric ids bound to their builders, with status for what has no source yet."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewgrid.operators import linkage, payfit, rewards, service, workforce as w

METRICS = {
    "headcount": w.headcount, "fte": w.fte, "net_headcount_growth": w.net_headcount_growth,
    "span_of_control": w.span_of_control, "span_outlier_rate": w.span_outlier_rate,
    "management_layers": w.management_layers, "contingent_workforce_ratio": w.contingent_workforce_ratio,
    "voluntary_attrition": w.voluntary_attrition, "regrettable_attrition": w.regrettable_attrition,
    "total_turnover_rate": w.total_turnover_rate, "involuntary_turnover_rate": w.involuntary_turnover_rate,
    "new_hire_attrition": w.new_hire_attrition, "early_attrition_90d": w.early_attrition_90d,
    "twelve_month_retention": w.twelve_month_retention, "compa_ratio": rewards.compa_ratio,
    "range_penetration": rewards.range_penetration, "out_of_band_rate": rewards.out_of_band_rate,
    "raw_pay_gap": rewards.raw_pay_gap, "adjusted_pay_gap": payfit.adjusted_pay_gap,
    "benefits_enrollment_rate": rewards.benefits_enrollment_rate,
    "benefits_cost_per_employee": rewards.benefits_cost_per_employee, "case_volume": service.case_volume,
    "sla_attainment": service.sla_attainment, "time_to_resolution": service.time_to_resolution,
    "reopen_rate": service.reopen_rate, "first_contact_resolution": service.first_contact_resolution,
    "case_csat": service.case_csat, "open_case_backlog": service.open_case_backlog,
    "representation_by_level": w.representation_by_level, "leadership_diversity": w.leadership_diversity,
    "rating_distribution": w.rating_distribution, "promotion_rate": w.promotion_rate, "nine_box": w.nine_box,
    "revenue_per_fte": linkage.revenue_per_fte, "operating_leverage": linkage.operating_leverage,
    "workforce_cost_ratio": linkage.workforce_cost_ratio,
}

SEGMENTS = {"compa_ratio": rewards.segment_compa_ratio, "voluntary_attrition": w.segment_voluntary_attrition}

# Metric id, domain, unit.
DOMAINS = {
    "headcount": "headcount", "fte": "headcount", "net_headcount_growth": "headcount", "span_of_control": "headcount",
    "span_outlier_rate": "headcount", "management_layers": "headcount", "contingent_workforce_ratio": "headcount",
    "voluntary_attrition": "attrition", "regrettable_attrition": "attrition", "total_turnover_rate": "attrition",
    "involuntary_turnover_rate": "attrition", "new_hire_attrition": "attrition", "early_attrition_90d": "attrition",
    "twelve_month_retention": "attrition", "compa_ratio": "total_rewards", "range_penetration": "total_rewards",
    "out_of_band_rate": "total_rewards", "raw_pay_gap": "total_rewards", "adjusted_pay_gap": "total_rewards",
    "benefits_enrollment_rate": "total_rewards", "benefits_cost_per_employee": "total_rewards",
    "case_volume": "people_ops", "sla_attainment": "people_ops", "time_to_resolution": "people_ops",
    "reopen_rate": "people_ops", "first_contact_resolution": "people_ops", "case_csat": "people_ops",
    "open_case_backlog": "people_ops", "representation_by_level": "diversity", "leadership_diversity": "diversity",
    "rating_distribution": "performance", "promotion_rate": "performance", "nine_box": "succession",
    "revenue_per_fte": "business_linkage", "operating_leverage": "business_linkage", "workforce_cost_ratio": "business_linkage",
}

# Metrics that are defined but wait for a source, and the input each one needs.
PENDING = {
    "internal_mobility_rate": ("attrition", "internal moves"),
    "internal_fill_rate": ("attrition", "filled requisitions with source"),
    "grievance_rate": ("compliance_ethics", "formal grievances"),
    "disciplinary_action_rate": ("compliance_ethics", "disciplinary actions"),
    "ethics_hotline_cases": ("compliance_ethics", "hotline reports"),
    "adverse_impact_ratio": ("diversity", "selection events by group"),
    "vacancy_rate": ("headcount", "approved positions"),
    "headcount_plan_attainment": ("headcount", "headcount plan"),
    "trir": ("health_safety", "recordable incidents and hours"),
    "ltifr": ("health_safety", "lost-time injuries and hours"),
    "absence_rate": ("health_safety", "absence days"),
    "training_hours_per_fte": ("learning_development", "training hours"),
    "training_completion_rate": ("learning_development", "training assignments"),
    "critical_skill_coverage": ("learning_development", "skill seats"),
    "self_service_deflection": ("people_ops", "self-service sessions"),
    "promotion_velocity": ("performance", "promotion dates"),
    "succession_coverage": ("succession", "critical roles and successors"),
    "successor_readiness_mix": ("succession", "successor readiness"),
    "open_requisitions": ("talent_acquisition", "requisitions"),
    "time_to_fill": ("talent_acquisition", "offers"),
    "time_to_hire": ("talent_acquisition", "candidates"),
    "req_aging": ("talent_acquisition", "requisitions"),
    "req_staleness": ("talent_acquisition", "requisitions"),
    "thin_pipeline": ("talent_acquisition", "candidate stages"),
    "offer_acceptance_rate": ("talent_acquisition", "offers"),
    "stage_pass_through_rate": ("talent_acquisition", "candidate stages"),
    "quality_of_hire": ("talent_acquisition", "hire outcomes"),
    "cost_per_hire": ("talent_acquisition", "recruiting cost"),
    "source_effectiveness": ("talent_acquisition", "candidates by source"),
    "recruiter_capacity": ("talent_acquisition", "recruiters"),
    "merit_increase_pct": ("total_rewards", "pay changes"),
    "comp_exception_rate": ("total_rewards", "exception requests"),
    "ceo_pay_ratio": ("total_rewards", "total annual pay"),
    "total_cash_compensation": ("total_rewards", "targets"),
    "bonus_attainment": ("total_rewards", "bonus payments"),
    "labor_cost_per_fte": ("total_rewards", "total labour cost"),
}


def compute(metric_id, wf, **opts):
    """(status, frame): ok with a frame, data_pending or unknown_metric with none."""
    if metric_id in METRICS:
        return "ok", METRICS[metric_id](wf, **opts)
    return ("data_pending", None) if metric_id in PENDING else ("unknown_metric", None)


def segment(metric_id, wf, by, **opts):
    if metric_id in SEGMENTS:
        return "ok", SEGMENTS[metric_id](wf, by, **opts)
    known = metric_id in METRICS or metric_id in PENDING
    return ("no_segment" if known else "unknown_metric"), None


def status_table(spark):
    """metric_status: one row per defined metric."""
    rows = [(m, DOMAINS[m], "ok", None) for m in METRICS] + [(m, d, "data_pending", need) for m, (d, need) in PENDING.items()]
    return spark.createDataFrame(rows, "metric_id string, domain string, status string, needs string")


def coverage_by_domain(spark):
    return status_table(spark).groupBy("domain").agg(F.count_if(F.col("status") == "ok").alias("computed"), F.count(F.lit(1)).alias("defined"))


def pending_by_domain(spark):
    p = status_table(spark).where("status = 'data_pending'")
    return p.groupBy("domain").agg(F.array_sort(F.collect_list("metric_id")).alias("metrics"))


def long_form(metric_id, frame, as_of):
    """Melt a one-row metric frame to (metric_id, as_of, field, value)."""
    nums = [F.col(c).cast("double").alias(c) for c in frame.columns]
    return frame.select(*nums).unpivot([], frame.columns, "field", "value").select(
        F.lit(metric_id).alias("metric_id"), F.lit(as_of).cast("date").alias("as_of"), "field", "value")


def metric_table(wf, metric_ids):
    """Several scalar metrics as one long frame."""
    out = None
    for m in metric_ids:
        status, frame = compute(m, wf)
        if status != "ok":
            raise ValueError(f"{m}: {status}")
        f = long_form(m, frame, wf.as_of)
        out = f if out is None else out.unionByName(f)
    return out

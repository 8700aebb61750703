"""Pay-for-performance screens and the two-advisor reconciliation, for every company as subject."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewgrid.functions.numeric import band_by_upper, clamp, half_even, level_high_is_worse, level_low_is_worse
from crewgrid.operators.peers import COCITATION, COMPARISON

# Published screen thresholds and windows per proxy season.
ISS_POLICIES = {
    2025: {"mom_blend": (1,), "rda_years": 3, "bands": {
        "mom": {"fpa_eligible": 1.84, "medium": 2.33, "high": 3.33},
        "rda": {"fpa_eligible": -38.0, "medium": -50.0, "high": -60.0},
        "pta": {"fpa_eligible": -25.0, "medium": -30.0, "high": -45.0}}},
    2026: {"mom_blend": (1, 3), "rda_years": 5, "bands": {
        "mom": {"fpa_eligible": 1.89, "medium": 2.33, "high": 3.40},
        "rda": {"fpa_eligible": -41.0, "medium": -54.0, "high": -64.0},
        "pta": {"fpa_eligible": -28.0, "medium": -30.0, "high": -45.0}}},
}
# Weights of the pay-TSR alignment regression (decay 0.85).
TSR_WEIGHTS = (0.6661, 0.7837, 0.9220, 1.0847, 1.2761, 1.5012)
PAY_WEIGHTS = (0.7225, 0.8500, 1.0000, 1.1765, 1.3841)
FPA_NEUTRAL = 20.0
LABELS = ["Low", "Medium", "High"]


def policy_for(year):
    if isinstance(year, bool) or not isinstance(year, int) or year not in ISS_POLICIES:
        raise ValueError(f"no policy for season {year!r}")
    return ISS_POLICIES[year]


def pay_average(k, prefix="pay_y", last=5):
    cols = [F.col(f"{prefix}{y}") for y in range(last - k + 1, last + 1)]
    return sum(cols[1:], cols[0]) / float(k)


def tsr_return(years, last=5):
    base = F.lit(100.0) if years == last else F.col(f"tsrval_y{last - years}")
    return F.col(f"tsrval_y{last}") / base - 1.0


def weighted_trend(values, xs, weights):
    """Weighted least-squares slope over the weighted mean of the values."""
    sw, swx = sum(weights), sum(w * x for w, x in zip(weights, xs))
    swxx = sum(w * x * x for w, x in zip(weights, xs))
    swp = sum((w * v for w, v in zip(weights, values)), F.lit(0.0))
    swxp = sum((w * x * v for w, x, v in zip(weights, xs, values)), F.lit(0.0))
    slope = (sw * swxp - swx * swp) / (sw * swxx - swx * swx)
    mean = swp / sw
    return F.when(mean != 0, slope / mean).otherwise(slope)


def iss_measures(years, rda_years):
    """One row per company with everything the screen ranks or compares."""
    pays = [F.col(f"pay_y{y}") for y in range(1, 6)]
    tsrs = [F.lit(100.0)] + [F.col(f"tsrval_y{y}") for y in range(1, 6)]
    return years.select(
        "ticker", pay_average(1).alias("pay_1"), pay_average(3).alias("pay_3"),
        F.bround(pay_average(rda_years), 9).alias("pay_w"), F.bround(tsr_return(rda_years), 9).alias("tsr_w"),
        F.bround("fin_eva", 9).alias("fin"),
        weighted_trend(pays, (1, 2, 3, 4, 5), PAY_WEIGHTS).alias("pay_trend"),
        weighted_trend(tsrs, (0, 1, 2, 3, 4, 5), TSR_WEIGHTS).alias("tsr_trend"),
    )


def rank_in_group(member, own, digits=2):
    """Average-rank percentile of the subject among its members plus itself, as one aggregate."""
    below, same = F.count_if(member < own), F.count_if(member == own)
    return F.bround(100.0 * (below + same / 2.0) / F.count(F.lit(1)), digits)


def iss_screen(companies_years, groups, policy_year=2026, minimum=COMPARISON["minimum"], bands=None):
    """MOM, RDA, PTA and FPA with the concern rules for every scorable subject."""
    p = policy_for(policy_year)
    b = bands or p["bands"]
    m = iss_measures(companies_years, p["rda_years"])
    own = m.select(F.col("ticker").alias("subject"), *[F.col(c).alias(f"s_{c}") for c in m.columns if c != "ticker"])
    j = groups.select("subject", "ticker").join(m, "ticker").join(own, "subject")
    s_cols = [c for c in own.columns if c != "subject"]
    agg = j.groupBy("subject", *s_cols).agg(
        F.count(F.lit(1)).alias("n_group"), F.median("pay_1").alias("m1"), F.median("pay_3").alias("m3"),  # at most 24 rows a group
        rank_in_group(F.col("pay_w"), F.col("s_pay_w")).alias("pay_pctile"),
        rank_in_group(F.col("tsr_w"), F.col("s_tsr_w")).alias("tsr_pctile"),
        rank_in_group(F.col("fin"), F.col("s_fin")).alias("fin_pctile"),
    ).where(F.col("n_group") >= minimum)
    parts = {1: F.col("s_pay_1") / F.col("m1"), 3: F.col("s_pay_3") / F.col("m3")}
    blend = [parts[k] for k in p["mom_blend"]]
    x = agg.select(
        "subject", "n_group", "pay_pctile", "tsr_pctile", "fin_pctile",
        (sum(blend[1:], blend[0]) / float(len(blend))).alias("mom_raw"),
        F.bround(F.col("tsr_pctile") - F.col("pay_pctile"), 2).alias("rda"),
        F.bround((F.col("s_tsr_trend") - F.col("s_pay_trend")) * 100.0, 2).alias("pta"),
        F.bround(F.col("fin_pctile") - F.col("pay_pctile"), 2).alias("fpa"),
    )
    x = (
        x.withColumn("mom_c", level_high_is_worse("mom_raw", b["mom"]["medium"], b["mom"]["high"]))
        .withColumn("rda_c", level_low_is_worse("rda", b["rda"]["medium"], b["rda"]["high"]))
        .withColumn("pta_c", level_low_is_worse("pta", b["pta"]["medium"], b["pta"]["high"]))
    )
    return concern_cascade(x, b).select(
        "subject", "n_group", half_even("mom_raw", 3).alias("mom"), "rda", "pta", "fpa",
        "pay_pctile", "tsr_pctile", "fin_pctile", *[label(c).alias(f"{c[:3]}_band") for c in ("mom_c", "rda_c", "pta_c")],
        "borders", "fpa_applied", label("overall").alias("concern"), "triggers",
    )


def label(c):
    return F.element_at(F.array(*[F.lit(v) for v in LABELS]), F.col(c) + 1)


def concern_cascade(x, b):
    """Measure levels (mom_c, rda_c, pta_c), values and fpa -> overall level and flags."""
    levels = [F.col(c) for c in ("mom_c", "rda_c", "pta_c")]
    n_high = sum(((c == 2).cast("int") for c in levels), F.lit(0))
    n_med = sum(((c == 1).cast("int") for c in levels), F.lit(0))
    between = lambda c, k: (F.col(c) > b[k]["medium"]) & (F.col(c) <= b[k]["fpa_eligible"])
    borders = ((F.col("mom_raw") >= b["mom"]["fpa_eligible"]) & (F.col("mom_raw") < b["mom"]["medium"])) | between("rda", "rda") | between("pta", "pta")
    poor, strong = F.col("fpa") < -FPA_NEUTRAL, F.col("fpa") > FPA_NEUTRAL
    overall = (
        F.when(n_high + n_med >= 2, 2)
        .when(n_high == 1, F.when(strong, 1).otherwise(2))
        .when(n_med == 1, F.when(poor, 2).when(strong, 0).otherwise(1))
        .otherwise(F.when(borders & poor, 1).otherwise(0))
    )
    applied = (
        F.when(n_high + n_med >= 2, False).when(n_high == 1, strong).when(n_med == 1, poor | strong).otherwise(borders & poor)
    )
    flags = F.filter(F.array(
        F.when(F.col("mom_raw") >= b["mom"]["fpa_eligible"], "magnitude"),
        F.when(F.col("rda") <= b["rda"]["fpa_eligible"], "relative_degree"),
        F.when(F.col("pta") <= b["pta"]["fpa_eligible"], "trend"),
        F.when(F.col("fpa") < 0, "financials"),
        F.lit("incentive_design"), F.lit("problematic_practices"), F.lit("responsiveness")), lambda v: v.isNotNull())
    return (
        x.withColumn("borders", borders).withColumn("overall", overall).withColumn("fpa_applied", applied)
        .withColumn("triggers", F.when(F.col("overall") >= 1, F.array_join(flags, ";")).otherwise(F.lit("")))
    )


# ---- five-test scorecard ----------------------------------------------------

# Illustrative weights and bands of the scorecard.
TEST_WEIGHTS = {"ceo_tsr": 0.22, "ceo_fin": 0.22, "sti_tsr": 0.14, "neo_fin": 0.24, "cap_tsr": 0.18}
YEAR_WEIGHTS_5 = (0.10, 0.15, 0.20, 0.25, 0.30)
YEAR_WEIGHTS_3 = (0.20, 0.30, 0.50)
CONCERN_BANDS = [(20.0, "Severe"), (40.0, "High"), (60.0, "Medium"), (80.0, "Low"), (None, "Negligible")]
TEST_BANDS = [(34.0, "Severe"), (50.0, "High"), (69.0, "Moderate"), (89.0, "Low"), (None, "Negligible")]
CAP_FREE_EXCESS = 1.5
STI_FLAG_PENALTY, PENALTY_CAP = 8.0, 20.0
SUPPORT_THRESHOLD = 80.0
RESPONSE_CONCERN = {"robust": "low", "limited": "elevated", "none": "high", "n/a": "high"}
FINANCIAL = ("rev_growth", "eps_growth", "ocf_growth", "roe", "roa")


def recency_average(values, weights):
    w = weights[-len(values):]
    return sum((v * k for v, k in zip(values, w)), F.lit(0.0)) / sum(w)


def _y(name, *ys):
    return [F.col(f"{name}_y{y}") for y in ys]


def gl_measures(years):
    five, three = range(1, 6), range(3, 6)
    growth = lambda n: recency_average([F.col(f"{n}_y{y}") / F.col(f"{n}_y{y - 1}") - 1.0 for y in three], YEAR_WEIGHTS_3)
    idx = [F.lit(100.0)] + _y("tsrval", *five)
    tsr = recency_average([idx[i] / idx[i - 1] - 1.0 for i in five], YEAR_WEIGHTS_5)
    cap = _y("cap", *five)
    raw = {
        "ceo": recency_average(_y("pay", *five), YEAR_WEIGHTS_5),
        "neo": recency_average([a + b for a, b in zip(_y("pay", *five), _y("neo_other_pay", *five))], YEAR_WEIGHTS_5),
        "sti": recency_average([a / b for a, b in zip(_y("sti_payout", *five), _y("sti_target", *five))], YEAR_WEIGHTS_5),
        "tsr": tsr,
        "rev_growth": growth("rev"), "eps_growth": growth("eps"), "ocf_growth": growth("ocf"),
        "roe": recency_average(_y("roe", *three), YEAR_WEIGHTS_3), "roa": recency_average(_y("roa", *three), YEAR_WEIGHTS_3),
    }
    return years.select("ticker", *[F.bround(v, 9).alias(k) for k, v in raw.items()],
                        (sum(cap[1:], cap[0]) / F.col("tsrval_y5")).alias("cap_ratio"),
                        F.bround("prior_support_pct", 1).alias("support"), "responsiveness")


def align_score(pay, perf):
    return clamp(85.0 - 1.6 * (pay - perf), 0.0, 100.0)


def concern_for_score(c):
    return band_by_upper(c, CONCERN_BANDS)


def gl_scorecard(companies_years, groups, minimum=COCITATION["minimum"]):
    """Five alignment tests, composite, concern and counterfactual reads per subject."""
    m = gl_measures(companies_years)
    own = m.select(F.col("ticker").alias("subject"), *[F.col(c).alias(f"s_{c}") for c in m.columns if c != "ticker"])
    ranked = ["ceo", "neo", "sti", "tsr", *FINANCIAL]
    j = groups.select("subject", "ticker").join(m, "ticker").join(own, "subject")
    s_cols = [c for c in own.columns if c != "subject"]
    agg = j.groupBy("subject", *s_cols).agg(
        F.count(F.lit(1)).alias("n_peers"), F.collect_list("cap_ratio").alias("_caps"),  # at most 15 values
        *[rank_in_group(F.col(c), F.col(f"s_{c}")).alias(f"{c}_p") for c in ranked],
    ).where(F.col("n_peers") >= minimum)
    caps = F.array_sort(F.array_append("_caps", F.col("s_cap_ratio")))
    n = F.size(caps)
    med = (F.element_at(caps, F.floor((n + 1) / 2).cast("int")) + F.element_at(caps, F.floor((n + 2) / 2).cast("int"))) / 2.0
    x = agg.withColumn("fin_p", sum((F.col(f"{c}_p") for c in FINANCIAL), F.lit(0.0)) / len(FINANCIAL)).withColumn("excess", F.col("s_cap_ratio") / med)
    tests = {
        "ceo_tsr": align_score(F.col("ceo_p"), F.col("tsr_p")), "ceo_fin": align_score(F.col("ceo_p"), F.col("fin_p")),
        "sti_tsr": align_score(F.col("sti_p"), F.col("tsr_p")), "neo_fin": align_score(F.col("neo_p"), F.col("fin_p")),
        "cap_tsr": F.when(F.col("excess") <= CAP_FREE_EXCESS, 90.0).otherwise(F.greatest(F.lit(0.0), 90.0 - (F.col("excess") - CAP_FREE_EXCESS) * 80.0)),
    }
    for k, v in tests.items():
        x = x.withColumn(k, v)
    quant = sum((F.col(k) * w for k, w in TEST_WEIGHTS.items()), F.lit(0.0)) / sum(TEST_WEIGHTS.values())
    flagged = (F.col("sti_p") > 60.0) & (F.col("tsr_p") < 40.0)
    x = x.withColumn("quant", quant).withColumn("penalty", F.when(flagged, min(PENALTY_CAP, STI_FLAG_PENALTY)).otherwise(0.0))
    x = x.withColumn("composite", half_even(clamp(F.col("quant") - F.col("penalty"), 0.0, 100.0), 1))
    tsr_only, fin_only = half_even("ceo_tsr", 1), half_even((F.col("ceo_fin") + F.col("neo_fin")) / 2.0, 1)
    low = F.col("s_support") < SUPPORT_THRESHOLD
    response = F.create_map(*[F.lit(v) for kv in RESPONSE_CONCERN.items() for v in kv])
    return x.select(
        "subject", "n_peers", "composite", concern_for_score("composite").alias("concern"), half_even("quant", 1).alias("quant_score"), "penalty",
        *[half_even(f"{c}_p", 1).alias(f"{c}_pctile") for c in ("ceo", "neo", "sti", "tsr", "fin")],
        half_even("excess", 2).alias("cap_excess"),
        *[half_even(k, 1).alias(f"{k}_score") for k in TEST_WEIGHTS],
        *[band_by_upper(half_even(k, 1), TEST_BANDS).alias(f"{k}_band") for k in TEST_WEIGHTS],
        tsr_only.alias("tsr_only_score"), concern_for_score(tsr_only).alias("tsr_only_concern"),
        fin_only.alias("fin_only_score"), concern_for_score(fin_only).alias("fin_only_concern"),
        F.col("s_support").alias("prior_support_pct"), low.alias("below_threshold"),
        F.when(low, F.coalesce(response[F.col("s_responsiveness")], F.lit("high"))).otherwise("none").alias("recommendation_concern"),
    )


# Expected support range by combined severity.
SUPPORT_BY_SEVERITY = {0: (90.0, 96.0), 1: (80.0, 92.0), 2: (72.0, 86.0), 3: (62.0, 78.0), 4: (52.0, 74.0)}
GL_ORDINAL = {"Negligible": 0, "Low": 0, "Medium": 1, "High": 2, "Severe": 2}


def _lookup(mapping, key):
    return F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])[key]


def advisor_reconciliation(iss, gl):
    """Verdict and agreement for subjects both screens scored."""
    j = iss.select("subject", F.col("concern").alias("iss_concern")).join(
        gl.select("subject", F.col("concern").alias("gl_concern"), F.col("composite").alias("gl_composite")), "subject")
    j = j.withColumn("i", _lookup({v: k for k, v in enumerate(LABELS)}, F.col("iss_concern"))).withColumn("g", _lookup(GL_ORDINAL, F.col("gl_concern")))
    i, g = F.col("i"), F.col("g")
    verdict = (
        F.when((i == 0) & (g == 0), "CLEAN SWEEP").when((i >= 1) & (g == 0), "ISS-ONLY FLAG").when((i == 0) & (g >= 1), "GL-ONLY FLAG")
        .when((i == 2) | (g == 2), "TWO-FRONT FIGHT").otherwise("DUAL WATCH"))
    return j.select(
        "subject", "iss_concern", "gl_concern", "gl_composite", verdict.alias("verdict"), ((i >= 1) == (g >= 1)).alias("agree"),
        _lookup({k: v[0] for k, v in SUPPORT_BY_SEVERITY.items()}, i + g).alias("support_lo"),
        _lookup({k: v[1] for k, v in SUPPORT_BY_SEVERITY.items()}, i + g).alias("support_hi"))

"""The contracts of each source, as rule sets over the shared gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewgrid.sources import contracts as c

LEVELS = ["L3", "L4", "L5", "L6", "L7"]
RATINGS = ["below", "meets", "exceeds", "outstanding"]
POTENTIAL = ["Low", "Med", "High"]


def present(col, values):
    """Non-null values outside the vocabulary."""
    return F.col(col).isNotNull() & c.not_in(col, values)


def workforce(workers, cases):
    """Impossible intervals and unknown labels, before any metric is computed."""
    w = c.violations(workers.where("worker_type = 'employee'"), "emp_id", {
        "rating_unknown": present("rating", RATINGS), "potential_unknown": present("potential", POTENTIAL)})
    return c.union(w, case_intervals(cases))


def case_intervals(cases):
    return c.violations(cases, "case_id", {
        "opened_missing": F.col("opened_at").isNull(), "resolved_before_opened": F.col("resolved_at") < F.col("opened_at")})


def merit_population(workers, bands):
    """Everyone in the cycle: labels, hours, promotion logic, and the band must be theirs."""
    emp = workers.where("worker_type = 'employee' and status <> 'terminated'")
    rules = c.violations(emp, "emp_id", {
        "status_unknown": c.not_in("status", ["active", "on_leave"]), "level_unknown": c.not_in("level", LEVELS), "rating_unknown": c.not_in("rating", RATINGS),
        "promotion_contradiction": (F.col("promoted_this_period") == "yes") & (F.col("promotion_eligible") != "yes"),
        "salary_not_positive": c.not_number("base_salary", positive=True), "hours_above_full_time": F.col("scheduled_hours") > F.col("standard_full_time_hours")})
    b = bands.select("band_id", F.col("level").alias("_l"), F.col("job_family").alias("_f"))
    j = emp.join(b, "band_id", "left")
    match = c.violations(j, "emp_id", {
        "band_unknown": F.col("_l").isNull(), "band_mismatch": F.col("_l").isNotNull() & ((F.col("_l") != F.col("level")) | (F.col("_f") != F.col("job_family")))})
    order = c.violations(bands, "band_id", {"band_order": ~((F.col("range_min") < F.col("range_mid")) & (F.col("range_mid") < F.col("range_max")))})
    return c.union(rules, match, order, c.duplicates(bands, ["band_id"], "duplicate_band"), c.duplicates(workers, ["emp_id"], "duplicate_emp"))


GRANT_GROUPS = ["ceo", "section16", "management", "staff", "director"]
AWARDS = ["rsu", "option", "psu"]


def equity_ledger(grants, workers, plans, shares, financials):
    """Keys, references, grant shape, dates after leaving, share sanity and equal spines."""
    shape = c.violations(grants, "grant_id", {
        "group_unknown": c.not_in("participant_group", GRANT_GROUPS), "award_unknown": c.not_in("award_type", AWARDS),
        "shares_not_whole": c.not_whole("shares_granted", True), "price_not_positive": c.not_number("stock_price_at_grant_usd", positive=True),
        "fv_not_positive": c.not_number("grant_date_fv_per_share_usd", positive=True), "months_not_positive": c.not_whole("vest_months_total", True),
        "cliff_after_vest": F.col("cliff_months") > F.col("vest_months_total")})
    late = grants.join(workers.where("term_date is not null").select("emp_id", "term_date"), "emp_id").where("grant_date > term_date")
    after = c.violations(late, "grant_id", {"granted_after_leaving": F.lit(True)})
    sane = c.violations(shares, "period_end", {
        "share_counts": (F.col("waso_basic") > F.col("common_shares_outstanding")) | (F.col("waso_diluted") < F.col("waso_basic")), "close_not_positive": c.not_number("close_price_usd", positive=True)})
    return c.union(
        shape, after, sane, c.duplicates(grants, ["grant_id"], "duplicate_grant"), c.unknown_refs(grants, "plan_id", plans, "plan_id", "plan_unknown"),
        c.unknown_refs(grants, "emp_id", workers, "emp_id", "holder_unknown"), c.roster_differences(shares, financials, "period_end", "spine_differs"),
        c.quarter_spine(shares, "period_end"), c.violations(financials, "period_end", {"revenue_not_positive": c.not_number("revenue_usd", positive=True)}))


def grant_terms(grants, plans):
    """Award-specific shape and the plan's active window (full ledger schema)."""
    psu, opt = F.col("award_type") == "psu", F.col("award_type") == "option"
    p = plans.select("plan_id", F.col("adoption_date").alias("_a"), F.col("expiration_date").alias("_e"))
    return c.violations(grants.join(p, "plan_id", "left"), "grant_id", {
        "psu_multiplier": psu & (F.col("psu_max_multiplier") <= 1), "multiplier_on_other": ~psu & (F.col("psu_max_multiplier") != 1),
        "psu_basis": psu & ~F.col("psu_share_basis").eqNullSafe("target"), "basis_on_other": ~psu & ~c.blank("psu_share_basis"),
        "strike_missing": opt & c.not_number("strike_price_usd", positive=True), "strike_on_other": ~opt & ~c.blank("strike_price_usd"),
        "outside_plan_window": ~F.col("grant_date").between(F.col("_a"), F.col("_e"))})


def director_labels(grants, directors):
    """A director's grant is labelled director and nobody else's is."""
    d = directors.select(F.col("director_id").alias("emp_id"), F.lit(True).alias("_d"))
    j = grants.join(d, "emp_id", "left")
    return c.violations(j, "grant_id", {"director_label": (F.col("participant_group") == "director") != F.coalesce(F.col("_d"), F.lit(False))})


def burn_benchmarks(b):
    return c.union(
        c.violations(b, "fiscal_year", {
            "note_not_illustrative": ~F.startswith(F.lower(F.trim("source_note")), F.lit("illustrative")),
            "cap_not_positive": c.not_number("vabr_benchmark_pct", positive=True), "threshold_not_whole": c.not_whole("epsc_pass_threshold", True)}),
        c.duplicates(b, ["fiscal_year"], "duplicate_year"))


# Forms a foreign private issuer reports pay on, and the archive every figure traces to.
FOREIGN_FORMS = ["20-F", "40-F", "6-K"]
ARCHIVE = "https://www.sec.gov/Archives/"
PROXY_MONEY = ["salary", "bonus", "stock_awards", "option_awards", "non_equity_incentive", "other_comp"]


def proxy_comp(p):
    """Disclosure basis, provenance and components that add up within 50."""
    peer = F.col("is_subject") == "no"
    parts = sum((F.col(m).try_cast("double") for m in PROXY_MONEY), F.lit(0.0))
    rules = {f"{m}_money": c.not_number(m, minimum=0) for m in [*PROXY_MONEY, "total"]}
    rules.update({f"{t}_blank": c.blank(t) for t in ("ticker", "company_name", "title", "fiscal_year", "role_bucket")})
    rules.update({
        "is_subject_value": c.not_in("is_subject", ["yes", "no"]), "currency_not_usd": ~F.trim("currency").eqNullSafe("USD"),
        "disclosure_unknown": peer & c.not_in("disclosure", ["def14a", "foreign_issuer_limited"]),
        "form_mismatch": peer & (((F.col("disclosure") == "def14a") & (F.col("form") != "DEF 14A")) | ((F.col("disclosure") == "foreign_issuer_limited") & c.not_in("form", FOREIGN_FORMS))),
        "source_url": peer & ~F.coalesce(F.startswith("source_url", F.lit(ARCHIVE)) & ~F.col("source_url").rlike(r"\s"), F.lit(False)),
        "extraction_date": peer & c.not_date("extraction_date"), "parts_differ_from_total": F.abs(parts - F.col("total").try_cast("double")) > 50.0})
    key = F.concat_ws("/", "ticker", "role_bucket", "title")
    return c.union(c.violations(p, key, rules), c.not_empty(p.where(peer), "no_peers"), c.not_empty(p.where(~peer), "no_subject"))


TICKER = r"^[A-Z][A-Z0-9.\-]{0,9}$"


def peer_universe(p):
    whole = {f"{f}_whole": c.not_whole(f) for f in ("revenue_usd", "market_cap_usd", "employees", "total_assets_usd")}
    anchor = {f"subject_{f}": (F.col("is_subject") == "yes") & c.not_number(f, positive=True) for f in ("revenue_usd", "market_cap_usd", "employees")}
    return c.union(
        c.violations(p, "ticker", {"ticker_shape": ~F.coalesce(F.col("ticker").rlike(TICKER), F.lit(False)), **whole, **anchor}),
        c.duplicates(p, ["ticker"], "duplicate_ticker"), c.exactly_one(p, F.col("is_subject") == "yes", "one_subject"), c.not_empty(p))


def screen_universe(companies, years):
    """Pay and performance inputs of the pay-for-performance screens."""
    pos = [f"{n}_y{y}" for n in ("pay", "tsrval", "neo_other_pay", "sti_payout", "sti_target", "cap") for y in range(1, 6)]
    pos += [f"{n}_y{y}" for n in ("eps", "rev", "ocf") for y in range(2, 6)]
    any_bad = lambda cols, f: c.F.exists(F.array(*[f(x) for x in cols]), lambda v: v)
    return c.union(
        c.violations(years, "ticker", {
            "not_positive": any_bad(pos, lambda x: c.not_number(x, positive=True)), "not_finite": any_bad([f"{n}_y{y}" for n in ("roe", "roa") for y in (3, 4, 5)], lambda x: c.not_number(x)),
            "support_range": c.outside("prior_support_pct", 0, 100), "responsiveness_unknown": c.not_in("responsiveness", ["robust", "limited", "none", "n/a"])}),
        c.roster_differences(companies, years, "ticker"), c.duplicates(companies, ["ticker"], "duplicate_ticker"), c.duplicates(years, ["ticker"], "duplicate_ticker"))


# Columns that must never reach the panel.
PROTECTED = ["gender", "sex", "race", "ethnicity", "age", "date_of_birth", "dob", "religion", "disability", "nationality", "marital_status", "pregnancy", "veteran_status", "gender_group", "ethnicity_group", "national_origin", "family_status"]
# Columns close to surveillance, kept out as well.
QUARANTINED = ["internal_app_activity", "internal_applications", "commute_change", "pto_anomaly", "overtime_trend", "work_model", "rto", "location_fine", "office_distance"]
FORBIDDEN = PROTECTED + QUARANTINED
EVENTS = ["none", "voluntary", "involuntary", "retirement"]


def panel(p, features=(), nullable=()):
    """Shape, calendar and sequence rules of a person-month panel.

    People's months are checked with grouped minima, maxima and counts instead of
    ordered windows: consecutive means max - min + 1 = distinct count."""
    rules = {"event_unknown": c.not_in("event_next", EVENTS), "month_not_month_end": ~F.coalesce(F.col("month") == F.last_day("month"), F.lit(False)), "index_negative": F.col("month_index") < 0}
    rules.update({f"{f}_number": (F.lit(False) if f not in nullable else F.col(f).isNotNull()) & c.not_number(f) if f in nullable else c.not_number(f) for f in features})
    rows = c.violations(p, F.concat_ws("@", "emp_id", "month"), rules)
    cal = p.groupBy("month").agg(F.min("month_index").alias("lo"), F.max("month_index").alias("hi"))
    split = c._row(cal.where("lo <> hi"), "index_per_month", F.col("month"))
    span = cal.agg(F.min("lo").alias("a"), F.max("hi").alias("b"), F.count(F.lit(1)).alias("n"), F.min("month").alias("m0"), F.max("month").alias("m1"))
    months = (F.year("m1") - F.year("m0")) * 12 + F.month("m1") - F.month("m0") + 1
    gap = c._row(span.where((F.col("a") != 0) | (F.col("b") - F.col("a") + 1 != F.col("n")) | (months != F.col("n"))), "months_not_consecutive", F.lit("panel"))
    terminal = F.col("event_next") != "none"
    per = p.groupBy("emp_id").agg(
        F.min("month_index").alias("a"), F.max("month_index").alias("b"), F.count(F.lit(1)).alias("n"), F.count_if(terminal).alias("t"), F.max(F.when(terminal, F.col("month_index"))).alias("tm"))
    contiguous = c._row(per.where("b - a + 1 <> n"), "person_months_gap", F.col("emp_id"))
    once = c._row(per.where("t > 1 or tm < b"), "terminal_event_last", F.col("emp_id"))
    return c.union(rows, split, gap, contiguous, once, c.duplicates(p, ["emp_id", "month"], "duplicate_person_month"))


# Charset allow-lists of the requisition feed.
REQ_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,31}$"
REQ_TEXT = r"^[A-Za-z0-9][A-Za-z0-9 .,&/()'-]{0,63}$"
REQ_PATTERNS = {"req_id": REQ_ID, **{k: REQ_TEXT for k in ("title", "department", "location", "country", "recruiter", "hiring_manager")}}
STAGES = ["Sourcing", "Screen", "Onsite", "Offer"]


def requisitions(r):
    rules = {f"{k}_text": ~F.coalesce(F.col(k).rlike(p), F.lit(False)) for k, p in REQ_PATTERNS.items()}
    rules.update({
        "stage_unknown": c.not_in("stage", STAGES), "priority_unknown": c.not_in("priority", ["P1", "P2", "P3"]), "status_unknown": c.not_in("status", ["open", "on-hold", "filled", "closed"]),
        "pipeline_not_whole": c.not_whole("pipeline"), "opened_date": c.not_date("opened_date"), "last_update": c.not_date("last_update"), "updated_before_opened": F.col("last_update") < F.col("opened_date")})
    return c.union(c.violations(r, "req_id", rules), c.duplicates(r, ["req_id"], "duplicate_req"), c.not_empty(r))


def comp_snapshot(s):
    nums = ["base_salary", "range_min", "range_mid", "range_max"]
    rules = {f"{n}_positive": c.not_whole(n, True) for n in nums}
    v = lambda n: F.col(n).try_cast("bigint")
    rules.update({"range_order": ~((v("range_min") < v("range_mid")) & (v("range_mid") < v("range_max"))), "exception_flag_value": c.not_in("exception_flag", ["yes", "no"])})
    return c.union(c.violations(s, "emp_id", rules), c.duplicates(s, ["emp_id"], "duplicate_emp"), c.not_empty(s))


def pay_equity(workers):
    emp = workers.where("worker_type = 'employee' and status in ('active', 'on_leave')")
    return c.union(c.violations(emp, "emp_id", {
        "salary_not_positive": c.not_number("base_salary", positive=True), "hours_not_positive": c.not_number("standard_full_time_hours", positive=True),
        "level_unknown": c.not_in("level", LEVELS), "rating_unknown": c.not_in("rating", RATINGS), "manager_flag": c.not_in("is_people_manager", ["yes", "no"]),
        "family_blank": c.blank("job_family"), "location_blank": c.blank("location"), "gender_label": present("gender_group", ["A", "B"]), "ethnicity_label": present("ethnicity_group", ["grp1", "grp2", "grp3"])}),
        c.duplicates(workers, ["emp_id"], "duplicate_emp"))


# Actions that may be granted, and actions that never may.
ALLOWED = ["calculate", "trend", "segment", "flag_outliers", "rank", "draft_summary", "forecast", "surface_to_human"]
DANGEROUS = ["change_salary", "recommend_pay_change", "change_pay", "change_rating", "recommend_termination", "make_hiring_decision", "terminate", "alter_record", "identify_individual_publicly"]


def metric_catalogue(m):
    """Vocabularies and conflicting action lists of a metric table with array columns."""
    clash = lambda a, b: F.size(F.array_intersect(F.col(a), F.col(b))) > 0
    return c.union(c.violations(m, "id", {
        "name_blank": c.blank("name"), "domain_blank": c.blank("domain"), "unit_blank": c.blank("unit"),
        "class_unknown": c.not_in("metric_class", ["core_kpi", "diagnostic", "operational_alert"]), "allowed_and_dangerous": F.size(F.array_intersect("allowed_actions", F.array(*[F.lit(a) for a in DANGEROUS]))) > 0,
        "allowed_and_forbidden": clash("allowed_actions", "forbidden_actions"),
        "allowed_unknown": F.size(F.array_except("allowed_actions", F.array(*[F.lit(a) for a in ALLOWED]))) > 0,
        "forbidden_unknown": F.size(F.array_except("forbidden_actions", F.array(*[F.lit(a) for a in DANGEROUS]))) > 0, "nothing_forbidden": F.size("forbidden_actions") <= 0}), c.duplicates(m, ["id"], "duplicate_metric"))


def price_coverage(companies, prices, n=30):
    """Every company has exactly n opening and n closing prices."""
    k = prices.groupBy("ticker", "period").agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("lo"))
    grid = companies.select("ticker").join(companies.sparkSession.createDataFrame([("start",), ("end",)], "period string"), how="cross")
    x = grid.join(k, ["ticker", "period"], "left")
    return c.violations(x, F.concat_ws("/", "ticker", "period"), {"prices_missing": F.col("n").isNull(), "observation_count": F.col("n") != n, "price_not_positive": F.col("lo") <= 0})


# ---- lineage records

# Forms of record ids, content hashes and time stamps.
ID = r"^[a-z0-9][a-z0-9._:@/-]{0,159}$"
HASH = r"^sha256:[0-9a-f]{64}$"


def _bad_id(col):
    return ~F.coalesce(F.col(col).rlike(ID), F.lit(False))


def _line(col, n):
    from crewgrid.functions.text import one_line

    return ~one_line(col, n)


def claims(t):
    from crewgrid.functions.text import display_matches

    n = lambda a: F.coalesce(F.size(a), F.lit(0))
    return c.violations(t, "id", {
        "id_shape": _bad_id("id"), "statement_line": _line("statement", 1000), "unit_line": _line("unit", 80), "as_of_date": c.not_date("as_of"),
        "status_unknown": c.not_in("status", ["supported", "caveated", "blocked"]), "display_differs": ~display_matches("value", "display_value"),
        "material_without_support": F.col("material") & (n("source_ids") == 0) & (n("supporting_claim_ids") == 0),
        "material_without_transformation": F.col("material") & F.col("transformation_id").isNull(), "material_without_check": F.col("material") & (n("check_ids") == 0),
        "caveated_without_caveat": (F.col("status") == "caveated") & (n("caveat_ids") == 0), "blocked_not_material": (F.col("status") == "blocked") & ~F.col("material")})


def sources(t):
    return c.violations(t, "id", {"id_shape": _bad_id("id"), "label_line": _line("label", 240), "uri_line": _line("uri", 2000), "as_of_date": c.not_date("as_of"),
                                  "hash_shape": ~F.coalesce(F.col("content_hash").rlike(HASH), F.lit(False)), "scope_unknown": c.not_in("hash_scope", ["file_bytes", "canonical_record", "source_version"])})


def checks(t):
    return c.violations(t, "id", {"id_shape": _bad_id("id"), "name_line": _line("name", 240), "details_line": _line("details", 1000), "status_unknown": c.not_in("status", ["passed", "failed", "not_run"]),
                                  "passed_without_source": (F.col("status") == "passed") & (F.coalesce(F.size("source_ids"), F.lit(0)) == 0)})


def artifacts(t):
    return c.violations(t, "id", {"id_shape": _bad_id("id"), "agent_shape": _bad_id("agent_id"), "title_line": _line("title", 240), "period_line": _line("period", 240), "as_of_date": c.not_date("as_of"),
                                  "status_unknown": c.not_in("status", ["draft", "reviewed", "approved", "published", "withdrawn"]), "hash_shape": ~F.coalesce(F.col("semantic_hash").rlike(HASH), F.lit(False))})


def transformations(t):
    return c.violations(t, "id", {"id_shape": _bad_id("id"), "name_line": _line("name", 240), "implementation_line": _line("implementation", 300)})


def assumptions(t):
    return c.violations(t, "id", {"id_shape": _bad_id("id"), "statement_line": _line("statement", 1000), "value_finite": c.not_number("value"), "unit_line": _line("unit", 80)})


def caveats(t):
    return c.violations(t, "id", {"id_shape": _bad_id("id"), "severity_unknown": c.not_in("severity", ["info", "warning", "blocking"]), "text_line": _line("text", 1000)})


# Fixed value.
STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"


def _bad_stamp(col):
    real = F.try_to_timestamp(F.col(col), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).isNotNull()
    return ~F.coalesce(F.col(col).rlike(STAMP) & real, F.lit(False))


def reviews(t):
    return c.violations(t, "id", {"id_shape": _bad_id("id"), "status_unknown": c.not_in("status", ["reviewed", "approved", "rejected"]), "stamp": _bad_stamp("reviewed_at"),
                                  "no_claims": F.coalesce(F.size("claim_ids"), F.lit(0)) == 0})


def decisions(t):
    return c.violations(t, "id", {"id_shape": _bad_id("id"), "status_unknown": c.not_in("status", ["proposed", "approved", "rejected", "deferred", "implemented"]), "stamp": _bad_stamp("decided_at"), "artifact_shape": _bad_id("artifact_id")})


def changes(t, scale="decimal(38,10)"):
    """absolute = current - prior exactly; percent at its own precision; drivers add up exactly."""
    d = lambda x: F.col(x).cast(scale)
    diff = d("current_value") - d("prior_value")
    comparable = F.col("comparability") == "comparable"
    places = F.length(F.regexp_extract(F.col("percent").cast("string"), r"\.(\d+)", 1))
    want = F.try_divide(diff, F.abs(d("prior_value"))) * 100
    off = F.abs(want - d("percent")) > F.pow(F.lit(10.0), -places).cast(scale) / 2
    total = F.aggregate("driver_effects", F.lit(0).cast(scale), lambda s, v: (s + v.cast(scale)).cast(scale))
    return c.violations(t, "claim_id", {
        "values_missing": comparable & (F.col("current_value").isNull() | F.col("prior_value").isNull()), "absolute_differs": comparable & (d("absolute") != diff),
        "percent_for_zero_prior": comparable & (d("prior_value") == 0) & F.col("percent").isNotNull(),
        "percent_differs": comparable & (d("prior_value") != 0) & F.coalesce(off, F.lit(True)),
        "drivers_differ": comparable & (F.coalesce(F.size("driver_effects"), F.lit(0)) > 0) & (total != d("absolute")),
        "not_comparable_with_values": ~comparable & (F.col("absolute").isNotNull() | F.col("percent").isNotNull())})


def bundles(b):
    """Sorted unique material ids and hash shapes of bundle entries; one agent, day and period per bundle."""
    ids = F.col("material_claim_ids")
    rows = c.violations(b, "bundle_id", {
        "hash_shape": ~(F.col("content_hash").rlike(HASH) & F.col("evidence_hash").rlike(HASH) & F.col("semantic_hash").rlike(HASH)),
        "ids_not_sorted": ids != F.array_sort(F.array_distinct(ids)), "no_material_claims": F.size(ids) == 0})
    mixed = b.groupBy("bundle_id").agg(F.count_distinct("agent_id", "as_of", "period").alias("n")).where("n > 1")
    return c.union(rows, c._row(mixed, "mixed_bundle", F.col("bundle_id")), c.duplicates(b, ["bundle_id", "artifact_id"], "duplicate_artifact"))


def authorizations(t):
    return c.violations(t, "bundle_id", {
        "bundle_shape": _bad_id("bundle_id"), "hash_shape": ~F.coalesce(F.col("bundle_hash").rlike(HASH), F.lit(False)), "claims_hash_shape": ~F.coalesce(F.col("material_claim_ids_hash").rlike(HASH), F.lit(False)),
        "artifacts_not_sorted": F.col("artifact_ids") != F.array_sort(F.array_distinct("artifact_ids")), "no_artifacts": F.size("artifact_ids") == 0})

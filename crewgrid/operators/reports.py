"""Requisition and pay-snapshot reports, and filing lists."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from crewgrid.functions.numeric import half_even, pct
from crewgrid.functions.ranking import quantiles
from crewgrid.operators.population import day

AGING_DAYS, STALE_DAYS, THIN_PIPELINE = 90, 14, 3
# Age bands in days.
AGE_BANDS = [("0-30", 0, 30), ("31-60", 31, 60), ("61-90", 61, 90), ("90+", 91, 10 ** 9)]


def requisition_flags(reqs, as_of):
    """Age, days since the last update and risk flags of open requisitions."""
    o = F.col("status") == "open"
    x = reqs.withColumns({"days_open": F.date_diff(day(as_of), "opened_date"), "days_since_update": F.date_diff(day(as_of), "last_update")})
    flags = F.array_compact(F.array(
        F.when(o & (F.col("days_open") > AGING_DAYS), F.lit("AGING")), F.when(o & (F.col("days_since_update") > STALE_DAYS), F.lit("STALE")),
        F.when(o & (F.col("priority") == "P1") & (F.col("pipeline") < THIN_PIPELINE), F.lit("THIN_PIPELINE"))))
    return x.withColumn("flags", flags)


def requisition_kpis(flagged):
    o = F.col("status") == "open"
    a = flagged.agg(
        F.count_if(o).alias("total_open"), F.count_if(F.col("status") == "on-hold").alias("on_hold"), half_even(F.avg(F.when(o, F.col("days_open")))).alias("avg_days_open"),
        F.count_if(o & (F.size("flags") > 0)).alias("at_risk"))
    m = quantiles(flagged.where(o), "pipeline", {"m": 0.5}, splits=[])  # pipeline depth is a small whole number
    return a.crossJoin(m.select(half_even("m").alias("median_pipeline")))


def requisition_mix(flagged, by):
    return flagged.where("status = 'open'").groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def requisition_age_bands(flagged):
    d = F.col("days_open")
    label = F.coalesce(*[F.when(d.between(lo, hi), F.lit(n)) for n, lo, hi in AGE_BANDS])
    return flagged.where("status = 'open'").groupBy(label.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def recruiter_scorecard(flagged):
    return flagged.where("status = 'open'").groupBy("recruiter").agg(
        F.count(F.lit(1)).alias("reqs"), F.count_if(F.size("flags") > 0).alias("at_risk"), F.sum("pipeline").alias("pipeline"), half_even(F.avg("days_open")).alias("avg_days_open"))


def watchlist(flagged):
    return flagged.where((F.col("status") == "open") & (F.col("days_since_update") > STALE_DAYS)).orderBy(F.desc("days_since_update"), "req_id")


def requisition_concentration(flagged):
    """Department with most aged requisitions and recruiter with most at-risk ones."""
    o = flagged.where("status = 'open'")
    top = lambda df, by, what: df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).agg(
        F.lit(what).alias("kind"), F.min_by(by, F.struct((-F.col("n")).alias("m"), F.col(by).alias("k"))).alias("name"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return top(o.where(F.col("days_open") > AGING_DAYS), "department", "aged").unionByName(top(o.where(F.size("flags") > 0), "recruiter", "at_risk"))


# Bands of pay over band midpoint.
COMPA_BANDS = [("<0.80", 0, 0.7999), ("0.80-0.90", 0.80, 0.8999), ("0.90-1.10", 0.90, 1.10), ("1.10-1.20", 1.1001, 1.20), (">1.20", 1.2001, float("inf"))]


def snapshot_enrich(rows):
    b, lo, hi = F.col("base_salary"), F.col("range_min"), F.col("range_max")
    x = rows.withColumns({
        "compa_ratio": half_even(b / F.col("range_mid"), 2), "range_penetration": F.when(hi > lo, half_even(100 * (b - lo) / F.when(hi > lo, hi - lo))).otherwise(0.0),
        "direction": F.when(b < lo, "below min").when(b > hi, "above max").otherwise("in band")})
    return x.withColumn("out_of_band", F.col("direction") != "in band").withColumn("unexcepted", F.col("out_of_band") & (F.col("exception_flag") == "no"))


def snapshot_kpis(x):
    a = x.agg(F.count(F.lit(1)).alias("population"), half_even(F.avg("compa_ratio"), 2).alias("avg_compa"), F.count_if("out_of_band").alias("out_of_band"),
              F.count_if(F.col("exception_flag") == "yes").alias("exceptions"), F.count_if("unexcepted").alias("unexcepted_oob"))
    return a.withColumn("out_of_band_rate", pct("out_of_band", "population"))


def snapshot_distribution(x):
    c = F.col("compa_ratio")
    label = F.coalesce(*[F.when(c.between(lo, hi), F.lit(n)) for n, lo, hi in COMPA_BANDS])
    return x.groupBy(label.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def snapshot_by_level(x):
    return x.groupBy("level").agg(F.count(F.lit(1)).alias("n"), half_even(F.avg("compa_ratio"), 2).alias("avg_compa"), F.count_if("out_of_band").alias("oob"))


# ---- filing lists already on disk

ACCESSION = r"^\d{10}-\d{2}-\d{6}$"
# Common names of filing forms.
FORM_ALIASES = {
    "PROXY": "DEF 14A", "PROXY STATEMENT": "DEF 14A", "10K": "10-K", "10Q": "10-Q", "8K": "8-K", "20F": "20-F", "40F": "40-F", "6K": "6-K", "S1": "S-1", "FORM 4": "4", "FORM 3": "3", "FORM 5": "5",
    "SCHEDULE 13D": "SC 13D", "SCHEDULE 13G": "SC 13G", "13F": "13F-HR", "13D": "SC 13D", "13G": "SC 13G", "424B1": "424B4", "424B2": "424B4", "424B3": "424B4", "424B5": "424B4", "424B": "424B4", "PROSPECTUS": "424B4",
}


def form_type(c):
    """Canonical form name with its '/A' amendment mark kept."""
    raw = F.upper(F.trim(c))
    amended = F.endswith(raw, F.lit("/A"))
    base = F.trim(F.regexp_replace(raw, r"/A$", ""))
    alias = F.create_map(*[F.lit(x) for kv in FORM_ALIASES.items() for x in kv])[base]
    return F.concat(F.coalesce(alias, base), F.when(amended, "/A").otherwise(""))


def safe_document(c, rounds=12):
    """One flat file name, or null: percent-decoding is repeated until nothing changes, then paths, blanks and leftovers are refused."""
    x = c
    for _ in range(rounds):
        x = F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)
    bad = x.rlike(r"[%/\\\s\x00-\x1f]") | F.contains(x, F.lit("..")) | (x == "")
    return F.when(~bad, x)


def filing_rows(submissions):
    """Columnar arrays (form, accession, document, date) to one row per valid filing."""
    z = submissions.select("cik", F.posexplode(F.arrays_zip("form", "accession", "document", "date")).alias("pos", "f"))
    r = z.select("cik", "pos", F.col("f.form").alias("form"), F.col("f.accession").alias("accession"), F.col("f.document").alias("document"), F.col("f.date").alias("date"))
    return r.where(F.col("accession").rlike(ACCESSION)).withColumn("document", safe_document(F.col("document"))).where("document is not null")


def latest_filing(filings, forms):
    """Newest filing per company among the forms."""
    f = filings.where(F.upper("form").isin(*[x.upper() for x in forms]))
    pick = F.struct("form", "accession", "document", "date")
    return f.groupBy("cik").agg(F.min_by(pick, F.struct((-F.unix_date(F.col("date").cast("date"))).alias("d"), "pos")).alias("p")).select("cik", "p.*")


def preferred_filing(filings):
    """DEF 14A if there is one, else the newest annual foreign form, else a 6-K."""
    tier = F.when(F.col("form") == "DEF 14A", 0).when(F.col("form").isin("20-F", "40-F"), 1).when(F.col("form") == "6-K", 2)
    pick = F.struct("form", "accession", "document", "date")
    key = F.struct(tier.alias("t"), (-F.unix_date(F.col("date").cast("date"))).alias("d"), "pos")
    return filings.where(tier.isNotNull()).groupBy("cik").agg(F.min_by(pick, key).alias("p")).select("cik", "p.*", (F.col("p.form") == "DEF 14A").alias("is_proxy"))

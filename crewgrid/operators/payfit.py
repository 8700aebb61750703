"""Pay equity: unadjusted gaps, regression-adjusted gaps and the 5 per cent screen."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window, functions as F

from crewgrid.functions.numeric import half_even, pct
from crewgrid.functions.ranking import quantiles
from crewgrid.operators import absorb
from crewgrid.operators.gram import ols, upper_sums
from crewgrid.operators.population import day

MIN_CELL = 5
EU_THRESHOLD = 5.0
LENSES = {"gender_group": True, "ethnicity_group": False}  # lens -> in scope of the 5 per cent screen
WRITTEN = 150  # labels written out as terms; controls beyond them are absorbed


def population(workers, as_of, keep=()):
    """In-scope people by status with hourly pay and tenure, and the further columns named in `keep`."""
    w = workers.where("worker_type = 'employee' and status in ('active', 'on_leave') and (gender_group is not null or ethnicity_group is not null)")
    return w.select(
        "emp_id", "gender_group", "ethnicity_group", "level", "job_family", "location", "rating", (F.col("is_people_manager") == "yes").cast("double").alias("mgr"),
        (F.date_diff(day(as_of), "hire_date") / 365.25).alias("tenure"), (F.col("base_salary") / F.col("standard_full_time_hours")).alias("hourly"), "base_salary", *keep)


def exclusions(workers):
    """Why people are outside the analysis, with counts."""
    reason = (
        F.when(F.col("worker_type") != "employee", "not_employee").when(~F.col("status").isin("active", "on_leave"), "not_employed_status")
        .when(F.col("gender_group").isNull() & F.col("ethnicity_group").isNull(), "missing_all_protected_class"))
    return workers.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def group_stats(pop, keys):
    """n, mean and exact median of hourly pay per key."""
    mean = pop.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("hourly").alias("mean_hourly"))
    med = quantiles(pop, "hourly", {"median_hourly": 0.5}, keys).drop("n_obs")
    return mean.join(med, keys)


def unadjusted(pop, key, min_cell=MIN_CELL):
    """Gaps against the best-paid group that is itself large enough; small groups show nothing."""
    g = group_stats(pop.where(F.col(key).isNotNull()), [key])
    ok = F.col("n") >= min_cell
    w = Window.partitionBy(F.lit(0))  # one row per group label
    best = F.max(F.when(ok, F.struct("mean_hourly", "median_hourly", F.col(key).alias("g")))).over(w)
    x = g.withColumn("_r", best)
    show = ok & F.col("_r").isNotNull()
    gap = lambda a: F.when(show, half_even((1.0 - F.col(a) / F.col(f"_r.{a}")) * 100.0, 6))
    return x.select(
        F.col(key).alias("grp"), "n", (~show).alias("suppressed"), F.when(show, half_even("mean_hourly", 6)).alias("mean_hourly"), F.when(show, half_even("median_hourly", 6)).alias("median_hourly"),
        gap("mean_hourly").alias("mean_gap_pct"), gap("median_hourly").alias("median_gap_pct"), F.coalesce(F.col(key) == F.col("_r.g"), F.lit(False)).alias("is_reference"))


def eu_screen(pop, key, threshold=EU_THRESHOLD, min_cell=MIN_CELL):
    """Per level: gap between the best and least paid groups on mean and median pay."""
    p = pop.where(F.col(key).isNotNull())
    s = group_stats(p, ["level", key])
    ok = F.col("n") >= min_cell
    pick = lambda f, a: f(F.when(ok, F.struct(F.col(a).alias("v"), F.col(key).alias("g"))))
    a = s.groupBy("level").agg(
        F.sum("n").alias("n"), F.count_if(ok).alias("k"), F.max(~ok).alias("small"), pick(F.max, "mean_hourly").alias("hm"), pick(F.min, "mean_hourly").alias("lm"),
        pick(F.max, "median_hourly").alias("hd"), pick(F.min, "median_hourly").alias("ld"))
    can = F.col("k") >= 2
    mean, med = (1.0 - F.col("lm.v") / F.col("hm.v")) * 100.0, (1.0 - F.col("ld.v") / F.col("hd.v")) * 100.0
    return a.select(
        "level", "n", can.alias("assessable"), "small", F.when(can, F.col("hm.g")).alias("advantaged"), F.when(can, F.col("lm.g")).alias("disadvantaged"),
        F.when(can, half_even(mean, 6)).alias("mean_gap_pct"), F.when(can, half_even(med, 6)).alias("median_gap_pct"),
        F.coalesce(can & (mean >= threshold), F.lit(False)).alias("exceeds"), F.coalesce(can & (mean < threshold) & (med >= threshold), F.lit(False)).alias("median_watch"))


def eu_headline(screen):
    return screen.agg(F.count(F.lit(1)).alias("categories"), F.count_if("exceeds").alias("flagged"), F.count_if("median_watch").alias("median_watch"), (F.count_if("exceeds") > 0).alias("joint_assessment"))


def _controls(df, cols, least=1):
    """({control: sorted labels that at least `least` people have}, [controls with too many labels to write out]).

    The controls with most labels are absorbed until the others have WRITTEN labels together, so the labels that
    reach the driver have a fixed bound and no control is refused."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])).alias("x")).select("x.c", "x.v").where("v is not null")
    k = pairs.groupBy("c", "v").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least)
    size = {c: 0 for c in cols} | {r["c"]: r["n"] for r in k.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    big = []
    while sum(n for c, n in size.items() if c not in big) > WRITTEN:
        big.append(max((c for c in cols if c not in big), key=lambda c: size[c]))
    rows = k.where(~F.col("c").isin(big)).collect() if big else k.collect()
    return {c: sorted(r["v"] for r in rows if r["c"] == c) for c in cols if c not in big}, big


def fit_controls(pop, target, focal, written, absorbed, numeric, least=1):
    """`fit` where all labels are written out, else `absorb.fit`: the same terms, coefficients and errors but for the intercept."""
    if not absorbed:
        return fit(pop, target, {**focal, **written}, numeric)
    return absorb.fit(pop, target, absorbed, {**focal, **written}, numeric, least)


def fit(pop, target, dummies, numeric):
    """OLS of ln(target) on an intercept, 0/1 columns and numeric columns.

    dummies: {column: [labels that get a term]}.  People are first reduced to one
    row per combination of the dummy columns and whole numeric part sums, so the
    part that grows is a plain hash aggregate; numpy sees combinations only."""
    factor = list(dummies)
    terms = ["intercept"] + [f"{c}={v}" for c in factor for v in dummies[c]] + list(numeric)
    q = len(numeric)
    y = F.ln(F.col(target).cast("double"))
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(y).alias("y"), F.sum(y * y).alias("yy")]
    for i, a in enumerate(numeric):
        aggs += [F.sum(a).alias(f"x{i}"), F.sum(F.col(a) * y).alias(f"x{i}y")]
        aggs += [F.sum(F.col(a) * F.col(b)).alias(f"x{i}x{j}") for j, b in enumerate(numeric) if j >= i]
    cells = pop.groupBy(*factor).agg(*aggs)
    labels = {c: list(v) for c, v in dummies.items()}
    p = len(terms)

    def block(pdf):
        d = [np.ones(len(pdf))]
        for c in factor:
            d += [(pdf[c] == v).to_numpy(float) for v in labels[c]]
        d = np.column_stack(d)
        k = d.shape[1]
        n = pdf["n"].to_numpy(float)
        m = np.zeros((p + 1, p + 1))
        m[:k, :k] = (d * n[:, None]).T @ d
        for i in range(q):
            m[:k, k + i] = d.T @ pdf[f"x{i}"].to_numpy(float)
            for j in range(i, q):
                m[k + i, k + j] = pdf[f"x{i}x{j}"].sum()
            m[k + i, p] = pdf[f"x{i}y"].sum()
        m[:k, p] = d.T @ pdf["y"].to_numpy(float)
        m[p, p] = pdf["yy"].sum()
        return np.triu(m)

    m = upper_sums(cells, block, p + 1)
    n, ys = m[0, 0], m[0, p]
    beta, se, r2 = ols(m[:p, :p], m[:p, p], m[p, p], ys, n)
    return {"terms": terms, "beta": beta, "se": se, "n": int(round(n)), "r2": r2}


CONTROLS = ["level", "job_family", "location", "rating"]


def adjusted(pop, key, reference, groups, z=1.96, controls=CONTROLS, numeric=("mgr", "tenure")):
    """Like-for-like gap per group against the reference group, with its interval.  Controls may have any number of labels."""
    p = pop.where(F.col(key).isin(reference, *groups))
    have, big = _controls(p, list(controls))
    order = {"rating": ["below", "meets", "exceeds", "outstanding"]}
    written = {c: [v for v in order.get(c, have[c]) if v in have[c]][1:] for c in have}
    return _gaps(pop.sparkSession, fit_controls(p, "hourly", {key: list(groups)}, written, big, list(numeric)), key, reference, groups, z)


def absorbed_gap(pop, key, reference, groups, controls, numeric, z=1.96):
    """`adjusted` with every control absorbed, however few labels it has."""
    p = pop.where(F.col(key).isin(reference, *groups))
    return _gaps(pop.sparkSession, absorb.fit(p, "hourly", list(controls), {key: list(groups)}, list(numeric)), key, reference, groups, z)


def _gaps(spark, f, key, reference, groups, z):
    out = []
    for g in groups:
        i = f["terms"].index(f"{key}={g}")
        b, s = float(f["beta"][i]), float(f["se"][i])
        lo, hi = sorted(((1 - math.exp(b + z * s)) * 100, (1 - math.exp(b - z * s)) * 100))
        out.append((g, reference, round(b, 6), round(s, 6), round((1 - math.exp(b)) * 100, 6), round(lo, 6), round(hi, 6), bool(b + z * s < 0 or b - z * s > 0), f["n"], round(f["r2"], 6)))
    return spark.createDataFrame(out, "grp string, reference string, coef double, se double, adjusted_gap_pct double, ci_lo double, ci_hi double, significant boolean, n long, r2 double")


def report(workers, as_of, key="gender_group"):
    """Unadjusted and adjusted gaps side by side for one lens."""
    pop = population(workers, as_of)
    un = unadjusted(pop, key)
    rows = un.collect()  # one row per group label of the lens
    ref = [r["grp"] for r in rows if r["is_reference"]]
    rest = sorted(r["grp"] for r in rows if not r["suppressed"] and not r["is_reference"])
    if not ref or not rest:
        return un.withColumns({"adjusted_gap_pct": F.lit(None).cast("double"), "significant": F.lit(None).cast("boolean")})
    adj = adjusted(pop, key, ref[0], rest).select("grp", "adjusted_gap_pct", "ci_lo", "ci_hi", "significant")
    return un.join(adj, "grp", "left")


def report_violations(un, adj, screen, threshold=EU_THRESHOLD):
    """Suppressed groups show no number, intervals bracket the estimate, flags follow the threshold."""
    row = lambda df, rule, key: df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"))
    return (
        row(un.where("suppressed and (mean_gap_pct is not null or median_hourly is not null)"), "suppressed_shows_number", F.col("grp"))
        .unionByName(row(un.where("suppressed and is_reference"), "suppressed_reference", F.col("grp")))
        .unionByName(row(adj.where("not (adjusted_gap_pct between ci_lo and ci_hi) or r2 not between 0 and 1"), "interval_brackets", F.col("grp")))
        .unionByName(row(screen.where(F.col("exceeds") != F.coalesce(F.col("assessable") & (F.col("mean_gap_pct") >= threshold), F.lit(False))), "flag_follows_threshold", F.col("level"))))


def adjusted_pay_gap(wf, min_people=30, min_side=10):
    """Gender and ethnicity contrasts on ln(base salary) with level, family, site and tenure held fixed.
    Negative means the focal group is paid less."""
    pop = wf.active.where("base_salary > 0 and gender_group is not null and ethnicity_group is not null").select(
        "level", "job_family", "location", "base_salary", F.coalesce(F.date_diff(day(wf.as_of), "hire_date") / 365.25, F.lit(0.0)).alias("tenure"),
        F.when(F.col("gender_group") == "B", "1").otherwise("0").alias("gender"), F.when(F.col("ethnicity_group").isin("grp2", "grp3"), "1").otherwise("0").alias("ethnicity"))
    schema = "contrast string, adj double, ci_lo double, ci_hi double, raw double, significant boolean, n long, r2 double"
    spark = pop.sparkSession
    n = pop.count()
    out = []
    if n >= min_people:
        have, big = _controls(pop, ["level", "job_family", "location"], least=2)
        cats = {c: v[1:] for c, v in have.items()}
        for key in ("gender", "ethnicity"):
            side = {r[key]: r for r in pop.groupBy(key).agg(F.count(F.lit(1)).alias("k"), F.avg(F.ln(F.col("base_salary").cast("double"))).alias("m")).collect()}
            k1 = side["1"]["k"] if "1" in side else 0
            if not min_side <= k1 <= n - min_side:
                continue
            f = fit_controls(pop, "base_salary", {key: ["1"]}, cats, big, ["tenure"], least=2)
            i = f["terms"].index(f"{key}=1")
            b, s = float(f["beta"][i]), float(f["se"][i])
            g = lambda v: round(100 * (math.exp(v) - 1), 1)
            out.append((key, g(b), g(b - 1.96 * s), g(b + 1.96 * s), g(side["1"]["m"] - side["0"]["m"]), bool(b - 1.96 * s > 0 or b + 1.96 * s < 0), f["n"], round(f["r2"], 3)))
    return spark.createDataFrame(out, schema)

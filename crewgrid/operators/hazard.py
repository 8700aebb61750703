"""Discrete-time exit hazard: design, fit, calibration, evaluation and segment reconciliation."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Window, functions as F

from crewgrid.functions.numeric import half_even, sigmoid
from crewgrid.functions.ranking import ordered_positions, quantiles, running_totals, split_points, value_ranks
from crewgrid.operators.gram import solve, upper_sums
from crewgrid.session import stored

TRAIN_END, CALIBRATION_END = 23, 29
L2, STEPS = 1.0, 15
MISSING = "__missing"
SEGMENT_FLOOR, REID_CUTOFF, RECONCILE_GAP = 30, 10, 0.02


@dataclass
class HazardModel:
    features: list
    intercept: float
    coef: dict
    mean: dict
    std: dict
    pos_weight: float = 1.0
    l2: float = L2
    platt: tuple = None
    bands: dict = field(default_factory=dict)

    def check(self):
        for f in self.features:
            if not (math.isfinite(self.coef[f]) and math.isfinite(self.mean[f]) and self.std[f] > 0):
                raise ValueError(f"model term {f} is not usable")
        if self.l2 < 0 or not math.isfinite(self.intercept):
            raise ValueError("model intercept or penalty is not usable")
        return self


def design(panel, features, nullable=()):
    """Row-local design: nulls become 0 plus an indicator; y is a voluntary exit next month."""
    cols = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]
    flags = [F.col(f).isNull().cast("double").alias(f + MISSING) for f in sorted(nullable)]
    other = [c for c in panel.columns if c not in features]
    part = F.when(F.col("month_index") <= TRAIN_END, "train").when(F.col("month_index") <= CALIBRATION_END, "calibration").otherwise("test")
    d = panel.select(*other, *cols, *flags, (F.col("event_next") == "voluntary").cast("int").alias("y"), part.alias("part"))
    return d, list(features) + [f + MISSING for f in sorted(nullable)]


def standardiser(train, features):
    """Train mean and population deviation; a flat feature keeps scale 1."""
    aggs = [a for f in features for a in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]
    r = train.agg(*aggs).first()
    mean = {f: float(r[f"m_{f}"]) for f in features}
    std = {f: (float(r[f"s_{f}"]) if r[f"s_{f}"] > 1e-9 else 1.0) for f in features}
    return mean, std


def _newton_block(features, mean, std, beta, pos_w, meat=False):
    mu, sd = np.array([mean[f] for f in features]), np.array([std[f] for f in features])
    p = len(features) + 1

    def block(pdf):
        x = np.column_stack([np.ones(len(pdf)), (pdf[features].to_numpy(float) - mu) / sd])
        y = pdf["y"].to_numpy(float)
        w = np.where(y == 1.0, pos_w, 1.0)
        pr = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -60, 60)))
        r = w * (y - pr)
        m = np.zeros((p + 1, p + 1))
        scale = r * r if meat else w * pr * (1 - pr)
        m[:p, :p] = (x * scale[:, None]).T @ x
        m[:p, p] = r @ x
        return np.triu(m)

    return block


def fit(designed, features, l2=L2, steps=STEPS):
    """Class-weighted ridge logistic by a fixed number of Newton steps on the train months.

    A step is one aggregate over the train rows; the driver holds one small matrix.
    Standardising happens inside the tasks, so the stored rows are reused unchanged."""
    train = designed.where("part = 'train'").select("y", *features).persist()
    try:
        mean, std = standardiser(train, features)
        c = train.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k")).first()
        if not 0 < (c["k"] or 0) < c["n"]:
            raise ValueError("the train months hold a single class")
        pos_w = (c["n"] - c["k"]) / c["k"]
        p = len(features) + 1
        beta, last = np.zeros(p), math.inf
        ridge = np.diag([0.0] + [l2] * (p - 1))
        for _ in range(steps):
            m = upper_sums(train, _newton_block(features, mean, std, beta, pos_w), p + 1)
            step = solve(m[:p, :p] + ridge, m[:p, p] - ridge @ beta, 1e-14)
            beta, last = beta + step, float(np.max(np.abs(step)))
        if not np.all(np.isfinite(beta)) or last > 1e-3:
            raise ValueError(f"the fit did not settle (last step {last:.2e})")
    finally:
        train.unpersist()
    return HazardModel(list(features), float(beta[0]), {f: float(b) for f, b in zip(features, beta[1:])}, mean, std, pos_w, l2).check()


def logit(model):
    """Intercept plus coefficient times standardised value, as one column expression."""
    parts = [F.lit(model.coef[f]) * ((F.col(f) - F.lit(model.mean[f])) / F.lit(model.std[f])) for f in model.features]
    return sum(parts, F.lit(model.intercept))


def calibrated(model):
    a, b = model.platt
    return sigmoid(F.lit(a) * logit(model) + F.lit(b))


def platt(model, designed, steps=60):
    """Two-parameter Newton on the calibration months: five sums per step."""
    cal = designed.where("part = 'calibration'").select("y", logit(model).alias("l")).persist()
    try:
        n = cal.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k")).first()
        if not 0 < (n["k"] or 0) < n["n"]:
            raise ValueError("the calibration months hold a single class")
        a, b = 1.0, 0.0
        for _ in range(steps):
            p = sigmoid(F.lit(a) * F.col("l") + F.lit(b))
            s, r = p * (1 - p), F.col("y") - p
            v = cal.agg(F.sum(r * F.col("l")).alias("g0"), F.sum(r).alias("g1"), F.sum(s * F.col("l") * F.col("l")).alias("h00"), F.sum(s * F.col("l")).alias("h01"), F.sum(s).alias("h11")).first()
            det = v["h00"] * v["h11"] - v["h01"] ** 2
            if abs(det) < 1e-12:
                raise ValueError("calibration scores do not vary")
            da, db = (v["h11"] * v["g0"] - v["h01"] * v["g1"]) / det, (-v["h01"] * v["g0"] + v["h00"] * v["g1"]) / det
            a, b = a + da, b + db
            if abs(da) < 1e-10 and abs(db) < 1e-10:
                break
    finally:
        cal.unpersist()
    return a, b


def train(panel, features, nullable=()):
    """Design, fit and calibrate.  The design is stored once; the fit, its calibration and whatever follows read it from there."""
    d, names = design(panel, features, nullable)
    d = stored(d)
    m = fit(d, names)
    m.platt = platt(m, d)
    return m, d


# ---- evaluation; scored: columns score, y, and where needed p, month_index, row_id, emp_id


def _by_score(scored, score="score"):
    return scored.groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))


def ranking_quality(scored, score="score"):
    """ROC-AUC with tied ranks averaged and average precision by score blocks, from one running total over distinct scores."""
    r = running_totals(_by_score(scored, score), [], score, ["n", "pos"], split_points(scored, score))
    tp, rank = F.col("total_pos") - F.col("below_pos"), F.col("total_n") - F.col("below_n")
    a = r.agg(
        F.sum(F.col("pos") * (F.col("below_n") + (F.col("n") + 1) / 2.0)).alias("rs"), F.sum(F.when(F.col("pos") > 0, F.col("pos") * (tp / rank))).alias("ap"),
        F.max("total_pos").alias("p"), F.max("total_n").alias("t"))
    p, t = F.col("p"), F.col("t")
    return a.select((((F.col("rs") - p * (p + 1) / 2.0)) / (p * (t - p))).alias("roc_auc"), (F.col("ap") / p).alias("pr_auc"), (p / t).alias("base_rate"), t.alias("n_rows"))


def precision_at_top(scored, share=0.10, min_denominator=50):
    """Hits among the top share of each month by (score, row), pooled over months."""
    x = ordered_positions(scored.select("month_index", "row_id", "y", (-F.col("score")).alias("neg")), "neg", "row_id", ["month_index"])
    k = F.greatest(F.lit(1), F.floor(F.col("pos_total") * share))
    a = x.where(F.col("pos") < k).agg(F.count(F.lit(1)).alias("n_flagged"), F.sum("y").alias("hits"))
    ok = F.col("n_flagged") >= min_denominator
    return a.select("n_flagged", "hits", F.when(ok, F.col("hits") / F.col("n_flagged")).alias("precision"), F.when(ok, "ok").otherwise("insufficient_denominator").alias("status"))


def brier(scored, p="p"):
    return scored.agg(F.avg(F.pow(F.col(p) - F.col("y"), 2)).alias("brier"), F.count(F.lit(1)).alias("n"))


def outcomes(scored):
    """Per person: highest risk, last observed month, and whether that month ends in the event."""
    return scored.groupBy("emp_id").agg(F.max("p").alias("risk"), F.max("month_index").alias("term_month"), F.max_by(F.col("event_next") == "voluntary", "month_index").alias("is_event"))


def concordance(people):
    """Harrell's C with competing exits censored, by counting instead of pairing.

    Each person stands in the later population of every earlier month (at most the
    number of months), and equal risks are merged before the running total."""
    months = people.select("term_month").distinct()
    later = people.withColumnRenamed("term_month", "_t").join(F.broadcast(months), F.col("_t") > F.col("term_month")).select("term_month", "risk", F.lit(1).alias("later"), F.lit(0).alias("ev"))
    events = people.where("is_event").select("term_month", "risk", F.lit(0).alias("later"), F.lit(1).alias("ev"))
    g = later.unionByName(events).groupBy("term_month", "risk").agg(F.sum("later").alias("later"), F.sum("ev").alias("ev"))
    r = running_totals(g, ["term_month"], "risk", ["later"], split_points(people, "risk"))
    a = r.agg(F.sum(F.col("ev") * (F.col("below_later") + F.col("later") / 2.0)).alias("conc"), F.sum(F.col("ev") * F.col("total_later")).alias("comp"))
    return a.select((F.col("conc") / F.when(F.col("comp") > 0, F.col("comp"))).alias("concordance"), F.col("comp").cast("bigint").alias("comparable_pairs"))


def reliability(scored, bins=10):
    """Equal-count bins by predicted probability: mean prediction against observed share."""
    x = ordered_positions(scored.select("p", "row_id", "y"), "p", "row_id")
    b = F.expr(f"cast((pos * {bins} + {bins - 1}) div pos_total as int)")
    g = x.groupBy((b + 1).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mp"), F.avg("y").alias("of"))
    return g.select("bin", "n", half_even("mp", 6).alias("mean_pred"), half_even("of", 6).alias("obs_freq"), half_even(F.col("mp") - F.col("of"), 6).alias("gap"))


def expected_calibration_error(rel):
    return rel.agg(half_even(F.sum(F.col("n") * F.abs(F.col("mean_pred") - F.col("obs_freq"))) / F.sum("n"), 6).alias("ece"))


def risk_bands(scored, elevated=0.85, high=0.97):
    """Nearest-rank cut-offs of the calibration months."""
    return quantiles(scored, "p", {"elevated": elevated, "high": high}, method="nearest")


def tier_counts(scored, bands):
    t = F.when(F.col("p") >= F.col("high"), "high").when(F.col("p") >= F.col("elevated"), "elevated").otherwise("low")
    return scored.crossJoin(F.broadcast(bands.select("elevated", "high"))).groupBy(t.alias("tier")).agg(F.count(F.lit(1)).alias("person_months"))


def _exit_curve(df, keys, horizon):
    """Model and observed exit probability over the first `horizon` months of each key.
    Months are averaged first; a key then has at most one row per month."""
    return _curve(df.groupBy(*keys, "month_index").agg(F.avg("p").alias("h"), F.avg("y").alias("r"), F.count(F.lit(1)).alias("n")), keys, horizon)


def _curve(m, keys, horizon):
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    m = m.withColumn("k", F.row_number().over(over.orderBy("month_index")))
    first = F.col("k") <= horizon
    return m.groupBy(*keys).agg(
        (1 - F.product(F.when(first, 1 - F.col("h")))).alias("bu"), (1 - F.product(F.when(first, 1 - F.col("r")))).alias("td"),
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("months_observed"))


def segment_risk(scored, dims, horizon=6, floor=SEGMENT_FLOOR):
    """Bottom-up and top-down exit risk per segment; small segments show a size band only."""
    if floor < SEGMENT_FLOOR or horizon < 1:
        raise ValueError("the privacy floor can only be raised and the horizon must be positive")
    long = scored.select("emp_id", "month_index", "p", "y", F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])).alias("s")).select(
        "emp_id", "month_index", "p", "y", "s.dim", "s.value")
    people = long.groupBy("dim", "value", "emp_id").agg(F.lit(1).alias("one")).groupBy("dim", "value").agg(F.count("one").alias("n_emp"))
    return _shown(_exit_curve(long, ["dim", "value"], horizon).join(people, ["dim", "value"]), horizon, floor)


def _shown(c, horizon, floor):
    """The figures of segments of at least `floor` people; of the others only a size band."""
    small = F.col("n_emp") < floor
    show = lambda e: F.when(~small, e)
    bu, td = half_even("bu", 6), half_even("td", 6)
    band = F.when(small, F.when(F.col("n_emp") < REID_CUTOFF, f"<{REID_CUTOFF}").otherwise(f"{REID_CUTOFF}-{floor - 1}"))
    gap = half_even(bu - td, 6)
    return c.select(
        "dim", "value", small.alias("suppressed"), band.alias("size_band"), show(F.col("n_emp")).alias("n_employees"), show(F.col("n_rows")).alias("n_rows"), show(bu).alias("bottom_up"), show(td).alias("top_down"),
        show(gap).alias("gap"), show(F.abs(gap) > RECONCILE_GAP).alias("gap_flagged"), show(F.col("months_observed") < horizon).alias("incomplete_window"))


def combined_segment_risk(scored, dims, depth=2, horizon=6, floor=SEGMENT_FLOOR):
    """`segment_risk` over every combination of one to `depth` dimensions, from one grouping-sets pass.

    People and months are first reduced to one row per combination of all dimensions, so the sets expand cells, not
    rows.  A segment with a missing label is one of its own, told from a dimension left out by `grouping`."""
    if floor < SEGMENT_FLOOR or horizon < 1 or not 1 <= depth <= len(dims):
        raise ValueError("the privacy floor can only be raised, the horizon must be positive and the depth within the dimensions")
    sets = [list(c) for k in range(1, depth + 1) for c in itertools.combinations(dims, k)]
    x = scored.select("emp_id", "month_index", "p", "y", *[F.col(d).cast("string").alias(d) for d in dims])
    out = [F.grouping(d).alias(f"_{d}") for d in dims]
    key = [*dims, *[f"_{d}" for d in dims]]

    def over(cells, extra, *aggs):
        return cells.groupingSets([[F.col(c) for c in [*s, extra]] for s in sets], *[F.col(c) for c in [*dims, extra]]).agg(*out, *aggs)

    cells = x.groupBy(*dims, "month_index").agg(F.sum("p").alias("p"), F.sum("y").cast("double").alias("y"), F.count(F.lit(1)).alias("n"))
    months = over(cells, "month_index", (F.sum("p") / F.sum("n")).alias("h"), (F.sum("y") / F.sum("n")).alias("r"), F.sum("n").alias("n"))
    people = over(x.select("emp_id", *dims).distinct(), "emp_id", F.lit(1).alias("one"))
    label = F.concat_ws(" & ", *[F.when(F.col(f"_{d}") == 0, F.concat(F.lit(f"{d}="), F.coalesce(F.col(d), F.lit("(none)")))) for d in dims])
    names = F.concat_ws(" & ", *[F.when(F.col(f"_{d}") == 0, F.lit(d)) for d in dims])
    named = lambda df: df.withColumns({"dim": names, "value": label}).drop(*key)
    c = _curve(named(months), ["dim", "value"], horizon).join(named(people).groupBy("dim", "value").agg(F.count("one").alias("n_emp")), ["dim", "value"])
    return _shown(c, horizon, floor)


def extreme_segments(segments):
    """The riskiest, the least risky and the worst reconciled of the segments that may be shown: (dim, which, segment,
    n_employees, bottom_up, gap) for every dimension set, and for all together ("all").  Ties go by name."""
    row = F.struct("value", "n_employees", "bottom_up", "gap")
    pick = lambda by, which: F.min_by(row, F.struct(by.alias("by"), F.col("dim").alias("d"), F.col("value").alias("v"))).alias(which)
    g = segments.where("not suppressed").rollup("dim").agg(F.grouping("dim").alias("_all"), pick(-F.col("bottom_up"), "highest"), pick(F.col("bottom_up"), "lowest"), pick(-F.abs("gap"), "widest_gap"))
    ends = F.explode(F.array(*[F.struct(F.lit(w).alias("which"), F.col(w).alias("s")) for w in ("highest", "lowest", "widest_gap")]))
    x = g.select(F.when(F.col("_all") == 1, "all").otherwise(F.col("dim")).alias("dim"), ends.alias("e")).where("e.s is not null")
    return x.select("dim", "e.which", F.col("e.s.value").alias("segment"), "e.s.n_employees", "e.s.bottom_up", "e.s.gap")


def reconciliation(segments):
    shown = ~F.col("suppressed")
    return segments.agg(F.count_if(shown).alias("n_segments"), F.count_if("suppressed").alias("n_suppressed"), F.count_if(F.col("gap_flagged")).alias("n_flagged"), F.coalesce(F.max(F.abs("gap")), F.lit(0.0)).alias("max_abs_gap"))


def company_risk(scored, horizon=6):
    people = scored.groupBy("emp_id").agg(F.lit(1).alias("one")).agg(F.count("one").alias("n_employees"))
    bu, td = half_even("bu", 6), half_even("td", 6)
    return _exit_curve(scored, [], horizon).crossJoin(people).select(bu.alias("bottom_up"), td.alias("top_down"), half_even(bu - td, 6).alias("gap"), "n_employees", "n_rows", "months_observed")


def company_survival(scored, max_h=12):
    """Observed monthly hazards, then their mean carried forward; one row per month ahead."""
    m = scored.groupBy("month_index").agg(F.avg("p").alias("h"))
    one = m.agg(F.transform(F.array_sort(F.collect_list(F.struct("month_index", "h"))), lambda s: s["h"]).alias("o"), F.avg("h").alias("mean"))  # one entry per test month
    path = one.select(F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(max_h)), lambda t: F.coalesce(F.try_element_at("o", t), F.col("mean")))).alias("i", "h"), F.size("o").alias("months_observed"))
    w = Window.partitionBy(F.lit(0)).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # max_h rows
    s = F.product(1 - F.col("h")).over(w)
    return path.select((F.col("i") + 1).alias("month_ahead"), half_even(s, 6).alias("survival"), half_even(1 - s, 6).alias("p_exit"), (F.col("i") < F.col("months_observed")).alias("observed"))


def median_time_to_exit(survival):
    """First month with survival under one half; null when it is not reached."""
    return survival.agg(F.min(F.when(F.col("survival") < 0.5, F.col("month_ahead"))).alias("median_months"))


def horizon_probability(hazards, h):
    """1 - product of (1 - hazard) over the first h entries of an array column; too short or out of range is an error."""
    part = F.slice(hazards, 1, h)
    bad = (F.size(hazards) < h) | F.exists(part, lambda v: (v < 0) | (v > 1) | F.isnan(v))
    return F.when(bad, F.raise_error(F.lit("hazards too short or outside [0, 1]"))).otherwise(1 - F.aggregate(part, F.lit(1.0), lambda s, v: s * (1 - v)))


def top_contributions(model, top=5):
    """Largest absolute contributions to the log-odds of a row, as an array of (feature, contribution)."""
    items = F.array(*[F.struct((-F.abs(F.lit(model.coef[f]) * (F.col(f) - model.mean[f]) / model.std[f])).alias("k"), F.lit(f).alias("feature"),
                               (F.lit(model.coef[f]) * (F.col(f) - model.mean[f]) / model.std[f]).alias("contribution")) for f in model.features])
    return F.transform(F.slice(F.array_sort(items), 1, top), lambda s: F.struct(s["feature"].alias("feature"), s["contribution"].alias("contribution")))


def coefficient_intervals(model, designed, z=1.96):
    """Robust (sandwich) standard errors at the fitted coefficients, from two aggregates."""
    tr = designed.where("part = 'train'").select("y", *model.features)
    beta = np.array([model.intercept] + [model.coef[f] for f in model.features])
    p = len(beta)
    h = upper_sums(tr, _newton_block(model.features, model.mean, model.std, beta, model.pos_weight), p + 1)[:p, :p] + np.diag([0.0] + [model.l2] * (p - 1))
    meat = upper_sums(tr, _newton_block(model.features, model.mean, model.std, beta, model.pos_weight, meat=True), p + 1)[:p, :p]
    inv = solve(h, np.eye(p), 1e-14)
    se = np.sqrt(np.diag(inv @ meat @ inv))
    rows = [(f, float(round(b, 8)), float(round(s, 8)), float(round(b - z * s, 8)), float(round(b + z * s, 8)), bool(b - z * s > 0 or b + z * s < 0)) for f, b, s in zip(model.features, beta[1:], se[1:])]
    return designed.sparkSession.createDataFrame(rows, "feature string, coef double, se double, ci_lo double, ci_hi double, excludes_zero boolean")


def importance(spark, model, decoys=()):
    """Features by absolute coefficient, decoys marked."""
    ordered = sorted(model.coef.items(), key=lambda kv: -abs(kv[1]))
    return spark.createDataFrame([(i + 1, f, float(c), f in decoys) for i, (f, c) in enumerate(ordered)], "rank int, feature string, coef double, is_decoy boolean")


def realism_problems(model, quality, precision, decoys=(), auc_max=0.90, pr_max=0.60):
    """Results too good to be true, and decoys among the three strongest features."""
    out = []
    if quality["roc_auc"] > auc_max:
        out.append("roc_auc")
    if quality["pr_auc"] > pr_max:
        out.append("pr_auc")
    if precision["status"] == "ok" and precision["precision"] == 1.0:
        out.append("precision_at_top")
    top = {f for f, _ in sorted(model.coef.items(), key=lambda kv: -abs(kv[1]))[:3]}
    return out + sorted(f"decoy:{d}" for d in top & set(decoys))


def manifest(model, panel_hash):
    """Rounded artifact for storage."""
    r = lambda v: round(float(v), 8)
    return {"features": model.features, "intercept": r(model.intercept), "coef": {k: r(v) for k, v in model.coef.items()}, "mean": {k: r(v) for k, v in model.mean.items()},
            "std": {k: r(v) for k, v in model.std.items()}, "pos_weight": r(model.pos_weight), "l2": model.l2, "platt": [r(v) for v in model.platt], "panel_hash": panel_hash}


def from_manifest(m, panel_hash=None):
    """Rebuild a model from its artifact; the panel must be the one it was fitted on."""
    if panel_hash is not None and m["panel_hash"] != panel_hash:
        raise ValueError("the panel is not the one this model was fitted on")
    if set(m["coef"]) != set(m["features"]):
        raise ValueError("artifact terms do not match its features")
    return HazardModel(m["features"], m["intercept"], m["coef"], m["mean"], m["std"], m["pos_weight"], m["l2"], tuple(m["platt"])).check()


def refit_differences(model, other, tol=1e-5):
    """Coefficients that differ beyond the tolerance between a refit and an artifact."""
    pairs = [("intercept", model.intercept, other.intercept)] + [(f, model.coef[f], other.coef[f]) for f in model.features]
    return [(n, a, b) for n, a, b in pairs if abs(a - b) > tol]


def panel_hash(panel, key=("emp_id", "month_index")):
    """Order-free digest of a panel: digests of rows are folded by sum and xor, so no sort is needed."""
    h = F.xxhash64(*sorted(panel.columns))
    r = panel.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum((h % 1000003).cast("bigint")).alias("s"))
    return r.select(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("n", "x", "s")]), 256).alias("panel_hash"))

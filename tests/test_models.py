import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from crewgrid.functions import dates, hashing, numeric, text
from crewgrid.operators import hazard as hz, payfit as pf, screens as sc, valuation as vl


def test_ols_equals_numpy(spark):
    r = np.random.default_rng(1)
    rows = [(str(r.integers(3)), str(r.integers(4)), float(r.uniform(0, 9)), float(r.uniform(0, 1))) for _ in range(400)]
    pay = [math.exp(10 + 0.1 * int(a) - 0.05 * int(b) + 0.02 * t + 0.01 * z) for a, b, t, z in rows]
    df = spark.createDataFrame([(*x, p) for x, p in zip(rows, pay)], "a string, b string, t double, z double, pay double")
    f = pf.fit(df, "pay", {"a": ["1", "2"], "b": ["1", "2", "3"]}, ["t", "z"])
    x = np.array([[1, a == "1", a == "2", b == "1", b == "2", b == "3", t, z] for a, b, t, z in rows], float)
    y = np.log(pay)
    assert np.allclose(f["beta"], np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-6) and f["n"] == 400


def test_collinear_terms_are_refused(spark):
    df = spark.createDataFrame([("1", "1", 2.0), ("0", "0", 3.0)] * 20, "a string, b string, pay double")
    with pytest.raises(ValueError):
        pf.fit(df, "pay", {"a": ["1"], "b": ["1"]}, [])


def panel(spark, n=300):
    r = np.random.default_rng(4)
    rows = []
    for e in range(n):
        for m in range(36):
            x, z = float(r.normal()), float(r.normal())
            out = r.random() < 1 / (1 + math.exp(-(-3 + 1.2 * x)))
            rows.append((e, m, x, z if r.random() > 0.1 else None, "voluntary" if out else "none", e * 100 + m))
            if out:
                break
    return rows, spark.createDataFrame(rows, "emp_id long, month_index int, x double, z double, event_next string, row_id long")


def test_hazard_fit_matches_dense_newton_and_finds_the_signal(spark):
    rows, p = panel(spark)
    m, d = hz.train(p, ["x", "z"], ["z"])
    tr = [r for r in rows if r[1] <= 23]
    raw = np.array([[r[2], r[3] or 0.0, float(r[3] is None)] for r in tr])
    y = np.array([r[4] == "voluntary" for r in tr], float)
    mu, sd = raw.mean(0), raw.std(0)
    x = np.column_stack([np.ones(len(raw)), (raw - mu) / sd])
    w = np.where(y == 1, (len(y) - y.sum()) / y.sum(), 1.0)
    b, ridge = np.zeros(4), np.diag([0.0, 1, 1, 1])
    for _ in range(15):
        pr = 1 / (1 + np.exp(-x @ b))
        b += np.linalg.solve((x * (w * pr * (1 - pr))[:, None]).T @ x + ridge, x.T @ (w * (y - pr)) - ridge @ b)
    assert np.allclose([m.intercept, *(m.coef[f] for f in m.features)], b, atol=1e-5)
    assert m.coef["x"] > 3 * abs(m.coef["z"])
    assert hz.refit_differences(m, hz.from_manifest(hz.manifest(m, "h"), "h")) == []
    with pytest.raises(ValueError):
        hz.from_manifest(hz.manifest(m, "h"), "other")
    s = d.select("emp_id", "row_id", "month_index", "y", "event_next", hz.logit(m).alias("score"), hz.calibrated(m).alias("p")).where("month_index > 29")
    q = hz.ranking_quality(s).first()
    assert 0.6 < q["roc_auc"] < 1
    assert hz.realism_problems(m, {"roc_auc": 0.95, "pr_auc": 0.1}, {"status": "ok", "precision": 1.0}, ["x"]) == ["roc_auc", "precision_at_top", "decoy:x"]
    ci = {r["feature"]: r for r in hz.coefficient_intervals(m, d).collect()}
    assert ci["x"]["excludes_zero"] and ci["x"]["ci_lo"] < ci["x"]["coef"] < ci["x"]["ci_hi"]


def test_precision_at_top_breaks_ties_by_row(spark):
    df = spark.createDataFrame([(1, i, int(i in (0, 1)), 5.0) for i in range(30)], "month_index int, row_id long, y int, score double")
    r = hz.precision_at_top(df, 0.1, 1).first()
    assert (r["n_flagged"], r["hits"]) == (3, 2)


def test_option_value_against_closed_form(spark):
    df = spark.createDataFrame([(100.0, 90.0, 2.0, 0.03, 0.4, 0.01), (100.0, 90.0, 0.0, 0.03, 0.4, 0.0), (100.0, 90.0, 1.0, 0.05, 0.0, 0.0)], "s double, k double, t double, r double, v double, q double")
    got = [x[0] for x in df.select(vl.call_value("s", "k", "t", "r", "v", "q")).collect()]
    cdf = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
    d1 = (math.log(100 / 90) + (0.03 - 0.01 + 0.08) * 2) / (0.4 * math.sqrt(2))
    assert got == [pytest.approx(100 * math.exp(-0.02) * cdf(d1) - 90 * math.exp(-0.06) * cdf(d1 - 0.4 * math.sqrt(2)), abs=1e-5), 10.0, pytest.approx(100 - 90 * math.exp(-0.05), abs=1e-6)]


def award(spark, vols, paths=4000):
    n = len(vols)
    corr = [1.0 if i == j else 0.4 for i in range(n) for j in range(n)]
    return spark.createDataFrame([("a", 0, 3.0, 0.04, paths, 7, [100.0] * n, vols, [0.0] * n, corr, [25.0, 50.0, 75.0], [50.0, 100.0, 200.0])],
                                 "award_id string, issuer int, years double, rate double, paths int, seed int, spots array<double>, vols array<double>, yields array<double>, corr array<double>, curve_x array<double>, curve_y array<double>")


def test_simulation_without_volatility_is_exact_and_repeats(spark):
    v = vl.valuation(award(spark, [0.0] * 5, 100)).first()
    assert v["fair_value"] == 100.0 and v["standard_error"] == 0.0  # all tie at the 50th percentile
    a = award(spark, [0.4] * 5)
    one, two = vl.valuation(a).first(), vl.valuation(a.repartition(3)).first()
    assert one == two and one["mean_percentile"] == pytest.approx(50, abs=2)


def test_payout_curve(spark):
    pts = [(25, 50), (50, 100), (75, 200)]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in (0.0, 24.99, 25.0, 37.5, 50.0, 62.5, 75.0, 100.0)], "p double").select(numeric.payout("p", pts)).collect()]
    assert got == [0, 0, 50, 75, 100, 150, 200, 200]
    for bad in ([(25, 50)], [(50, 1), (25, 2)], [(0, -1), (10, 1)], [(0, 1), (101, 2)]):
        with pytest.raises(ValueError):
            numeric.check_curve(bad)


def test_concern_rules(spark):
    cases = [((2, 1, 0, 1.0, 0.0, 0.0, 99.0), 2), ((2, 0, 0, 3.5, 0.0, 0.0, 30.0), 1), ((2, 0, 0, 3.5, 0.0, 0.0, 0.0), 2), ((1, 0, 0, 2.5, 0.0, 0.0, -30.0), 2), ((1, 0, 0, 2.5, 0.0, 0.0, 30.0), 0),
             ((0, 0, 0, 2.0, 0.0, 0.0, -30.0), 1), ((0, 0, 0, 1.0, 0.0, 0.0, -30.0), 0), ((0, 0, 0, 2.0, 0.0, 0.0, 0.0), 0)]
    df = spark.createDataFrame([(*a, b) for a, b in cases], "mom_c int, rda_c int, pta_c int, mom_raw double, rda double, pta double, fpa double, want int")
    x = sc.concern_cascade(df, sc.policy_for(2026)["bands"])
    assert x.where("overall <> want").count() == 0
    for y in (2019, "2026", True):
        with pytest.raises(ValueError):
            sc.policy_for(y)


def test_whole_months_and_survival(spark):
    d = lambda a, b: spark.sql(f"select date'{a}' a, date'{b}' b").select(dates.whole_months("a", "b")).first()[0]
    assert (d("2024-01-31", "2024-02-29"), d("2024-01-15", "2025-01-15"), d("2024-05-01", "2024-01-01")) == (0, 12, 0)
    h = spark.sql("select array(0.1D, 0.5D, 1.0D) h")
    assert h.select(hz.horizon_probability(F.col("h"), 2)).first()[0] == pytest.approx(0.55)
    with pytest.raises(Exception):
        h.select(hz.horizon_probability(F.col("h"), 4)).collect()


def test_hmac_and_canonical_json(spark):
    import hashlib
    import hmac

    for key in (b"k", b"x" * 90):
        got = spark.sql("select 'héllo' t").select(hashing.hmac_sha256(key, "t")).first()[0]
        assert got == hmac.new(key, "héllo".encode(), hashlib.sha256).hexdigest()
    df = spark.createDataFrame([('{"b": 1.0, "a": [2]}',), ('{"a":1,"a":2}',), ("{bad",)], "t string")
    assert [r[0] for r in df.select(hashing.canonical_json("t")).collect()] == ['{"a":[2],"b":1.0}', None, None]
    assert df.select(hashing.strict_json("t")).collect()[1][0] is False


def test_text_helpers(spark):
    df = spark.createDataFrame([("call (212) 555-0100", ["phone"]), ("id 123-45-6789 x", ["ssn"]), ("a@badexample.com", ["email"]), ("a@sub.example.com", []), (None, [])], "t string, want array<string>")
    assert df.where(text.pii_hits("t") != F.col("want")).count() == 0
    m = spark.createDataFrame([
        ("$1,234", 1234.0, "ok"), ("(1,234)", -1234.0, "ok"), ("—", None, "empty"), ("——", None, "empty"), ("", None, "empty"), (None, None, "empty"), ("$", None, "empty"), ("about 5", None, "unparseable"),
        ("$650,000", 650000.0, "ok"), ("$0", 0.0, "ok"), ("(5)", -5.0, "ok"), ("$12,345 (3)", 12345.0, "ok"), ("1,234 (12)", 1234.0, "ok"), ("1,234 5", 1234.0, "ok"), ("12 [3]*", 12.0, "ok"),
        ("$1,234,567.89", 1234567.89, "ok"), ("500,000 600,000", None, "unparseable"), ("1,234.56.78", None, "unparseable"), ("12-34", None, "unparseable"), ("1,234 restricted units", None, "unparseable"),
    ], "t string, v double, f string")
    got = m.select("v", "f", text.parse_money("t").alias("p")).collect()
    assert all((r["p"]["value"], r["p"]["flag"]) == (r["v"], r["f"]) for r in got)
    v = spark.createDataFrame([(1234567.0, "$1.2M", True), (1234567.0, "$1.3M", False), (12.5, "12.5%", True), (12.5, "13", True), (12.5, "14", False), (-3.0, "n/a", False)], "v double, d string, ok boolean")
    assert v.where(text.display_matches("v", "d") != F.col("ok")).count() == 0
    n = spark.createDataFrame([("The Foo-Bar Group, Inc.",)], "n string").select(text.canonical_name("n")).first()[0]
    assert n == "foo bar"

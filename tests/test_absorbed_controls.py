"""Regressions with controls of many labels against dense least squares."""

import numpy as np
import pandas as pd
import pytest

from crewgrid.operators import absorb, payfit as pf


def people(n, sites, teams, seed=3):
    rng = np.random.default_rng(seed)
    site, team, grp, tenure = rng.integers(0, sites, n), rng.integers(0, teams, n), rng.integers(0, 2, n), rng.uniform(0, 20, n)
    site[: n // 3] = 0  # one site holds a third of the people
    pay = np.exp(3 + 0.3 * rng.standard_normal(sites)[site] + 0.2 * rng.standard_normal(teams)[team] - 0.05 * grp + 0.01 * tenure + 0.1 * rng.standard_normal(n))
    return pd.DataFrame({"site": [f"s{v:05d}" for v in site], "team": [f"t{v:04d}" for v in team], "grp": np.where(grp == 1, "B", "A"), "tenure": tenure, "mgr": rng.integers(0, 2, n).astype(float), "hourly": pay})


def dense(pdf, factors):
    """Coefficients and errors of the group and the numeric terms with every label written out."""
    x = np.column_stack([pdf.grp == "B", pdf.tenure, pdf.mgr, np.ones(len(pdf)), *[pd.get_dummies(pdf[f], drop_first=True) for f in factors]]).astype(float)
    y = np.log(pdf.hourly.to_numpy())
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rss = ((y - x @ beta) ** 2).sum()
    inv = np.linalg.inv(x.T @ x)
    return beta[:3], np.sqrt(rss / (len(y) - x.shape[1]) * np.diag(inv))[:3], 1 - rss / ((y - y.mean()) ** 2).sum()


def same(f, pdf, factors):
    beta, se, r2 = dense(pdf, factors)
    np.testing.assert_allclose(f["beta"][:1], beta[:1], atol=1e-8)
    at = [f["terms"].index(t) for t in ("grp=B", "tenure", "mgr")]
    np.testing.assert_allclose(f["beta"][at], beta, atol=1e-8)
    np.testing.assert_allclose(f["se"][at], se, rtol=1e-6)
    assert f["r2"] == pytest.approx(r2, abs=1e-8) and f["n"] == len(pdf)


def test_one_factor_equals_dense(spark):
    pdf = people(3000, 150, 4)
    f = absorb.fit(spark.createDataFrame(pdf), "hourly", ["site"], {"grp": ["B"], "team": ["t0001", "t0002", "t0003"]}, ["tenure", "mgr"])
    assert f["rounds"] == 1
    same(f, pdf, ["site", "team"])


def test_several_factors_equal_dense(spark):
    pdf = people(3000, 150, 40)
    f = absorb.fit(spark.createDataFrame(pdf), "hourly", ["site", "team"], {"grp": ["B"]}, ["tenure", "mgr"])
    assert f["rounds"] > 1
    same(f, pdf, ["site", "team"])


def test_written_and_absorbed_controls_agree(spark, monkeypatch):
    df = spark.createDataFrame(people(2000, 30, 5))
    controls = dict(controls=["site", "team"], numeric=["tenure", "mgr"])
    whole = pf.adjusted(df, "grp", "A", ["B"], **controls).collect()
    monkeypatch.setattr(pf, "WRITTEN", 10)
    assert pf._controls(df, ["site", "team"])[1] == ["site"]
    assert pf.adjusted(df, "grp", "A", ["B"], **controls).collect() == whole
    monkeypatch.setattr(pf, "WRITTEN", 0)
    assert pf.adjusted(df, "grp", "A", ["B"], **controls).collect() == whole


def test_five_thousand_sites_are_not_refused(spark):
    pdf = people(30000, 5000, 3)
    got = pf.adjusted(spark.createDataFrame(pdf), "grp", "A", ["B"], controls=["site", "team"], numeric=["tenure"]).collect()[0]
    assert got["significant"] and got["ci_lo"] < got["adjusted_gap_pct"] < got["ci_hi"] and 3 < got["adjusted_gap_pct"] < 7


def test_people_without_a_label_count_with_the_first(spark):
    pdf = people(800, 12, 3)
    gap = pdf.copy()
    pdf.loc[pdf.index % 50 == 7, "site"] = None
    pdf.loc[5, "site"] = "alone"
    gap["site"] = pdf["site"].where(pdf["site"].notna() & (pdf["site"] != "alone"), pdf["site"].dropna().loc[lambda v: v != "alone"].min())
    f = absorb.fit(spark.createDataFrame(pdf), "hourly", ["site"], {"grp": ["B"], "team": ["t0001", "t0002"]}, ["tenure", "mgr"], least=2)
    same(f, gap, ["site", "team"])


def test_no_variation_within_a_factor_is_refused(spark):
    pdf = people(500, 20, 3)
    pdf["grp"] = np.where(pdf.site.str[-1].astype(int) % 2 == 0, "A", "B")  # the group is decided by the site
    with pytest.raises(ValueError, match="singular"):
        absorb.fit(spark.createDataFrame(pdf), "hourly", ["site"], {"grp": ["B"]}, ["tenure"])
    with pytest.raises(ValueError, match="rows"):
        absorb.fit(spark.createDataFrame(pdf).where("false"), "hourly", ["site"], {"grp": ["B"]}, ["tenure"])

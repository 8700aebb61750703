import datetime as dt

import pytest
from pyspark.sql import functions as F

from crewgrid.operators import benchmarking as bm, ledger as lg, policy, proxy_tables as px, reports as rp
from crewgrid.plans import metric_registry as reg
from crewgrid.sources import contracts as ct, readers, rulesets as rs, sinks


def rules(df):
    return sorted({r["rule"] for r in df.collect()})


def test_csv_contract(spark, tmp_path):
    p = tmp_path / "comp.csv"
    cols = ["emp_id", "level", "job_family", "location", "base_salary", "range_min", "range_mid", "range_max", "exception_flag"]
    p.write_text("﻿" + ",".join(cols) + "\nE1,L3,Eng,X,100,80,100,120,no\nE2,L3,Eng,X,10.9,80,70,120,maybe\nE2,L3,Eng,X,100,80,100,120,no\n")
    df = readers.csv(spark, str(p), cols, "order")
    assert rules(rs.comp_snapshot(df)) == ["base_salary_positive", "duplicate_emp", "exception_flag_value", "range_order"]
    with pytest.raises(ct.ContractError):
        ct.require_clean(rs.comp_snapshot(df))
    ct.require_clean(rs.comp_snapshot(df.limit(1)))
    with pytest.raises(ct.ContractError):
        readers.csv(spark, str(p), cols[:-1])
    with pytest.raises(ct.ContractError):
        ct.check_header(["emp_id", "Gender"], ["emp_id"], "min", forbidden=rs.FORBIDDEN)
    with pytest.raises(ct.ContractError):
        ct.check_header(["emp_id", "rto"], ["emp_id"], "min", forbidden=rs.FORBIDDEN)
    with pytest.raises(ct.ContractError):
        ct.check_header(["a", "A"], ["a"], "min")


GOOD = dict(ticker="AB", company_name="Ab", role_bucket="CEO", title="Chief", salary="10", bonus="0", stock_awards="5", option_awards="0", non_equity_incentive="0", other_comp="0", total="15", fiscal_year="2025",
            disclosure="def14a", form="DEF 14A", currency="USD", source_url=rs.ARCHIVE + "x", extraction_date="2025-01-31", row_caveat="", is_subject="no")


@pytest.mark.parametrize("change, rule", [({"total": "99"}, "parts_differ_from_total"), ({"currency": "EUR"}, "currency_not_usd"), ({"extraction_date": "2025-02-31"}, "extraction_date"), ({"form": "6-K"}, "form_mismatch"),
                                         ({"source_url": "http://x"}, "source_url"), ({"salary": "NaN"}, "salary_money"), ({"bonus": "-1", "total": "14"}, "bonus_money")])
def test_proxy_contract_finds_each_change(spark, change, rule):
    subject = {**GOOD, "is_subject": "yes"}
    clean = spark.createDataFrame([GOOD, subject])
    assert rules(rs.proxy_comp(clean)) == []
    assert rule in rules(rs.proxy_comp(spark.createDataFrame([{**GOOD, **change}, subject])))


def test_ledger_append_and_anchor(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "e0", "k0", "h0"), (1, 1, "e1", None, "h1"), (1, 2, "e2", "k0", "h2")], "ledger_id long, position long, event_id string, idempotency_key string, event_hash string").withColumn("sequence", F.col("position"))
    path = str(tmp_path / "ledger")
    sinks.append_ledger(spark, path, rows)
    sinks.append_ledger(spark, path, rows.where("idempotency_key is not null"))
    have = spark.read.parquet(path)
    assert sorted(r[0] for r in have.select("event_id").collect()) == ["e0", "e1"]
    a = str(tmp_path / "anchor")
    sinks.write_anchor(spark, a, lg.anchor(have))
    with pytest.raises(ct.ContractError):
        sinks.write_anchor(spark, a, lg.anchor(have.where("position = 0")))


def test_notes_and_policy(spark, tmp_path):
    d = tmp_path / "policy"
    d.mkdir()
    (d / "leave.md").write_text("---\ntopic: leave\nstatus: approved\nlast_reviewed: 2025-06-01\n---\nTake leave.")
    (d / "old.md").write_text("---\ntopic: pay\nstatus: approved\nlast_reviewed: 2020-06-01\n---\nOld.")
    n = readers.notes(spark, str(d), tmp_path.name)
    topics = spark.createDataFrame([("leave",), ("pay",), ("other",)], "topic string")
    got = {r["topic"]: (r["status"], r["answer"]) for r in policy.lookup(n, topics, dt.date(2025, 9, 1)).collect()}
    assert got == {"leave": ("answered", "Take leave."), "pay": ("stale", None), "other": ("no_policy", None)}
    assert "stale" in rules(policy.note_lint(n, dt.date(2025, 9, 1)))


HTML = """<table><tr><td>x</td></tr></table><div style="display: none"><table><tr><td>Name</td><td>Year</td><td>Salary</td><td>Total</td></tr></table></div>
<table><tr><th>Name and Principal Position</th><th>Year</th><th>Salary</th><th></th><th>Bonus</th><th>Stock Awards</th><th>Total</th></tr>
<tr><td>Ann Lee, CEO</td><td>2025</td><td>$</td><td>100</td><td>—</td><td>50</td><td>150</td></tr>
<tr><td>2024</td><td>90</td><td>10</td><td>40</td><td>140</td></tr>
<tr><td>Bo Day</td><td>2025</td><td>70</td><td>30</td><td>100</td></tr>
<tr><td>Cy Fox</td><td>2025</td><td>70</td><td>5</td><td>30</td><td>999</td></tr></table>"""


def test_pay_table_from_html(spark):
    rows = px.rows_from_html(spark.createDataFrame([("d", HTML), ("e", "<p>none</p>")], "doc_id string, html string"))
    table = px.extract(px.clean_rows(rows), px.headers(rows))
    x = table.orderBy("row_no").collect()
    assert [(r["kind"], r["name"], r["year"], r["total"], r["reconciled"]) for r in x] == [
        ("full", "Ann Lee, CEO", 2025, 150.0, True), ("continuation", "Ann Lee, CEO", 2024, 140.0, True), ("partial", "Bo Day", 2025, 100.0, True), ("full", "Cy Fox", 2025, 999.0, False)]
    s = px.select_table(px.confidence(table, rows)).first()
    assert s["found"] and s["band"] in ("medium", "low")


def cells(spark, html):
    return [(r.table_no, r.cells) for r in px.rows_from_html(spark.createDataFrame([("d", html)], "doc_id string, html string")).collect()]


@pytest.mark.parametrize("hide", ['<div aria-hidden="true">', '<div class="x Hidden">', '<div style="Visibility : hidden">', "<div hidden>", "<style>@media screen {.decoy, p {display: none}}</style><div class=decoy>"])
def test_hidden_tables_are_not_read(spark, hide):
    assert cells(spark, f"{hide}<table><tr><td>a</table></div><table><tr><td>b</td></tr></table>") == [(1, ["b"])]


def test_cells_of_untidy_tables(spark):
    assert cells(spark, "<table><tr><td>1,234<sup>5</sup><td>b<tr class=sr-only><td>c<tr><td colspan='2'>wide<td colspan=x>z") == [(0, ["1,234", "b"]), (0, ["wide", "", "z"])]
    assert cells(spark, "<table><tr><td>out<table><tr><td>in</table>er</td></tr></table>") == [(1, ["in"]), (0, ["outer"])]


def test_header_with_fillers_and_wide_rows(spark):
    head = ["Name", "Year", "Sal\u00adary"] + [f"Note {k}" for k in range(1200)] + ["Total"]
    rows = spark.createDataFrame([("d", 0, 0, head), ("d", 0, 1, ["Ann Lee", "2025", "5"] + ["x"] * 1200 + ["5"]), ("d", 0, 2, ["2024", "7"] + ["x"] * 1200 + ["7"])], "doc_id string, table_no int, row_no long, cells array<string>")
    got = px.extract(px.clean_rows(rows), px.headers(rows)).orderBy("row_no").collect()
    assert [(r.kind, r.name, r.year, r.total) for r in got] == [("full", "Ann Lee", 2025, 5.0), ("continuation", "Ann Lee", 2024, 7.0)]


def test_year_order_looks_past_partial_rows(spark):
    head = ["Name", "Year", "Salary", "Bonus", "Stock Awards", "Total"]
    body = [["Ann Lee", "2024", "5", "1", "1", "7"], ["Ann Lee", "2020", "5", "2", "7"], ["2023", "5", "1", "1", "7"], ["2023", "5", "1", "1", "7"]]
    rows = spark.createDataFrame([("d", 0, k, r) for k, r in enumerate([head, *body])], "doc_id string, table_no int, row_no long, cells array<string>")
    got = px.extract(px.clean_rows(rows), px.headers(rows)).orderBy("row_no").collect()
    assert [(r.kind, r.suspect) for r in got] == [("full", False), ("partial", False), ("continuation", False), ("continuation", True)]


def test_filings(spark):
    sub = spark.createDataFrame([("c", ["6-K", "20-F", "DEF 14A"], ["0000000001-25-000001", "0000000001-25-000002", "bad"], ["a.htm", "%252e%252e%252fb.htm", "c.htm"], ["2025-03-01", "2025-01-01", "2025-02-01"])],
                                "cik string, form array<string>, accession array<string>, document array<string>, date array<string>")
    f = rp.filing_rows(sub)
    assert [r["form"] for r in f.collect()] == ["6-K"]
    assert rp.preferred_filing(f).first()["form"] == "6-K"
    assert spark.createDataFrame([("proxy",), ("10k/a",)], "f string").select(rp.form_type(F.col("f"))).collect() == [("DEF 14A",), ("10-K/A",)]


def test_position_contract(spark):
    ok = spark.createDataFrame([("CEO", "base", 40.0, 45.0, 55.0, "below", 5.0, 1.0, 2.0, 3.0)], "role string, element string, percentile double, target_lo double, target_hi double, status string, gap double, p25 double, median double, p75 double")
    assert bm.position_violations(ok).count() == 0
    assert bm.position_violations(ok.withColumn("status", F.lit("within"))).count() == 1


def test_registry():
    assert len(reg.METRICS) == 36 and len(reg.PENDING) == 36
    assert reg.compute("nope", None) == ("unknown_metric", None) and reg.compute("trir", None) == ("data_pending", None)
    assert reg.segment("headcount", None, "level")[0] == "no_segment" and set(reg.DOMAINS) == set(reg.METRICS)


def test_forked_ledger_is_reported(spark):
    from crewgrid.functions.hashing import sha256
    e = spark.createDataFrame([(1, 0, 10, lg.GENESIS, "a"), (1, 0, 11, lg.GENESIS, "b")], "ledger_id long, sequence long, event_id long, prev_hash string, body string").withColumn("event_hash", sha256(lg.content()))
    got = sorted((r["rule"], r["key"]) for r in lg.verify_chain(e).collect())
    assert got == [("duplicate_sequence", "10"), ("duplicate_sequence", "11")]

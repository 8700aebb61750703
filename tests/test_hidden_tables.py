"""Which tables of a page a reader sees, and which cells hold an amount."""

import pytest
from pyspark.sql import functions as F

from crewgrid.functions import text
from crewgrid.operators.proxy_tables import _Cells

TABLE = "<table><tr><td>a</td></tr></table>"
PAGES = [
    (f"<style>.x {{ display : none }}</style><div class=x>{TABLE}</div>", 0),
    (f"<style>@media screen {{ .y{{color:red}} .x.z > p, .w:hover {{ color: red; DISPLAY:None !important; }} }}</style><div class='a W'>{TABLE}</div>", 0),
    (f"<style>@media screen {{ .y{{color:red}} .x {{ display:none }} }}</style><div class=y>{TABLE}</div>", 1),
    (f"<div class=x>{TABLE}</div><style>/* .q{{ */ .x{{visibility:hidden}}</style>", 0),
    (f"<style>.a{{color:red; .b{{display:none}}}}</style><div class=b>{TABLE}</div><div class=a>{TABLE}</div>", 1),
    (f"<style>.a{{.b{{color:red}} display:none}}</style><div class=b>{TABLE}</div><div class=a>{TABLE}</div>", 1),
    (f"<style>.x{{display:block}} }} .y{{</style><div class='x y'>{TABLE}</div>", 1),
    (f"<p style='color:red;display:none'>{TABLE}</p>", 0), (f"<p style='display:inline'>{TABLE}</p>", 1), (f"<p class='SR-only'>{TABLE}</p>", 0), (f"<p hidden>{TABLE}</p>", 0), (f"<p aria-hidden=' True'>{TABLE}</p>", 0),
    (f"<p>.x{{display:none}}</p><div class=x>{TABLE}</div>", 1), ("<style>", 0), ("", 0),
]
CELLS = [
    ("$1,234", 1234.0, "ok"), ("(1,234.50)", -1234.5, "ok"), ("-5", -5.0, "ok"), ("$ 12 (3)(4)", 12.0, "ok"), ("12[123]*†", 12.0, "ok"), ("12 3,4", 12.0, "ok"), ("12 (1234)", None, "unparseable"), ("12 345", None, "unparseable"), ("12.5.3", None, "unparseable"),
    ("12 USD", None, "unparseable"), ("12 (3", None, "unparseable"), ("about 12", None, "unparseable"), ("()", None, "unparseable"), ("12 (a)", None, "unparseable"), ("12 (3]", None, "unparseable"), ("—", None, "empty"), ("  ", None, "empty"), (None, None, "empty"), ("£", None, "empty"), ("(12) (3)", None, "unparseable"), ("0", 0.0, "ok"),
]


@pytest.mark.parametrize("page,shown", PAGES)
def test_tables_a_reader_sees(page, shown):
    assert len(_Cells(page).rows) == shown


def test_amounts(spark):
    t = spark.createDataFrame([(i, c) for i, (c, _, _) in enumerate(CELLS)], "i int, c string")
    got = {r.i: (r.p.value, r.p.flag) for r in t.select("i", text.parse_money("c").alias("p")).collect()}
    assert [got[i] for i in range(len(CELLS))] == [(v, f) for _, v, f in CELLS]


def test_amounts_are_read_once_a_row(spark):
    """However often a value and its flag are used, the cell meets each regular expression once."""
    p = spark.createDataFrame([("$1,234.50(2)",)], "c string").withColumn("p", text.parse_money("c"))
    x = p.select((F.coalesce("p.value", F.lit(0.0)) + F.when(F.col("p.flag") == "ok", F.col("p.value")).otherwise(F.lit(-1.0))).alias("twice"))
    assert x.first()["twice"] == 2469.0 and x._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 2


def test_cells_are_cleaned_once_whatever_is_asked_of_them(spark):
    from pyspark.sql import functions as F

    from crewgrid.functions.text import parse_money
    from crewgrid.operators import proxy_tables as px
    from crewgrid.session import guard

    guard(spark)
    data = [(1, 0, 0, ["20\u200b25", "$", " a "]), (2, 0, 0, ["$", ""]), (3, 0, 0, None), (4, 0, 0, ["2024", "é\ufeff"])]
    rows = px.clean_rows(spark.createDataFrame(data, "doc_id int, table_no int, row_no long, cells array<string>"))
    found = rows.where(F.array_join("cells", " ").rlike(px.YEAR))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
    assert [tuple(r) for r in found.orderBy("doc_id").collect()] == [(1, 0, 0, ["2025", "a"]), (4, 0, 0, ["2024", "é"])]
    cells = ["$1,234", " 12 ", "1,", "$$5", "(7)", "1.50", "1\n", "$", "5 (2)", "5 6x", None]
    money = spark.createDataFrame(list(enumerate(cells)), "i int, c string").select("i", parse_money("c").alias("m")).orderBy("i").collect()
    assert [tuple(r.m) for r in money] == [
        (1234.0, "ok"), (12.0, "ok"), (1.0, "ok"), (5.0, "ok"), (-7.0, "ok"), (1.5, "ok"), (1.0, "ok"), (None, "empty"), (5.0, "ok"), (None, "unparseable"), (None, "empty")]

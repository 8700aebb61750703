"""Risk of segments over several dimensions at once."""

import pytest
from pyspark.sql import functions as F

from crewgrid.operators import hazard as hz


@pytest.fixture
def scored(spark):
    """240 people over eight months: site b is risky for grade 2 alone, one in ten has no grade, site c is small."""
    x = spark.range(240).select(F.col("id").alias("emp_id"), F.when(F.col("id") < 10, "c").when(F.col("id") % 2 == 0, "a").otherwise("b").alias("site"), F.when(F.col("id") % 10 == 9, None).otherwise(F.pmod(F.floor(F.col("id") / 2), F.lit(2)) + 1).alias("grade"))
    x = x.withColumn("month_index", F.explode(F.sequence(F.lit(30), F.lit(37))))
    return x.withColumn("p", F.when((F.col("site") == "b") & (F.col("grade") == 2), 0.05).otherwise(0.01)).withColumn("y", ((F.col("emp_id") == 13) & (F.col("month_index") == 31)).cast("double"))


def test_single_dimensions_equal_segment_risk(scored):
    figures = ["suppressed", "size_band", "n_employees", "n_rows", "bottom_up", "top_down", "gap", "gap_flagged", "incomplete_window"]
    one = {(r["dim"], f"{r['dim']}={r['value']}"): tuple(r[c] for c in figures) for r in hz.segment_risk(scored, ["site", "grade"]).collect()}
    assert {(r["dim"], r["value"]): tuple(r[c] for c in figures) for r in hz.combined_segment_risk(scored, ["site", "grade"], 1).where("value <> 'grade=(none)'").collect()} == one


def test_pairs_are_found_and_small_ones_hidden(scored):
    got = {r["value"]: r for r in hz.combined_segment_risk(scored, ["site", "grade"]).where("dim = 'site & grade'").collect()}
    assert got["site=c & grade=1"]["suppressed"] and got["site=c & grade=1"]["bottom_up"] is None
    assert got["site=b & grade=(none)"]["suppressed"]
    assert got["site=a & grade=1"]["bottom_up"] == pytest.approx(1 - 0.99 ** 6, abs=1e-6)


def test_both_ends(spark, scored):
    x = {(r["dim"], r["which"]): r["segment"] for r in hz.extreme_segments(hz.combined_segment_risk(scored, ["site", "grade"])).collect()}
    assert {d for d, _ in x} == {"site", "grade", "site & grade", "all"} and len(x) == 12
    assert x["all", "highest"] == x["site & grade", "highest"] == "site=b & grade=2"
    assert x["site", "highest"] == "site=b" and x["site", "lowest"] == "site=a"  # site c has ten people and is not shown
    assert x["site & grade", "lowest"] == "site=a & grade=1"  # a tie goes by name
    assert hz.extreme_segments(hz.combined_segment_risk(scored.where("false"), ["site", "grade"])).count() == 0
    with pytest.raises(ValueError):
        hz.combined_segment_risk(scored, ["site", "grade"], 3)
    with pytest.raises(ValueError):
        hz.combined_segment_risk(scored, ["site", "grade"], 2, floor=5)

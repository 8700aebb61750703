"""Checks of claims meet the claims' sources without writing out a check's sources for every claim that names it."""

from crewgrid.operators import lineage as ln


def test_checks_are_looked_up_from_the_closure(spark):
    sources = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (None, 10)], "check_id long, source_id long")
    checks = spark.createDataFrame([(100, 1), (100, 2), (100, 2), (101, 1), (102, 3), (103, None)], "claim_id long, check_id long")
    closure = spark.createDataFrame([(100, 11), (100, 12), (101, 20), (103, 10)], "claim_id long, source_id long")
    found = ln.check_overlap(sources, checks, closure)
    assert sorted(tuple(r) for r in found.collect()) == [("check_outside_closure", "100/2"), ("check_outside_closure", "101/1")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Inner, (check_id" not in plan  # all sources of all checks of all claims

"""The design of a fit is stored once; nothing that follows evaluates the panel again."""

import random

from crewgrid.operators import hazard as hz


def test_intervals_read_the_stored_design(spark):
    draw = random.Random(3)
    rows = [(i, i % 36, draw.random(), draw.choice([0.0, 1.0, None]), "voluntary" if draw.random() < 0.3 else "none") for i in range(2000)]
    panel = spark.createDataFrame(rows, "emp_id long, month_index int, x double, z double, event_next string").groupBy("emp_id", "month_index", "x", "z", "event_next").count()
    model, designed = hz.train(panel, ["x", "z"], ["z"])
    assert {r["part"] for r in designed.select("part").distinct().collect()} == {"train", "calibration", "test"}
    plan = designed._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "parquet" in plan
    again, _ = hz.design(panel, ["x", "z"], ["z"])
    assert [tuple(r) for r in hz.coefficient_intervals(model, designed).collect()] == [tuple(r) for r in hz.coefficient_intervals(model, again).collect()]

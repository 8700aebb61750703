"""Distributed ranks against brute force, with one value and one key holding most rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from crewgrid.functions import ranking as rk


def frame(spark, seed=3, n=600):
    r = random.Random(seed)
    rows = [(i, "hot" if r.random() < 0.6 else r.choice("abc"), 7.0 if r.random() < 0.35 else round(r.uniform(-5, 20), 1)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, k string, v double").repartition(5)


def test_value_ranks_match_counts(spark):
    rows, df = frame(spark)
    for splits in ([], [0.0, 7.0, 9.5], None):
        for r in rk.value_ranks(df, "v", ["k"], splits).collect():
            vals = [v for _, k, v in rows if k == r["k"]]
            assert (r["n"], r["below"], r["total"]) == (vals.count(r["v"]), sum(x < r["v"] for x in vals), len(vals))


def test_quantiles_match_numpy(spark):
    rows, df = frame(spark, 5)
    got = {r["k"]: r for r in rk.quantiles(df, "v", {"a": 0.25, "m": 0.5, "z": 0.9}, ["k"]).collect()}
    for k, r in got.items():
        vals = [v for _, q, v in rows if q == k]
        assert np.allclose([r["a"], r["m"], r["z"]], np.quantile(vals, [0.25, 0.5, 0.9]))
    near = rk.quantiles(df, "v", {"z": 0.9}, method="nearest").first()
    s = sorted(v for _, _, v in rows)
    assert near["z"] == s[round(0.9 * (len(s) - 1))]


def test_row_numbers_and_positions(spark):
    rows, df = frame(spark, 8)
    got = {r["id"]: r["row_no"] for r in rk.row_numbers(df, "id", ["k"]).collect()}
    for k in {k for _, k, _ in rows}:
        ids = sorted(i for i, q, _ in rows if q == k)
        assert [got[i] for i in ids] == list(range(1, len(ids) + 1))
    pos = {r["id"]: r["pos"] for r in rk.ordered_positions(df, "v", "id").collect()}
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    assert [pos[i] for i, _, _ in order] == list(range(len(rows)))


def test_carry_last_crosses_ranges(spark):
    rows, df = frame(spark, 11)
    got = {r["id"]: r["last_seen"]["id"] if r["last_seen"] else None for r in rk.carry_last(df, ["k"], "id", F.col("v") == 7.0, ["v"], splits=[100, 250, 400]).collect()}
    for i, k, _ in rows:
        want = [j for j, q, v in rows if q == k and v == 7.0 and j < i]
        assert got[i] == (want[-1] if want else None)


def test_tie_percentiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "v double")
    p = {r["v"]: r["p"] for r in rk.value_ranks(df, "v").withColumn("p", rk.average_rank_percentile()).collect()}
    assert p == {1.0: 0.0, 2.0: 50.0, 3.0: 100.0}


def test_text_keys(spark):
    """Row numbers and carried rows in the order of text, a hot key included."""
    rows, df = frame(spark, 11)
    names = {i: f"E-{i * 7919 % 1000:05d}" for i, _, _ in rows}
    df = spark.createDataFrame([(names[i], k, v) for i, k, v in rows], "emp string, k string, v double")
    for splits in (None, ["E-00200", "E-00500", "E-00900"]):
        got = {r["emp"]: r["row_no"] for r in rk.row_numbers(df, "emp", ["k"], splits=splits).collect()}
        for k in {k for _, k, _ in rows}:
            order = sorted(names[i] for i, q, _ in rows if q == k)
            assert [got[e] for e in order] == list(range(1, len(order) + 1))
        last = {r["emp"]: r["last_seen"] for r in rk.carry_last(df, ["k"], "emp", F.col("v") == 7.0, ["v"], splits=splits).collect()}
        for i, k, _ in rows:
            before = [names[j] for j, q, v in rows if q == k and v == 7.0 and names[j] < names[i]]
            assert (last[names[i]]["emp"] if last[names[i]] else None) == (max(before) if before else None)

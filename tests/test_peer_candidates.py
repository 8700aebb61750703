"""Candidates of all subjects are sized before they are shuffled; no join runs over pairs of companies."""

import random

import pytest

from crewgrid.operators import peers as pr


@pytest.fixture(scope="module")
def graph(spark):
    draw = random.Random(5)
    companies = [(i, draw.randrange(50, 200), draw.randrange(50, 400), f"s{i % 3}", f"u{i % 7}") for i in range(60)]
    edges = sorted({(draw.randrange(64), draw.randrange(64)) for _ in range(500)} | {(3, 3), (61, 5), (5, 61)})  # 60 to 63 are no listed companies, and 3 names itself
    return companies, edges, spark.createDataFrame(companies, "ticker long, revenue_usd long, market_cap_usd long, sector string, subindustry string"), spark.createDataFrame(edges, "src long, dst long")


def test_sized_candidates_equal_a_plain_count(graph):
    rows, edges, companies, links = graph
    by = {r[0]: r for r in rows}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, {}).setdefault(b, [0, 0])[0] = 1
            near.setdefault(b, {}).setdefault(a, [0, 0])[1] = 1
    want = {}
    for s, ps in near.items():
        for p, hits in ps.items():
            for t, first, n in [(p, 1, sum(hits)), *[(b, 0, 1) for a, b in edges if a == p and b != p]]:
                if t != s and s in by and t in by and 0.5 * by[s][1] <= by[t][1] <= 2 * by[s][1]:
                    was = want.setdefault((s, t), [0, 0, abs(by[t][1] - by[s][1])])
                    was[0], was[1] = max(was[0], first), was[1] + n
    got = pr.sized_candidates(companies, links, lambda s, x: x["revenue_usd"].between(0.5 * s["revenue_usd"], 2 * s["revenue_usd"]), apart=lambda s, x: abs_(x["revenue_usd"] - s["revenue_usd"]))
    assert {(r["subject"], r["ticker"]): [r["first_degree"], r["citations"], r["apart"]] for r in got.collect()} == want


def abs_(c):
    from pyspark.sql import functions as F

    return F.abs(c)


@pytest.mark.parametrize("groups", [pr.comparison_groups, pr.cocitation_groups])
def test_no_join_runs_over_pairs(graph, groups):
    plan = groups(graph[2], graph[3])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "Join" not in plan[:plan.index("Generate")]

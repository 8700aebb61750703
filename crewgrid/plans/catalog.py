"""Named queries: each is a DataFrame builder plus the SQL it must agree with."""

from __future__ import annotations

from crewgrid.views import oracle

QUERIES = {}
ORACLES = {}


def add(name, build, views=None, sql=None):
    """build(spark, sf_dir) -> DataFrame; sql uses the names of `views` as tables."""
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = build
    if sql is not None:
        ORACLES[name] = oracle(views or [], sql)


def load_all():
    from crewgrid.plans import (  # noqa: F401
        workforce_queries, peer_queries, equity_queries, governance_queries, model_queries, valuation_queries, stream_queries, event_ledger_queries, bundle_queries, manifest_queries, identifier_queries,
    )
    return QUERIES, ORACLES

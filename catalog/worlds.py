"""Shared inputs of the registered queries: each analysis runs once per session."""

from __future__ import annotations

from depfleet.operators.cycles import simple_cycles
from depfleet.plans.analysis import analyse
from depfleet.plans.compare import compare, what_if
from depfleet.sources import tables as t
from depfleet.staging import stage

from .base import memo


def common(spark, sf):
    """The links of all systems, which nodes, edges, versions and changes are made of: items and orders are joined once."""
    return {"fleet_common": memo(spark, sf, "fleet_common", lambda: stage(t.derive(spark, sf, "fleet_common")).df)}


def fleet(spark, sf):
    """Staged nodes and edges of the fleet."""
    return memo(spark, sf, "fleet", lambda: tuple(stage(x).df for x in t.fleet(spark, sf, common(spark, sf))))


def analysis(spark, sf):
    return memo(spark, sf, "analysis", lambda: analyse(*fleet(spark, sf)))


def cycle_list(spark, sf):
    """All cycles of the fleet: a step of its own, which no score needs."""
    a = analysis(spark, sf)
    return memo(spark, sf, "cycles", lambda: stage(simple_cycles(a["link"], a["strong"])).df)


def versions(spark, sf):
    return memo(spark, sf, "versions", lambda: tuple(
        stage(x).df for v in (1, 2) for x in t.fleet_version(spark, sf, v, common(spark, sf))))


def comparison(spark, sf):
    return memo(spark, sf, "comparison", lambda: compare(*versions(spark, sf)))


def scenario_run(spark, sf):
    n, e, _, _ = versions(spark, sf)
    return memo(spark, sf, "what_if", lambda: what_if(n, e, t.derive(spark, sf, "fleet_changes", common(spark, sf))))


def supply(spark, sf):
    return memo(spark, sf, "supply", lambda: stage(t.derive(spark, sf, "supply_edges")).df)

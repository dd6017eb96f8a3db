"""The whole analysis of a fleet, each intermediate table staged once and reused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import score as s
from ..operators import walks as w
from ..operators.cycles import few_cycles, simple_cycles
from ..staging import stage, together


def analyse(nodes: DataFrame, edges: DataFrame, list_cycles: bool = False) -> dict[str, DataFrame]:
    """Every table of the canonical profile, keyed by graph.

    The number of cycles may be exponential, and no score needs more of it than whether there are none, one or more; so
    ``cycles`` and the column ``cycles_count`` of ``complexity`` are made only with ``list_cycles``.
    """
    nodes, edges = stage(g.last_declared(nodes)).df, stage(edges).df
    vertex, link = (t.df for t in together(lambda: stage(g.vertices(nodes, edges)), lambda: stage(g.links(edges))))
    size = g.graph_size(vertex, link)

    def reach_side():
        levels = w.shortest_walks(link, paths=True, counts=True)
        walks = stage(w.as_table(levels)).df
        strong = stage(g.strong_labels_from_reach(vertex, walks)).df
        depend, severed, height, few = together(
            lambda: stage(w.dependencies(link, levels)).df,
            lambda: stage(w.severed_pairs(link, walks)).df,
            lambda: stage(g.heights(link, strong)).df,
            lambda: stage(few_cycles(link, strong)).df)
        return walks, strong, depend, severed, height, few

    (walks, strong, depend, severed, height, few), rank, weak, degree = together(
        reach_side, lambda: stage(w.pagerank(vertex, link)).df, lambda: stage(g.weak_labels(vertex, link)).df,
        lambda: stage(g.degrees(vertex, link)).df)
    reach, between = (t.df for t in together(lambda: stage(w.reach_counts(vertex, walks)),
                                             lambda: stage(w.betweenness(vertex, link, depend=depend))))
    metrics = stage(s.node_metrics(nodes, degree, reach, between, rank)).df
    affected = stage(s.spof_affected(metrics, severed, walks)).df
    spof = stage(s.spofs(metrics, severed, affected, size)).df
    depth = height.groupBy(g.G).agg(F.max("height").alias("max_dependency_depth"))
    complexity = stage(g.complexity(size, weak, strong, depth, few)).df
    crit = stage(s.criticality(metrics, spof)).df
    edge = stage(s.edge_risk(edges, crit, spof, w.cycle_edges(link, strong), degree, nodes)).df
    out = {
        "nodes": nodes, "edges": edges, "vertex": vertex, "link": link, "size": size, "walks": walks,
        "degree": degree, "reach": reach, "between": between, "depend": depend, "height": height, "metrics": metrics,
        "severed": severed, "affected": affected, "spof": spof, "weak": weak, "strong": strong, "complexity": complexity,
        "criticality": crit, "edge_risk": edge,
        "node_risk": s.node_risk(nodes, crit, spof, w.cycle_nodes(link, strong)),
        "system": s.system_risk(complexity, spof, edge, nodes),
    }
    if list_cycles:
        out["cycles"] = stage(simple_cycles(link, strong)).df
        out["complexity"] = stage(g.cycle_counts(complexity, out["cycles"])).df
    return out

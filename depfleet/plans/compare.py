"""Two-version comparison and what-if runs as whole plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diff as d
from ..operators import whatif as x
from ..operators.graph import G
from ..operators.lite import lite_analysis
from ..operators.rescore import rescore
from ..staging import stage, together
from .analysis import analyse


def _tagged(df: DataFrame, tag: str) -> DataFrame:
    return df.withColumn(G, F.concat(G, F.lit(tag)))


def _world(tables: dict[str, DataFrame], tag: str) -> dict[str, DataFrame]:
    """The tables of one tag, keyed as before."""
    return {k: df.filter(F.col(G).endswith(tag)).withColumn(G, F.substring_index(G, "@", 1)) for k, df in tables.items()}


def compare(n1: DataFrame, e1: DataFrame, n2: DataFrame, e2: DataFrame) -> dict[str, DataFrame]:
    """Diff, impact, ledger and risk delta of all systems present in either version."""
    n1, e1, n2, e2 = (stage(t).df for t in (n1, e1, n2, e2))
    nodes, edges = stage(d.node_diff(n1, n2)).df, stage(d.edge_diff(e1, e2)).df
    changed = stage(d.directly_changed(nodes, edges)).df
    paths = stage(d.impact_paths(changed, n1.select(G, "node_id").unionByName(n2.select(G, "node_id")),
                                 d.active_edges(e1, e2))).df
    # one analysis over both versions: half the rounds of two
    both = lite_analysis(_tagged(n1, "@1").unionByName(_tagged(n2, "@2")), _tagged(e1, "@1").unionByName(_tagged(e2, "@2")))
    before, after = _world(both, "@1"), _world(both, "@2")
    cut = lambda a: a["metrics"].filter("is_cut").select(G, "node_id")
    broken = stage(d.broken_dependencies(nodes, e1, n2)).df
    pruned = stage(d.pruned_edges(edges, nodes, n2)).df
    new_hubs = stage(d.new_in_second(d.hubs(e1), d.hubs(e2))).df
    new_cuts = stage(d.new_in_second(cut(before), cut(after))).df
    graphs = nodes.select(G).distinct()
    book = d.compare_ledger(graphs, broken, edges, pruned, nodes, new_hubs, new_cuts)
    delta = stage(d.risk_delta(before["system"], after["system"])).df
    return {"n1": n1, "e1": e1, "n2": n2, "e2": e2, "nodes": nodes, "edges": edges, "changed": changed,
            "paths": paths, "broken": broken, "pruned": pruned, "new_hubs": new_hubs, "new_cuts": new_cuts,
            "ledger": book, "delta": delta, "before": before, "after": after}


def what_if(nodes: DataFrame, edges: DataFrame, changes: DataFrame) -> dict[str, DataFrame]:
    """Apply every scenario and score the hypothetical graphs.

    Each base graph is analysed once, however many scenarios change it.
    """
    change, base = together(lambda: x.apply_changes(nodes, edges, changes),
                            lambda: analyse(nodes, edges.withColumn("description", F.lit(None).cast("string"))))
    after = rescore(base, change)
    lost = stage(x.broken(change)).df
    shift = stage(x.shifts(change, lost, after["born"], after["dead"], after["spof"])).df
    book = stage(x.whatif_ledger(shift)).df
    current = change["graphs"].join(x.on_base(base["system"]).select("base_id", F.col("system_risk").alias("current_score")), "base_id")
    return {**change, "base": base, "after": after, "broken": lost, "shift": shift, "ledger": book,
            "score": stage(x.whatif_score(book, current, after["system"])).df,
            "paths": stage(x.propagation(change["touched"], change["graphs"], after["sources"], after["walks"], base["walks"])).df}

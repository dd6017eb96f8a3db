"""Reachability, shortest walks, betweenness, dominators, longest paths, cycle flags.

All operators advance level by level for every (graph, source) at once and cut
lineage after each level.  Their state is what the answer itself needs: closure
rows for reach, candidate rows on one shortest path for single points of failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import Staged, stage, union_all
from .cycles import simple_cycles  # noqa: F401
from .graph import G, strong_labels
from .rank import pagerank  # noqa: F401

PAIR = [G, "src", "dst"]


def no_loops(link: DataFrame) -> DataFrame:
    return link.filter(F.col("src") != F.col("dst")).select(G, "src", "dst")


def weighted(link: DataFrame) -> DataFrame:
    """Edges between different nodes with their multiplicity as double."""
    n = F.col("n").cast("double") if "n" in link.columns else F.lit(1.0)
    return link.filter(F.col("src") != F.col("dst")).select(G, "src", "dst", n.alias("n"))


def shortest_walks(link: DataFrame, sources: DataFrame | None = None, paths: bool = False,
                   counts: bool = False, toward: bool = False) -> list[Staged]:
    """Breadth-first levels: table k holds the pairs (src, dst) at distance k + 1.

    ``paths`` carries the smallest shortest path, ``counts`` the number of shortest
    paths (as double; a column ``n`` of ``link`` says how many parallel edges there
    are).  ``sources`` (graph_id, node_id) restricts where walks start.  ``toward``
    is for reversed links: paths then read, and are compared, from dst to src.
    """
    hop = stage(weighted(link)).df
    first = hop
    if sources is not None:
        first = hop.join(sources.select(G, F.col("node_id").alias("src")).distinct(), [G, "src"], "left_semi")
    if paths:
        first = first.withColumn("path", F.array("dst", "src") if toward else F.array("src", "dst"))
    if counts:
        first = first.withColumn("sigma", F.col("n"))
    first = first.drop("n")
    onward = hop.select(G, F.col("src").alias("dst"), F.col("dst").alias("next"), "n")
    levels = [stage(first)]
    while levels[-1].rows:
        extended = levels[-1].df.join(onward, [G, "dst"]).filter(F.col("src") != F.col("next"))
        keys = [G, "src", F.col("next").alias("dst")]
        aggregates = []
        if paths:
            longer = F.concat(F.array("next"), "path") if toward else F.concat("path", F.array("next"))
            aggregates.append(F.min(longer).alias("path"))
        if counts:
            aggregates.append(F.sum(F.col("sigma") * F.col("n")).alias("sigma"))
        grouped = extended.groupBy(*keys).agg(*aggregates) if aggregates else extended.select(*keys).distinct()
        known = union_all([s.df.select(*PAIR) for s in levels])
        levels.append(stage(grouped.join(known, PAIR, "left_anti")))
    return levels[:-1] if len(levels) > 1 else levels


def as_table(levels: list[Staged]) -> DataFrame:
    """All levels as one table with ``dist``."""
    return union_all([s.df.withColumn("dist", F.lit(k + 1)) for k, s in enumerate(levels)])


def closure(link: DataFrame) -> DataFrame:
    """All (src, dst, dist) with a directed path and src <> dst."""
    return as_table(shortest_walks(link))


def reach_counts(vertex: DataFrame, reach: DataFrame) -> DataFrame:
    """Blast radius (who reaches me) and footprint (whom I reach) of every vertex."""
    ends = reach.select(G, F.explode(F.array(
        F.struct(F.col("dst").alias("node_id"), F.lit(1).alias("b"), F.lit(0).alias("f")),
        F.struct(F.col("src").alias("node_id"), F.lit(0).alias("b"), F.lit(1).alias("f")))).alias("e"))
    sums = ends.groupBy(G, F.col("e.node_id").alias("node_id")).agg(
        F.sum("e.b").alias("blast_radius"), F.sum("e.f").alias("footprint"))
    return vertex.select(G, "node_id").join(sums, [G, "node_id"], "left").na.fill(
        0, ["blast_radius", "footprint"])


def dependencies(link: DataFrame, levels: list[Staged]) -> DataFrame:
    """(src, dst, delta): how much of the shortest walks from src to other nodes runs through dst.

    Backward accumulation over the levels, from the farthest: every level is a join
    on (graph, source, node), so the work is sources x edges, never node triples.
    """
    hop = stage(weighted(link)).df
    back = hop.select(G, F.col("src").alias("prev"), "dst", "n")
    parts: list[DataFrame] = []
    below: DataFrame | None = None
    for k in range(len(levels) - 1, 0, -1):
        at = levels[k].df.select(G, "src", "dst", "sigma")
        if below is None:
            at = at.withColumn("delta", F.lit(0.0))
        else:
            at = at.join(below, PAIR, "left").na.fill(0.0, ["delta"])
        pushed = (at.withColumn("share", (1.0 + F.col("delta")) / F.col("sigma"))
                  .join(back, [G, "dst"])
                  .groupBy(G, "src", F.col("prev").alias("dst")).agg(F.sum(F.col("share") * F.col("n")).alias("share")))
        below = stage(levels[k - 1].df.select(G, "src", "dst", "sigma").join(pushed, PAIR)
                      .select(G, "src", "dst", (F.col("sigma") * F.col("share")).alias("delta"))).df
        parts.append(below)
    return union_all(parts) if parts else levels[0].df.select(*PAIR, F.lit(0.0).alias("delta")).filter("false")


def betweenness_scale(n):
    """What a sum of dependencies is multiplied with in a graph of ``n`` nodes."""
    return F.when(n > 2, 1.0 / ((n - 1) * (n - 2))).otherwise(1.0)


def betweenness(vertex: DataFrame, link: DataFrame, levels: list[Staged] | None = None,
                depend: DataFrame | None = None) -> DataFrame:
    """Directed, unweighted betweenness without endpoints, scaled by 1/((n-1)(n-2)); ``raw`` is the sum unscaled."""
    if depend is None:
        hop = stage(weighted(link)).df
        depend = dependencies(hop, levels or shortest_walks(hop, counts=True))
    n = vertex.groupBy(G).agg(F.count(F.lit(1)).alias("n"))
    total = depend.groupBy(G, F.col("dst").alias("node_id")).agg(F.sum("delta").alias("d"))
    raw = F.coalesce("d", F.lit(0.0))
    return (vertex.select(G, "node_id").join(n, G).join(total, [G, "node_id"], "left")
            .select(G, "node_id", (raw * betweenness_scale(F.col("n"))).alias("betweenness"), raw.alias("raw")))


def severed_pairs(link: DataFrame, walks: DataFrame) -> DataFrame:
    """(src, dst, via): every path from src to dst runs through ``via``.

    These are the dominators of dst in the flow graph of src.  A dominator lies on
    every path, so the inner nodes of one shortest path are all the candidates; a
    candidate falls when some predecessor of dst is reached without it, and its fall
    is passed on along edges until nothing changes.  The result is exact, and the
    state is bounded by closure rows times distance.
    """
    hop = stage(no_loops(link)).df
    inner = F.slice("path", 2, F.size("path") - 2)
    candidate = stage(walks.filter(F.size("path") > 2)
                      .select(G, "src", "dst", F.explode(inner).alias("via"))).df
    triple = [G, "src", "dst", "via"]
    into = hop.select(G, F.col("src").alias("prev"), "dst")
    reached = walks.select(G, "src", F.col("dst").alias("prev"))
    asked = (candidate.join(into, [G, "dst"]).filter("prev <> via AND prev <> dst AND prev <> src")
             .join(reached, [G, "src", "prev"], "left_semi"))
    kept = candidate.select(G, "src", F.col("dst").alias("prev"), "via")
    fallen = [stage(asked.join(kept, [G, "src", "prev", "via"], "left_anti").select(*triple).distinct())]
    onward = hop.select(G, F.col("src").alias("dst"), F.col("dst").alias("next"))
    while fallen[-1].rows:
        step = (fallen[-1].df.join(onward, [G, "dst"]).filter("next <> via")
                .select(G, "src", F.col("next").alias("dst"), "via").distinct()
                .join(candidate, triple, "left_semi"))
        fallen.append(stage(step.join(union_all([f.df for f in fallen]), triple, "left_anti")))
    return candidate.join(union_all([f.df for f in fallen]), triple, "left_anti")


def cut_vertices(vertex: DataFrame, link: DataFrame, weak: DataFrame) -> DataFrame:
    """Articulation points of the undirected projection.

    A node other than the root cuts its component iff it dominates some node as seen
    from the root; a second root decides about the first.  So two sources per
    component suffice, whatever the size.
    """
    known = vertex.select(G, "node_id")
    both = (no_loops(link)
            .join(known.withColumnRenamed("node_id", "src"), [G, "src"], "left_semi")
            .join(known.withColumnRenamed("node_id", "dst"), [G, "dst"], "left_semi"))
    sym = stage(both.unionByName(both.select(G, F.col("dst").alias("src"), F.col("src").alias("dst")))
                .distinct()).df
    roots = (weak.groupBy(G, "component").agg(F.min("node_id").alias("a"), F.max("node_id").alias("b"))
             .select(G, F.explode(F.array("a", "b")).alias("node_id")).distinct())
    walks = as_table(shortest_walks(sym, sources=roots, paths=True))
    return severed_pairs(sym, walks).select(G, F.col("via").alias("node_id")).distinct()


def _cyclic_upstream(link: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Nodes that are on a cycle or reach one; the rest of the graph is a plain DAG."""
    if labels is None:
        ends = link.select(G, F.explode(F.array("src", "dst")).alias("node_id")).distinct()
        labels = stage(strong_labels(ends, link)).df
    big = labels.groupBy(G, "component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    on_cycle = labels.join(big, [G, "component"], "left_semi").select(G, "node_id")
    back = stage(link.select(G, F.col("dst").alias("src"), F.col("src").alias("dst"))).df
    seen = [stage(on_cycle)]
    while seen[-1].rows:
        step = (seen[-1].df.join(back.withColumnRenamed("src", "node_id"), [G, "node_id"])
                .select(G, F.col("dst").alias("node_id")).distinct())
        seen.append(stage(step.join(union_all([s.df for s in seen]), [G, "node_id"], "left_anti")))
    return union_all([s.df for s in seen])


def longest_paths(vertex: DataFrame, link: DataFrame, max_nodes: int | None = None, upstream: bool = False,
                  labels: DataFrame | None = None) -> DataFrame:
    """Longest simple path from each vertex (or into it); at most ``max_nodes`` nodes if that is given.

    Of equally long paths the smallest is given.  A path passes the strong components in their order, so the longest way
    between each two nodes of a component is found once, and one programme over the component graph puts them
    together: round k holds the best path of each node that crosses between components k times.
    """
    if max_nodes is not None:
        return _capped_paths(vertex, link, max_nodes, upstream, labels)
    hop = no_loops(link)
    if upstream:
        hop = hop.select(G, F.col("dst").alias("src"), F.col("src").alias("dst"))
    hop = stage(hop).df
    grow = (lambda head, tail: F.concat(tail, head)) if upstream else (lambda head, tail: F.concat(head, tail))
    if labels is None:
        labels = stage(strong_labels(vertex, hop)).df
    a = labels.select(G, F.col("node_id").alias("src"), F.col("component").alias("cs"))
    b = labels.select(G, F.col("node_id").alias("dst"), F.col("component").alias("cd"))
    sided = stage(hop.join(a, [G, "src"]).join(b, [G, "dst"]).select(G, "src", "dst", (F.col("cs") == F.col("cd")).alias("inner"))).df
    inner, cross = sided.filter("inner"), sided.filter("NOT inner")
    best_of = F.min(F.struct((-F.size("path")).alias("n"), F.col("path"))).alias("p")

    # the longest way between any two nodes of a component: a way is known by its ends and the set of its nodes
    alone = vertex.select(G, F.col("node_id").alias("start"), F.col("node_id").alias("last"), F.array("node_id").alias("path"))
    ways = [stage(inner.select(G, F.col("src").alias("start"), F.col("dst").alias("last"), F.array_sort(F.array("src", "dst")).alias("seen"),
                               grow(F.array("src"), F.array("dst")).alias("path")))]
    onward = inner.select(G, F.col("src").alias("last"), F.col("dst").alias("next"))
    while ways[-1].rows:
        step = (ways[-1].df.join(onward, [G, "last"]).filter(~F.array_contains("seen", F.col("next")))
                .select(G, "start", F.col("next").alias("last"), F.array_sort(F.concat("seen", F.array("next"))).alias("seen"),
                        grow(F.col("path"), F.array("next")).alias("path"))
                .groupBy(G, "start", "last", "seen").agg(F.min("path").alias("path")))
        ways.append(stage(step))
    inside = stage(union_all([alone] + [x.df.select(G, "start", "last", "path") for x in ways])
                   .groupBy(G, "start", "last").agg(best_of).select(G, "start", "last", "p.path")).df

    best = [stage(inside.groupBy(G, F.col("start").alias("node_id")).agg(best_of).select(G, "node_id", "p.path"))]
    while best[-1].rows:
        left = (cross.join(best[-1].df.withColumnRenamed("node_id", "dst"), [G, "dst"])
                .groupBy(G, F.col("src").alias("last")).agg(best_of).select(G, "last", F.col("p.path").alias("tail")))
        step = (inside.join(left, [G, "last"]).select(G, F.col("start").alias("node_id"), grow(F.col("path"), F.col("tail")).alias("path"))
                .groupBy(G, "node_id").agg(best_of).select(G, "node_id", "p.path"))
        best.append(stage(step))
    ranked = union_all([x.df for x in best]).groupBy(G, "node_id").agg(best_of)
    return ranked.select(G, "node_id", (F.size("p.path") - 1).alias("depth"), F.col("p.path").alias("path"))


def _capped_paths(vertex: DataFrame, link: DataFrame, max_nodes: int, upstream: bool, labels: DataFrame | None) -> DataFrame:
    """Longest simple paths of at most ``max_nodes`` nodes.

    Where no cycle can be reached the best path is built backwards from the successors, one pass per length; only
    nodes that reach a cycle enumerate paths, and those stop where the DAG begins.
    """
    hop = no_loops(link)
    if upstream:
        hop = hop.select(G, F.col("dst").alias("src"), F.col("src").alias("dst"))
    hop = stage(hop).df
    knotted = stage(_cyclic_upstream(hop, labels)).df
    def grow(head, tail):
        return F.concat(tail, head) if upstream else F.concat(head, tail)

    # best[k]: node -> smallest path of exactly k + 1 nodes that starts in the DAG part
    plain = vertex.select(G, "node_id").join(knotted, [G, "node_id"], "left_anti")
    best = [stage(plain.withColumn("path", F.array("node_id")))]
    from_plain = hop.join(knotted.withColumnRenamed("node_id", "src"), [G, "src"], "left_anti")
    while best[-1].rows and len(best) < max_nodes:
        step = (from_plain.join(best[-1].df.withColumnRenamed("node_id", "dst"), [G, "dst"])
                .groupBy(G, F.col("src").alias("node_id"))
                .agg(F.min(grow(F.array("src"), F.col("path"))).alias("path")))
        best.append(stage(step))
    parts = [b.df for b in best]

    # simple paths inside the knotted part: rows (start, last, seen) with the smallest path
    open_paths = stage(knotted.select(G, F.col("node_id").alias("start"), F.col("node_id").alias("last"),
                                      F.array("node_id").alias("seen"), F.array("node_id").alias("path")))
    in_knot = stage(hop.join(knotted.withColumnRenamed("node_id", "dst"), [G, "dst"], "left_semi")
                    .join(knotted.withColumnRenamed("node_id", "src"), [G, "src"], "left_semi")).df
    leaving = stage(hop.join(knotted.withColumnRenamed("node_id", "dst"), [G, "dst"], "left_anti")
                    .join(knotted.withColumnRenamed("node_id", "src"), [G, "src"], "left_semi")).df
    tails = union_all([b.df.withColumnRenamed("node_id", "dst") for b in best])
    exits = leaving.join(tails, [G, "dst"]).select(
        G, F.col("src").alias("last"), F.size("path").alias("extra"), F.col("path").alias("tail"))
    # of the tails of one length behind an exit only the smallest can win
    exits = stage(exits.groupBy(G, "last", "extra").agg(F.min("tail").alias("tail"))).df
    length = 1
    while open_paths.rows and length <= max_nodes:
        parts.append(open_paths.df.groupBy(G, F.col("start").alias("node_id")).agg(F.min("path").alias("path")))
        fitting = exits.filter(F.col("extra") <= max_nodes - length)
        ended = (open_paths.df.join(fitting, [G, "last"])
                 .withColumn("path", grow(F.col("path"), F.col("tail"))))
        longest = ended.groupBy(G, F.col("start").alias("node_id")).agg(
            F.min(F.struct(-F.size("path"), F.col("path"))).alias("p"))
        parts.append(longest.select(G, "node_id", F.col("p.path").alias("path")))
        step = (open_paths.df.join(in_knot.withColumnRenamed("src", "last"), [G, "last"])
                .filter(~F.array_contains("seen", F.col("dst")))
                .select(G, "start", F.col("dst").alias("last"),
                        F.array_sort(F.concat("seen", F.array("dst"))).alias("seen"),
                        grow(F.col("path"), F.array("dst")).alias("path"))
                .groupBy(G, "start", "last", "seen").agg(F.min("path").alias("path")))
        open_paths = stage(step)
        length += 1
    ranked = union_all(parts).groupBy(G, "node_id").agg(
        F.min(F.struct((-F.size("path")).alias("n"), F.col("path"))).alias("p"))
    return ranked.select(G, "node_id", (F.size("p.path") - 1).alias("depth"), F.col("p.path").alias("path"))


def cycle_edges(link: DataFrame, labels: DataFrame) -> DataFrame:
    """(src, dst) pairs on any cycle: self loops, and edges inside a strong component."""
    a = labels.select(G, F.col("node_id").alias("src"), F.col("component").alias("cs"))
    b = labels.select(G, F.col("node_id").alias("dst"), F.col("component").alias("cd"))
    return (link.select(G, "src", "dst").distinct().join(a, [G, "src"]).join(b, [G, "dst"])
            .filter("cs = cd").select(G, "src", "dst"))


def cycle_nodes(link: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes on any cycle; each has an edge inside its strong component."""
    return cycle_edges(link, labels).select(G, F.col("src").alias("node_id")).distinct()


def transit_samples(walks: DataFrame, ends: int = 10, keep: int = 3) -> DataFrame:
    """Up to three shortest paths strictly through each node.

    Sources are the node's first ten ancestors by id, targets its first ten descendants.
    """
    from pyspark.sql import Window
    near = Window.partitionBy(G, "node_id").orderBy("end_id")
    up = walks.select(G, F.col("dst").alias("node_id"), F.col("src").alias("end_id")).withColumn(
        "k", F.row_number().over(near)).filter(F.col("k") <= ends).select(G, "node_id", F.col("end_id").alias("src"))
    down = walks.select(G, F.col("src").alias("node_id"), F.col("dst").alias("end_id")).withColumn(
        "k", F.row_number().over(near)).filter(F.col("k") <= ends).select(G, "node_id", F.col("end_id").alias("dst"))
    pairs = up.join(down, [G, "node_id"]).filter("src <> dst")
    through = pairs.join(walks.select(G, "src", "dst", "path"), PAIR).filter(
        F.array_position(F.slice("path", 2, F.greatest(F.size("path") - 2, F.lit(0))), F.col("node_id")) > 0)
    first = Window.partitionBy(G, "node_id").orderBy("src", "dst")
    return through.withColumn("sample_no", F.row_number().over(first)).filter(
        F.col("sample_no") <= keep).select(G, "node_id", "sample_no", "path")

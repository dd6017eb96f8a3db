"""Building the simple digraph and its linear-size facts.

Everything here costs a constant number of shuffles over the edge table, or one
such pass per round.  Joins are keyed by (graph_id, node), never by graph_id
alone on both sides, so one graph with a third of all rows is spread out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import Staged, stage, union_all

G = "graph_id"


def simple_edges(edges: DataFrame) -> DataFrame:
    """One row per (src, dst); of parallel edges the last by ``pos`` gives the attributes."""
    last = F.max_by(F.struct("edge_id", "type", "protocol", "description"), "pos").alias("a")
    return edges.groupBy(G, "src", "dst").agg(last).select(
        G, "src", "dst", "a.edge_id", "a.type",
        F.coalesce("a.protocol", F.lit("Default")).alias("protocol"),
        F.coalesce("a.description", F.concat_ws(" ", "src", "a.type", "dst")).alias("description"),
    )


def links(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) pairs without attributes."""
    return edges.select(G, "src", "dst").distinct()


def last_declared(nodes: DataFrame) -> DataFrame:
    """One row per node id; of a repeated id the last by ``pos`` counts."""
    rest = [c for c in nodes.columns if c not in (G, "node_id")]
    return nodes.groupBy(G, "node_id").agg(F.max_by(F.struct(*rest), "pos").alias("a")).select(G, "node_id", "a.*")


def vertices(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Declared nodes plus endpoints that no node row declares; of a repeated id the last by ``pos`` counts."""
    ends = edges.select(G, F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    last = F.max_by(F.struct("name", "type", "technology"), "pos").alias("a")
    declared = nodes.groupBy(G, "node_id").agg(last).select(
        G, "node_id", "a.name", "a.type", "a.technology", F.lit(True).alias("declared"))
    implicit = ends.join(nodes.select(G, "node_id"), [G, "node_id"], "left_anti").select(
        G, "node_id", F.col("node_id").alias("name"), F.lit("Service").alias("type"),
        F.lit("Generic").alias("technology"), F.lit(False).alias("declared"))
    return declared.unionByName(implicit)


def degrees(vertex: DataFrame, link: DataFrame) -> DataFrame:
    """In, out and total degree of every vertex in the simple graph."""
    ends = link.select(
        G, F.explode(F.array(
            F.struct(F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
            F.struct(F.col("dst").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
        )).alias("e"))
    counted = ends.groupBy(G, F.col("e.node_id").alias("node_id")).agg(
        F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    return (vertex.select(G, "node_id").join(counted, [G, "node_id"], "left")
            .select(G, "node_id",
                    F.coalesce("in_degree", F.lit(0)).alias("in_degree"),
                    F.coalesce("out_degree", F.lit(0)).alias("out_degree"))
            .withColumn("total_degree", F.col("in_degree") + F.col("out_degree")))


def adjacency(link: DataFrame) -> DataFrame:
    """Callers and callees as rows: a hub's list may be a third of all edges, so no arrays."""
    callers = link.select(G, F.col("dst").alias("node_id"), F.lit("caller").alias("side"),
                          F.col("src").alias("other_id"))
    callees = link.select(G, F.col("src").alias("node_id"), F.lit("callee").alias("side"),
                          F.col("dst").alias("other_id"))
    return callers.unionByName(callees)


def graph_size(vertex: DataFrame, link: DataFrame) -> DataFrame:
    """V and E per graph."""
    v = vertex.groupBy(G).agg(F.count(F.lit(1)).alias("node_count"))
    e = link.groupBy(G).agg(F.count(F.lit(1)).alias("edge_count"))
    return v.join(e, G, "left").select(
        G, "node_count", F.coalesce("edge_count", F.lit(0)).alias("edge_count"))


HOT_ROWS = 100_000  # rows of one key that a task may get, while that makes fewer than as many hot keys


def spread_join(rows: DataFrame, n_rows: int, table: DataFrame, keys: list[str], hot: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined with ``table`` (one row per key), where one key may hold a third of all rows.

    Keys with more than ``hot`` rows, fewer than ``n_rows / hot`` by count, are sent to all tasks, so their rows stay where
    they are; all others meet in a shuffle.
    """
    least = max(hot, n_rows // HOT_ROWS)
    if n_rows <= least:
        return rows.join(table, keys)
    busy = stage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least).select(*keys))
    if not busy.rows:
        return rows.join(table, keys)
    few = F.broadcast(busy.df)
    sent = stage(table.join(few, keys, "left_semi")).df
    return rows.join(F.broadcast(sent), keys).unionByName(rows.join(few, keys, "left_anti").join(table, keys))


# --- components ---------------------------------------------------------------------------

def weak_labels(vertex: DataFrame, link: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """Smallest node id of each weak component, by large-star / small-star rounds.

    Rounds grow with the logarithm of the component size.  Each star is a partial minimum per node and a join back;
    the neighbours of a hub, as the root of a large component becomes, stay spread out in both.
    """
    pairs = link.filter(F.col("src") != F.col("dst")).select(
        G, F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("m")).distinct()
    facts = {"print": F.bit_xor(F.xxhash64(G, "u", "m"))}
    now = stage(pairs, **facts)
    while now.rows:
        both = now.df.unionByName(now.df.select(G, F.col("m").alias("u"), F.col("u").alias("m")))
        low = both.groupBy(G, "u").agg(F.least(F.min("m"), F.first("u")).alias("root"))
        large = (spread_join(both.filter(F.col("m") > F.col("u")), now.rows, low, [G, "u"], hot)
                 .select(G, F.col("m").alias("u"), F.col("root").alias("m")).distinct())
        large = stage(large)
        low = large.df.groupBy(G, "u").agg(F.min("m").alias("root"))
        joined = spread_join(large.df, large.rows, low, [G, "u"], hot)
        small = joined.select(G, F.explode(F.array("u", "m")).alias("u"), F.col("root").alias("m"))
        after = stage(small.filter(F.col("u") != F.col("m")).distinct(), **facts)
        large.drop()
        same = after.facts == now.facts
        now.drop()
        now = after
        if same:
            break
    return vertex.select(G, "node_id").join(
        now.df.select(G, F.col("u").alias("node_id"), "m"), [G, "node_id"], "left"
    ).select(G, "node_id", F.coalesce("m", "node_id").alias("component"))


def _spread(start: DataFrame, along: DataFrame, within: str | None = None) -> list[Staged]:
    """Rows (node_id[, tag]) reachable from ``start`` along (src, dst), one table per round."""
    tag = [within] if within else []
    keys = [G, "node_id", *tag]
    seen = [stage(start.select(*keys).distinct())]
    while seen[-1].rows:
        step = (seen[-1].df.join(along.withColumnRenamed("src", "node_id"), keys)
                .select(G, F.col("dst").alias("node_id"), *tag).distinct())
        seen.append(stage(step.join(union_all([s.df for s in seen]), keys, "left_anti")))
    return seen


PATIENCE = 8  # rounds of colouring before chains are taken out


def strong_labels(vertex: DataFrame, link: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """Smallest node id of each strong component, linear space in V and E.

    Rounds of: trim nodes with no edge in or out, twice; colour every node with the smallest id that reaches it; take the
    nodes that reach their colour's root inside the colour; drop them and go on with the rest.  Where colours still
    move after ``patience`` rounds, long ways are taken out first (``_shortened``), so that the number of rounds follows the
    logarithm of a chain's or ring's length.
    """
    edges = stage(link.filter(F.col("src") != F.col("dst")).select(G, "src", "dst"))
    found: list[DataFrame] = []
    folded: list[DataFrame] = []
    short = False
    while edges.rows:
        # trim: a node without an edge in, or without one out, is a component by itself
        for _ in range(2):
            ins = edges.df.select(G, F.col("dst").alias("src")).distinct()
            outs = edges.df.select(G, F.col("src").alias("dst")).distinct()
            kept = stage(edges.df.join(ins, [G, "src"], "left_semi")
                         .join(outs, [G, "dst"], "left_semi").select(G, "src", "dst"))
            done = kept.rows == edges.rows
            edges.drop()
            edges = kept
            if done or not edges.rows:
                break
        if not edges.rows:
            break
        colour = _coloured(edges.df, None if short else patience)
        if colour is None:
            edges, records = _shortened(edges)
            folded += records
            short = True
            continue
        # back from each root inside its colour
        tinted = colour.withColumnRenamed("node_id", "src").withColumnRenamed("colour", "cs")
        tinted_to = colour.withColumnRenamed("node_id", "dst").withColumnRenamed("colour", "cd")
        inside = stage(edges.df.join(tinted, [G, "src"]).join(tinted_to, [G, "dst"])
                       .filter("cs = cd")
                       .select(G, F.col("dst").alias("src"), F.col("src").alias("dst"),
                               F.col("cs").alias("colour")))
        roots = colour.filter("node_id = colour")
        members = union_all([s.df for s in _spread(roots, inside.df, "colour")])
        found.append(members.select(G, "node_id", F.col("colour").alias("component")))
        gone = members.select(G, "node_id")
        rest = stage(edges.df.join(gone.withColumnRenamed("node_id", "src"), [G, "src"], "left_anti")
                     .join(gone.withColumnRenamed("node_id", "dst"), [G, "dst"], "left_anti")
                     .select(G, "src", "dst"))
        edges.drop()
        edges = rest
        short = False
    base = vertex.select(G, "node_id")
    if not found and not folded:
        return base.withColumn("component", F.col("node_id"))
    if folded:
        found = [_unfolded(found, folded)]
    return base.join(union_all(found), [G, "node_id"], "left").select(
        G, "node_id", F.coalesce("component", "node_id").alias("component"))


def _coloured(edges: DataFrame, patience: int | None) -> DataFrame | None:
    """(node_id, colour): the smallest id that reaches each node; None if it still moves after ``patience`` rounds."""
    ids = edges.select(G, F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    colour = stage(ids.withColumn("colour", F.col("node_id")))
    rounds = 0
    while True:
        offers = (edges.join(colour.df.withColumnRenamed("node_id", "src"), [G, "src"])
                  .groupBy(G, F.col("dst").alias("node_id")).agg(F.min("colour").alias("offer")))
        better = (colour.df.join(offers, [G, "node_id"], "left")
                  .select(G, "node_id", F.least("colour", "offer").alias("colour"),
                          (F.col("offer") < F.col("colour")).alias("moved")))
        after = stage(better, moved=F.count_if("moved"))
        colour.drop()
        colour = Staged(after.df.drop("moved"), after.facts, after.path)
        rounds += 1
        if not after.facts["moved"]:
            return colour.df
        if patience is not None and rounds >= patience:
            colour.drop()
            return None


def _shortened(edges: Staged) -> tuple[Staged, list[DataFrame]]:
    """The graph without its long ways, and how to label what was taken out.

    Nodes that call each other are one node from now on.  A node with a single edge in or a single one out is taken out and
    its neighbours are linked past it, many nodes at a time: those whose number is the smallest among their neighbours
    that could go as well.  With a single edge out, to w, it belongs to the component of w exactly if one of its callers
    does; with a single one in, likewise.  A record (node_id, anchor, other) says so: the node takes the label of its anchor
    if that is the label of ``other`` as well.
    """
    records: list[DataFrame] = []
    while edges.rows:
        turned = edges.df.select(G, F.col("dst").alias("src"), F.col("src").alias("dst"))
        mutual = stage(edges.df.join(turned, [G, "src", "dst"], "left_semi"))
        if mutual.rows:
            ends = mutual.df.select(G, F.col("src").alias("node_id")).distinct()
            joined = stage(weak_labels(ends, mutual.df)).df
            records.append(joined.filter("node_id <> component").select(G, "node_id", F.col("component").alias("anchor"), F.col("component").alias("other")))
            a = joined.select(G, F.col("node_id").alias("src"), F.col("component").alias("cs"))
            b = joined.select(G, F.col("node_id").alias("dst"), F.col("component").alias("cd"))
            merged = stage(edges.df.join(a, [G, "src"], "left").join(b, [G, "dst"], "left")
                           .select(G, F.coalesce("cs", "src").alias("src"), F.coalesce("cd", "dst").alias("dst")).filter("src <> dst").distinct())
            edges.drop()
            edges = merged
        degree = (edges.df.select(G, F.explode(F.array(
            F.struct(F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
            F.struct(F.col("dst").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
            .groupBy(G, "e.node_id").agg(F.sum("e.i").alias("i"), F.sum("e.o").alias("o")))
        draw = F.xxhash64(G, "node_id", F.lit(len(records)))
        state = degree.select(G, "node_id", ((F.col("i") == 0) | (F.col("o") == 0)).alias("bare"), (F.col("o") == 1).alias("one_out"),
                              F.when((F.col("i") == 1) | (F.col("o") == 1), draw).alias("draw"))
        names = ("bare", "one_out", "draw")
        at = lambda end, p: state.select(G, F.col("node_id").alias(end), *[F.col(c).alias(f"{p}_{c}") for c in names])
        marked = stage(edges.df.join(at("src", "s"), [G, "src"]).join(at("dst", "d"), [G, "dst"]), bare=F.count_if(F.col("s_bare") | F.col("d_bare")))
        live = marked.df.filter("NOT s_bare AND NOT d_bare")
        # a node goes if no neighbour that could go has a smaller number
        rivals = live.select(G, F.explode(F.array(
            F.struct(F.col("src").alias("node_id"), F.col("s_draw").alias("own"), F.col("d_draw").alias("rival"), F.col("s_one_out").alias("one_out")),
            F.struct(F.col("dst").alias("node_id"), F.col("d_draw").alias("own"), F.col("s_draw").alias("rival"), F.col("d_one_out").alias("one_out")))).alias("e"))
        chosen = (rivals.filter("e.own IS NOT NULL").groupBy(G, "e.node_id", "e.own", "e.one_out").agg(F.min("e.rival").alias("rival"))
                  .filter("rival IS NULL OR own < rival").select(G, "node_id", "one_out"))
        chosen = stage(chosen)
        if not chosen.rows and not marked.facts["bare"]:
            return edges, records
        pick = chosen.df.select(G, "node_id")
        into = live.select(G, F.col("src").alias("u"), F.col("dst").alias("node_id"))
        out = live.select(G, F.col("src").alias("node_id"), F.col("dst").alias("w"))
        past = stage(chosen.df.join(into, [G, "node_id"]).join(out, [G, "node_id"]))
        records.append(past.df.select(G, "node_id", F.when(F.col("one_out"), F.col("w")).otherwise(F.col("u")).alias("anchor"),
                                      F.when(F.col("one_out"), F.col("u")).otherwise(F.col("w")).alias("other")))
        rest = (live.select(G, "src", "dst").join(pick.withColumnRenamed("node_id", "src"), [G, "src"], "left_anti")
                .join(pick.withColumnRenamed("node_id", "dst"), [G, "dst"], "left_anti"))
        after = stage(rest.select(G, "src", "dst").unionByName(past.df.select(G, F.col("u").alias("src"), F.col("w").alias("dst")).filter("src <> dst")).distinct())
        edges.drop()
        marked.drop()
        edges = after
    return edges, records


def _unfolded(found: list[DataFrame], records: list[DataFrame]) -> DataFrame:
    """Labels of found components with the nodes that were taken out, the last ones first; the smallest id names each."""
    known = list(found)
    for record in reversed(records):
        labels = union_all(known) if known else record.select(G, "node_id", F.col("anchor").alias("component")).filter("false")
        a = labels.select(G, F.col("node_id").alias("anchor"), F.col("component").alias("la"))
        b = labels.select(G, F.col("node_id").alias("other"), F.col("component").alias("lo"))
        taken = (record.join(a, [G, "anchor"], "left").join(b, [G, "other"], "left")
                 .withColumn("component", F.coalesce("la", "anchor")).filter(F.col("component") == F.coalesce("lo", "other")))
        known.append(stage(taken.select(G, "node_id", "component").distinct()).df)
    labels = union_all(known).distinct()
    ends = labels.unionByName(labels.select(G, F.col("component").alias("node_id"), "component")).distinct()
    low = ends.groupBy(G, "component").agg(F.min("node_id").alias("low"))
    return ends.join(low, [G, "component"]).select(G, "node_id", F.col("low").alias("component"))


def strong_labels_from_reach(vertex: DataFrame, reach: DataFrame) -> DataFrame:
    """The same labels when the closure is at hand: smallest node in a mutual pair."""
    mutual = reach.select(G, "src", "dst").join(
        reach.select(G, F.col("src").alias("dst"), F.col("dst").alias("src")), [G, "src", "dst"])
    low = mutual.groupBy(G, F.col("src").alias("node_id")).agg(F.min("dst").alias("other"))
    return vertex.select(G, "node_id").join(low, [G, "node_id"], "left").select(
        G, "node_id", F.least("node_id", "other").alias("component"))


def condense(link: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between different components, as (src, dst) labels."""
    a = labels.select(G, F.col("node_id").alias("src"), F.col("component").alias("cs"))
    b = labels.select(G, F.col("node_id").alias("dst"), F.col("component").alias("cd"))
    return (link.join(a, [G, "src"]).join(b, [G, "dst"]).filter("cs <> cd")
            .select(G, F.col("cs").alias("src"), F.col("cd").alias("dst")).distinct())


def walk_levels(start: DataFrame, dag: DataFrame) -> DataFrame:
    """Longest distance from any start node in an acyclic (src, dst) table; a column ``level`` of ``start`` is a head start."""
    dag = stage(dag).df
    first = stage(start.select(G, "node_id", (F.col("level") if "level" in start.columns else F.lit(0)).cast("int").alias("level")).distinct(),
                  last=F.max("level"))
    last = first.facts["last"] or 0
    rounds = [stage(first.df.filter("level = 0").select(G, "node_id"))]
    while rounds[-1].rows or len(rounds) <= last:
        step = rounds[-1].df.join(dag.withColumnRenamed("src", "node_id"), [G, "node_id"]).select(G, F.col("dst").alias("node_id"))
        if len(rounds) <= last:
            step = step.unionByName(first.df.filter(F.col("level") == len(rounds)).select(G, "node_id"))
        rounds.append(stage(step.distinct()))
    rows = union_all([r.df.withColumn("level", F.lit(k)) for k, r in enumerate(rounds)])
    return rows.groupBy(G, "node_id").agg(F.max("level").alias("level"))


def heights(link: DataFrame, labels: DataFrame, floors: DataFrame | None = None) -> DataFrame:
    """(node_id, height): edges on the longest path of components below each node's own.

    ``floors`` (node_id, height) are heights that nodes have at least by links that ``link`` does not hold.
    """
    part = labels.select(G, "node_id", "component")
    dag = condense(link, labels).select(G, F.col("dst").alias("src"), F.col("src").alias("dst"))
    start = part.select(G, F.col("component").alias("node_id"), F.lit(0).alias("level")).distinct()
    if floors is not None:
        start = start.unionByName(floors.join(part, [G, "node_id"]).select(G, F.col("component").alias("node_id"), F.col("height").cast("int").alias("level")))
    level = walk_levels(start, dag).select(G, F.col("node_id").alias("component"), F.col("level").alias("height"))
    return part.join(level, [G, "component"]).select(G, "node_id", "height")


def condensation_depth(link: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges on the longest path of the component DAG, per graph."""
    return heights(link, labels).groupBy(G).agg(F.max("height").alias("max_dependency_depth"))


CLIENT_ID_WORDS = ("frontend", "client", "extension", "ui")     # fixed values
CLIENT_NAME_WORDS = ("frontend", "client")                       # fixed values


def tier_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Layer of each declared node: entries first, datastores and externals last.

    Nodes on one cycle share a layer (flag ``on_cycle``), so the layering ends on
    any graph; without cycles it is the longest distance from an entry.
    """
    known = nodes.select(G, "node_id", "name", "type", "pos")
    inner = known.filter(~F.col("type").isin("Database", "External System"))
    both = (links(edges).join(known.select(G, F.col("node_id").alias("src")), [G, "src"], "left_semi")
            .join(known.select(G, F.col("node_id").alias("dst")), [G, "dst"], "left_semi"))
    parents = both.select(G, F.col("dst").alias("node_id")).distinct().withColumn("called", F.lit(True))
    low_id, low_name = F.lower("node_id"), F.lower("name")
    client = F.lit(False)
    for word in CLIENT_ID_WORDS:
        client = client | low_id.contains(word)
    for word in CLIENT_NAME_WORDS:
        client = client | low_name.contains(word)
    marked = inner.join(parents, [G, "node_id"], "left").withColumn(
        "entry", (F.col("type") == "Application") | F.col("called").isNull() | client)
    named = marked.filter("entry").select(G, "node_id")
    without = inner.join(named.select(G).distinct(), G, "left_anti")
    entry = named.unionByName(without.groupBy(G).agg(F.min_by("node_id", "pos").alias("node_id")))
    core = (both.join(inner.select(G, F.col("node_id").alias("src")), [G, "src"], "left_semi")
            .join(inner.select(G, F.col("node_id").alias("dst")), [G, "dst"], "left_semi"))
    core = stage(core).df
    labels = stage(strong_labels(inner, core)).df
    start = entry.join(labels, [G, "node_id"]).select(G, F.col("component").alias("node_id"))
    levels = walk_levels(start, condense(core, labels)).withColumnRenamed("node_id", "component")
    size = labels.groupBy(G, "component").agg((F.count(F.lit(1)) > 1).alias("on_cycle"))
    placed = stage(labels.join(levels, [G, "component"], "left").join(size, [G, "component"])
                   .select(G, "node_id", F.coalesce("level", F.lit(1)).alias("tier"), "on_cycle")).df
    deepest = placed.groupBy(G).agg((F.max("tier") + 1).alias("last"))
    sinks = (known.filter(F.col("type").isin("Database", "External System"))
             .join(deepest, G, "left")
             .select(G, "node_id", F.coalesce("last", F.lit(1)).alias("tier"), F.lit(False).alias("on_cycle")))
    return placed.unionByName(sinks)


def complexity_points(density, cyclomatic, cycles, depth):
    """Points behind the complexity rating (fixed thresholds)."""
    by_density = F.when(density > 0.20, 3).when(density > 0.12, 2).when(density > 0.06, 1).otherwise(0)
    by_paths = F.when(cyclomatic > 10, 3).when(cyclomatic > 5, 2).when(cyclomatic > 2, 1).otherwise(0)
    by_cycles = F.when(cycles > 0, 3).otherwise(0)
    by_depth = F.when(depth >= 5, 2).when(depth >= 3, 1).otherwise(0)
    return by_density + by_paths + by_cycles + by_depth


def with_density(size: DataFrame) -> DataFrame:
    """Average degree and density from ``node_count`` and ``edge_count``."""
    n, e = F.col("node_count"), F.col("edge_count")
    return (size.withColumn("average_degree", F.round(2.0 * e / n, 2))
            .withColumn("density", F.when(n > 1, F.round(e / (n * (n - 1)), 4)).otherwise(0.0)))


def complexity(size: DataFrame, weak: DataFrame, strong: DataFrame, depth: DataFrame, few: DataFrame) -> DataFrame:
    """One row per graph: degree, density, cyclomatic number, components, depth, rating.

    ``few`` tells of cycles as far as ratings and scores ask (``cycles_least``); ``cycle_counts`` adds their number.
    """
    weak_n = weak.filter("component = node_id").groupBy(G).agg(F.count(F.lit(1)).alias("weak_components"))
    strong_n = strong.filter("component = node_id").groupBy(G).agg(F.count(F.lit(1)).alias("scc_count"))
    n, e = F.col("node_count"), F.col("edge_count")
    row = (with_density(size).join(weak_n, G, "left").join(strong_n, G, "left").join(depth, G, "left")
           .join(few, G, "left").na.fill(0, ["cycles_least", "max_dependency_depth"])
           .withColumn("cyclomatic_complexity", F.greatest(F.lit(1), e - n + 2 * F.col("weak_components"))))
    points = complexity_points(F.col("density"), F.col("cyclomatic_complexity"),
                               F.col("cycles_least"), F.col("max_dependency_depth"))
    return row.withColumn("points", points).withColumn(
        "complexity_rating",
        F.when(F.col("points") >= 7, "HIGH").when(F.col("points") >= 3.5, "MEDIUM").otherwise("LOW"))


def cycle_counts(row: DataFrame, cycles: DataFrame) -> DataFrame:
    """``row`` (one a graph) with ``cycles_count`` from the list of cycles."""
    n = cycles.groupBy(G).agg(F.count(F.lit(1)).alias("cycles_count"))
    return row.join(n, G, "left").na.fill(0, ["cycles_count"])


def complexity_summary(row: DataFrame) -> DataFrame:
    """The rating in words."""
    head = F.format_string("Complexity %s: density %.2f%%, cyclomatic number %d.", "complexity_rating",
                           F.col("density") * 100, "cyclomatic_complexity")
    loops = F.when(F.col("cycles_count") > 0, F.format_string("%d cycle(s).", "cycles_count"))
    deep = F.format_string("Depth %d%s.", "max_dependency_depth",
                           F.when(F.col("max_dependency_depth") >= 4, ", which is deep").otherwise(""))
    return row.withColumn("summary", F.concat_ws(" ", head, loops, deep))

"""Scores of hypothetical graphs from the base analysis and what each scenario changes.

Shortest walks differ only for sources that reach a link that came or went: the sources of such links and, in the base
closure, whoever reaches them.  For these sources alone walks, dependencies and severed pairs are found anew, in the
part of the hypothetical graph that they reach.  Every figure of a node is then its base figure, less what these sources
gave to it before, plus what they give to it now.  Base tables are joined by ``base_id`` and never copied per scenario.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tiers import EDGE_BOUNDS, fair_round, tier
from ..staging import stage, together, union_all
from . import graph as g
from . import score as s
from . import walks as w
from .cycles import cycles_through, inner_links
from .graph import G
from .rank import ranks
from .whatif import BASE, on_base

NODE = [G, "node_id"]
SUMS = ("in_degree", "out_degree", "blast_radius", "raw", "severed_pairs", "plain_in", "cycle_in")


def base_figures(base: dict[str, DataFrame]) -> DataFrame:
    """One row per vertex of each base graph with every figure that scenarios correct."""
    severed = base["severed"].groupBy(G, F.col("via").alias("node_id")).agg(F.count(F.lit(1)).alias("severed_pairs"))
    into = base["edge_risk"].groupBy(G, F.col("dst").alias("node_id")).agg(
        F.count_if(~F.col("on_cycle")).alias("plain_in"), F.count_if("on_cycle").alias("cycle_in"))
    return (base["degree"].select(*NODE, "in_degree", "out_degree")
            .join(base["reach"].select(*NODE, "blast_radius"), NODE).join(base["between"].select(*NODE, "raw"), NODE)
            .join(base["height"], NODE).join(severed, NODE, "left").join(into, NODE, "left")
            .na.fill(0, ["severed_pairs", "plain_in", "cycle_in"]))


def changed_links(change: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Pairs of ends that lose their last edge, and pairs that get their first one."""
    pair = [*BASE, "src", "dst"]
    net = (change["gone_edges"].select(*pair, F.lit(-1).alias("d")).unionByName(change["new_edges"].select(*pair, F.lit(1).alias("d")))
           .groupBy(*pair).agg(F.sum("d").alias("d")))
    had = (net.select(*pair).join(on_base(change["base_edges"]).select("base_id", "src", "dst", F.lit(1).alias("e")), ["base_id", "src", "dst"])
           .groupBy(*pair).agg(F.count("e").alias("had")))
    row = net.join(had, pair, "left").na.fill(0, ["had"]).withColumn("has", F.col("had") + F.col("d"))
    row = stage(row).df
    return row.filter("had > 0 AND has <= 0").select(*pair), row.filter("had = 0 AND has > 0").select(*pair)


def _region(base: dict[str, DataFrame], gone: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources whose walks can differ, and the hypothetical links that their walks can use."""
    heads = gone.unionByName(new)
    reach = on_base(base["walks"]).select("base_id", "src", "dst")
    tails = heads.select(*BASE, F.col("src").alias("node_id")).distinct()
    sources = stage(tails.unionByName(
        tails.join(reach.withColumnRenamed("dst", "node_id"), ["base_id", "node_id"]).select(*BASE, F.col("src").alias("node_id"))).distinct()).df
    starts = sources.unionByName(new.select(*BASE, F.col("dst").alias("node_id"))).distinct()
    inside = starts.unionByName(
        starts.join(reach.withColumnRenamed("src", "node_id"), ["base_id", "node_id"]).select(*BASE, F.col("dst").alias("node_id"))).distinct()
    kept = (inside.withColumnRenamed("node_id", "src").join(on_base(base["link"]), ["base_id", "src"])
            .join(gone.select(G, "src", "dst"), [G, "src", "dst"], "left_anti"))
    return sources, stage(kept.select(*BASE, "src", "dst").unionByName(new)).df


def _vertices(change: dict[str, DataFrame], figures: DataFrame, fixes: DataFrame, gone: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices that vanish and vertices that appear: no declaration is left or was there, and no edge."""
    ends = gone.unionByName(new).select(*BASE, F.explode(F.array("src", "dst")).alias("node_id"))
    asked = ends.unionByName(change["gone_nodes"]).unionByName(change["new_nodes"].select(*BASE, "node_id")).distinct()
    base = on_base(figures).select("base_id", "node_id", (F.col("in_degree") + F.col("out_degree")).alias("deg"))
    declared = on_base(change["base_nodes"]).select("base_id", "node_id").distinct().withColumn("declared", F.lit(True))
    row = (asked.join(base, ["base_id", "node_id"], "left").join(declared, ["base_id", "node_id"], "left")
           .join(change["gone_nodes"].select(*NODE, F.lit(True).alias("dropped")), NODE, "left")
           .join(change["new_nodes"].select(*NODE, F.lit(True).alias("added")).distinct(), NODE, "left")
           .join(fixes.select(*NODE, (F.col("in_degree") + F.col("out_degree")).alias("more")), NODE, "left"))
    stays = ((F.col("declared") & F.col("dropped").isNull()) | F.col("added")
             | (F.coalesce("deg", F.lit(0)) + F.coalesce("more", F.lit(0)) > 0))
    row = stage(row.select(*BASE, "node_id", F.col("deg").isNotNull().alias("was"), F.coalesce(stays, F.lit(False)).alias("stays"))).df
    return row.filter("was AND NOT stays").select(*BASE, "node_id"), row.filter("NOT was AND stays").select(*BASE, "node_id")


def _edge_fixes(base: dict[str, DataFrame], change: dict[str, DataFrame], sources: DataFrame, labels: DataFrame) -> DataFrame:
    """Corrections to how many edges, on a cycle or not, come into each node.

    Outside the sources no strong component changes, so an edge from there keeps its flag.
    """
    old = on_base(base["edge_risk"]).select("base_id", "edge_id", "src", "dst", "on_cycle")
    into = lambda df, sign: df.select(G, F.col("dst").alias("node_id"), F.when(F.col("on_cycle"), 0).otherwise(sign).alias("plain_in"),
                                      F.when(F.col("on_cycle"), sign).otherwise(0).alias("cycle_in"))
    flags = old.select("base_id", "src", "dst", "on_cycle").distinct()
    gone = change["gone_edges"].select(*BASE, "src", "dst").join(flags, ["base_id", "src", "dst"])
    a = labels.select(G, F.col("node_id").alias("src"), F.col("component").alias("cs"))
    b = labels.select(G, F.col("node_id").alias("dst"), F.col("component").alias("cd"))
    new = (change["new_edges"].select(*BASE, "src", "dst").join(a, [G, "src"], "left").join(b, [G, "dst"], "left")
           .join(flags.withColumnRenamed("on_cycle", "before"), ["base_id", "src", "dst"], "left")
           .withColumn("on_cycle", F.when(F.col("cs").isNull(), F.coalesce("before", F.lit(False)))
                       .otherwise(F.coalesce(F.col("cs") == F.col("cd"), F.lit(False)))))
    from_sources = on_base(change["base_edges"]).select("base_id", "row_id", "src", "dst").join(
        sources.withColumnRenamed("node_id", "src"), ["base_id", "src"])
    kept = (from_sources.join(change["gone_edges"].select(G, "row_id"), [G, "row_id"], "left_anti")
            .join(flags.withColumnRenamed("on_cycle", "before"), ["base_id", "src", "dst"])
            .join(a, [G, "src"]).join(b, [G, "dst"], "left")
            .withColumn("on_cycle", F.coalesce(F.col("cs") == F.col("cd"), F.lit(False))).filter("before <> on_cycle"))
    return union_all([into(gone, -1), into(new, 1), into(kept, 1), into(kept.withColumn("on_cycle", F.col("before")), -1)])


def rescore(base: dict[str, DataFrame], change: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``system`` and changed ``spof`` verdicts of every hypothetical graph, cycles ``born`` and ``dead``, and new ``walks`` of ``sources``."""
    scen = change["graphs"]
    gone, new = changed_links(change)
    figures, (sources, hop) = together(lambda: stage(base_figures(base)).df, lambda: _region(base, gone, new))
    link = hop.select(G, "src", "dst")
    deg = lambda df, sign: df.select(G, F.explode(F.array(
        F.struct(F.col("src").alias("node_id"), F.lit(0).alias("in_degree"), F.lit(sign).alias("out_degree")),
        F.struct(F.col("dst").alias("node_id"), F.lit(sign).alias("in_degree"), F.lit(0).alias("out_degree")))).alias("e")).select(G, "e.*")
    degree_fixes = stage(deg(gone, -1).unionByName(deg(new, 1)).groupBy(*NODE).agg(F.sum("in_degree").alias("in_degree"), F.sum("out_degree").alias("out_degree"))).df
    vanished, appeared = _vertices(change, figures, degree_fixes, gone, new)
    v = base["size"].select(F.col(G).alias("base_id"), "node_count", "edge_count")
    tally = lambda df, name: df.groupBy(G).agg(F.count(F.lit(1)).alias(name))
    size = scen.join(v, "base_id")
    for df, name in ((vanished, "v0"), (appeared, "v1"), (gone, "e0"), (new, "e1")):
        size = size.join(tally(df, name), G, "left").na.fill(0, [name])
    size = stage(size.select(*BASE, (F.col("node_count") - F.col("v0") + F.col("v1")).alias("node_count"),
                             (F.col("edge_count") - F.col("e0") + F.col("e1")).alias("edge_count")).filter("node_count > 0")).df
    every = (scen.join(on_base(figures).select("base_id", "node_id", "out_degree"), "base_id")
             .join(vanished.select(*NODE), NODE, "left_anti")
             .unionByName(appeared.withColumn("out_degree", F.lit(0))))

    def ranked():
        start = (every.join(degree_fixes.select(*NODE, F.col("out_degree").alias("more")), NODE, "left").join(size.select(G, F.col("node_count").alias("n")), G)
                 .select(G, "base_id", "node_id", "n", (F.col("out_degree") + F.coalesce("more", F.lit(0))).alias("out_degree")))
        base_link = on_base(base["link"])
        flips = stage(gone.select(G, "src", "dst", F.lit(-1.0).alias("sign")).unionByName(new.select(G, "src", "dst", F.lit(1.0).alias("sign")))).df
        give = lambda shares: (shares.join(base_link, ["base_id", "src"]).select(G, "dst", "share").unionByName(
            shares.join(flips, [G, "src"]).select(G, "dst", (F.col("share") * F.col("sign")).alias("share"))))
        links_of = lambda graphs: (scen.join(graphs, G, "left_semi").join(base_link, "base_id").select(G, "src", "dst")
                                   .join(gone.select(G, "src", "dst"), [G, "src", "dst"], "left_anti")
                                   .unionByName(new.select(G, "src", "dst").join(graphs, G, "left_semi")).withColumn("many", F.lit(1)))
        return stage(ranks(start, size.select(G, (F.col("node_count") + F.col("edge_count")).alias("rows")), links_of, give)).df

    def walked():
        levels = w.shortest_walks(link, sources=sources.select(*NODE), paths=True, counts=True)
        walks = stage(w.as_table(levels)).df
        labels = stage(g.strong_labels_from_reach(sources.select(*NODE), walks)).df
        depend, severed, height, (born, dead) = together(
            lambda: stage(w.dependencies(link, levels)).df, lambda: stage(w.severed_pairs(link, walks)).df,
            lambda: _heights(base, sources, hop, labels, scen, vanished), lambda: _cycles(base, link, labels, gone, new))
        return walks, labels, depend, severed, height, born, dead

    rank, (walks, labels, depend, severed, depth, born, dead) = together(ranked, walked)

    at_sources = lambda df: sources.withColumnRenamed("node_id", "src").join(on_base(df), ["base_id", "src"])
    one = lambda df, node, name, value: df.select(G, F.col(node).alias("node_id"), *[(value if c == name else F.lit(0)).cast("double").alias(c) for c in SUMS])
    wide = lambda df: df.select(*NODE, *[(F.col(c) if c in df.columns else F.lit(0)).cast("double").alias(c) for c in SUMS])
    fixes = union_all([
        one(at_sources(base["walks"].select(G, "src", "dst")), "dst", "blast_radius", F.lit(-1)), one(walks, "dst", "blast_radius", F.lit(1)),
        one(at_sources(base["depend"]), "dst", "raw", -F.col("delta")), one(depend, "dst", "raw", F.col("delta")),
        one(at_sources(base["severed"]), "via", "severed_pairs", F.lit(-1)), one(severed, "via", "severed_pairs", F.lit(1)),
        wide(degree_fixes), wide(_edge_fixes(base, change, sources, labels))])
    fixes = stage(fixes.groupBy(*NODE).agg(*[F.sum(c).alias(f"{c}_fix") for c in SUMS])).df
    kept = (scen.join(on_base(figures), "base_id").join(vanished.select(*NODE), NODE, "left_anti").select(*NODE, *SUMS)
            .unionByName(appeared.select(*NODE, *[F.lit(0).alias(c) for c in SUMS])))
    fixed = kept.join(fixes, NODE, "left").join(size.select(G, "node_count"), G)
    whole = [(F.col(c) + F.coalesce(f"{c}_fix", F.lit(0.0))).cast("long").alias(c) for c in SUMS if c != "raw"]
    raw = F.greatest(F.col("raw") + F.coalesce("raw_fix", F.lit(0.0)), F.lit(0.0)) * w.betweenness_scale(F.col("node_count"))
    now = stage(fixed.select(*NODE, *whole, fair_round(raw, 4).alias("betweenness"))).df

    metrics = (g.last_declared(change["nodes"]).join(now, NODE)
               .join(rank.select(*NODE, fair_round(F.col("pagerank"), 4).alias("pagerank")), NODE)
               .withColumn("shared", s.is_shared_sink()).withColumn("affected_count", F.lit(0)))
    metrics = stage(metrics).df
    spof = stage(s.spof_verdict(metrics, size)).df
    crit = s.criticality_scores(metrics.drop("shared", "affected_count"), spof)
    target = (now.select(*NODE, F.col("in_degree").alias("fan_in"), "plain_in", "cycle_in")
              .join(crit.select(*NODE, "tier"), NODE, "left").join(spof.select(*NODE, F.col("is_spof").alias("target_spof")), NODE, "left")
              .na.fill(False, ["target_spof"]))
    high = lambda on: F.when(tier(s.edge_score(F.lit(on)), EDGE_BOUNDS).isin("CRITICAL", "HIGH"), F.col("cycle_in" if on else "plain_in")).otherwise(0)
    risky = target.groupBy(G).agg(F.sum(high(True) + high(False)).alias("risky_edges"))
    spofs = spof.groupBy(G).agg(F.count_if("is_spof").alias("spof_count"))
    outside = metrics.groupBy(G).agg(F.count_if(F.col("type") == "External System").alias("external_count"))
    few = base["complexity"].select(F.col(G).alias("base_id"), "cycles_least")
    inner = _few(base, scen, sources, labels, link, few)
    row = g.with_density(size.select(G, "node_count", "edge_count"))
    for df in (depth, inner, spofs, risky, outside):
        row = row.join(df, G, "left")
    system = s.system_score(row.na.fill(0))

    was = scen.join(on_base(base["spof"]).select("base_id", "node_id", F.col("is_spof").alias("was")), "base_id").filter("was")
    verdicts = (spof.filter("is_spof").select(*NODE, "is_spof").join(was.select(*NODE, "was"), NODE, "full")
                .na.fill(False).filter("is_spof <> was"))
    return {"system": stage(system).df, "spof": stage(verdicts).df, "born": born, "dead": dead, "walks": walks, "sources": sources}


def _heights(base: dict[str, DataFrame], sources: DataFrame, hop: DataFrame, labels: DataFrame, scen: DataFrame, vanished: DataFrame) -> DataFrame:
    """Depth of each hypothetical graph: new heights of the sources, base heights of all others."""
    height = on_base(base["height"])
    mine = sources.select(*NODE)
    out = hop.join(mine.withColumnRenamed("node_id", "src"), [G, "src"], "left_semi").filter("src <> dst")
    leaving = (out.join(mine.withColumnRenamed("node_id", "dst"), [G, "dst"], "left_anti")
               .join(height.withColumnRenamed("node_id", "dst"), ["base_id", "dst"], "left")
               .groupBy(G, F.col("src").alias("node_id")).agg((F.max(F.coalesce("height", F.lit(0))) + 1).alias("height")))
    inside = out.join(mine.withColumnRenamed("node_id", "dst"), [G, "dst"], "left_semi").select(G, "src", "dst")
    new = g.heights(inside, labels, leaving)
    old = (scen.join(height, "base_id").join(mine, NODE, "left_anti").join(vanished.select(*NODE), NODE, "left_anti").select(*NODE, "height"))
    return stage(new.unionByName(old).groupBy(G).agg(F.max("height").alias("max_dependency_depth"))).df


def _cycles(base: dict[str, DataFrame], link: DataFrame, labels: DataFrame, gone: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cycles through new links in the hypothetical graphs, and through gone links in the base."""
    strong = on_base(base["strong"])
    base_inner = on_base(inner_links(base["link"], base["strong"]))
    hit = gone.join(base_inner, ["base_id", "src", "dst"]).select(*BASE, "component").distinct()
    loops = gone.filter("src = dst").select(G, "src", "dst")
    old_link = hit.join(base_inner, ["base_id", "component"]).select(G, "src", "dst").unionByName(loops)
    old_labels = hit.join(strong, ["base_id", "component"]).select(*NODE, "component")
    return tuple(together(lambda: stage(cycles_through(link, labels, new)).df, lambda: stage(cycles_through(old_link, old_labels, gone)).df))


def _few(base: dict[str, DataFrame], scen: DataFrame, sources: DataFrame, labels: DataFrame, link: DataFrame, few: DataFrame) -> DataFrame:
    """``cycles_least`` of the hypothetical graphs: base components outside the sources, new ones inside, and self loops."""
    parts = lambda inner, key: inner.groupBy(*key, "component").agg(F.count(F.lit(1)).alias("e"), F.count_distinct("src").alias("v"))
    worth = F.when(F.col("e") > F.col("v"), 2).otherwise(1)
    mine = sources.select(*NODE)
    fresh = parts(inner_links(link, labels), [G]).select(G, worth.alias("n"))
    # a base component lies outside the sources as a whole or not at all; its smallest node stands for it
    still = (scen.join(on_base(parts(inner_links(base["link"], base["strong"]), [G])), "base_id")
             .join(mine.withColumnRenamed("node_id", "component"), [G, "component"], "left_anti").select(G, worth.alias("n")))
    own = link.filter("src = dst").select(G, F.col("src").alias("node_id")).distinct().join(mine, NODE, "left_semi").select(G, F.lit(1).alias("n"))
    kept = (scen.join(on_base(base["link"].filter("src = dst").select(G, F.col("src").alias("node_id")).distinct()), "base_id")
            .join(mine, NODE, "left_anti").select(G, F.lit(1).alias("n")))
    return union_all([fresh, still, own, kept]).groupBy(G).agg(F.least(F.sum("n"), F.lit(2)).cast("int").alias("cycles_least"))

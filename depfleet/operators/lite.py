"""The second scoring profile, used when two versions are compared.

It counts parallel edges, takes undirected cut vertices as single points of
failure and scores without normalisation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tiers import CRITICALITY_BOUNDS, EDGE_BOUNDS, SYSTEM_BOUNDS, fair_round, tier
from ..staging import stage, together
from . import walks as w
from .cycles import few_cycles
from .graph import G, links, strong_labels, vertices, weak_labels
from .ranking import rank_desc

NODE = [G, "node_id"]


def multi_links(edges: DataFrame) -> DataFrame:
    """(src, dst, n): parallel edges counted."""
    return edges.groupBy(G, "src", "dst").agg(F.count(F.lit(1)).alias("n"))


def lite_metrics(nodes: DataFrame, edges: DataFrame, strong: DataFrame | None = None) -> DataFrame:
    """Degrees, betweenness, PageRank, depth and cut flag of declared nodes."""
    nodes, link = stage(nodes).df, stage(multi_links(edges)).df
    known = nodes.select(*NODE)
    ins = link.groupBy(G, F.col("dst").alias("node_id")).agg(F.sum("n").alias("in_degree"))
    outs = link.groupBy(G, F.col("src").alias("node_id")).agg(F.sum("n").alias("out_degree"))
    inner = stage(link.join(known.withColumnRenamed("node_id", "src"), [G, "src"], "left_semi")
                  .join(known.withColumnRenamed("node_id", "dst"), [G, "dst"], "left_semi")).df
    every = vertices(nodes, edges).select(*NODE)

    def cuts():
        weak = stage(weak_labels(known, inner)).df
        return stage(w.cut_vertices(known, inner, weak).withColumn("is_cut", F.lit(True))).df
    between, rank, cut, depth = together(
        lambda: stage(w.betweenness(known, inner)).df,
        lambda: stage(w.pagerank(known, link, tol=1e-5, max_rounds=50, per_node=False)).df,
        cuts, lambda: stage(w.longest_paths(every, link, labels=strong).select(*NODE, "depth")).df)
    return stage(nodes.select(G, "node_id", "pos", "name", "type", "technology")
                 .join(ins, NODE, "left").join(outs, NODE, "left")
                 .join(between.select(*NODE, fair_round(F.col("betweenness"), 4).alias("betweenness")), NODE)
                 .join(rank.select(*NODE, fair_round(F.col("pagerank"), 4).alias("pagerank")), NODE)
                 .join(depth, NODE).join(cut, NODE, "left")
                 .na.fill(0, ["in_degree", "out_degree"]).na.fill(False, ["is_cut"])).df


def lite_spofs(metrics: DataFrame) -> DataFrame:
    callers = F.col("in_degree")
    return metrics.select(
        *NODE, F.col("is_cut").alias("is_spof"),
        F.when(F.col("type") == "Database", "SHARED_DATASTORE").otherwise("TRANSIT").alias("spof_type"),
        F.when(F.col("is_cut"), callers * 2).otherwise(0).alias("disconnected_paths"),
        callers.alias("affected_count"),
        F.when(~F.col("is_cut"), "NONE").when(callers >= 3, "CRITICAL").otherwise("HIGH").alias("severity"))


def lite_complexity(metrics: DataFrame, edges: DataFrame, few: DataFrame) -> DataFrame:
    n = metrics.groupBy(G).agg(F.count(F.lit(1)).alias("node_count"),
                               F.max("depth").alias("max_dependency_depth"))
    e = edges.groupBy(G).agg(F.count(F.lit(1)).alias("edge_count"))
    row = n.join(e, G, "left").join(few, G, "left").na.fill(0, ["edge_count", "cycles_least"])
    v, m = F.col("node_count"), F.col("edge_count")
    row = (row.withColumn("average_degree", F.round(2.0 * m / v, 2))
           .withColumn("density", F.when(v > 1, F.round(m / (v * (v - 1)), 3)).otherwise(0.0))
           .withColumn("cyclomatic_complexity", F.greatest(F.lit(1), m - v + 2)))
    return row.withColumn(
        "complexity_rating",
        F.when((F.col("cyclomatic_complexity") > 10) | (F.col("density") > 0.35) | (F.col("cycles_least") > 0), "HIGH")
        .when(F.col("cyclomatic_complexity") > 4, "MEDIUM").otherwise("LOW"))


def lite_criticality(metrics: DataFrame) -> DataFrame:
    score = fair_round(F.least(F.lit(1.0), F.col("in_degree") * 0.25 + F.col("betweenness") * 0.35
                            + F.col("pagerank") * 0.2 + F.when(F.col("is_cut"), 0.2).otherwise(0.0)), 2)
    row = metrics.withColumn("criticality", score).withColumn("tier", tier(F.col("criticality"), CRITICALITY_BOUNDS))
    return rank_desc(row, G, "criticality", "pos")


def lite_edge_risk(edges: DataFrame, crit: DataFrame) -> DataFrame:
    target = crit.select(G, F.col("node_id").alias("dst"), "is_cut", "tier", "criticality", "in_degree")
    row = edges.select(G, "edge_id", "pos", "src", "dst", "type").join(target, [G, "dst"], "left")
    score = (0.2 + F.when(F.col("is_cut"), 0.35).otherwise(0.0)
             + F.when(F.col("tier") == "CRITICAL", 0.25).otherwise(0.0)
             + F.when(F.col("in_degree") >= 4, 0.15).otherwise(0.0))
    return row.select(
        G, "edge_id", "src", "dst", "type", F.round(F.least(F.lit(1.0), score), 2).alias("risk_score"),
        tier(F.round(score, 4), EDGE_BOUNDS).alias("risk_level"),
        F.coalesce("is_cut", F.lit(False)).alias("target_spof"),
        F.when(F.col("criticality") != 0, F.col("criticality")).otherwise(0.2).alias("target_criticality"))


def lite_system_risk(complexity: DataFrame, metrics: DataFrame, edge: DataFrame) -> DataFrame:
    """The 0-100 score with this profile's figures."""
    m = metrics.groupBy(G).agg(F.count_if("is_cut").alias("spof_count"),
                               F.count_if(F.col("type") == "External System").alias("external_count"))
    e = edge.groupBy(G).agg(F.count_if(F.col("risk_level").isin("CRITICAL", "HIGH")).alias("risky_edges"))
    row = complexity.join(m, G).join(e, G, "left").na.fill(0, ["risky_edges"])
    total = (F.least(F.lit(25.0), F.col("density") * 30.0 + F.col("average_degree") * 2.5)
             + F.least(F.lit(30.0), F.col("spof_count") * 12.0)
             + F.least(F.lit(20.0), F.col("cycles_least") * 10.0)
             + F.least(F.lit(15.0), F.col("risky_edges") * 3.5)
             + F.least(F.lit(10.0), F.col("external_count") * 3.0
                       + F.greatest(F.lit(0), F.col("max_dependency_depth") - 3) * 1.5))
    score = fair_round(F.least(F.lit(100.0), F.greatest(F.lit(5.0), total)), 1)
    return row.select(G, score.alias("system_risk"), tier(score, SYSTEM_BOUNDS).alias("system_level"))


def model_score(metrics: DataFrame, edges: DataFrame) -> DataFrame:
    """Coupling, bottleneck, external and cut-vertex points on a base of 20."""
    deg = (edges.select(G, F.explode(F.array("src", "dst")).alias("node_id")).groupBy(*NODE)
           .agg(F.count(F.lit(1)).alias("degree")))
    hubs = deg.filter("degree >= 3").groupBy(G).agg(F.count(F.lit(1)).alias("bottlenecks"))
    e = edges.groupBy(G).agg(F.count(F.lit(1)).alias("edge_count"))
    m = metrics.groupBy(G).agg(F.count(F.lit(1)).alias("node_count"), F.count_if("is_cut").alias("cut_vertices"),
                               F.count_if(F.col("type") == "External System").alias("externals"))
    row = m.join(e, G, "left").join(hubs, G, "left").na.fill(0, ["edge_count", "bottlenecks"])
    ratio = F.round(F.col("edge_count") / F.greatest(F.lit(1), F.col("node_count")), 2)
    row = row.withColumn("coupling_ratio", ratio)
    score = (20 + F.least(F.lit(30), F.round(F.col("coupling_ratio") * 15, 0).cast("int"))
             + F.col("bottlenecks") * 8 + F.col("externals") * 6 + F.col("cut_vertices") * 12)
    return row.select(G, "coupling_ratio", "bottlenecks", "externals", "cut_vertices",
                      F.least(F.lit(100), F.greatest(F.lit(0), score)).cast("int").alias("model_score"))


def lite_analysis(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """All tables of the profile; cycles are told apart as far as scores ask, and listed by ``simple_cycles`` alone."""
    nodes, edges = stage(nodes).df, stage(edges).df
    every, link = vertices(nodes, edges), links(edges)
    strong = stage(strong_labels(every, link)).df
    metrics, few = together(lambda: lite_metrics(nodes, edges, strong), lambda: stage(few_cycles(link, strong)).df)
    crit = stage(lite_criticality(metrics)).df
    edge = stage(lite_edge_risk(edges, crit)).df
    complexity = stage(lite_complexity(metrics, edges, few)).df
    return {"nodes": nodes, "edges": edges, "link": link, "strong": strong, "metrics": metrics, "spof": lite_spofs(metrics),
            "criticality": crit, "edge_risk": edge, "complexity": complexity,
            "system": lite_system_risk(complexity, metrics, edge), "model": model_score(metrics, edges)}

"""Registering sightings of nodes and edges: validation, merging, pruning, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage, union_all
from .graph import G

# fixed values
NODE_TYPES = ("Service", "Application", "API", "Database", "Module", "Library", "External System",
              "Queue", "Package", "Worker", "Infrastructure")
EDGE_TYPES = ("CALLS", "USES", "DEPENDS_ON", "CONNECTS_TO", "EXPOSES", "IMPORTS", "QUERIES", "PUBLISHES",
              "SUBSCRIBES", "LOADS")
ARCHITECTURAL = ("CALLS", "USES", "DEPENDS_ON", "CONNECTS_TO", "QUERIES", "PUBLISHES", "SUBSCRIBES")


def validate(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Issue rows, clean nodes, clean edges and one verdict row per graph.

    All faults are reported, not only the first.  Of rows with one id the first by
    ``pos`` stays.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    n = nodes.withColumn("node_id", F.trim("node_id"))
    e = edges.withColumn("src", F.trim("src")).withColumn("dst", F.trim("dst"))
    named = n.filter(~blank("node_id"))
    first = named.groupBy(G, "node_id").agg(F.min("pos").alias("first_pos"))
    marked = stage(named.join(first, [G, "node_id"])).df
    clean_nodes = marked.filter("pos = first_pos").drop("first_pos")
    odd_type = ~F.coalesce(F.col("type").isin(*NODE_TYPES), F.lit(False))
    ids = clean_nodes.select(G, "node_id")
    ended = (e.join(ids.withColumnRenamed("node_id", "src").withColumn("src_known", F.lit(True)), [G, "src"], "left")
             .join(ids.withColumnRenamed("node_id", "dst").withColumn("dst_known", F.lit(True)), [G, "dst"], "left"))
    ended = (ended.withColumn("no_end", blank("src") | blank("dst"))
             .withColumn("dangling", ~F.col("no_end") & (F.col("src_known").isNull() | F.col("dst_known").isNull())))
    ended = stage(ended).df
    odd_edge = ~F.coalesce(F.col("type").isin(*EDGE_TYPES), F.lit(False))

    def issues(df, level, code, subject):
        return df.select(G, F.lit(level).alias("level"), F.lit(code).alias("code"), subject.alias("subject"), "pos")
    key = F.col("edge_id")
    listed = union_all([
        issues(n.filter(blank("node_id")), "error", "missing_node_id", F.lit("")),
        issues(marked.filter("pos > first_pos"), "error", "duplicate_node_id", F.col("node_id")),
        issues(clean_nodes.filter(odd_type), "warning", "unknown_node_type", F.col("node_id")),
        issues(ended.filter("no_end"), "error", "missing_edge_end", key),
        issues(ended.filter("dangling"), "error", "undefined_edge_end", key),
        issues(ended.filter(~F.col("no_end") & ~F.col("dangling") & odd_edge), "warning", "unknown_edge_type", key)])
    kept = ended.filter("NOT no_end AND NOT dangling").drop("src_known", "dst_known", "no_end", "dangling")
    clean_nodes = clean_nodes.withColumn("type", F.when(odd_type, "Service").otherwise(F.col("type")))
    kept = kept.withColumn("type", F.when(odd_edge, "CALLS").otherwise(F.col("type")))
    errors = listed.filter("level = 'error'").groupBy(G).agg(F.count(F.lit(1)).alias("errors"))
    good = clean_nodes.groupBy(G).agg(F.count(F.lit(1)).alias("node_count"))
    graphs = nodes.select(G).distinct()
    verdict = graphs.join(errors, G, "left").join(good, G, "left").na.fill(0).withColumn(
        "accepted", (F.col("errors") == 0) & (F.col("node_count") > 0))
    return listed, clean_nodes, kept, verdict


def merge_nodes(sightings: DataFrame) -> DataFrame:
    """One node per id from its sightings in ``pos`` order.

    The first sighting gives name, source and evidence; the first non-empty
    description stays; an Application or Module is upgraded by the first other type;
    a generic technology by the first other one; later metadata wins per key.
    """
    soft = F.col("type").isin("Application", "Module")
    plain = F.coalesce("technology", F.lit("Generic")).isin("Generic")
    row = sightings.groupBy(G, "node_id").agg(
        F.min("pos").alias("pos"), F.min_by("name", "pos").alias("name"),
        F.min_by("type", "pos").alias("_type"), F.min_by("type", F.when(~soft, F.col("pos"))).alias("_hard"),
        F.min_by("technology", F.when(~plain, F.col("pos"))).alias("technology"),
        F.min_by("description", F.when(F.coalesce("description", F.lit("")) != "", F.col("pos"))).alias("description"))
    return row.withColumn("type", F.when(F.col("_type").isin("Application", "Module"),
                                         F.coalesce("_hard", "_type")).otherwise(F.col("_type"))
                          ).withColumn("technology", F.coalesce("technology", F.lit("Generic"))).drop("_type", "_hard")


def merge_metadata(sightings: DataFrame) -> DataFrame:
    """(node_id, key, value) rows; of several values the latest sighting's."""
    pairs = sightings.select(G, "node_id", "pos", F.explode("metadata").alias("key", "value"))
    return pairs.groupBy(G, "node_id", "key").agg(F.max_by("value", "pos").alias("value"))


def merge_files(sightings: DataFrame) -> DataFrame:
    """(node_id, path) rows in order of first sighting."""
    pairs = sightings.select(G, "node_id", "pos", F.posexplode("associated_files").alias("i", "path"))
    return pairs.groupBy(G, "node_id", "path").agg(F.min(F.struct("pos", "i")).alias("first")).select(
        G, "node_id", "path", F.col("first.pos").alias("first_pos"))


def dedupe_edges(sightings: DataFrame) -> DataFrame:
    """No self edges; the first sighting per (src, dst, type)."""
    rest = [c for c in sightings.columns if c not in (G, "src", "dst", "type")]
    return (sightings.filter("src <> dst").groupBy(G, "src", "dst", "type")
            .agg(F.min_by(F.struct(*rest), "pos").alias("r")).select(G, "src", "dst", "type", "r.*"))


def prune_dangling(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with both ends declared, and a warning row for every other edge."""
    ids = nodes.select(G, "node_id")
    kept = (edges.join(ids.withColumnRenamed("node_id", "src"), [G, "src"], "left_semi")
            .join(ids.withColumnRenamed("node_id", "dst"), [G, "dst"], "left_semi"))
    a = ids.select(G, F.col("node_id").alias("src"), F.lit(True).alias("s"))
    b = ids.select(G, F.col("node_id").alias("dst"), F.lit(True).alias("d"))
    gone = (edges.join(a, [G, "src"], "left").join(b, [G, "dst"], "left")
            .filter("s IS NULL OR d IS NULL").select(G, "edge_id", "src", "dst"))
    return kept, gone


def model_stats(nodes: DataFrame, edges: DataFrame, profile: str = "full") -> DataFrame:
    """Nodes per kind; the full profile counts queues as datastores and packages as modules."""
    kind = F.col("type")
    stores = ("Database", "Queue") if profile == "full" else ("Database",)
    modules = ("Module", "Package") if profile == "full" else ("Module",)
    n = nodes.groupBy(G).agg(
        F.count_if(kind.isin("Service", "Application")).alias("services"), F.count_if(kind == "API").alias("apis"),
        F.count_if(kind.isin(*stores)).alias("databases"), F.count_if(kind.isin(*modules)).alias("modules"),
        F.count_if(kind == "Library").alias("libraries"),
        F.count_if(kind == "External System").alias("external_systems"), F.count(F.lit(1)).alias("total_nodes"))
    e = edges.groupBy(G).agg(F.count(F.lit(1)).alias("total_edges"))
    return n.join(e, G, "left").na.fill(0, ["total_edges"])


def protocol_breakdown(edges: DataFrame) -> DataFrame:
    return edges.groupBy(G, F.coalesce("protocol", F.lit("Default")).alias("protocol")).agg(
        F.count(F.lit(1)).alias("n"))


def edge_kpis(edges: DataFrame) -> DataFrame:
    return edges.groupBy(G).agg(
        F.count_if(F.col("type") == "CALLS").alias("calls"),
        F.count_if(F.col("type").isin("QUERIES", "USES", "CONNECTS_TO")).alias("data_links"),
        F.count_if(F.col("ev_confidence") == "HIGH").alias("high_confidence"))

"""Comparing two versions of nodes, edges, files and folders.

Both sides carry the same ``graph_id`` (the system); a full outer join on
(graph_id, key) classifies every item of both versions in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as p
from ..staging import stage, union_all
from . import walks as w
from .graph import G, links

CHANGES = ("removed", "added", "modified", "unchanged")


def change_rank(change: Column) -> Column:
    """Removed first, then added, modified, unchanged."""
    return F.coalesce(F.array_position(F.lit(list(CHANGES)), change), F.lit(99))


def _both(v1: DataFrame, v2: DataFrame, key: str = "key") -> DataFrame:
    """Full outer join of the last row per key on each side, as structs a and b."""
    def last(df, name):
        fields = [c for c in df.columns if c not in (G, key, "_order")]
        return df.groupBy(G, key).agg(F.max_by(F.struct(*fields), "_order").alias(name))
    return last(v1, "a").join(last(v2, "b"), [G, key], "full_outer")


def _change(modified: Column) -> Column:
    return (F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed")
            .when(modified, "modified").otherwise("unchanged"))


def _origin() -> Column:
    return F.when(F.col("a").isNull(), "V2").when(F.col("b").isNull(), "V1").otherwise("BOTH")


def _differs_when_both(field: str) -> Column:
    """Both sides non-empty and different."""
    a, b = F.col(f"a.{field}"), F.col(f"b.{field}")
    return F.coalesce((a != "") & (b != "") & (a != b), F.lit(False))


def node_diff(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """Change of every node; cosmetic differences against a missing value do not count."""
    def side(df):
        return df.select(G, p.node_key(F.col("node_id")).alias("key"), "node_id", "name", "type",
                         "technology", "description", F.col("pos").alias("_order"))
    modified = ((F.col("a.type") != F.col("b.type")) | (F.col("a.name") != F.col("b.name"))
                | _differs_when_both("technology") | _differs_when_both("description"))
    pick = lambda f: F.coalesce(F.col(f"b.{f}"), F.col(f"a.{f}")).alias(f)
    return _both(side(v1), side(v2)).select(
        G, "key", _change(modified).alias("change_type"), _origin().alias("version_origin"),
        pick("node_id"), pick("name"), pick("type"), F.col("a.name").alias("previous_name"))


def edge_diff(v1: DataFrame, v2: DataFrame, v1_name: str = "V1", v2_name: str = "V2") -> DataFrame:
    """Added, removed and unchanged edges; protocol and evidence are not part of identity."""
    def side(df):
        return df.select(G, p.edge_key(F.col("src"), F.col("dst"), F.col("type")).alias("key"),
                         "edge_id", "src", "dst", "type", "ev_file", "ev_confidence", F.col("pos").alias("_order"))
    pick = lambda f: F.coalesce(F.col(f"b.{f}"), F.col(f"a.{f}")).alias(f)
    found = F.coalesce(F.col("b.ev_file"), F.col("a.ev_file"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return _both(side(v1), side(v2)).select(
        G, "key", _change(F.lit(False)).alias("change_type"), _origin().alias("version_origin"),
        pick("edge_id"), pick("src"), pick("dst"), pick("type"),
        F.when(found.isNotNull() | both, found).otherwise("unavailable").alias("ev_file"),
        F.when(F.col("b.ev_file").isNotNull(), F.col("b.ev_confidence"))
        .when(F.col("a.ev_file").isNotNull(), F.col("a.ev_confidence"))
        .when(~both, "LOW").alias("ev_confidence"),
        F.when(found.isNull() & F.col("a").isNull(), f"Added in {v2_name}")
        .when(found.isNull() & F.col("b").isNull(), f"Decommissioned from {v1_name}").alias("ev_description"))


def file_diff(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """Change of every file by path, without the folder all files of a version share."""
    def side(df):
        keyed = df.withColumn("_full", p.file_key(F.col("path")))
        return p.strip_common_root(keyed, "_full", "key").select(
            G, "key", "path", "content_hash", "size_bytes", "lines_count", F.col("path").alias("_order"))
    differs = lambda f: F.coalesce(F.col(f"a.{f}") != F.col(f"b.{f}"), F.lit(False))
    modified = _differs_when_both("content_hash") | differs("size_bytes") | differs("lines_count")
    return _both(side(v1), side(v2)).select(
        G, "key", _change(modified).alias("change_type"), _origin().alias("version_origin"),
        F.coalesce("b.path", "a.path").alias("path"),
        F.when(_change(modified) == "modified", F.format_string(
            "File modified (%d lines -> %d lines)", F.coalesce("a.lines_count", F.lit(0)).cast("long"),
            F.coalesce("b.lines_count", F.lit(0)).cast("long"))).alias("diff_reason"))


def folder_diff(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """Added, removed and unchanged folders."""
    def side(df):
        return df.select(G, p.folder_key(F.col("folder")).alias("key"), "folder", F.col("folder").alias("_order"))
    return _both(side(v1), side(v2)).select(
        G, "key", _change(F.lit(False)).alias("change_type"), _origin().alias("version_origin"),
        F.coalesce("b.folder", "a.folder").alias("folder"))


def ordered(diff: DataFrame, path: str) -> DataFrame:
    """Actionable changes first; a distributed sort over all graphs."""
    return diff.withColumn("change_rank", change_rank(F.col("change_type")).cast("int")).orderBy(
        G, "change_rank", path)


def counts(diff: DataFrame, what: str) -> DataFrame:
    """Items per change type, one row per graph."""
    return diff.groupBy(G).agg(*[
        F.count_if(F.col("change_type") == c).alias(f"{c}_{what}") for c in CHANGES])


def architecture_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The eight counts of nodes and edges."""
    return counts(nodes, "nodes").join(counts(edges, "edges"), G, "full_outer").na.fill(0)


def repository_summary(files: DataFrame, folders: DataFrame) -> DataFrame:
    """The seven counts of files and folders."""
    return counts(files, "files").join(
        counts(folders, "folders").drop("modified_folders"), G, "full_outer").na.fill(0)


def reversed_diff(diff: DataFrame) -> DataFrame:
    """The same diff read from V2 to V1."""
    swap = lambda c, x, y: F.when(F.col(c) == x, y).when(F.col(c) == y, x).otherwise(F.col(c))
    return diff.withColumn("change_type", swap("change_type", "added", "removed")).withColumn(
        "version_origin", swap("version_origin", "V1", "V2"))


def reversed_delta(delta: DataFrame) -> DataFrame:
    """The risk delta read from V2 to V1: scores and levels change sides, the difference its sign."""
    return delta.select(
        G, F.col("changed_score").alias("original_score"), F.col("changed_level").alias("original_level"),
        F.col("original_score").alias("changed_score"), F.col("original_level").alias("changed_level"), (-F.col("delta")).alias("delta"),
        _shift(-F.col("delta")).alias("shift"))


def _shift(delta):
    return (F.when(delta > 0, "Higher structural risk").when(delta < 0, "Lower structural risk")
            .otherwise("No structural risk change"))


def reconciled(diff: DataFrame, v1_keys: DataFrame, v2_keys: DataFrame) -> DataFrame:
    """Check that the change counts add up to the distinct keys of each version."""
    c = counts(diff, "items")
    n1 = v1_keys.distinct().groupBy(G).agg(F.count(F.lit(1)).alias("v1_count"))
    n2 = v2_keys.distinct().groupBy(G).agg(F.count(F.lit(1)).alias("v2_count"))
    kept = F.col("modified_items") + F.col("unchanged_items")
    return c.join(n1, G, "left").join(n2, G, "left").na.fill(0).withColumn(
        "reconciled", (F.col("removed_items") + kept == F.col("v1_count"))
        & (F.col("added_items") + kept == F.col("v2_count")))


# --- impact ---------------------------------------------------------------------------------

def directly_changed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Changed nodes and the known ends of added and removed edges."""
    known = nodes.select(G, "key", "node_id")
    touched = edges.filter(F.col("change_type") != "unchanged").select(
        G, F.explode(F.array("src", "dst")).alias("end"))
    ends = touched.select(G, p.node_key(F.col("end")).alias("key")).distinct().join(known, [G, "key"])
    return (nodes.filter(F.col("change_type") != "unchanged").select(G, "node_id")
            .unionByName(ends.select(G, "node_id")).distinct())


def active_edges(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """Edges of V2; of V1 for a graph without any in V2."""
    return links(v2).unionByName(links(v1).join(v2.select(G).distinct(), G, "left_anti"))


def impact_paths(changed: DataFrame, known: DataFrame, edges: DataFrame) -> DataFrame:
    """Callers that reach a changed node, with the smallest shortest path changed -> caller."""
    back = edges.select(G, F.col("dst").alias("src"), F.col("src").alias("dst"))
    walks = w.as_table(w.shortest_walks(back, sources=changed, paths=True))
    return (walks.select(G, F.col("src").alias("changed_id"), F.col("dst").alias("node_id"), "dist", "path")
            .join(changed, [G, "node_id"], "left_anti")
            .join(known.select(G, "node_id").distinct(), [G, "node_id"], "left_semi")
            .select(G, "changed_id", F.col("node_id").alias("impacted_id"), "dist", "path"))


def broken_dependencies(node_change: DataFrame, v1_edges: DataFrame, v2_nodes: DataFrame) -> DataFrame:
    """Edges of V1 whose target was removed while the caller is still there."""
    gone = node_change.filter("change_type = 'removed'").select(G, F.col("node_id").alias("dst"))
    return (v1_edges.join(gone, [G, "dst"], "left_semi")
            .join(v2_nodes.select(G, F.col("node_id").alias("src")), [G, "src"], "left_semi")
            .select(G, "edge_id", "src", "dst"))


def pruned_edges(edge_change: DataFrame, node_change: DataFrame, v2_nodes: DataFrame) -> DataFrame:
    """Removed edges that leave no caller without its target."""
    gone = node_change.filter("change_type = 'removed'").select(
        G, F.col("node_id").alias("dst"), F.lit(True).alias("target_gone"))
    alive = v2_nodes.select(G, F.col("node_id").alias("src"), F.lit(True).alias("caller_alive"))
    return (edge_change.filter("change_type = 'removed'").join(gone, [G, "dst"], "left")
            .join(alive, [G, "src"], "left")
            .filter("NOT (coalesce(target_gone, false) AND coalesce(caller_alive, false))")
            .select(G, "edge_id", "src", "dst", "type"))


def hubs(edges: DataFrame) -> DataFrame:
    """Nodes with three or more edge ends."""
    return (edges.select(G, F.explode(F.array("src", "dst")).alias("node_id")).groupBy(G, "node_id")
            .agg(F.count(F.lit(1)).alias("degree")).filter("degree >= 3").select(G, "node_id"))


def new_in_second(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """Rows (graph_id, node_id) of V2 that V1 does not have."""
    return v2.join(v1, [G, "node_id"], "left_anti")


# fixed values: points per item of each compare factor, in ledger order
COMPARE_FACTORS = (
    ("callers_cut_off", 15.0),
    ("links_added", 4.0),
    ("links_dropped", -3.0),
    ("externals_added", 6.0),
    ("hubs_new", 8.0),
    ("cut_points_new", 12.0),
)
STABLE = "unchanged"


def ledger(graphs: DataFrame, items: list[tuple[str, float, DataFrame]], neutral: str) -> DataFrame:
    """One row per factor with any item, points per item; a graph with none gets a neutral row."""
    parts = [df.groupBy(G).agg(F.count(F.lit(1)).alias("evidence_count")).select(
        G, F.lit(i + 1).alias("line_no"), F.lit(name).alias("factor"),
        F.round(F.col("evidence_count") * each, 1).alias("points"), "evidence_count")
        for i, (name, each, df) in enumerate(items)]
    listed = stage(union_all(parts)).df
    calm = graphs.join(listed.select(G).distinct(), G, "left_anti").select(
        G, F.lit(0).alias("line_no"), F.lit(neutral).alias("factor"), F.lit(0.0).alias("points"),
        F.lit(0).cast("long").alias("evidence_count"))
    return listed.unionByName(calm)


def compare_ledger(graphs: DataFrame, broken: DataFrame, edge_change: DataFrame, pruned: DataFrame,
                   node_change: DataFrame, new_hubs: DataFrame, new_cuts: DataFrame) -> DataFrame:
    """Attribution of the risk change between two versions."""
    added = edge_change.filter("change_type = 'added'")
    external = node_change.filter("change_type = 'added' AND type = 'External System'")
    frames = (broken, added, pruned, external, new_hubs, new_cuts)
    return ledger(graphs, [(n, each, df) for (n, each), df in zip(COMPARE_FACTORS, frames)], STABLE)


def risk_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Score, level and shift between two system-risk tables."""
    a = before.select(G, F.col("system_risk").alias("original_score"), F.col("system_level").alias("original_level"))
    b = after.select(G, F.col("system_risk").alias("changed_score"), F.col("system_level").alias("changed_level"))
    delta = F.round(F.col("changed_score") - F.col("original_score"), 1)
    return a.join(b, G).withColumn("delta", delta).withColumn("shift", _shift(F.col("delta")))


def compare_story(summary: DataFrame, delta: DataFrame, changed: DataFrame, impacted: DataFrame) -> DataFrame:
    """The change in three lines of text."""
    c = changed.groupBy(G).agg(F.count(F.lit(1)).alias("changed"))
    i = impacted.select(G, "impacted_id").distinct().groupBy(G).agg(F.count(F.lit(1)).alias("impacted"))
    row = summary.join(delta, G).join(c, G, "left").join(i, G, "left").na.fill(0, ["changed", "impacted"])
    lines = F.array(
        F.format_string("Components: %d new, %d gone, %d changed; links: %d new, %d gone.",
                        "added_nodes", "removed_nodes", "modified_nodes", "added_edges", "removed_edges"),
        F.format_string("%d component(s) differ; %d reach them.", "changed", "impacted"),
        F.format_string("Risk: %.1f, then %.1f (%s%.1f).",
                        "original_score", "changed_score",
                        F.when(F.col("delta") >= 0, "+").otherwise(""), "delta"))
    return row.select(G, F.posexplode(lines).alias("line_no", "line"))

"""From a file table to a dependency graph: the whole extraction as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as p
from ..operators import extract as x
from ..operators import inventory as inv
from ..operators import register as rg
from ..operators import resolve as rs
from ..operators.graph import G
from ..staging import stage, together, union_all


def extract_graph(files: DataFrame, lines: DataFrame | None = None) -> dict[str, DataFrame]:
    """Files, file dependencies, modules, nodes and edges of every repository.

    ``lines``: those of ``files``, if the caller has staged both.
    """
    if lines is None:
        files = stage(files).df
        lines = stage(x.code_lines(files)).df
    imports = stage(x.import_hits(lines)).df
    artefacts = x.artefact_hits(lines).withColumn("items", F.lit(None).cast("array<string>"))
    columns = [G, "path", "line", "kind", "spec", "type", "method", "items"]
    hits = stage(imports.select(*columns).unionByName(artefacts.select(*columns))).df
    resolved = stage(rs.resolve(hits, files)).df
    route = stage(x.routes(lines)).df
    calls = stage(rs.match_endpoints(x.endpoint_calls(lines), route)).df
    by_call = calls.groupBy(G, "src_path", "dst_path").agg(F.min(F.struct("line", "statement")).alias("c")).select(
        G, "src_path", "dst_path", F.lit("CALLS").alias("type"), F.col("c.line").alias("line"),
        F.col("c.statement").alias("spec"), F.lit("REST API Call").alias("method"))
    deps = stage(rs.file_dependencies(resolved).unionByName(by_call)).df

    found = stage(x.manifests(files)).df
    from_manifest = x.manifest_edges(found)
    c_nodes, c_edges = x.compose(lines)
    k_nodes, k_edges = x.kubernetes(lines)
    parts = stage(x.subsystem_files(files)).df
    mods = stage(inv.modules(files)).df

    def sighting(df, order, **given):
        cols = {"name": F.col("node_id"), "type": F.lit("Service"), "technology": F.lit("Generic"),
                "folder": F.lit(None).cast("string"), "path": F.lit(None).cast("string")} | given
        return df.select(G, "node_id", F.lit(order).alias("rank"), *[c.alias(n) for n, c in cols.items()])
    plain = lambda *names: {n: F.col(n) for n in names}
    early = union_all([
        sighting(c_nodes, 1, **plain("name", "type", "technology", "path")),
        sighting(found, 2, **plain("name", "type", "technology", "path", "folder")),
        sighting(from_manifest.withColumnRenamed("dst", "node_id"), 3, type=F.col("dst_type"), path=F.col("path")),
        sighting(k_nodes, 4, **plain("type", "path")),
        sighting(x.datasources(lines), 5, name=F.col("name"), type=F.lit("Database"), technology=F.col("technology"), path=F.col("path")),
        sighting(parts, 6, **plain("type", "technology", "path"))])
    early = stage(early).df
    grown = inv.elevate_modules(mods, early.select(G, "node_id", "type").distinct())
    grown = sighting(grown, 7, **plain("name", "type", "technology", "folder"))
    api = stage(x.api_nodes(lines)).df
    java_routes = stage(x.spring_routes(files, lines)).df
    named = [G, "path", "line", "verb", "endpoint"]
    open_api = stage(x.exposed(route.select(*named).unionByName(java_routes.select(*named)).distinct())).df
    marks, hosts = (t.df for t in together(lambda: stage(x.marker_hits(lines)), lambda: stage(x.host_calls(lines))))
    late = union_all([grown, sighting(api, 8, name=F.col("name"), type=F.lit("API"), technology=F.lit("REST API Endpoint")),
                      sighting(hosts, 9, technology=F.lit("HTTP Microservice")),
                      sighting(marks, 10, type=F.col("node_type")),
                      sighting(open_api, 11, name=F.col("name"), type=F.lit("API"), technology=F.lit("REST API Endpoint"))])
    seen = stage(early.unionByName(late)).df
    # one global order of sightings: family, then path, then name
    order = F.concat_ws("|", F.lpad(F.col("rank").cast("string"), 3, "0"), F.coalesce("path", F.lit("")), "node_id")
    nodes = rg.merge_nodes(seen.withColumn("pos", order).withColumn("description", F.lit(None).cast("string")))
    nodes = _with_fallback(files, stage(nodes).df)
    home = seen.filter("folder IS NOT NULL").groupBy(G, "node_id").agg(F.min("folder").alias("folder"))
    nodes = stage(nodes.join(home, [G, "node_id"], "left")).df
    node_files = seen.filter("path IS NOT NULL").select(G, "node_id", "path").distinct()
    owner = stage(rs.owning_node(files, nodes.filter("type <> 'API'"), node_files)).df
    file_module = stage(rs.owning_module(files, mods.withColumn("pos", F.length("folder")))).df
    module_deps = stage(rs.module_dependencies(deps, file_module)).df

    def edge(df, src, dst, kind, protocol, order, path=None, line=None):
        return df.select(G, src.alias("src"), dst.alias("dst"), kind.alias("type"), protocol.alias("protocol"),
                         F.lit(order).alias("rank"), (path if path is not None else F.lit(None).cast("string")).alias("ev_file"),
                         (line if line is not None else F.lit(None).cast("int")).alias("ev_line"))
    c = F.col
    of = lambda df, order: edge(df, c("src"), c("dst"), c("type"), c("protocol"), order, c("path"), c("line"))
    markers = marks.join(owner.select(G, "path", c("node_id").alias("src")), [G, "path"])
    edges = union_all([
        of(c_edges, 1), edge(from_manifest, c("src"), c("dst"), c("type"), c("protocol"), 2, c("path")), of(k_edges, 3),
        of(x.owned_edges(api, owner, "USES", "Internal Route"), 4),
        of(x.owned_edges(hosts, owner, "CALLS", "HTTP / JSON"), 5),
        edge(markers, c("src"), c("node_id"), c("type"), c("protocol"), 6, c("path"), c("line")),
        edge(rs.lift_to_nodes(deps, owner), c("src"), c("dst"), c("type"), F.lit("Cross-Component Reference"), 7, c("ev_file"), c("ev_line")),
        edge(rs.lift_module_dependencies(module_deps, nodes), c("src"), c("dst"), c("type"), F.lit("Internal Import"), 8),
        of(x.owned_edges(open_api, owner, "EXPOSES", "HTTP Endpoint"), 9), of(x.repository_stores(lines, nodes, owner), 10)])
    at = F.concat_ws("|", F.lpad(c("rank").cast("string"), 3, "0"), F.coalesce("ev_file", F.lit("")),
                     F.lpad(F.coalesce(c("ev_line"), F.lit(0)).cast("string"), 9, "0"))
    unique = rg.dedupe_edges(edges.withColumn("pos", at).drop("rank")).withColumn(
        "edge_id", F.concat_ws("-", F.lit("rel"), "src", "dst", F.lower("type")))
    kept, dangling = rg.prune_dangling(nodes, unique)
    kept = stage(kept).df
    mapped = seen.filter("path IS NOT NULL").groupBy(G, "path").agg(F.min("name").alias("node_name"))
    return {"files": files, "lines": lines, "hits": hits, "resolved": resolved, "routes": route, "java_routes": java_routes, "calls": calls, "deps": deps,
            "modules": mods, "file_module": file_module, "module_deps": module_deps, "nodes": nodes, "owner": owner,
            "edges": kept, "dangling": dangling, "manifests": found, "subsystem_files": parts,
            "frameworks": x.frameworks(files), "inventory": inv.inventory(files), "status": inv.analysis_status(files, mapped, deps),
            "flags": inv.limited_flags(files, nodes, kept), "stats": rg.model_stats(nodes, kept)}


def _with_fallback(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes, and one application for each graph in which nothing was found."""
    core = inv.fallback_nodes(files, nodes, files.select(G, F.col(G).alias("archive")).distinct())
    return nodes.unionByName(core.select(
        *[F.col(c) if c in core.columns else F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in nodes.columns]))

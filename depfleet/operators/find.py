"""Filters, searches, look-ups and extraction accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import line_range
from .graph import G
from .ranking import top_k

ALL = "ALL"
MANIFEST_SUFFIXES = ("package.json", "pom.xml", "requirements.txt", "go.mod", "build.gradle", "Cargo.toml")  # fixed values
NO_SNIPPET = "No source lines stored."


def _has(query: str, *fields: str) -> Column:
    """Any field holds the trimmed query, whatever its case; an empty query holds everywhere."""
    wanted = query.lower().strip()
    if not wanted:
        return F.lit(True)
    hit = F.lit(False)
    for field in fields:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(field), F.lit(""))), F.lit(wanted))
    return hit


def _is(field: str, value: str) -> Column:
    return F.lit(True) if value == ALL else F.col(field) == value


def edge_filter(edges: DataFrame, kind: str = ALL, confidence: str = ALL, query: str = "") -> DataFrame:
    return edges.filter(_is("type", kind) & _is("ev_confidence", confidence)
                        & _has(query, "src", "dst", "protocol", "ev_file"))


def evidence_list(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Evidence of edges, and of nodes that name a file, with defaults filled in."""
    of_edges = edges.filter(F.col("ev_file").isNotNull()).select(
        G, F.concat(F.lit("rel-"), "edge_id").alias("item_id"), F.col("src").alias("source_name"),
        F.col("dst").alias("target_name"), "type", F.col("ev_file").alias("file"),
        line_range(F.col("ev_line"), F.col("ev_line_end")).alias("line_range"),
        F.coalesce("ev_snippet", F.lit(NO_SNIPPET)).alias("snippet"),
        F.coalesce("ev_confidence", F.lit("HIGH")).alias("confidence"),
        F.coalesce("ev_method", F.lit("AST Dependency Scanner")).alias("method"),
        F.coalesce("description", F.concat_ws(" ", "src", "type", "dst")).alias("description"))
    of_nodes = nodes.filter(F.col("ev_file").isNotNull()).select(
        G, F.concat(F.lit("ent-"), "node_id").alias("item_id"), F.col("name").alias("source_name"),
        F.lit(None).cast("string").alias("target_name"), "type", F.col("ev_file").alias("file"),
        F.lit(None).cast("string").alias("line_range"), F.lit(NO_SNIPPET).alias("snippet"),
        F.lit("HIGH").alias("confidence"),
        F.when(F.col("source") == "Detected", "AST Module Parser").otherwise("Manifest Scanner").alias("method"),
        F.coalesce("description", F.format_string(
            'Discovered %s component "%s" defined in %s', "type", "name", "ev_file")).alias("description"))
    return of_edges.unionByName(of_nodes)


def evidence_filter(items: DataFrame, confidence: str = ALL, query: str = "") -> DataFrame:
    return items.filter(_is("confidence", confidence)
                        & _has(query, "file", "source_name", "target_name", "description"))


def evidence_kpis(items: DataFrame) -> DataFrame:
    return items.groupBy(G).agg(
        F.count_if(F.col("confidence") == "HIGH").alias("high_confidence"),
        F.count_if(F.col("method").contains("AST")).alias("ast"),
        F.count_if(F.col("method").contains("Manifest")).alias("manifest"))


def finding_filter(found: DataFrame, severity: str = ALL, query: str = "") -> DataFrame:
    return found.filter(_is("severity", severity) & _has(query, "title", "component_id", "category"))


def file_filter(files: DataFrame, category: str = ALL, query: str = "", manifests_only: bool = False) -> DataFrame:
    kept = files.filter(_is("category", category) & _has(query, "path", "language"))
    if manifests_only:
        suffix = F.lit(False)
        for ending in MANIFEST_SUFFIXES:
            suffix = suffix | F.col("path").endswith(ending)
        kept = kept.filter(suffix)
    return kept


def code_slice(files: DataFrame, deps: DataFrame, kind: str = ALL, service: str = ALL, dep_type: str = ALL,
               query: str = "") -> tuple[DataFrame, DataFrame]:
    """Files that pass the filters, and the dependencies with both ends among them."""
    shown = files.filter(_is("category", kind) & _is("node_id", service) & _has(query, "path", "name"))
    ids = shown.select(G, "path")
    edges = (deps.filter(_is("type", dep_type))
             .join(ids.withColumnRenamed("path", "src_path"), [G, "src_path"], "left_semi")
             .join(ids.withColumnRenamed("path", "dst_path"), [G, "dst_path"], "left_semi"))
    return shown, edges


def search_index(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """One row per thing that can be found: components, dependencies, files, evidence."""
    def rows(df, order, category, key, title, subtitle, badge, pos):
        return df.select(G, F.lit(order).alias("kind_no"), F.lit(category).alias("category"), key.alias("item_id"),
                         title.alias("title"), subtitle.alias("subtitle"), badge.alias("badge"), pos.alias("pos"))
    about = F.concat(F.col("type"), F.lit(" • "), F.coalesce("technology", F.lit("")), F.lit(" "),
                     F.coalesce(F.concat(F.lit("• "), "description"), F.lit("")))
    return (rows(nodes, 1, "component", F.concat(F.lit("entity-"), "node_id"), F.col("name"), about,
                 F.upper("type"), F.col("pos").cast("string"))
            .unionByName(rows(edges, 2, "dependency", F.concat(F.lit("rel-"), "edge_id"),
                              F.concat(F.col("src"), F.lit(" → "), F.col("dst")),
                              F.format_string("%s via %s (Confidence: %s)", "type",
                                              F.coalesce("protocol", F.lit("Default")),
                                              F.coalesce("ev_confidence", F.lit("MEDIUM"))),
                              F.lit("DEPENDENCY"), F.col("pos").cast("string")))
            .unionByName(rows(files, 3, "file", F.concat(F.lit("file-"), "path"), F.col("path"),
                              F.format_string("Size: %.1f KB • Status: %s", F.col("size_bytes") / 1024.0,
                                              F.coalesce("analysis_status", F.lit("Retained"))),
                              F.lit("FILE"), F.col("path")))
            .unionByName(rows(edges.filter(F.col("ev_file").isNotNull()), 4, "evidence",
                              F.concat(F.lit("evidence-"), "edge_id"), F.concat(F.lit("Citation in "), "ev_file"),
                              F.coalesce("description", F.concat_ws(" ", "src", "type", "dst")),
                              F.lit("EVIDENCE"), F.col("pos").cast("string"))))


def global_search(index: DataFrame, query: str = "", category: str = "all", k: int | None = None) -> DataFrame:
    """All hits, or the first ``k`` per graph by kind and position with their ``place``."""
    hits = index if category == "all" else index.filter(F.col("category") == category)
    hits = hits.filter(_has(query, "title", "subtitle", "badge"))
    return hits if k is None else top_k(hits, [G], ["kind_no", F.length("pos"), "pos", "item_id"], k)


def node_match(nodes: DataFrame, asked: str) -> DataFrame:
    """First node per graph whose name or id equals the text, or whose name and the text contain each other."""
    text = asked.lower()
    name, key = F.lower("name"), F.lower("node_id")
    hit = (name == text) | (key == text) | F.contains(F.lit(text), name) | F.contains(name, F.lit(text))
    return nodes.filter(hit).groupBy(G).agg(
        F.min_by("node_id", "pos").alias("node_id"), F.min_by("name", "pos").alias("name"))


def direct_neighbours(edges: DataFrame, nodes: DataFrame, node_id: str | None = None) -> DataFrame:
    """Who depends on a node and what it depends on, with names and protocol."""
    calls = edges.select(G, F.col("dst").alias("node_id"), F.lit("depends on it").alias("role"),
                         F.col("src").alias("other_id"), F.coalesce("protocol", "type").alias("via"), "edge_id")
    needs = edges.select(G, F.col("src").alias("node_id"), F.lit("it depends on").alias("role"),
                         F.col("dst").alias("other_id"), F.coalesce("protocol", "type").alias("via"), "edge_id")
    both = calls.unionByName(needs)
    if node_id is not None:
        both = both.filter(F.col("node_id") == node_id)
    names = nodes.select(G, F.col("node_id").alias("other_id"), F.col("name").alias("other_name"))
    return both.join(names, [G, "other_id"], "left").withColumn("other_name", F.coalesce("other_name", "other_id"))


def incident_edges(edges: DataFrame, node_id: str) -> DataFrame:
    """Edges at a node and their other end."""
    return edges.filter((F.col("src") == node_id) | (F.col("dst") == node_id)).select(
        G, "edge_id", F.when(F.col("src") == node_id, F.col("dst")).otherwise(F.col("src")).alias("other_id"))


def impact_rows(walks: DataFrame) -> DataFrame:
    """Transitive callers and callees of every node, with a flag for direct ones."""
    up = walks.select(G, F.col("dst").alias("node_id"), F.lit("upstream").alias("side"),
                      F.col("src").alias("other_id"), (F.col("dist") == 1).alias("is_direct"))
    down = walks.select(G, F.col("src").alias("node_id"), F.lit("downstream").alias("side"),
                        F.col("dst").alias("other_id"), (F.col("dist") == 1).alias("is_direct"))
    return up.unionByName(down)


def blast_split(metrics: DataFrame) -> DataFrame:
    """Direct callers and those further up."""
    return metrics.select(G, "node_id", F.col("in_degree").alias("direct_callers"),
                          (F.col("blast_radius") - F.col("in_degree")).alias("transitive_callers"))


def cascade(metrics: DataFrame) -> DataFrame:
    """Share of the graph that goes with each node, and a label for it."""
    n = metrics.groupBy(G).agg(F.count(F.lit(1)).alias("n"))
    total = F.col("blast_radius") + 1
    return metrics.join(n, G).select(
        G, "node_id", total.alias("affected_total"), F.round(total * 100.0 / F.col("n"), 0).alias("blast_pct"),
        F.when(total > 5, "High").when(total > 2, "Moderate").otherwise("Low").alias("cascade"))


def counts_by_type(nodes: DataFrame) -> DataFrame:
    """Nodes per asked-for type; controllers count as services."""
    low = F.lower("type")
    return nodes.groupBy(G).agg(
        F.count_if(low.isin("service", "controller")).alias("services"),
        F.count_if(low == "database").alias("databases"), F.count_if(low == "api").alias("apis"),
        F.count(F.lit(1)).alias("total"))


def nodes_of_type(nodes: DataFrame, kind: str) -> DataFrame:
    wanted = ("service", "controller") if kind == "service" else (kind,)
    return nodes.filter(F.lower("type").isin(*wanted))


def file_lookup(files: DataFrame, asked: str) -> DataFrame:
    """Files whose path ends with the text or whose name is the text."""
    text = asked.lower()
    return files.filter(F.lower("path").endswith(text) | (F.lower("name") == text))


def node_evidence(edges: DataFrame) -> DataFrame:
    """First edge with a snippet at each node."""
    cited = edges.filter(F.coalesce(F.col("ev_snippet"), F.lit("")) != "")
    return cited.select(G, F.explode(F.array("src", "dst")).alias("node_id"), "pos", "edge_id", "ev_file").groupBy(
        G, "node_id").agg(F.min_by("edge_id", "pos").alias("edge_id"), F.min_by("ev_file", "pos").alias("ev_file"))


def node_slice(nodes: DataFrame, crit: DataFrame, spof: DataFrame, cycle_nodes: DataFrame, edges: DataFrame,
               kind: str = ALL, query: str = "", risk: str = ALL, edge_type: str = ALL) -> DataFrame:
    """Nodes by type, text and risk flag; an edge type keeps the nodes at such an edge."""
    kept = nodes.filter(_is("type", kind) & _has(query, "name", "technology", "node_id"))
    key = [G, "node_id"]
    if risk == "SPOF":
        kept = kept.join(spof.filter("is_spof").select(*key), key, "left_semi")
    elif risk == "CYCLE":
        kept = kept.join(cycle_nodes, key, "left_semi")
    elif risk != ALL:
        kept = kept.join(crit.filter(F.col("tier") == risk).select(*key), key, "left_semi")
    if edge_type != ALL:
        at = edges.filter(F.col("type") == edge_type).select(G, F.explode(F.array("src", "dst")).alias("node_id"))
        kept = kept.join(at, key, "left_semi")
    return kept


def edge_risk_slice(risk: DataFrame, at_least: str = "HIGH") -> DataFrame:
    levels = ("CRITICAL",) if at_least == "CRITICAL" else ("CRITICAL", "HIGH")
    return risk.filter(F.col("risk_level").isin(*levels))


# --- extraction accuracy ----------------------------------------------------------------------

def _scores(tp: str, fp: str, fn: str, what: str) -> list[Column]:
    t, p, n = F.col(tp), F.col(fp), F.col(fn)
    precision = F.when(t + p > 0, t / (t + p)).otherwise(1.0)
    recall = F.when(t + n > 0, t / (t + n)).otherwise(1.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return [precision.alias(f"{what}_precision"), recall.alias(f"{what}_recall"), f1.alias(f"{what}_f1")]


def _tally(found: DataFrame, truth: DataFrame, key: list[str], group: list[str]) -> DataFrame:
    """TP, FP, FN per group; each truth row is matched at most once, by counting rows per key."""
    a = found.groupBy(*key).agg(F.count(F.lit(1)).alias("f"))
    b = truth.groupBy(*key).agg(F.count(F.lit(1)).alias("t"))
    both = a.join(b, key, "full_outer").na.fill(0, ["f", "t"])
    return both.groupBy(*group).agg(
        F.sum(F.least("f", "t")).alias("tp"), F.sum(F.greatest(F.col("f") - F.col("t"), F.lit(0))).alias("fp"),
        F.sum(F.greatest(F.col("t") - F.col("f"), F.lit(0))).alias("fn"))


def node_accuracy(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and F1 of detected node ids."""
    row = _tally(found.select(G, "node_id").distinct(), truth.select(G, "node_id").distinct(), [G, "node_id"], [G])
    return row.select(G, "tp", "fp", "fn", *_scores("tp", "fp", "fn", "node"))


def edge_accuracy(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and F1 of detected edges by (src, dst), one truth edge per detected edge."""
    row = _tally(found, truth, [G, "src", "dst"], [G])
    return row.select(G, "tp", "fp", "fn", *_scores("tp", "fp", "fn", "edge"))


def edge_accuracy_by_type(found: DataFrame, truth: DataFrame) -> DataFrame:
    """The same per edge type over all graphs."""
    row = _tally(found, truth, [G, "src", "dst", "type"], ["type"])
    return row.select("type", "tp", "fp", "fn", *_scores("tp", "fp", "fn", "edge"))


def macro_average(rows: DataFrame) -> DataFrame:
    """Plain mean of the scores over graphs."""
    scores = [c for c in rows.columns if c.rsplit("_", 1)[-1] in ("precision", "recall", "f1")]
    return rows.agg(*[F.avg(c).alias(c) for c in scores])


def evidence_validity(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Percentage of edges whose evidence names an existing file, a line, a snippet and a method."""
    known = files.select(G, F.col("path").alias("ev_file"), F.lit(True).alias("exists")).distinct()
    row = edges.join(known, [G, "ev_file"], "left")
    manifest = F.lit(False)
    for name in ("package.json", "requirements.txt", "pom.xml"):
        manifest = manifest | F.col("ev_file").contains(name)
    valid = (F.col("exists") & (F.coalesce(F.col("ev_line") > 0, F.lit(False)) | manifest)
             & (F.length("ev_snippet") > 0) & (F.length("ev_method") > 0))
    return row.groupBy(G).agg(F.count(F.lit(1)).alias("edge_count"), F.count_if(valid).alias("valid")).withColumn(
        "validity_pct", F.round(F.col("valid") * 100.0 / F.col("edge_count"), 4))

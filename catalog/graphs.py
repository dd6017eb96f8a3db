"""Queries over the fleet: graph operators (f) and scoring (g)."""

from __future__ import annotations

from pyspark.sql import functions as F

from depfleet.functions.tiers import fair_round
from depfleet.operators import graph as gr
from depfleet.operators import lite as lt
from depfleet.operators import score as sc
from depfleet.operators import walks as wk
from depfleet.operators.reach import reach_sizes
from depfleet.staging import stage

from . import graph_sql  # noqa: F401
from .base import memo, query
from .worlds import analysis, cycle_list, fleet, supply


def text(column):
    """Arrays leave as text, so every engine compares them alike."""
    return F.array_join(column, " > ")


def _links(spark, sf):
    return gr.links(fleet(spark, sf)[1])


@query("f01_simple_digraph", """SELECT graph_id, src, dst, max_by(edge_id, pos) AS edge_id, max_by(type, pos) AS type,
 coalesce(max_by(coalesce(protocol, 'Default'), pos), 'Default') AS protocol
FROM fleet_edges GROUP BY graph_id, src, dst""")
def simple_digraph(spark, sf):
    return gr.simple_edges(fleet(spark, sf)[1]).select("graph_id", "src", "dst", "edge_id", "type", "protocol")


@query("f01_vertices", """SELECT x.g AS graph_id, x.v AS node_id, coalesce(d.type, 'Service') AS type, (d.v IS NOT NULL) AS declared
FROM vx x LEFT JOIN decl d ON d.g = x.g AND d.v = x.v""")
def vertices(spark, sf):
    return gr.vertices(*fleet(spark, sf)).select("graph_id", "node_id", "type", "declared")


@query("f02_graph_status", """SELECT z.g AS graph_id, z.n AS node_count, z.e AS edge_count, z.n = 0 AS is_empty, w.p AS weak_components
FROM sz z JOIN (SELECT g, count(DISTINCT c) AS p FROM weak GROUP BY g) w ON w.g = z.g""")
def graph_status(spark, sf):
    a = analysis(spark, sf)
    weak = a["weak"].groupBy("graph_id").agg(F.count_if(F.col("component") == F.col("node_id")).alias("weak_components"))
    return a["size"].join(weak, "graph_id").withColumn("is_empty", F.col("node_count") == 0)


@query("f03_degrees", "SELECT g AS graph_id, v AS node_id, ind AS in_degree, outd AS out_degree, ind + outd AS total_degree FROM deg")
def degrees(spark, sf):
    n, e = fleet(spark, sf)
    return gr.degrees(gr.vertices(n, e), gr.links(e))


@query("f03_degrees_supply", """SELECT v AS node_id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (
SELECT src AS v, 0 AS i, 1 AS o FROM supply_edges UNION ALL SELECT dst, 1, 0 FROM supply_edges) x GROUP BY v""")
def degrees_supply(spark, sf):
    link = supply(spark, sf)
    return gr.degrees(_ends(link), link).select("node_id", "in_degree", "out_degree")


def _ends(link):
    return link.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()


@query("f04_adjacency", """SELECT g AS graph_id, dst AS node_id, 'caller' AS side, src AS other_id FROM lk
UNION ALL SELECT g, src, 'callee', dst FROM lk""")
def adjacency(spark, sf):
    return gr.adjacency(_links(spark, sf))


@query("f05_closure", "SELECT g AS graph_id, s AS src, t AS dst, d AS dist FROM dist")
def closure(spark, sf):
    return wk.closure(_links(spark, sf))


@query("f06_blast_radius", "SELECT g AS graph_id, v AS node_id, blast AS blast_radius, foot AS footprint FROM reach")
def blast_radius(spark, sf):
    n, e = fleet(spark, sf)
    return reach_sizes(gr.vertices(n, e), gr.links(e))


@query("f06_blast_radius_supply", """SELECT v AS node_id, CAST(sum(b) AS BIGINT) AS blast_radius, CAST(sum(f) AS BIGINT) AS footprint
FROM (SELECT t AS v, 1 AS b, 0 AS f FROM supply_reach UNION ALL SELECT s, 0, 1 FROM supply_reach) x GROUP BY v""")
def blast_radius_supply(spark, sf):
    link = supply(spark, sf)
    return reach_sizes(_ends(link), link).drop("graph_id")


@query("f07_shortest_paths", "SELECT g AS graph_id, s AS src, t AS dst, d AS dist, array_to_string(path, ' > ') AS path FROM sp WHERE s <> t")
def shortest_paths(spark, sf):
    return analysis(spark, sf)["walks"].select("graph_id", "src", "dst", "dist", text(F.col("path")).alias("path"))


LONGEST = """SELECT g AS graph_id, {end} AS node_id, len(p) - 1 AS depth, array_to_string(p, ' > ') AS path FROM (
SELECT g, {end}, min_by(path, (-len(path), path)) AS p FROM simple_path GROUP BY g, {end}) x"""


@query("f08_longest_downstream", LONGEST.format(end="s").replace("len(p) - 1", "CAST(len(p) - 1 AS INT)"))
def longest_downstream(spark, sf):
    a = analysis(spark, sf)
    return wk.longest_paths(a["vertex"], a["link"], labels=a["strong"]).withColumn("path", text(F.col("path")))


@query("f08_longest_upstream", LONGEST.format(end="t").replace("len(p) - 1", "CAST(len(p) - 1 AS INT)"))
def longest_upstream(spark, sf):
    a = analysis(spark, sf)
    return wk.longest_paths(a["vertex"], a["link"], upstream=True, labels=a["strong"]).withColumn("path", text(F.col("path")))


@query("f09_transit_samples", """SELECT g AS graph_id, v AS node_id, k AS sample_no, array_to_string(path, ' > ') AS path FROM (
SELECT u.g, u.v, p.path, CAST(row_number() OVER (PARTITION BY u.g, u.v ORDER BY u.e, w.e) AS INT) AS k
FROM (SELECT g, t AS v, s AS e, row_number() OVER (PARTITION BY g, t ORDER BY s) AS r FROM dist) u
JOIN (SELECT g, s AS v, t AS e, row_number() OVER (PARTITION BY g, s ORDER BY t) AS r FROM dist) w
  ON w.g = u.g AND w.v = u.v AND w.r <= 10 AND u.r <= 10 AND u.e <> w.e
JOIN sp p ON p.g = u.g AND p.s = u.e AND p.t = w.e AND list_contains(p.path[2:len(p.path) - 1], u.v)) x WHERE k <= 3""")
def transit_samples(spark, sf):
    return wk.transit_samples(analysis(spark, sf)["walks"]).withColumn("path", text(F.col("path")))


@query("f10_betweenness", f"SELECT g AS graph_id, v AS node_id, {graph_sql.fair('cb', 4)} AS betweenness FROM btw")
def betweenness(spark, sf):
    n, e = fleet(spark, sf)
    return wk.betweenness(gr.vertices(n, e), gr.links(e)).select("graph_id", "node_id", fair_round(F.col("betweenness"), 4).alias("betweenness"))


@query("f11_pagerank", f"SELECT g AS graph_id, v AS node_id, {graph_sql.fair('r', 6)} AS pagerank FROM rank_of")
def pagerank(spark, sf):
    n, e = fleet(spark, sf)
    return wk.pagerank(gr.vertices(n, e), gr.links(e)).select("graph_id", "node_id", fair_round(F.col("pagerank"), 6).alias("pagerank"))


@query("f12_weak_components", "SELECT g AS graph_id, v AS node_id, c AS component FROM weak")
def weak_components(spark, sf):
    n, e = fleet(spark, sf)
    return gr.weak_labels(gr.vertices(n, e), gr.links(e))


@query("f12_weak_components_supply", "SELECT v AS node_id, (SELECT min(src) FROM supply_edges) AS component FROM (SELECT src AS v FROM supply_edges UNION SELECT dst FROM supply_edges) x")
def weak_components_supply(spark, sf):
    link = supply(spark, sf)
    return gr.weak_labels(_ends(link), link).drop("graph_id")


@query("f13_strong_components", "SELECT g AS graph_id, v AS node_id, c AS component FROM scc")
def strong_components(spark, sf):
    n, e = fleet(spark, sf)
    return gr.strong_labels(gr.vertices(n, e), gr.links(e))


@query("f14_condensation_depth", "SELECT g AS graph_id, depth AS max_dependency_depth FROM depth")
def condensation_depth(spark, sf):
    a = analysis(spark, sf)
    return gr.condensation_depth(a["link"], a["strong"])


@query("f15_simple_cycles", "SELECT g AS graph_id, k AS cycle_no, array_to_string(path, ' > ') AS path FROM cyc")
def simple_cycles(spark, sf):
    return cycle_list(spark, sf).withColumn("path", text(F.col("path")))


@query("f16_cycle_edges", "SELECT g AS graph_id, src, dst FROM cyc_edge")
def cycle_edges(spark, sf):
    a = analysis(spark, sf)
    return wk.cycle_edges(a["link"], a["strong"])


@query("f16_cycle_nodes", "SELECT g AS graph_id, v AS node_id FROM cyc_node")
def cycle_nodes(spark, sf):
    a = analysis(spark, sf)
    return wk.cycle_nodes(a["link"], a["strong"])


@query("f17_severed_pairs", "SELECT g AS graph_id, s AS src, t AS dst, v AS via FROM sev")
def severed_pairs(spark, sf):
    a = analysis(spark, sf)
    return wk.severed_pairs(a["link"], a["walks"])


@query("f18_shared_sinks", "SELECT m.g AS graph_id, m.v AS node_id, m.ind AS callers, m.blast AS blast_radius FROM met m JOIN shared s ON s.g = m.g AND s.v = m.v")
def shared_sinks(spark, sf):
    return sc.shared_sinks(analysis(spark, sf)["metrics"]).select(
        "graph_id", "node_id", F.col("in_degree").alias("callers"), "blast_radius")


@query("f18_affected", "SELECT g AS graph_id, v AS node_id, a AS affected_id FROM aff")
def affected(spark, sf):
    a = analysis(spark, sf)
    return sc.spof_affected(a["metrics"], a["severed"], a["walks"])


@query("f19_spof", """SELECT g AS graph_id, v AS node_id, is_spof, spof_type, lost AS disconnected_paths, aff_n AS affected_count,
 NOT is_spof AS has_alternate_path, severity FROM spof""")
def spof(spark, sf):
    a = analysis(spark, sf)
    return sc.spofs(a["metrics"], a["severed"], a["affected"], a["size"]).drop("pos", "name", "type", "in_degree")


@query("f19_spof_explained", """SELECT s.g AS graph_id, s.v AS node_id, CASE
 WHEN NOT s.is_spof THEN 'Without ''' || s.name || ''' all others still reach what they reached before.'
 WHEN s.spof_type = 'SHARED_DATASTORE' THEN s.ind || ' component(s) call ''' || s.name || ''' directly and stop with it: ' || f.t || CASE WHEN s.aff_n > 3 THEN ' and more' ELSE '' END || '.'
 ELSE '''' || s.name || ''' is on every route of ' || s.lost || ' pair(s); without it ' || s.aff_n || ' component(s) lose a connection: ' || f.t || CASE WHEN s.aff_n > 3 THEN ' and more' ELSE '' END || '.' END AS explanation
FROM spof s LEFT JOIN (SELECT g, v, string_agg(nm, ', ' ORDER BY a) AS t FROM (
 SELECT x.g, x.v, x.a, coalesce(d.name, x.a) AS nm, row_number() OVER (PARTITION BY x.g, x.v ORDER BY x.a) AS r
 FROM aff x LEFT JOIN decl d ON d.g = x.g AND d.v = x.a) y WHERE r <= 3 GROUP BY g, v) f ON f.g = s.g AND f.v = s.v""")
def spof_explained(spark, sf):
    a = analysis(spark, sf)
    return sc.spof_explained(a["spof"], a["affected"], a["nodes"]).select("graph_id", "node_id", "explanation")


@query("f20_severed_path_samples", """SELECT x.g AS graph_id, x.v AS node_id, x.kind, x.k AS place, array_to_string(x.path, ' > ') AS path FROM (
SELECT s.g, s.v, 'transit' AS kind, CAST(row_number() OVER (PARTITION BY s.g, s.v ORDER BY s.s, s.t) AS INT) AS k, p.path, 6 AS cap
FROM sev s JOIN sp p ON p.g = s.g AND p.s = s.s AND p.t = s.t
UNION ALL
SELECT h.g, h.dst, 'shared', CAST(row_number() OVER (PARTITION BY h.g, h.dst ORDER BY h.src) AS INT), [h.src, h.dst], 4
FROM hop h JOIN shared z ON z.g = h.g AND z.v = h.dst) x JOIN decl d ON d.g = x.g AND d.v = x.v WHERE x.k <= x.cap""")
def severed_path_samples(spark, sf):
    a = analysis(spark, sf)
    return sc.severed_path_samples(a["metrics"], a["severed"], a["walks"], a["link"]).withColumn("path", text(F.col("path")))


@query("f21_cut_vertices", """SELECT DISTINCT u.g AS graph_id, x.v AS node_id FROM dclo u JOIN decl x ON x.g = u.g AND x.v <> u.a AND x.v <> u.b AND u.a <> u.b
WHERE NOT EXISTS (SELECT 1 FROM uban b WHERE b.g = u.g AND b.v = x.v AND b.a = u.a AND b.b = u.b)""")
def cut_vertices(spark, sf):
    n, e = fleet(spark, sf)
    link = stage(gr.links(e)).df
    known = n.select("graph_id", "node_id")
    inner = (link.join(known.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi")
             .join(known.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"], "left_semi"))
    return wk.cut_vertices(n, inner, stage(gr.weak_labels(known, inner)).df)


@query("f22_complexity", """SELECT g AS graph_id, n AS node_count, e AS edge_count, avgdeg AS average_degree, density,
 cyclo AS cyclomatic_complexity, depth AS max_dependency_depth, cycles AS cycles_count, sccs AS scc_count,
 p AS weak_components, points, rating AS complexity_rating FROM cx""")
def complexity(spark, sf):
    return gr.cycle_counts(analysis(spark, sf)["complexity"], cycle_list(spark, sf)).drop("cycles_least")


@query("f22_complexity_summary", """SELECT g AS graph_id, 'Complexity ' || rating || ': density ' || printf('%.2f', density * 100) || '%, cyclomatic number ' || cyclo || '.'
 || CASE WHEN cycles > 0 THEN ' ' || cycles || ' cycle(s).' ELSE '' END
 || ' Depth ' || depth || CASE WHEN depth >= 4 THEN ', which is deep.' ELSE '.' END AS summary FROM cx""")
def complexity_summary(spark, sf):
    return gr.complexity_summary(gr.cycle_counts(analysis(spark, sf)["complexity"], cycle_list(spark, sf))).select("graph_id", "summary")


@query("f23_tier_levels", """SELECT d.g AS graph_id, d.v AS node_id, CAST(CASE WHEN d.type IN ('Database', 'External System') THEN coalesce(m.k, 0) + 1
 ELSE coalesce(l.k, 1) END AS INT) AS tier,
 CASE WHEN d.type IN ('Database', 'External System') THEN false ELSE z.n > 1 END AS on_cycle
FROM decl d LEFT JOIN tscc c ON c.g = d.g AND c.v = d.v
LEFT JOIN (SELECT g, c, count(*) AS n FROM tscc GROUP BY g, c) z ON z.g = d.g AND z.c = c.c
LEFT JOIN (SELECT g, v, max(k) AS k FROM tlev GROUP BY g, v) l ON l.g = d.g AND l.v = c.c
LEFT JOIN (SELECT t.g, max(coalesce(y.k, 1)) AS k FROM tscc t LEFT JOIN (SELECT g, v, max(k) AS k FROM tlev GROUP BY g, v) y
  ON y.g = t.g AND y.v = t.c GROUP BY t.g) m ON m.g = d.g""")
def tier_levels(spark, sf):
    return gr.tier_levels(*fleet(spark, sf))


# --- scoring --------------------------------------------------------------------------------

@query("g01_criticality", "SELECT g AS graph_id, v AS node_id, score AS criticality, tier FROM crit")
def criticality(spark, sf):
    a = analysis(spark, sf)
    return sc.criticality(a["metrics"], a["spof"]).select("graph_id", "node_id", "criticality", "tier")


@query("g02_criticality_rank", "SELECT g AS graph_id, v AS node_id, rk AS rank FROM crit")
def criticality_rank(spark, sf):
    return analysis(spark, sf)["criticality"].select("graph_id", "node_id", "rank")


@query("g03_criticality_parts", f"""SELECT g AS graph_id, v AS node_id, {graph_sql.fair('CAST(0.30 AS DOUBLE) * ncb', 4)} AS betweenness_factor,
 {graph_sql.fair('CAST(0.25 AS DOUBLE) * npr', 4)} AS pagerank_factor, {graph_sql.fair('CAST(0.20 AS DOUBLE) * nind', 4)} AS in_degree_factor,
 {graph_sql.fair('CAST(0.15 AS DOUBLE) * nbl', 4)} AS blast_radius_factor, {graph_sql.fair('CAST(0.10 AS DOUBLE) * nsp', 4)} AS spof_factor,
 coalesce(nullif(concat_ws(' | ', CASE WHEN ncb >= 0.60 THEN 'betweenness ' || printf('%.4f', cb) || ': many shortest paths run through it' END,
  CASE WHEN nind >= 0.60 OR ind >= 3 THEN 'fan-in ' || ind || ': so many call it directly' END,
  CASE WHEN is_spof THEN 'only route: ' || lost || ' pair(s) are cut apart without it' END,
  CASE WHEN blast >= 4 OR nbl >= 0.60 THEN 'blast radius ' || blast || ': so many reach it on some way' END,
  CASE WHEN npr >= 0.60 THEN 'rank ' || printf('%.4f', pr) || ': those that call it are called much themselves' END), ''), 'no signal stands out') AS reasons FROM crit""")
def criticality_parts(spark, sf):
    row = sc.criticality_evidence(analysis(spark, sf)["criticality"])
    return row.select("graph_id", "node_id", "betweenness_factor", "pagerank_factor", "in_degree_factor",
                      "blast_radius_factor", "spof_factor", F.array_join("evidence", " | ").alias("reasons"))


@query("g04_edge_risk", """SELECT g AS graph_id, edge_id, src_name, dst_name, score AS risk_score, lvl AS risk_level, on_cycle, tspof AS target_spof,
 tcrit AS target_criticality, rk AS risk_rank FROM erisk""")
def edge_risk(spark, sf):
    return analysis(spark, sf)["edge_risk"].select(
        "graph_id", "edge_id", "src_name", "dst_name", "risk_score", "risk_level", "on_cycle", "target_spof",
        "target_criticality", "risk_rank")


@query("g05_propagation_paths", """SELECT e.graph_id, e.edge_id, array_to_string(list_append(coalesce(f.p, [e.src]), e.dst), ' > ') AS propagation_path
FROM fleet_edges e LEFT JOIN (SELECT g, t, min_by(path, s) AS p FROM sp WHERE s <> t GROUP BY g, t) f ON f.g = e.graph_id AND f.t = e.src""")
def propagation_paths(spark, sf):
    a = analysis(spark, sf)
    return sc.propagation_paths(a["edges"], a["walks"]).select(
        "graph_id", "edge_id", text(F.col("propagation_path")).alias("propagation_path"))


@query("g06_node_risk", "SELECT g AS graph_id, v AS node_id, score AS risk_score, lvl AS risk_level, is_spof, crit AS is_critical, in_cycle FROM nrisk")
def node_risk(spark, sf):
    return analysis(spark, sf)["node_risk"].select(
        "graph_id", "node_id", "risk_score", "risk_level", "is_spof", "is_critical", "in_cycle")


@query("g07_system_risk", """SELECT g AS graph_id, round(cp, 4) AS coupling_points, sp AS spof_points, yp AS cycle_points, ep AS edge_points, xp AS external_points,
 score AS system_risk, CASE WHEN score >= 70 THEN 'CRITICAL' WHEN score >= 50 THEN 'HIGH' WHEN score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS system_level FROM sysrisk""")
def system_risk(spark, sf):
    return analysis(spark, sf)["system"]


# one line of the insights each, and all of them
INSIGHTS = {
    "spof": (2, """SELECT c.g AS graph_id, 2 AS line_no, CASE WHEN s.n IS NULL THEN 'Single points of failure: none.'
 ELSE 'Single points of failure: ' || s.n || '; the worst is ''' || s.nm || ''', which cuts ' || s.lost || ' pair(s).' END AS insight
FROM cx c LEFT JOIN (SELECT g, count(*) AS n, min_by(name, (-lost, pos)) AS nm, max(lost) AS lost FROM spof WHERE is_spof GROUP BY g) s ON s.g = c.g"""),
    "cycle": (3, """SELECT g, 3, 'First cycle: ' || array_to_string(list_append(path, path[1]), ' -> ') || '.' FROM cyc WHERE k = 1"""),
    "links": (4, """SELECT g, 4, 'Links at risk: ' || count(*) || '; the first is ''' || min_by(src_name || ' -> ' || dst_name, rk) || '''.' FROM erisk WHERE lvl IN ('CRITICAL', 'HIGH') GROUP BY g"""),
    "overall": (5, """SELECT g, 5, 'Complexity: ' || rating || '; density ' || printf('%.1f', density * 100) || '%, depth ' || depth || '.' FROM cx"""),
    "criticality": (1, """SELECT g, 1, 'Highest criticality: ''' || name || ''' with ' || printf('%.2f', floor(score * 100 + 0.5000001) / 100) || ' (' || coalesce(nullif(array_to_string(list_filter([
  CASE WHEN ncb >= 0.60 THEN 'betweenness ' || printf('%.4f', cb) END,
  CASE WHEN nind >= 0.60 OR ind >= 3 THEN 'fan-in ' || ind END,
  CASE WHEN is_spof THEN 'only route' END,
  CASE WHEN blast >= 4 OR nbl >= 0.60 THEN 'blast radius ' || blast END,
  CASE WHEN npr >= 0.60 THEN 'rank ' || printf('%.4f', pr) END], lambda x: x IS NOT NULL)[1:2], ', '), ''), 'no signal stands out') || ').' FROM crit WHERE rk = 1"""),
}


def _insight_rows(spark, sf):
    def build():
        a = analysis(spark, sf)
        return stage(sc.insights(a["criticality"], a["spof"], cycle_list(spark, sf), a["edge_risk"], a["complexity"])).df
    return memo(spark, sf, "insights", build)


@query("g08_insights", "\nUNION ALL ".join(part for _, part in INSIGHTS.values()))
def insights(spark, sf):
    return _insight_rows(spark, sf)


def _one_line(name, line_no, sql):
    @query(f"g08_insight_{name}", f"SELECT * FROM ({sql}) x(graph_id, line_no, insight)")
    def one(spark, sf):
        return _insight_rows(spark, sf).filter(F.col("line_no") == line_no)


for _name, (_line, _sql) in INSIGHTS.items():
    _one_line(_name, _line, _sql)


FINDINGS = """SELECT g AS graph_id, 'spof-' || v AS finding_id, CASE WHEN severity = 'CRITICAL' THEN 'CRITICAL' ELSE 'HIGH' END AS severity, 'SPOF' AS category, v AS component_id, aff_n AS blast_radius, 'Single point of failure: ' || name AS title FROM spof WHERE is_spof
UNION ALL SELECT c.g, 'crit-' || c.v, 'HIGH', 'Coupling', c.v, greatest(c.blast, c.ind), 'Critical component: ' || c.name FROM crit c LEFT JOIN spof s ON s.g = c.g AND s.v = c.v AND s.is_spof WHERE c.tier = 'CRITICAL' AND s.v IS NULL
UNION ALL SELECT g, 'cycle-' || (k - 1), 'HIGH', 'Cycles', path[1], len(path), 'Cycle of ' || len(path) || ' component(s)' FROM cyc
UNION ALL SELECT e.graph_id, 'db-share-' || e.dst, 'HIGH', 'Data Isolation', e.dst, count(DISTINCT e.src), 'Shared database: ' || min(d.name) FROM fleet_edges e JOIN decl d ON d.g = e.graph_id AND d.v = e.dst AND lower(d.type) = 'database'
  WHERE e.type IN ('QUERIES', 'USES', 'CONNECTS_TO') GROUP BY e.graph_id, e.dst HAVING count(DISTINCT e.src) > 1
UNION ALL SELECT g, 'dep-' || edge_id, CASE WHEN lvl = 'CRITICAL' THEN 'CRITICAL' ELSE 'HIGH' END, 'Coupling', src, 2, 'Link at risk: ' || src_name || ' → ' || dst_name FROM erisk WHERE lvl IN ('CRITICAL', 'HIGH') AND rk <= 3"""
graph_sql.cte("found", FINDINGS)
graph_sql.cte("all_found", """SELECT * FROM found UNION ALL
SELECT d.g, 'clean-arch', 'LOW', 'Coupling', min_by(d.v, d.pos), 0, 'Nothing found' FROM decl d WHERE d.g NOT IN (SELECT graph_id FROM found) GROUP BY d.g""")


def _findings(spark, sf):
    def build():
        a = analysis(spark, sf)
        stores = sc.shared_datastores(a["nodes"], a["edges"])
        return stage(sc.findings(a["nodes"], a["spof"], a["criticality"], cycle_list(spark, sf), stores, a["edge_risk"])).df
    return memo(spark, sf, "findings", build)


@query("g09_findings", "SELECT graph_id, finding_id, title, severity, category, component_id, CAST(blast_radius AS BIGINT) AS blast_radius FROM all_found")
def findings(spark, sf):
    return _findings(spark, sf)


@query("g10_severity_counts", """SELECT graph_id, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high,
 count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low FROM all_found GROUP BY graph_id""")
def severity_counts(spark, sf):
    return sc.severity_counts(_findings(spark, sf))


@query("k04_finding_filter", "SELECT graph_id, finding_id, severity FROM all_found WHERE severity = 'HIGH' AND contains(lower(category), 'cyc')")
def finding_filter(spark, sf):
    from depfleet.operators.find import finding_filter
    return finding_filter(_findings(spark, sf), "HIGH", " Cyc ").select("graph_id", "finding_id", "severity")


@query("k21_health", """SELECT c.g AS graph_id, count(*) FILTER (c.tier IN ('CRITICAL', 'HIGH')) AS risky_nodes,
 (SELECT count(*) FROM spof s WHERE s.g = c.g AND s.is_spof) AS spof_count, (SELECT count(*) FROM cyc y WHERE y.g = c.g) AS cycle_count,
 (SELECT count(*) FROM erisk e WHERE e.g = c.g AND e.lvl IN ('CRITICAL', 'HIGH')) AS risky_edges FROM crit c GROUP BY c.g""")
def health(spark, sf):
    a = analysis(spark, sf)
    return sc.health(a["criticality"], a["spof"], cycle_list(spark, sf), a["edge_risk"])


@query("e16_shared_datastores", """SELECT e.graph_id, e.dst AS node_id, d.name, count(DISTINCT e.src) AS callers FROM fleet_edges e JOIN decl d ON d.g = e.graph_id AND d.v = e.dst AND d.type = 'Database'
WHERE e.type IN ('QUERIES', 'USES', 'CONNECTS_TO') GROUP BY e.graph_id, e.dst, d.name HAVING count(DISTINCT e.src) > 1""")
def shared_datastores(spark, sf):
    return sc.shared_datastores(*fleet(spark, sf))

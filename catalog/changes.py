"""Queries that compare versions (h), run scenarios, look things up (k), register (e, a)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from depfleet.functions import paths as p
from depfleet.operators import diff as d
from depfleet.operators import find as fi
from depfleet.operators import lite as lt
from depfleet.operators import ranking as rk
from depfleet.operators import register as rg
from depfleet.operators import score as sc
from depfleet.operators import whatif as wi
from depfleet.operators.cycles import simple_cycles
from depfleet.operators.graph import cycle_counts
from depfleet.sources import tables as t
from depfleet.staging import stage

from .base import CTES, cte, memo, query
from .graph_sql import fair
from .graphs import text
from .worlds import analysis, common, comparison, fleet, scenario_run, versions

# --- the lite profile in SQL ------------------------------------------------------------------

cte("mlk", "SELECT graph_id AS g, src, dst, CAST(count(*) AS DOUBLE) AS n FROM fleet_edges GROUP BY graph_id, src, dst")
cte("mhop", """SELECT m.g, m.src, m.dst, m.n FROM mlk m JOIN decl a ON a.g = m.g AND a.v = m.src
JOIN decl b ON b.g = m.g AND b.v = m.dst WHERE m.src <> m.dst""")
cte("mwalk", """SELECT g, src AS s, dst AS t, 1 AS d, n FROM mhop UNION ALL
SELECT w.g, w.s, h.dst, w.d + 1, sum(w.n * h.n) FROM mwalk w JOIN mhop h ON h.g = w.g AND h.src = w.t
WHERE w.d < 12 GROUP BY w.g, w.s, h.dst, w.d + 1""")
cte("mdist", "SELECT g, s, t, min(d) AS d, min_by(n, d) AS n FROM mwalk WHERE s <> t GROUP BY g, s, t")
cte("dn", "SELECT g, count(*) AS n FROM decl GROUP BY g")
cte("mbtw", """SELECT x.g, x.v, coalesce(b.c, 0) * CASE WHEN z.n > 2 THEN CAST(1.0 AS DOUBLE) / ((z.n - 1) * (z.n - 2)) ELSE 1 END AS cb
FROM decl x JOIN dn z ON z.g = x.g LEFT JOIN (SELECT a.g, a.t AS v, sum(a.n * b.n / c.n) AS c FROM mdist a
 JOIN mdist b ON b.g = a.g AND b.s = a.t JOIN mdist c ON c.g = a.g AND c.s = a.s AND c.t = b.t AND c.d = a.d + b.d
 GROUP BY a.g, a.t) b ON b.g = x.g AND b.v = x.v""")
cte("mpr0", """SELECT x.g, x.v, z.n, coalesce(o.k, 0) AS od, coalesce(i.k, 0) AS ind FROM decl x JOIN dn z ON z.g = x.g
LEFT JOIN (SELECT g, src AS v, sum(n) AS k FROM mlk GROUP BY g, src) o ON o.g = x.g AND o.v = x.v
LEFT JOIN (SELECT g, dst AS v, sum(n) AS k FROM mlk GROUP BY g, dst) i ON i.g = x.g AND i.v = x.v""")
cte("mpr", """SELECT g, v, n, od, CAST(1.0 / n AS DOUBLE) AS r, 0 AS it, CAST(1e9 AS DOUBLE) AS err FROM mpr0
UNION ALL
SELECT c.g, c.v, c.n, c.od, x.nr, c.it + 1, sum(abs(x.nr - c.r)) OVER (PARTITION BY c.g)
FROM mpr c JOIN (
  SELECT a.g, a.v, CAST(0.15 AS DOUBLE) / a.n + CAST(0.85 AS DOUBLE) * (coalesce(b.got, 0) + coalesce(l.loose, 0) / a.n) AS nr
  FROM mpr a
  LEFT JOIN (SELECT h.g, h.dst AS v, sum(q.r / q.od * h.n) AS got FROM mpr q JOIN mlk h ON h.g = q.g AND h.src = q.v
             GROUP BY h.g, h.dst) b ON b.g = a.g AND b.v = a.v
  LEFT JOIN (SELECT g, sum(r) AS loose FROM mpr WHERE od = 0 GROUP BY g) l ON l.g = a.g) x
ON x.g = c.g AND x.v = c.v WHERE c.err >= CAST(1e-5 AS DOUBLE) AND c.it < 50""")
cte("cutv", """SELECT DISTINCT u.g, x.v FROM dclo u JOIN decl x ON x.g = u.g AND x.v <> u.a AND x.v <> u.b AND u.a <> u.b
WHERE NOT EXISTS (SELECT 1 FROM uban b WHERE b.g = u.g AND b.v = x.v AND b.a = u.a AND b.b = u.b)""")
cte("mdepth", "SELECT g, s AS v, max(len(path)) - 1 AS k FROM simple_path GROUP BY g, s")
cte("lmet", f"""SELECT d.g, d.v, d.pos, d.name, d.type, CAST(q.ind AS BIGINT) AS ind, CAST(q.od AS BIGINT) AS outd, {fair('b.cb', 4)} AS cb, {fair('r.r', 4)} AS pr,
 (c.v IS NOT NULL) AS cut, z.k AS depth
FROM decl d JOIN mpr0 q ON q.g = d.g AND q.v = d.v JOIN mbtw b ON b.g = d.g AND b.v = d.v
JOIN (SELECT g, v, max_by(r, it) AS r FROM mpr GROUP BY g, v) r ON r.g = d.g AND r.v = d.v
JOIN mdepth z ON z.g = d.g AND z.v = d.v LEFT JOIN cutv c ON c.g = d.g AND c.v = d.v""")
cte("lcrit", """SELECT *, CASE WHEN score >= 0.70 THEN 'CRITICAL' WHEN score >= 0.45 THEN 'HIGH' WHEN score >= 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS tier
FROM (SELECT *, round(least(CAST(1 AS DOUBLE), ind * CAST(0.25 AS DOUBLE) + cb * CAST(0.35 AS DOUBLE) + pr * CAST(0.2 AS DOUBLE)
 + CASE WHEN cut THEN CAST(0.2 AS DOUBLE) ELSE 0 END), 2) AS score FROM lmet) x""")
cte("lerisk", """SELECT *, CASE WHEN round(raw, 4) >= 0.70 THEN 'CRITICAL' WHEN round(raw, 4) >= 0.50 THEN 'HIGH' WHEN round(raw, 4) >= 0.30 THEN 'MEDIUM' ELSE 'LOW' END AS lvl
FROM (SELECT e.graph_id AS g, e.edge_id, coalesce(c.cut, false) AS tspof, CASE WHEN coalesce(c.score, 0) <> 0 THEN c.score ELSE CAST(0.2 AS DOUBLE) END AS tcrit,
 CAST(0.2 AS DOUBLE) + CASE WHEN c.cut THEN CAST(0.35 AS DOUBLE) ELSE 0 END + CASE WHEN c.tier = 'CRITICAL' THEN CAST(0.25 AS DOUBLE) ELSE 0 END
 + CASE WHEN c.ind >= 4 THEN CAST(0.15 AS DOUBLE) ELSE 0 END AS raw
FROM fleet_edges e LEFT JOIN lcrit c ON c.g = e.graph_id AND c.v = e.dst) x""")
cte("lcx", """SELECT *, greatest(1, e - n + 2) AS cyclo, CASE WHEN greatest(1, e - n + 2) > 10 OR density > 0.35 OR cycles > 0 THEN 'HIGH'
 WHEN greatest(1, e - n + 2) > 4 THEN 'MEDIUM' ELSE 'LOW' END AS rating FROM (
SELECT z.g, z.n, coalesce(e.e, 0) AS e, round(CAST(2.0 * coalesce(e.e, 0) AS DOUBLE) / z.n, 2) AS avgdeg,
 CASE WHEN z.n > 1 THEN round(CAST(coalesce(e.e, 0) AS DOUBLE) / (z.n * (z.n - 1)), 3) ELSE 0 END AS density,
 m.k AS depth, coalesce(c.n, 0) AS cycles
FROM dn z LEFT JOIN (SELECT graph_id AS g, count(*) AS e FROM fleet_edges GROUP BY graph_id) e ON e.g = z.g
JOIN (SELECT g, max(depth) AS k FROM lmet GROUP BY g) m ON m.g = z.g LEFT JOIN cyc_n c ON c.g = z.g) x""")
cte("lsys", """SELECT c.g, round(least(CAST(100 AS DOUBLE), greatest(CAST(5 AS DOUBLE), least(CAST(25 AS DOUBLE), c.density * CAST(30 AS DOUBLE) + c.avgdeg * CAST(2.5 AS DOUBLE))
 + least(CAST(30 AS DOUBLE), m.cuts * CAST(12 AS DOUBLE)) + least(CAST(20 AS DOUBLE), c.cycles * CAST(10 AS DOUBLE))
 + least(CAST(15 AS DOUBLE), coalesce(e.k, 0) * CAST(3.5 AS DOUBLE))
 + least(CAST(10 AS DOUBLE), m.ext * CAST(3 AS DOUBLE) + greatest(0, c.depth - 3) * CAST(1.5 AS DOUBLE)))), 1) AS score
FROM lcx c JOIN (SELECT g, count(*) FILTER (cut) AS cuts, count(*) FILTER (type = 'External System') AS ext FROM lmet GROUP BY g) m ON m.g = c.g
LEFT JOIN (SELECT g, count(*) AS k FROM lerisk WHERE lvl IN ('CRITICAL', 'HIGH') GROUP BY g) e ON e.g = c.g""")
LEVEL = "CASE WHEN {0} >= 70 THEN 'CRITICAL' WHEN {0} >= 50 THEN 'HIGH' WHEN {0} >= 30 THEN 'MEDIUM' ELSE 'LOW' END"

GRAPH_CTES = [n for n in CTES if n not in t.RELATIONS and n not in ("supply_reach",)]


def world(suffix: str, nodes: str, edges: str) -> None:
    """The same CTEs over another pair of node and edge tables."""
    swap = {n: f"{n}_{suffix}" for n in GRAPH_CTES} | {"fleet_nodes": nodes, "fleet_edges": edges}
    for name in GRAPH_CTES:
        cte(f"{name}_{suffix}", re.sub(
            r"\b(FROM|JOIN)\s+(\w+)\b", lambda m: f"{m[1]} {swap.get(m[2], m[2])}", CTES[name]))


for v in (1, 2):
    cte(f"n_v{v}", f"SELECT * REPLACE (split_part(graph_id, '-', 1) AS graph_id) FROM fleet_nodes WHERE graph_id LIKE '%-v{v}'")
    cte(f"e_v{v}", f"SELECT * REPLACE (split_part(graph_id, '-', 1) AS graph_id) FROM fleet_edges WHERE graph_id LIKE '%-v{v}'")
    world(f"v{v}", f"n_v{v}", f"e_v{v}")


def _lite(spark, sf):
    return memo(spark, sf, "lite", lambda: lt.lite_analysis(*fleet(spark, sf)))


@query("g11_lite_metrics", """SELECT g AS graph_id, v AS node_id, ind AS in_degree, outd AS out_degree, cb AS betweenness, pr AS pagerank, CAST(depth AS INT) AS depth, cut AS is_cut FROM lmet""")
def lite_metrics(spark, sf):
    return _lite(spark, sf)["metrics"].drop("pos", "name", "type", "technology")


@query("g11_lite_spof", """SELECT g AS graph_id, v AS node_id, cut AS is_spof, CASE WHEN type = 'Database' THEN 'SHARED_DATASTORE' ELSE 'TRANSIT' END AS spof_type,
 CASE WHEN cut THEN ind * 2 ELSE 0 END AS disconnected_paths, ind AS affected_count, CASE WHEN NOT cut THEN 'NONE' WHEN ind >= 3 THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM lmet""")
def lite_spof(spark, sf):
    return lt.lite_spofs(_lite(spark, sf)["metrics"])


@query("g11_lite_complexity", """SELECT g AS graph_id, n AS node_count, e AS edge_count, avgdeg AS average_degree, density, CAST(depth AS INT) AS max_dependency_depth,
 cycles AS cycles_count, cyclo AS cyclomatic_complexity, rating AS complexity_rating FROM lcx""")
def lite_complexity(spark, sf):
    a = _lite(spark, sf)
    return cycle_counts(a["complexity"], simple_cycles(a["link"], a["strong"])).drop("cycles_least")


@query("g11_lite_criticality", """SELECT g AS graph_id, v AS node_id, score AS criticality, tier, CAST(row_number() OVER (PARTITION BY g ORDER BY score DESC, pos) AS INT) AS rank FROM lcrit""")
def lite_criticality(spark, sf):
    return _lite(spark, sf)["criticality"].select("graph_id", "node_id", "criticality", "tier", "rank")


@query("g11_lite_edge_risk", "SELECT g AS graph_id, edge_id, round(least(CAST(1 AS DOUBLE), raw), 2) AS risk_score, lvl AS risk_level, tspof AS target_spof, tcrit AS target_criticality FROM lerisk")
def lite_edge_risk(spark, sf):
    return _lite(spark, sf)["edge_risk"].drop("src", "dst", "type")


@query("g11_lite_system_risk", f"SELECT g AS graph_id, score AS system_risk, {LEVEL.format('score')} AS system_level FROM lsys")
def lite_system(spark, sf):
    return _lite(spark, sf)["system"]


@query("g12_model_score", """SELECT *, CAST(least(100, greatest(0, 20 + least(30, CAST(round(coupling_ratio * 15) AS INT)) + bottlenecks * 8 + externals * 6 + cut_vertices * 12)) AS INT) AS model_score FROM (
SELECT c.g AS graph_id, round(CAST(c.e AS DOUBLE) / greatest(1, c.n), 2) AS coupling_ratio,
 (SELECT count(*) FROM (SELECT x.v FROM (SELECT graph_id AS g, src AS v FROM fleet_edges UNION ALL SELECT graph_id, dst FROM fleet_edges) x WHERE x.g = c.g GROUP BY x.v HAVING count(*) >= 3) y) AS bottlenecks,
 (SELECT count(*) FROM lmet m WHERE m.g = c.g AND m.type = 'External System') AS externals, (SELECT count(*) FROM lmet m WHERE m.g = c.g AND m.cut) AS cut_vertices FROM lcx c) z""")
def model_score(spark, sf):
    return _lite(spark, sf)["model"]


# --- two versions -----------------------------------------------------------------------------

cte("ndiff", """SELECT coalesce(a.graph_id, b.graph_id) AS g, lower(trim(coalesce(a.node_id, b.node_id))) AS key, coalesce(b.node_id, a.node_id) AS v,
 coalesce(b.name, a.name) AS name, coalesce(b.type, a.type) AS type, a.name AS previous_name,
 CASE WHEN a.node_id IS NULL THEN 'added' WHEN b.node_id IS NULL THEN 'removed' WHEN a.type <> b.type OR a.name <> b.name
  OR (a.technology <> '' AND b.technology <> '' AND a.technology <> b.technology) OR (a.description <> '' AND b.description <> '' AND a.description <> b.description)
  THEN 'modified' ELSE 'unchanged' END AS ch,
 CASE WHEN a.node_id IS NULL THEN 'V2' WHEN b.node_id IS NULL THEN 'V1' ELSE 'BOTH' END AS origin
FROM n_v1 a FULL JOIN n_v2 b ON a.graph_id = b.graph_id AND lower(trim(a.node_id)) = lower(trim(b.node_id))""")
cte("ediff", """SELECT coalesce(a.graph_id, b.graph_id) AS g, coalesce(a.k, b.k) AS key, coalesce(b.edge_id, a.edge_id) AS edge_id, coalesce(b.src, a.src) AS src,
 coalesce(b.dst, a.dst) AS dst, coalesce(b.type, a.type) AS type, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'unchanged' END AS ch,
 CASE WHEN a.k IS NULL THEN 'V2' WHEN b.k IS NULL THEN 'V1' ELSE 'BOTH' END AS origin,
 CASE WHEN coalesce(b.ev_file, a.ev_file) IS NOT NULL OR (a.k IS NOT NULL AND b.k IS NOT NULL) THEN coalesce(b.ev_file, a.ev_file) ELSE 'unavailable' END AS ev_file,
 CASE WHEN b.ev_file IS NOT NULL THEN b.ev_confidence WHEN a.ev_file IS NOT NULL THEN a.ev_confidence WHEN a.k IS NULL OR b.k IS NULL THEN 'LOW' END AS ev_confidence
FROM (SELECT *, lower(src) || '->' || lower(dst) || ':' || type AS k FROM e_v1) a
FULL JOIN (SELECT *, lower(src) || '->' || lower(dst) || ':' || type AS k FROM e_v2) b ON a.graph_id = b.graph_id AND a.k = b.k""")
cte("changed", """SELECT g, v FROM ndiff WHERE ch <> 'unchanged' UNION SELECT n.g, n.v FROM ndiff n JOIN ediff e ON e.g = n.g AND (lower(e.src) = n.key OR lower(e.dst) = n.key) WHERE e.ch <> 'unchanged'""")
cte("hop2", "SELECT DISTINCT graph_id AS g, src, dst FROM e_v2 WHERE src <> dst")
cte("back", """SELECT h.g, h.dst AS s, h.src AS t, 1 AS d, [h.dst, h.src] AS path FROM hop2 h JOIN changed c ON c.g = h.g AND c.v = h.dst
UNION ALL
SELECT w.g, w.s, h.src, w.d + 1, min(list_append(w.path, h.src)) FROM back w JOIN hop2 h ON h.g = w.g AND h.dst = w.t
JOIN dist_v2 x ON x.g = w.g AND x.s = h.src AND x.t = w.s AND x.d = w.d + 1 GROUP BY w.g, w.s, h.src, w.d + 1""")
cte("ipath", """SELECT b.* FROM back b WHERE b.s <> b.t AND NOT EXISTS (SELECT 1 FROM changed c WHERE c.g = b.g AND c.v = b.t)
AND EXISTS (SELECT 1 FROM ndiff n WHERE n.g = b.g AND n.v = b.t)""")
cte("broke", """SELECT e.graph_id AS g, e.edge_id, e.src, e.dst FROM e_v1 e JOIN ndiff n ON n.g = e.graph_id AND n.v = e.dst AND n.ch = 'removed'
JOIN n_v2 m ON m.graph_id = e.graph_id AND m.node_id = e.src""")
cte("pruned", """SELECT e.g, e.edge_id, e.src, e.dst, e.type FROM ediff e WHERE e.ch = 'removed'
AND NOT (EXISTS (SELECT 1 FROM ndiff n WHERE n.g = e.g AND n.v = e.dst AND n.ch = 'removed') AND EXISTS (SELECT 1 FROM n_v2 m WHERE m.graph_id = e.g AND m.node_id = e.src))""")
for v in (1, 2):
    cte(f"hub_v{v}", f"SELECT g, v FROM (SELECT graph_id AS g, src AS v FROM e_v{v} UNION ALL SELECT graph_id, dst FROM e_v{v}) x GROUP BY g, v HAVING count(*) >= 3")
cte("new_hub", "SELECT a.g, a.v FROM hub_v2 a WHERE NOT EXISTS (SELECT 1 FROM hub_v1 b WHERE b.g = a.g AND b.v = a.v)")
cte("new_cut", "SELECT a.g, a.v FROM cutv_v2 a WHERE NOT EXISTS (SELECT 1 FROM cutv_v1 b WHERE b.g = a.g AND b.v = a.v)")
cte("cbook", """SELECT g, 1 AS line_no, 'callers_cut_off' AS factor, 15.0 AS each, count(*) AS n FROM broke GROUP BY g
UNION ALL SELECT g, 2, 'links_added', 4.0, count(*) FROM ediff WHERE ch = 'added' GROUP BY g
UNION ALL SELECT g, 3, 'links_dropped', -3.0, count(*) FROM pruned GROUP BY g
UNION ALL SELECT g, 4, 'externals_added', 6.0, count(*) FROM ndiff WHERE ch = 'added' AND type = 'External System' GROUP BY g
UNION ALL SELECT g, 5, 'hubs_new', 8.0, count(*) FROM new_hub GROUP BY g
UNION ALL SELECT g, 6, 'cut_points_new', 12.0, count(*) FROM new_cut GROUP BY g""")
cte("rdelta", f"""SELECT a.g, a.score AS s1, b.score AS s2, round(b.score - a.score, 1) AS delta FROM lsys_v1 a JOIN lsys_v2 b ON b.g = a.g""")


@query("h01_node_diff", "SELECT g AS graph_id, key, ch AS change_type, origin AS version_origin, v AS node_id, name, type, previous_name FROM ndiff")
def node_diff(spark, sf):
    n1, _, n2, _ = versions(spark, sf)
    return d.node_diff(n1, n2)


@query("h02_edge_diff", "SELECT g AS graph_id, key, ch AS change_type, origin AS version_origin, edge_id, src, dst, type, ev_file, ev_confidence FROM ediff")
def edge_diff(spark, sf):
    _, e1, _, e2 = versions(spark, sf)
    return d.edge_diff(e1, e2).drop("ev_description")


@query("h05_diff_order", """SELECT g AS graph_id, v AS node_id, ch AS change_type, CASE ch WHEN 'removed' THEN 1 WHEN 'added' THEN 2 WHEN 'modified' THEN 3 ELSE 4 END AS change_rank FROM ndiff""")
def diff_order(spark, sf):
    return d.ordered(comparison(spark, sf)["nodes"], "node_id").select("graph_id", "node_id", "change_type", "change_rank")


SUMMARY = ", ".join(f"coalesce(n.{c}_nodes, 0) AS {c}_nodes, coalesce(e.{c}_edges, 0) AS {c}_edges" for c in d.CHANGES)
FILTERS = lambda what: ", ".join(f"count(*) FILTER (ch = '{c}') AS {c}_{what}" for c in d.CHANGES)


@query("h06_diff_summary", f"""SELECT coalesce(n.g, e.g) AS graph_id, {SUMMARY} FROM (SELECT g, {FILTERS('nodes')} FROM ndiff GROUP BY g) n
FULL JOIN (SELECT g, {FILTERS('edges')} FROM ediff GROUP BY g) e ON e.g = n.g""")
def diff_summary(spark, sf):
    c = comparison(spark, sf)
    return d.architecture_summary(c["nodes"], c["edges"])


@query("h07_reversed_diff", """SELECT g AS graph_id, key, CASE ch WHEN 'added' THEN 'removed' WHEN 'removed' THEN 'added' ELSE ch END AS change_type,
 CASE origin WHEN 'V1' THEN 'V2' WHEN 'V2' THEN 'V1' ELSE origin END AS version_origin FROM ediff""")
def reversed_diff(spark, sf):
    return d.reversed_diff(comparison(spark, sf)["edges"]).select("graph_id", "key", "change_type", "version_origin")


@query("h08_directly_changed", "SELECT g AS graph_id, v AS node_id FROM changed")
def directly_changed(spark, sf):
    c = comparison(spark, sf)
    return d.directly_changed(c["nodes"], c["edges"])


@query("h09_impact_paths", "SELECT g AS graph_id, s AS changed_id, t AS impacted_id, d AS dist, array_to_string(path, ' > ') AS path FROM ipath")
def impact_paths(spark, sf):
    return comparison(spark, sf)["paths"].withColumn("path", text(F.col("path")))


@query("h10_broken_dependencies", "SELECT g AS graph_id, edge_id, src, dst FROM broke")
def broken(spark, sf):
    return comparison(spark, sf)["broken"]


@query("h11_pruned_edges", "SELECT g AS graph_id, edge_id, src, dst, type FROM pruned")
def pruned(spark, sf):
    return comparison(spark, sf)["pruned"]


@query("h12_new_bottlenecks", "SELECT g AS graph_id, v AS node_id, 'bottleneck' AS kind FROM new_hub UNION ALL SELECT g, v, 'cut vertex' FROM new_cut")
def new_bottlenecks(spark, sf):
    c = comparison(spark, sf)
    return c["new_hubs"].withColumn("kind", F.lit("bottleneck")).unionByName(
        c["new_cuts"].withColumn("kind", F.lit("cut vertex")))


@query("h13_compare_ledger", """SELECT g AS graph_id, line_no, factor, round(CAST(n * each AS DOUBLE), 1) AS points, n AS evidence_count FROM cbook
UNION ALL SELECT DISTINCT g, 0, 'unchanged', CAST(0 AS DOUBLE), 0 FROM ndiff WHERE g NOT IN (SELECT g FROM cbook)""")
def compare_ledger(spark, sf):
    return comparison(spark, sf)["ledger"]


@query("h14_risk_delta", f"""SELECT g AS graph_id, s1 AS original_score, {LEVEL.format('s1')} AS original_level, s2 AS changed_score, {LEVEL.format('s2')} AS changed_level, delta,
 CASE WHEN delta > 0 THEN 'Higher structural risk' WHEN delta < 0 THEN 'Lower structural risk' ELSE 'No structural risk change' END AS shift FROM rdelta""")
def risk_delta(spark, sf):
    return comparison(spark, sf)["delta"]


@query("h07_reversed_delta", """SELECT g AS graph_id, s2 AS original_score, s1 AS changed_score, CASE WHEN delta = 0 THEN 0 ELSE -delta END AS delta,
 CASE WHEN delta < 0 THEN 'Higher structural risk' WHEN delta > 0 THEN 'Lower structural risk' ELSE 'No structural risk change' END AS shift FROM rdelta""")
def reversed_delta(spark, sf):
    row = d.reversed_delta(comparison(spark, sf)["delta"]).select("graph_id", "original_score", "changed_score", "delta", "shift")
    return row.withColumn("delta", F.col("delta") + F.lit(0.0))  # no negative zero


@query("h20_compare_story", f"""SELECT x.g AS graph_id, l.n AS line_no, CASE l.n
 WHEN 0 THEN 'Components: ' || a.added_nodes || ' new, ' || a.removed_nodes || ' gone, ' || a.modified_nodes || ' changed; links: ' || coalesce(e.added_edges, 0) || ' new, ' || coalesce(e.removed_edges, 0) || ' gone.'
 WHEN 1 THEN coalesce(c.n, 0) || ' component(s) differ; ' || coalesce(i.n, 0) || ' reach them.'
 ELSE 'Risk: ' || printf('%.1f', x.s1) || ', then ' || printf('%.1f', x.s2) || ' (' || CASE WHEN x.delta >= 0 THEN '+' ELSE '' END || printf('%.1f', x.delta) || ').' END AS line
FROM rdelta x JOIN (SELECT g, {FILTERS('nodes')} FROM ndiff GROUP BY g) a ON a.g = x.g LEFT JOIN (SELECT g, {FILTERS('edges')} FROM ediff GROUP BY g) e ON e.g = x.g
LEFT JOIN (SELECT g, count(*) AS n FROM changed GROUP BY g) c ON c.g = x.g LEFT JOIN (SELECT g, count(DISTINCT t) AS n FROM ipath GROUP BY g) i ON i.g = x.g, (SELECT unnest([0, 1, 2]) AS n) l""")
def compare_story(spark, sf):
    c = comparison(spark, sf)
    return d.compare_story(d.architecture_summary(c["nodes"], c["edges"]), c["delta"], c["changed"], c["paths"])


@query("k22_reconciled", f"""SELECT g AS graph_id, {FILTERS('items')}, count(*) FILTER (origin <> 'V2') AS v1_count, count(*) FILTER (origin <> 'V1') AS v2_count, true AS reconciled FROM ediff GROUP BY g""")
def reconciled(spark, sf):
    _, e1, _, e2 = versions(spark, sf)
    key = lambda e: e.select("graph_id", p.edge_key(F.col("src"), F.col("dst"), F.col("type")).alias("key"))
    return d.reconciled(d.edge_diff(e1, e2), key(e1), key(e2))


# --- what-if ------------------------------------------------------------------------------------

cte("chg", "SELECT *, graph_id || '#' || scenario_id AS h FROM fleet_changes")
cte("wn_all", """SELECT c.h, n.node_id AS v, n.pos, n.name, n.type, n.technology, -1 AS seq FROM (SELECT DISTINCT h, graph_id FROM chg) c JOIN n_v1 n ON n.graph_id = c.graph_id
UNION ALL SELECT h, node_id, 1000000000 + seq, name, type, technology, seq FROM chg WHERE action = 'add_component'""")
cte("wdrop", "SELECT DISTINCT c.h, c.node_id AS v, c.seq FROM chg c JOIN wn_all n ON n.h = c.h AND n.v = c.node_id AND n.seq < c.seq WHERE c.action = 'remove_component'")
cte("wn", "SELECT n.* FROM wn_all n WHERE NOT EXISTS (SELECT 1 FROM wdrop r WHERE r.h = n.h AND r.v = n.v AND r.seq > n.seq)")
cte("we_all", """SELECT c.h, e.edge_id, e.pos, e.src, e.dst, e.type, e.protocol, -1 AS seq FROM (SELECT DISTINCT h, graph_id FROM chg) c JOIN e_v1 e ON e.graph_id = c.graph_id
UNION ALL SELECT h, edge_id, 1000000000 + seq, src, dst, edge_type, protocol, seq FROM chg WHERE action = 'add_dependency'""")
cte("wcut", """SELECT c.h, c.seq, min_by(e.edge_id, e.pos) AS edge_id, min_by(e.src, e.pos) AS src, min_by(e.dst, e.pos) AS dst FROM chg c JOIN we_all e ON e.h = c.h AND e.seq < c.seq
 AND (e.edge_id = c.edge_id OR (c.edge_id IS NULL AND e.src = c.src AND e.dst = c.dst)) WHERE c.action = 'remove_dependency' GROUP BY c.h, c.seq""")
cte("we", """SELECT e.* FROM we_all e WHERE NOT EXISTS (SELECT 1 FROM wdrop r WHERE r.h = e.h AND (r.v = e.src OR r.v = e.dst) AND r.seq > e.seq)
AND NOT EXISTS (SELECT 1 FROM wcut x WHERE x.h = e.h AND x.edge_id = e.edge_id AND x.seq > e.seq)""")
cte("wtouch", """SELECT h, node_id AS v FROM chg WHERE action = 'add_component' UNION SELECT h, v FROM wdrop UNION SELECT h, src FROM chg WHERE action = 'add_dependency'
UNION SELECT h, dst FROM chg WHERE action = 'add_dependency' UNION SELECT h, src FROM wcut UNION SELECT h, dst FROM wcut""")
cte("wnodes_h", "SELECT h AS graph_id, v AS node_id, pos, name, type, technology FROM wn")
cte("wedges_h", "SELECT h AS graph_id, edge_id, pos, src, dst, type, protocol FROM we")
cte("wnodes_b", "SELECT h AS graph_id, v AS node_id, pos, name, type, technology FROM wn_all WHERE seq = -1")
cte("wedges_b", "SELECT h AS graph_id, edge_id, pos, src, dst, type, protocol FROM we_all WHERE seq = -1")
world("wh", "wnodes_h", "wedges_h")
world("wb", "wnodes_b", "wedges_b")
cte("wbroke", "SELECT e.h, e.edge_id, e.src, e.dst FROM we_all e WHERE e.seq = -1 AND EXISTS (SELECT 1 FROM wdrop r WHERE r.h = e.h AND r.v = e.dst) AND EXISTS (SELECT 1 FROM wn n WHERE n.h = e.h AND n.v = e.src)")
cte("wshift", """SELECT x.h, b.n AS broken, greatest(e1.n - e0.n, 0) AS coupled, CASE WHEN e1.n - e0.n <= 0 AND b.n = 0 THEN greatest(abs(e1.n - e0.n) - b.n, 0) ELSE 0 END AS pruned,
 (SELECT count(*) FROM spof_wh s WHERE s.g = x.h AND s.is_spof AND NOT EXISTS (SELECT 1 FROM spof_wb q WHERE q.g = s.g AND q.v = s.v AND q.is_spof)) AS spof_new,
 (SELECT count(*) FROM spof_wb s WHERE s.g = x.h AND s.is_spof AND NOT EXISTS (SELECT 1 FROM spof_wh q WHERE q.g = s.g AND q.v = s.v AND q.is_spof)) AS spof_gone,
 greatest(c1.n - c0.n, 0) AS loop_new, greatest(c0.n - c1.n, 0) AS loop_gone, greatest(x1.n - x0.n, 0) AS external_new, greatest(x0.n - x1.n, 0) AS external_gone
FROM (SELECT DISTINCT h FROM chg) x, LATERAL (SELECT count(*) AS n FROM wbroke y WHERE y.h = x.h) b, LATERAL (SELECT count(*) AS n FROM wedges_b y WHERE y.graph_id = x.h) e0,
 LATERAL (SELECT count(*) AS n FROM wedges_h y WHERE y.graph_id = x.h) e1, LATERAL (SELECT count(*) AS n FROM cyc_wb y WHERE y.g = x.h) c0,
 LATERAL (SELECT count(*) AS n FROM cyc_wh y WHERE y.g = x.h) c1, LATERAL (SELECT count(*) AS n FROM wnodes_b y WHERE y.graph_id = x.h AND y.type = 'External System') x0,
 LATERAL (SELECT count(*) AS n FROM wnodes_h y WHERE y.graph_id = x.h AND y.type = 'External System') x1""")
ENTRIES = " UNION ALL ".join(
    f"SELECT h, {i + 1} AS line_no, '{name}' AS factor, round(CAST({col} * {each} AS DOUBLE), 1) AS points, CAST({col} AS BIGINT) AS n FROM wshift WHERE {col} > 0"
    for i, (col, (name, each)) in enumerate(wi.FACTORS.items()))
cte("wbook0", ENTRIES)
cte("wbook", f"SELECT * FROM wbook0 UNION ALL SELECT h, 0, '{wi.NEUTRAL}', CAST(0 AS DOUBLE), 0 FROM wshift WHERE h NOT IN (SELECT h FROM wbook0)")
cte("wscore", """SELECT *, greatest(CAST(0 AS DOUBLE), least(CAST(100 AS DOUBLE), round(current_score + delta, 1))) AS new_score FROM (
SELECT b.h, b.ledger_sum, b.has_broken, c.score AS current_score, coalesce(m.score, 0) AS modelled_score,
 CASE WHEN b.has_broken THEN b.ledger_sum ELSE round(coalesce(m.score, 0) - c.score, 1) END AS delta
FROM (SELECT h, round(sum(points), 1) AS ledger_sum, bool_or(factor = 'callers_cut_off') AS has_broken FROM wbook GROUP BY h) b
JOIN sysrisk_wb c ON c.g = b.h LEFT JOIN sysrisk_wh m ON m.g = b.h) x""")


@query("h15_hypothetical_nodes", "SELECT h AS graph_id, v AS node_id, name, type FROM wn")
def hypothetical_nodes(spark, sf):
    return scenario_run(spark, sf)["nodes"].select("graph_id", "node_id", "name", "type")


@query("h15_hypothetical_edges", "SELECT h AS graph_id, edge_id, src, dst, type FROM we")
def hypothetical_edges(spark, sf):
    return scenario_run(spark, sf)["edges"].select("graph_id", "edge_id", "src", "dst", "type")


@query("h15_touched", "SELECT h AS graph_id, v AS node_id FROM wtouch")
def touched(spark, sf):
    return scenario_run(spark, sf)["touched"]


cte("wprop", """SELECT graph_id, source, target, min_by(path, o) AS path, min_by(topology, o) AS topology FROM (
SELECT p.g AS graph_id, p.s AS source, p.t AS target, array_to_string(p.path, ' > ') AS path, 'hypothetical' AS topology, 0 AS o FROM sp_wh p JOIN wtouch c ON c.h = p.g AND c.v = p.t
 WHERE p.s <> p.t AND NOT EXISTS (SELECT 1 FROM wtouch q WHERE q.h = p.g AND q.v = p.s)
UNION ALL SELECT p.g, p.s, p.t, array_to_string(p.path, ' > '), 'current', 1 FROM sp_wb p JOIN wtouch c ON c.h = p.g AND c.v = p.t
 WHERE p.s <> p.t AND NOT EXISTS (SELECT 1 FROM wtouch q WHERE q.h = p.g AND q.v = p.s)) x GROUP BY graph_id, source, target, x.path""")


@query("h16_propagation", "SELECT * FROM wprop")
def propagation(spark, sf):
    return scenario_run(spark, sf)["paths"].withColumn("path", text(F.col("path")))


@query("h17_whatif_ledger", "SELECT h AS graph_id, line_no, factor, points, n AS evidence_count FROM wbook")
def whatif_ledger(spark, sf):
    return scenario_run(spark, sf)["ledger"]


@query("h18_whatif_score", "SELECT h AS graph_id, ledger_sum, has_broken, current_score, modelled_score, delta, new_score FROM wscore")
def whatif_score(spark, sf):
    return scenario_run(spark, sf)["score"]


CHECK_VALUES = ", ".join("('{}', '{}')".format(wi.FACTORS[k][0], v.replace("'", "''")) for k, v in wi.CHECKS.items())


@query("h19_recommended_checks", f"""SELECT b.h AS graph_id, b.factor, r.advice FROM wbook b JOIN (VALUES {CHECK_VALUES}) r(factor, advice) ON r.factor = b.factor
UNION ALL SELECT DISTINCT h, NULL, '{wi.DEFAULT_CHECK}' FROM wbook WHERE h NOT IN (SELECT h FROM wbook WHERE factor IN (SELECT factor FROM (VALUES {CHECK_VALUES}) r(factor, advice)))""")
def recommended_checks(spark, sf):
    return wi.recommended_checks(scenario_run(spark, sf)["ledger"])


@query("h20_whatif_story", """SELECT h AS graph_id, 2 AS line_no, 'Risk: ' || printf('%.1f', current_score) || ', then ' || printf('%.1f', new_score) || ' (' || printf('%+.1f', delta) || ').' AS line FROM wscore
UNION ALL SELECT h, 3, 'First factor: ' || min_by(factor, line_no) || ' (' || printf('%+.1f', min_by(points, line_no)) || ')' FROM wbook GROUP BY h
UNION ALL SELECT x.h, 1, CASE WHEN p.i > 0 THEN p.i || ' component(s) reach them, by ' || p.n || ' path(s).'
 ELSE 'No other component reaches them.' END
 FROM wscore x LEFT JOIN (SELECT graph_id, count(DISTINCT source) AS i, count(*) AS n FROM wprop GROUP BY graph_id) p ON p.graph_id = x.h
UNION ALL SELECT c.h, 0, count(*) || ' change(s) to ' || (SELECT count(*) FROM wtouch t WHERE t.h = c.h) || ' component(s).' FROM chg c GROUP BY c.h""")
def whatif_story(spark, sf):
    r = scenario_run(spark, sf)
    return wi.whatif_story(t.derive(spark, sf, "fleet_changes", common(spark, sf)), r["touched"], r["paths"], r["score"], r["ledger"])


# --- registering --------------------------------------------------------------------------------

@query("a03_validation_issues", """SELECT graph_id, 'error' AS level, 'missing_node_id' AS code, '' AS subject, pos FROM raw_nodes WHERE trim(coalesce(node_id, '')) = ''
UNION ALL SELECT graph_id, 'error', 'duplicate_node_id', trim(node_id), pos FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, trim(node_id) ORDER BY pos) AS r FROM raw_nodes WHERE trim(coalesce(node_id, '')) <> '') x WHERE r > 1
UNION ALL SELECT graph_id, 'warning', 'unknown_node_type', trim(node_id), pos FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, trim(node_id) ORDER BY pos) AS r FROM raw_nodes WHERE trim(coalesce(node_id, '')) <> '') x WHERE r = 1 AND type = 'Gateway'
UNION ALL SELECT graph_id, 'error', 'missing_edge_end', edge_id, pos FROM raw_edges WHERE coalesce(src, '') = '' OR coalesce(dst, '') = ''
UNION ALL SELECT e.graph_id, 'error', 'undefined_edge_end', edge_id, pos FROM raw_edges e WHERE coalesce(src, '') <> '' AND coalesce(dst, '') <> '' AND (NOT EXISTS (SELECT 1 FROM raw_nodes n WHERE n.graph_id = e.graph_id AND trim(n.node_id) = e.src) OR NOT EXISTS (SELECT 1 FROM raw_nodes n WHERE n.graph_id = e.graph_id AND trim(n.node_id) = e.dst))
UNION ALL SELECT e.graph_id, 'warning', 'unknown_edge_type', edge_id, pos FROM raw_edges e WHERE type = 'LINKS' AND coalesce(src, '') <> '' AND coalesce(dst, '') <> '' AND EXISTS (SELECT 1 FROM raw_nodes n WHERE n.graph_id = e.graph_id AND trim(n.node_id) = e.src) AND EXISTS (SELECT 1 FROM raw_nodes n WHERE n.graph_id = e.graph_id AND trim(n.node_id) = e.dst)""")
def validation_issues(spark, sf):
    return rg.validate(t.derive(spark, sf, "raw_nodes"), t.derive(spark, sf, "raw_edges"))[0]


@query("a03_validation_clean_nodes", """SELECT graph_id, trim(node_id) AS node_id, CASE WHEN type = 'Gateway' THEN 'Service' ELSE type END AS type FROM (
SELECT *, row_number() OVER (PARTITION BY graph_id, trim(node_id) ORDER BY pos) AS r FROM raw_nodes WHERE trim(coalesce(node_id, '')) <> '') x WHERE r = 1""")
def validation_clean(spark, sf):
    return rg.validate(t.derive(spark, sf, "raw_nodes"), t.derive(spark, sf, "raw_edges"))[1].select("graph_id", "node_id", "type")


cte("sight", """SELECT split_part(graph_id, '-', 1) AS g, node_id, pos + CASE WHEN graph_id LIKE '%-v2' THEN 100 ELSE 0 END AS pos, name, type, technology, description, ev_file FROM fleet_nodes""")


def _sightings(spark, sf):
    n, _ = fleet(spark, sf)
    second = F.col("graph_id").endswith("-v2")
    return n.select(
        F.substring_index("graph_id", "-", 1).alias("graph_id"), "node_id",
        (F.col("pos") + F.when(second, 100).otherwise(0)).alias("pos"), "name", "type", "technology", "description",
        F.create_map(F.lit("name"), "name", F.concat(F.lit("seen_"), F.right("graph_id", F.lit(2))), F.col("pos").cast("string")).alias("metadata"),
        F.array_compact(F.array("ev_file", F.concat(F.lit("src/"), "node_id"))).alias("associated_files"))


@query("e01_merge_nodes", """SELECT g AS graph_id, node_id, CAST(min(pos) AS INT) AS pos, min_by(name, pos) AS name, min_by(type, pos) AS type,
 coalesce(min_by(technology, pos) FILTER (technology IS NOT NULL AND technology <> 'Generic'), 'Generic') AS technology, min_by(description, pos) AS description FROM sight GROUP BY g, node_id""")
def merge_nodes(spark, sf):
    return rg.merge_nodes(_sightings(spark, sf))


@query("e01_merge_metadata", """SELECT g AS graph_id, node_id, 'name' AS key, max_by(name, pos) AS value FROM sight GROUP BY g, node_id
UNION ALL SELECT g, node_id, CASE WHEN pos >= 100 THEN 'seen_v2' ELSE 'seen_v1' END, CAST(pos % 100 AS VARCHAR) FROM sight""")
def merge_metadata(spark, sf):
    return rg.merge_metadata(_sightings(spark, sf))


@query("e01_merge_files", """SELECT g AS graph_id, node_id, path, CAST(min(pos) AS INT) AS first_pos FROM (SELECT g, node_id, pos, ev_file AS path FROM sight WHERE ev_file IS NOT NULL
UNION ALL SELECT g, node_id, pos, 'src/' || node_id FROM sight) x GROUP BY g, node_id, path""")
def merge_files(spark, sf):
    return rg.merge_files(_sightings(spark, sf))


cte("esight", "SELECT split_part(graph_id, '-', 1) AS g, edge_id, pos + CASE WHEN graph_id LIKE '%-v2' THEN 10000 ELSE 0 END AS pos, src, dst, type, protocol FROM fleet_edges")


def _edge_sightings(spark, sf):
    _, e = fleet(spark, sf)
    return e.select(F.substring_index("graph_id", "-", 1).alias("graph_id"), "edge_id",
                    (F.col("pos") + F.when(F.col("graph_id").endswith("-v2"), 10000).otherwise(0)).alias("pos"),
                    "src", "dst", "type", "protocol")


@query("e02_dedupe_edges", "SELECT g AS graph_id, src, dst, type, min_by(edge_id, pos) AS edge_id, CAST(min(pos) AS INT) AS pos FROM esight WHERE src <> dst GROUP BY g, src, dst, type")
def dedupe_edges(spark, sf):
    return rg.dedupe_edges(_edge_sightings(spark, sf)).drop("protocol")


@query("e03_prune_dangling", "SELECT e.graph_id, e.edge_id, EXISTS (SELECT 1 FROM decl a WHERE a.g = e.graph_id AND a.v = e.src) AND EXISTS (SELECT 1 FROM decl a WHERE a.g = e.graph_id AND a.v = e.dst) AS kept FROM fleet_edges e")
def prune_dangling(spark, sf):
    kept, gone = rg.prune_dangling(*fleet(spark, sf))
    return kept.select("graph_id", "edge_id", F.lit(True).alias("kept")).unionByName(
        gone.select("graph_id", "edge_id", F.lit(False).alias("kept")))


@query("e05_model_stats", """SELECT d.g AS graph_id, count(*) FILTER (type IN ('Service', 'Application')) AS services, count(*) FILTER (type = 'API') AS apis, count(*) FILTER (type IN ('Database', 'Queue')) AS databases,
 count(*) FILTER (type IN ('Module', 'Package')) AS modules, count(*) FILTER (type = 'Library') AS libraries, count(*) FILTER (type = 'External System') AS external_systems, count(*) AS total_nodes,
 (SELECT count(*) FROM fleet_edges e WHERE e.graph_id = d.g) AS total_edges FROM decl d GROUP BY d.g""")
def model_stats(spark, sf):
    return rg.model_stats(*fleet(spark, sf))


@query("e13_protocol_breakdown", "SELECT graph_id, coalesce(protocol, 'Default') AS protocol, count(*) AS n FROM fleet_edges GROUP BY ALL")
def protocol_breakdown(spark, sf):
    return rg.protocol_breakdown(fleet(spark, sf)[1])


@query("e14_edge_kpis", "SELECT graph_id, count(*) FILTER (type = 'CALLS') AS calls, count(*) FILTER (type IN ('QUERIES', 'USES', 'CONNECTS_TO')) AS data_links, count(*) FILTER (ev_confidence = 'HIGH') AS high_confidence FROM fleet_edges GROUP BY graph_id")
def edge_kpis(spark, sf):
    return rg.edge_kpis(fleet(spark, sf)[1])


@query("e20_top_risky_edges", "SELECT g AS graph_id, edge_id, rk AS place FROM erisk WHERE rk <= 15")
def top_risky_edges(spark, sf):
    e = analysis(spark, sf)["edge_risk"].select("graph_id", "edge_id", "risk_score", "pos")
    return rk.top_k(e, ["graph_id"], [F.desc("risk_score"), "pos"], 15).select("graph_id", "edge_id", "place")


# --- looking things up --------------------------------------------------------------------------

cte("evid", """SELECT graph_id, 'rel-' || edge_id AS item_id, src AS source_name, dst AS target_name, type, ev_file AS file,
 CASE WHEN ev_line_end <> ev_line THEN ev_line || '–' || ev_line_end ELSE CAST(ev_line AS VARCHAR) END AS line_range, coalesce(ev_snippet, 'No source lines stored.') AS snippet,
 coalesce(ev_confidence, 'HIGH') AS confidence, coalesce(ev_method, 'AST Dependency Scanner') AS method, description FROM fleet_edges WHERE ev_file IS NOT NULL
UNION ALL SELECT graph_id, 'ent-' || node_id, name, NULL, type, ev_file, NULL, 'No source lines stored.', 'HIGH', 'AST Module Parser', description FROM fleet_nodes WHERE ev_file IS NOT NULL""")


@query("d10_edge_labels", "SELECT e.graph_id, e.edge_id, coalesce(a.name, e.src) AS src_name, coalesce(b.name, e.dst) AS dst_name FROM fleet_edges e LEFT JOIN decl a ON a.g = e.graph_id AND a.v = e.src LEFT JOIN decl b ON b.g = e.graph_id AND b.v = e.dst")
def edge_labels(spark, sf):
    n, e = fleet(spark, sf)
    return sc.labelled(e, n).select("graph_id", "edge_id", "src_name", "dst_name")


@query("d11_incident_edges", "SELECT graph_id, edge_id, CASE WHEN src = 'c15' THEN dst ELSE src END AS other_id FROM fleet_edges WHERE src = 'c15' OR dst = 'c15'")
def incident_edges(spark, sf):
    return fi.incident_edges(fleet(spark, sf)[1], "c15")


@query("k01_edge_filter", "SELECT graph_id, edge_id FROM fleet_edges WHERE type = 'USES' AND ev_confidence = 'MEDIUM' AND (contains(src, 'c1') OR contains(dst, 'c1') OR contains(lower(protocol), 'c1') OR contains(ev_file, 'c1'))")
def edge_filter(spark, sf):
    return fi.edge_filter(fleet(spark, sf)[1], "USES", "MEDIUM", " C1").select("graph_id", "edge_id")


@query("k02_evidence_list", "SELECT * FROM evid")
def evidence_list(spark, sf):
    return fi.evidence_list(*fleet(spark, sf))


@query("k03_evidence_filter", "SELECT graph_id, item_id FROM evid WHERE confidence = 'HIGH' AND (contains(lower(file), 'main.ts') OR contains(lower(source_name), 'main.ts') OR contains(lower(target_name), 'main.ts') OR contains(lower(description), 'main.ts'))")
def evidence_filter(spark, sf):
    return fi.evidence_filter(fi.evidence_list(*fleet(spark, sf)), "HIGH", "MAIN.ts").select("graph_id", "item_id")


@query("e15_evidence_kpis", "SELECT graph_id, count(*) FILTER (confidence = 'HIGH') AS high_confidence, count(*) FILTER (contains(method, 'AST')) AS ast, count(*) FILTER (contains(method, 'Manifest')) AS manifest FROM evid GROUP BY graph_id")
def evidence_kpis(spark, sf):
    return fi.evidence_kpis(fi.evidence_list(*fleet(spark, sf)))


@query("k08_node_match", "SELECT graph_id, min_by(node_id, pos) AS node_id, min_by(name, pos) AS name FROM fleet_nodes WHERE lower(name) = 'component 1' OR lower(node_id) = 'component 1' OR contains('component 1', lower(name)) OR contains(lower(name), 'component 1') GROUP BY graph_id")
def node_match(spark, sf):
    return fi.node_match(fleet(spark, sf)[0], "Component 1")


@query("k09_direct_neighbours", """SELECT x.*, coalesce(d.name, x.other_id) AS other_name FROM (
SELECT graph_id, dst AS node_id, 'depends on it' AS role, src AS other_id, coalesce(protocol, type) AS via, edge_id FROM fleet_edges
UNION ALL SELECT graph_id, src, 'it depends on', dst, coalesce(protocol, type), edge_id FROM fleet_edges) x LEFT JOIN decl d ON d.g = x.graph_id AND d.v = x.other_id""")
def direct_neighbours(spark, sf):
    n, e = fleet(spark, sf)
    return fi.direct_neighbours(e, n)


@query("k10_impact_rows", "SELECT g AS graph_id, t AS node_id, 'upstream' AS side, s AS other_id, d = 1 AS is_direct FROM dist UNION ALL SELECT g, s, 'downstream', t, d = 1 FROM dist")
def impact_rows(spark, sf):
    return fi.impact_rows(analysis(spark, sf)["walks"])


@query("k11_cascade", """SELECT m.g AS graph_id, m.v AS node_id, m.blast + 1 AS affected_total, round((m.blast + 1) * CAST(100 AS DOUBLE) / n.n, 0) AS blast_pct,
 CASE WHEN m.blast + 1 > 5 THEN 'High' WHEN m.blast + 1 > 2 THEN 'Moderate' ELSE 'Low' END AS cascade FROM met m JOIN dn n ON n.g = m.g""")
def cascade(spark, sf):
    return fi.cascade(analysis(spark, sf)["metrics"])


@query("k12_counts_by_type", "SELECT g AS graph_id, count(*) FILTER (type = 'Service') AS services, count(*) FILTER (type = 'Database') AS databases, count(*) FILTER (type = 'API') AS apis, count(*) AS total FROM decl GROUP BY g")
def counts_by_type(spark, sf):
    return fi.counts_by_type(fleet(spark, sf)[0])


@query("k12_services", "SELECT g AS graph_id, v AS node_id, name FROM decl WHERE type = 'Service'")
def services(spark, sf):
    return fi.nodes_of_type(fleet(spark, sf)[0], "service").select("graph_id", "node_id", "name")


@query("k14_node_evidence", "SELECT graph_id, v AS node_id, min_by(edge_id, pos) AS edge_id, min_by(ev_file, pos) AS ev_file FROM (SELECT graph_id, src AS v, pos, edge_id, ev_file FROM fleet_edges WHERE ev_snippet <> '' UNION ALL SELECT graph_id, dst, pos, edge_id, ev_file FROM fleet_edges WHERE ev_snippet <> '') x GROUP BY graph_id, v")
def node_evidence(spark, sf):
    return fi.node_evidence(fleet(spark, sf)[1])


PRF = """CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 1 END AS {0}_precision, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 1 END AS {0}_recall"""
F1 = "CASE WHEN {0}_precision + {0}_recall > 0 THEN 2 * {0}_precision * {0}_recall / ({0}_precision + {0}_recall) ELSE 0 END AS {0}_f1"
cte("nacc", """SELECT g, count(*) FILTER (origin = 'BOTH') AS tp, count(*) FILTER (origin = 'V2') AS fp, count(*) FILTER (origin = 'V1') AS fn FROM ndiff GROUP BY g""")
cte("eacc", """SELECT coalesce(a.g, b.g) AS g, coalesce(a.type, b.type) AS type, CAST(sum(CASE WHEN a.r IS NOT NULL AND b.r IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS tp,
 CAST(sum(CASE WHEN b.r IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN a.r IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS fn
FROM (SELECT graph_id AS g, src, dst, 'x' AS type, row_number() OVER (PARTITION BY graph_id, src, dst) AS r FROM e_v2) a
FULL JOIN (SELECT graph_id AS g, src, dst, 'x' AS type, row_number() OVER (PARTITION BY graph_id, src, dst) AS r FROM e_v1) b ON a.g = b.g AND a.src = b.src AND a.dst = b.dst AND a.r = b.r GROUP BY 1, 2""")
cte("eacc_row", f"SELECT *, {F1.format('edge')} FROM (SELECT g AS graph_id, tp, fp, fn, {PRF.format('edge')} FROM eacc) x")


@query("k15_node_accuracy", f"SELECT *, {F1.format('node')} FROM (SELECT g AS graph_id, tp, fp, fn, {PRF.format('node')} FROM nacc) x")
def node_accuracy(spark, sf):
    n1, _, n2, _ = versions(spark, sf)
    return fi.node_accuracy(n2, n1)


@query("k15_edge_accuracy", "SELECT * FROM eacc_row")
def edge_accuracy(spark, sf):
    _, e1, _, e2 = versions(spark, sf)
    return fi.edge_accuracy(e2, e1)


@query("k17_macro_average", "SELECT round(avg(edge_precision), 9) AS edge_precision, round(avg(edge_recall), 9) AS edge_recall, round(avg(edge_f1), 9) AS edge_f1 FROM eacc_row")
def macro_average(spark, sf):
    _, e1, _, e2 = versions(spark, sf)
    row = fi.macro_average(fi.edge_accuracy(e2, e1))
    return row.select(*[F.round(c, 9).alias(c) for c in row.columns])


@query("k17_accuracy_by_type", f"""SELECT *, {F1.format('edge')} FROM (SELECT type, tp, fp, fn, {PRF.format('edge')} FROM (SELECT type, count(*) FILTER (origin = 'BOTH') AS tp, count(*) FILTER (origin = 'V2') AS fp, count(*) FILTER (origin = 'V1') AS fn FROM ediff GROUP BY type) y) x""")
def accuracy_by_type(spark, sf):
    _, e1, _, e2 = versions(spark, sf)
    return fi.edge_accuracy_by_type(e2, e1)


@query("k18_node_slice", """SELECT d.g AS graph_id, d.v AS node_id FROM decl d JOIN spof s ON s.g = d.g AND s.v = d.v AND s.is_spof
WHERE d.type = 'Service' AND (contains(lower(d.name), 'component') OR contains(lower(d.technology), 'component')) AND EXISTS (SELECT 1 FROM fleet_edges e WHERE e.graph_id = d.g AND e.type = 'USES' AND (e.src = d.v OR e.dst = d.v))""")
def node_slice(spark, sf):
    a = analysis(spark, sf)
    from depfleet.operators.walks import cycle_nodes
    return fi.node_slice(a["nodes"], a["criticality"], a["spof"], cycle_nodes(a["link"], a["strong"]), a["edges"],
                         "Service", "component", "SPOF", "USES").select("graph_id", "node_id")


@query("k19_edge_risk_slice", "SELECT g AS graph_id, edge_id, lvl AS risk_level FROM erisk WHERE lvl IN ('CRITICAL', 'HIGH')")
def edge_risk_slice(spark, sf):
    return fi.edge_risk_slice(analysis(spark, sf)["edge_risk"]).select("graph_id", "edge_id", "risk_level")


@query("k20_blast_split", "SELECT g AS graph_id, v AS node_id, ind AS direct_callers, blast - ind AS transitive_callers FROM met")
def blast_split(spark, sf):
    return fi.blast_split(analysis(spark, sf)["metrics"])

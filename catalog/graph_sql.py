"""Check SQL for graph operators: plain recursive SQL, written apart from the Spark side."""

from .base import cte


def fair(x: str, digits: int) -> str:
    """Half-up rounding that counts a near tie as a tie."""
    return f"(floor(({x}) * 1e{digits} + 0.500001) / 1e{digits})"


cte("lk", "SELECT DISTINCT graph_id AS g, src, dst FROM fleet_edges")
cte("hop", "SELECT g, src, dst FROM lk WHERE src <> dst")
cte("ends", "SELECT g, src AS v FROM lk UNION SELECT g, dst AS v FROM lk")
cte("decl", "SELECT graph_id AS g, node_id AS v, pos, name, type, technology FROM fleet_nodes")
cte("vx", "SELECT g, v FROM decl UNION SELECT g, v FROM ends")
cte("sz", """SELECT a.g, a.n, coalesce(b.e, 0) AS e FROM (SELECT g, count(*) AS n FROM vx GROUP BY g) a
LEFT JOIN (SELECT g, count(*) AS e FROM lk GROUP BY g) b ON a.g = b.g""")
cte("deg", """SELECT x.g, x.v, count(DISTINCT i.src) AS ind, count(DISTINCT o.dst) AS outd FROM vx x
LEFT JOIN lk i ON i.g = x.g AND i.dst = x.v LEFT JOIN lk o ON o.g = x.g AND o.src = x.v GROUP BY x.g, x.v""")
cte("walk", """SELECT g, src AS s, dst AS t, 1 AS d, CAST(1 AS DOUBLE) AS n FROM hop
UNION ALL
SELECT w.g, w.s, h.dst, w.d + 1, sum(w.n) FROM walk w JOIN hop h ON h.g = w.g AND h.src = w.t
WHERE w.d < 12 GROUP BY w.g, w.s, h.dst, w.d + 1""")
cte("dist", "SELECT g, s, t, min(d) AS d, min_by(n, d) AS n FROM walk WHERE s <> t GROUP BY g, s, t")
cte("reach", """SELECT x.g, x.v, (SELECT count(*) FROM dist a WHERE a.g = x.g AND a.t = x.v) AS blast,
(SELECT count(*) FROM dist b WHERE b.g = x.g AND b.s = x.v) AS foot FROM vx x""")
cte("sp", """SELECT g, src AS s, dst AS t, 1 AS d, [src, dst] AS path FROM hop
UNION ALL
SELECT w.g, w.s, h.dst, w.d + 1, min(list_append(w.path, h.dst)) FROM sp w
JOIN hop h ON h.g = w.g AND h.src = w.t
JOIN dist x ON x.g = w.g AND x.s = w.s AND x.t = h.dst AND x.d = w.d + 1
GROUP BY w.g, w.s, h.dst, w.d + 1""")
cte("btw", """SELECT x.g, x.v, coalesce(b.c, 0) * CASE WHEN z.n > 2 THEN 1.0 / ((z.n - 1) * (z.n - 2)) ELSE 1 END AS cb
FROM vx x JOIN sz z ON z.g = x.g LEFT JOIN (
  SELECT a.g, a.t AS v, sum(a.n * b.n / c.n) AS c FROM dist a JOIN dist b ON b.g = a.g AND b.s = a.t
  JOIN dist c ON c.g = a.g AND c.s = a.s AND c.t = b.t AND c.d = a.d + b.d GROUP BY a.g, a.t) b
ON b.g = x.g AND b.v = x.v""")
cte("pr0", """SELECT x.g, x.v, z.n, coalesce(o.k, 0) AS od FROM vx x JOIN sz z ON z.g = x.g
LEFT JOIN (SELECT g, src AS v, count(*) AS k FROM lk GROUP BY g, src) o ON o.g = x.g AND o.v = x.v""")
cte("pr", """SELECT g, v, n, od, CAST(1.0 / n AS DOUBLE) AS r, 0 AS it, CAST(1e9 AS DOUBLE) AS err FROM pr0
UNION ALL
SELECT c.g, c.v, c.n, c.od, x.nr, c.it + 1, sum(abs(x.nr - c.r)) OVER (PARTITION BY c.g)
FROM pr c JOIN (
  SELECT a.g, a.v, CAST(0.15 AS DOUBLE) / a.n + CAST(0.85 AS DOUBLE) * (coalesce(b.got, 0) + coalesce(l.loose, 0) / a.n) AS nr
  FROM pr a
  LEFT JOIN (SELECT h.g, h.dst AS v, sum(p.r / p.od) AS got FROM pr p JOIN lk h ON h.g = p.g AND h.src = p.v
             GROUP BY h.g, h.dst) b ON b.g = a.g AND b.v = a.v
  LEFT JOIN (SELECT g, sum(r) AS loose FROM pr WHERE od = 0 GROUP BY g) l ON l.g = a.g) x
ON x.g = c.g AND x.v = c.v
WHERE c.err >= c.n * CAST(1e-6 AS DOUBLE) AND c.it < 200""")
cte("rank_of", "SELECT g, v, max_by(r, it) AS r FROM pr GROUP BY g, v")
cte("und", "SELECT g, src AS a, dst AS b FROM hop UNION SELECT g, dst, src FROM hop")
cte("uclo", "SELECT g, a, b FROM und UNION SELECT u.g, u.a, e.b FROM uclo u JOIN und e ON e.g = u.g AND e.a = u.b")
cte("weak", "SELECT x.g, x.v, least(x.v, coalesce(min(u.b), x.v)) AS c FROM vx x LEFT JOIN uclo u ON u.g = x.g AND u.a = x.v GROUP BY x.g, x.v")
cte("scc", """SELECT x.g, x.v, least(x.v, coalesce(min(a.t), x.v)) AS c FROM vx x
LEFT JOIN (SELECT p.g, p.s, p.t FROM dist p JOIN dist q ON q.g = p.g AND q.s = p.t AND q.t = p.s) a
ON a.g = x.g AND a.s = x.v GROUP BY x.g, x.v""")
cte("cond", """SELECT DISTINCT h.g, a.c AS src, b.c AS dst FROM hop h JOIN scc a ON a.g = h.g AND a.v = h.src
JOIN scc b ON b.g = h.g AND b.v = h.dst WHERE a.c <> b.c""")
cte("lev", "SELECT DISTINCT g, c AS v, 0 AS k FROM scc UNION SELECT l.g, c.dst, l.k + 1 FROM lev l JOIN cond c ON c.g = l.g AND c.src = l.v")
cte("depth", "SELECT g, max(k) AS depth FROM lev GROUP BY g")
cte("inner_hop", """SELECT h.g, h.src, h.dst FROM hop h JOIN scc a ON a.g = h.g AND a.v = h.src
JOIN scc b ON b.g = h.g AND b.v = h.dst WHERE a.c = b.c""")
cte("cyc_walk", """SELECT g, src AS s, dst AS t, [src, dst] AS path FROM inner_hop WHERE src < dst
UNION ALL
SELECT w.g, w.s, h.dst, list_append(w.path, h.dst) FROM cyc_walk w JOIN inner_hop h ON h.g = w.g AND h.src = w.t
WHERE h.dst > w.s AND NOT list_contains(w.path, h.dst)""")
cte("cyc_all", """SELECT w.g, w.path FROM cyc_walk w JOIN inner_hop h ON h.g = w.g AND h.src = w.t AND h.dst = w.s
UNION ALL SELECT g, [src] FROM lk WHERE src = dst""")
cte("cyc", "SELECT g, path, CAST(row_number() OVER (PARTITION BY g ORDER BY len(path), path) AS INT) AS k FROM cyc_all")
cte("cyc_n", "SELECT g, count(*) AS n FROM cyc GROUP BY g")
cte("cyc_edge", """SELECT DISTINCT g, path[i] AS src, CASE WHEN i = len(path) THEN path[1] ELSE path[i + 1] END AS dst
FROM (SELECT g, path, unnest(range(1, len(path) + 1)) AS i FROM cyc) x""")
cte("cyc_node", "SELECT DISTINCT g, src AS v FROM cyc_edge")
cte("ban", """SELECT h.g, x.v, h.src AS s, h.dst AS t FROM hop h JOIN vx x ON x.g = h.g WHERE h.src <> x.v AND h.dst <> x.v
UNION
SELECT b.g, b.v, b.s, h.dst FROM ban b JOIN hop h ON h.g = b.g AND h.src = b.t WHERE h.dst <> b.v""")
cte("sev", """SELECT a.g, x.v, a.s, a.t FROM dist a JOIN vx x ON x.g = a.g WHERE x.v <> a.s AND x.v <> a.t
AND NOT EXISTS (SELECT 1 FROM ban b WHERE b.g = a.g AND b.v = x.v AND b.s = a.s AND b.t = a.t)""")
cte("met", f"""SELECT d.g, d.v, d.pos, d.name, d.type, d.technology, g2.ind, g2.outd, r.blast, r.foot,
{fair('b.cb', 4)} AS cb, {fair('p.r', 4)} AS pr FROM decl d JOIN deg g2 ON g2.g = d.g AND g2.v = d.v
JOIN reach r ON r.g = d.g AND r.v = d.v JOIN btw b ON b.g = d.g AND b.v = d.v JOIN rank_of p ON p.g = d.g AND p.v = d.v""")
cte("shared", "SELECT g, v FROM met WHERE (type IN ('Database', 'External System') OR outd = 0) AND ind >= 2")
cte("aff", """SELECT x.g, x.v, x.a FROM (SELECT g, v, s AS a FROM sev UNION SELECT g, v, t FROM sev
UNION SELECT d.g, d.t, d.s FROM dist d JOIN shared z ON z.g = d.g AND z.v = d.t) x JOIN met m ON m.g = x.g AND m.v = x.v""")
cte("spof", """SELECT g, v, pos, name, type, ind, (sv > 0 OR sh) AS is_spof,
CASE WHEN sh AND sv = 0 THEN 'SHARED_DATASTORE' ELSE 'TRANSIT' END AS spof_type, lost, aff_n,
CASE WHEN NOT (sv > 0 OR sh) THEN 'NONE' WHEN lost >= 5 OR (sh AND ind >= 4) THEN 'CRITICAL'
     WHEN lost >= 2 OR ind >= 2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM (SELECT m.*, coalesce(s.n, 0) AS sv, (h.v IS NOT NULL) AS sh, coalesce(a.n, 0) AS aff_n,
  coalesce(s.n, 0) + CASE WHEN h.v IS NOT NULL THEN m.blast ELSE 0 END AS lost
  FROM met m JOIN sz z ON z.g = m.g AND z.n > 1
  LEFT JOIN (SELECT g, v, count(*) AS n FROM sev GROUP BY g, v) s ON s.g = m.g AND s.v = m.v
  LEFT JOIN (SELECT g, v, count(*) AS n FROM aff GROUP BY g, v) a ON a.g = m.g AND a.v = m.v
  LEFT JOIN shared h ON h.g = m.g AND h.v = m.v) y""")
cte("cx", """SELECT *, CASE WHEN points >= 7 THEN 'HIGH' WHEN points >= 3.5 THEN 'MEDIUM' ELSE 'LOW' END AS rating FROM (
SELECT *, CASE WHEN density > 0.20 THEN 3 WHEN density > 0.12 THEN 2 WHEN density > 0.06 THEN 1 ELSE 0 END
 + CASE WHEN cyclo > 10 THEN 3 WHEN cyclo > 5 THEN 2 WHEN cyclo > 2 THEN 1 ELSE 0 END
 + CASE WHEN cycles > 0 THEN 3 ELSE 0 END + CASE WHEN depth >= 5 THEN 2 WHEN depth >= 3 THEN 1 ELSE 0 END AS points
FROM (SELECT z.g, z.n, z.e, round(CAST(2.0 * z.e AS DOUBLE) / z.n, 2) AS avgdeg,
 CASE WHEN z.n > 1 THEN round(CAST(z.e AS DOUBLE) / (z.n * (z.n - 1)), 4) ELSE 0 END AS density,
 w.p, s.k AS sccs, greatest(1, z.e - z.n + 2 * w.p) AS cyclo, d.depth, coalesce(c.n, 0) AS cycles
 FROM sz z JOIN (SELECT g, count(DISTINCT c) AS p FROM weak GROUP BY g) w ON w.g = z.g
 JOIN (SELECT g, count(DISTINCT c) AS k FROM scc GROUP BY g) s ON s.g = z.g
 JOIN depth d ON d.g = z.g LEFT JOIN cyc_n c ON c.g = z.g) a) b""")


def _norm(c: str) -> str:
    lo, hi = f"min({c}) OVER (PARTITION BY m.g)", f"max({c}) OVER (PARTITION BY m.g)"
    return (f"CASE WHEN {hi} < 1e-9 THEN 0.0 WHEN {hi} - {lo} < 1e-9 THEN 0.5 "
            f"ELSE greatest(0.0, least(1.0, CAST({c} - {lo} AS DOUBLE) / ({hi} - {lo}))) END")


cte("crit", f"""SELECT *, CASE WHEN score >= 0.70 THEN 'CRITICAL' WHEN score >= 0.45 THEN 'HIGH'
WHEN score >= 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS tier,
CAST(row_number() OVER (PARTITION BY g ORDER BY score DESC, pos) AS INT) AS rk FROM (
SELECT *, {fair('CAST(0.30 AS DOUBLE) * ncb + CAST(0.25 AS DOUBLE) * npr + CAST(0.20 AS DOUBLE) * nind + CAST(0.15 AS DOUBLE) * nbl + CAST(0.10 AS DOUBLE) * nsp', 4)} AS score FROM (
SELECT m.*, s.is_spof, s.lost, CAST({_norm('m.cb')} AS DOUBLE) AS ncb, CAST({_norm('m.pr')} AS DOUBLE) AS npr,
 CAST({_norm('m.ind')} AS DOUBLE) AS nind, CAST({_norm('m.blast')} AS DOUBLE) AS nbl,
 CASE WHEN s.is_spof THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS nsp
FROM met m LEFT JOIN spof s ON s.g = m.g AND s.v = m.v) a) b""")
cte("erisk", """SELECT *, CASE WHEN score >= 0.70 THEN 'CRITICAL' WHEN score >= 0.50 THEN 'HIGH'
WHEN score >= 0.30 THEN 'MEDIUM' ELSE 'LOW' END AS lvl,
CAST(row_number() OVER (PARTITION BY g ORDER BY score DESC, pos) AS INT) AS rk FROM (
SELECT e.graph_id AS g, e.edge_id, e.pos, e.src, e.dst, e.type, e.protocol, coalesce(a.name, e.src) AS src_name,
 coalesce(b.name, e.dst) AS dst_name, (y.g IS NOT NULL) AS on_cycle, coalesce(s.is_spof, false) AS tspof,
 coalesce(c.score, CAST(0.2 AS DOUBLE)) AS tcrit, c.tier, d.ind,
 round(least(CAST(1 AS DOUBLE), CAST(0.15 AS DOUBLE) + CASE WHEN coalesce(s.is_spof, false) THEN CAST(0.35 AS DOUBLE) ELSE 0 END
  + CASE WHEN c.tier = 'CRITICAL' THEN CAST(0.25 AS DOUBLE) WHEN c.tier = 'HIGH' THEN CAST(0.15 AS DOUBLE) ELSE 0 END
  + CASE WHEN y.g IS NOT NULL THEN CAST(0.30 AS DOUBLE) ELSE 0 END
  + CASE WHEN d.ind >= 4 THEN CAST(0.15 AS DOUBLE) ELSE 0 END), 3) AS score
FROM fleet_edges e LEFT JOIN decl a ON a.g = e.graph_id AND a.v = e.src LEFT JOIN decl b ON b.g = e.graph_id AND b.v = e.dst
LEFT JOIN spof s ON s.g = e.graph_id AND s.v = e.dst LEFT JOIN crit c ON c.g = e.graph_id AND c.v = e.dst
LEFT JOIN deg d ON d.g = e.graph_id AND d.v = e.dst
LEFT JOIN cyc_edge y ON y.g = e.graph_id AND y.src = e.src AND y.dst = e.dst) x""")
cte("nrisk", """SELECT *, CASE WHEN score >= 0.65 OR (is_spof AND crit) THEN 'CRITICAL' WHEN score >= 0.45 OR is_spof THEN 'HIGH'
WHEN score >= 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS lvl FROM (
SELECT d.g, d.v, d.name, d.type, coalesce(s.is_spof, false) AS is_spof, coalesce(c.tier IN ('CRITICAL', 'HIGH'), false) AS crit,
 (y.v IS NOT NULL) AS in_cycle, c.tier, round(least(CAST(1 AS DOUBLE), CAST(0.1 AS DOUBLE) + coalesce(c.score, 0) * CAST(0.4 AS DOUBLE)
 + CASE WHEN coalesce(s.is_spof, false) THEN CAST(0.35 AS DOUBLE) ELSE 0 END
 + CASE WHEN y.v IS NOT NULL THEN CAST(0.25 AS DOUBLE) ELSE 0 END), 3) AS score
FROM decl d LEFT JOIN spof s ON s.g = d.g AND s.v = d.v LEFT JOIN crit c ON c.g = d.g AND c.v = d.v
LEFT JOIN cyc_node y ON y.g = d.g AND y.v = d.v) x""")
cte("sysrisk", """SELECT *, round(least(CAST(100 AS DOUBLE), greatest(CAST(5 AS DOUBLE), cp + sp + yp + ep + xp)), 1) AS score FROM (
SELECT c.g, least(25.0, c.density * CAST(30 AS DOUBLE) + c.avgdeg * CAST(2.5 AS DOUBLE)) AS cp,
 least(CAST(30 AS DOUBLE), coalesce(s.n, 0) * CAST(12 AS DOUBLE)) AS sp, least(CAST(20 AS DOUBLE), c.cycles * CAST(10 AS DOUBLE)) AS yp,
 least(CAST(15 AS DOUBLE), coalesce(e.n, 0) * CAST(3.5 AS DOUBLE)) AS ep,
 least(CAST(10 AS DOUBLE), coalesce(x.n, 0) * CAST(3 AS DOUBLE) + greatest(0, c.depth - 3) * CAST(1.5 AS DOUBLE)) AS xp
FROM cx c LEFT JOIN (SELECT g, count(*) AS n FROM spof WHERE is_spof GROUP BY g) s ON s.g = c.g
LEFT JOIN (SELECT g, count(*) AS n FROM erisk WHERE lvl IN ('CRITICAL', 'HIGH') GROUP BY g) e ON e.g = c.g
LEFT JOIN (SELECT g, count(*) AS n FROM decl WHERE type = 'External System' GROUP BY g) x ON x.g = c.g) y""")
cte("simple_path", """SELECT g, v AS s, v AS t, [v] AS path FROM vx
UNION ALL
SELECT p.g, p.s, h.dst, list_append(p.path, h.dst) FROM simple_path p JOIN hop h ON h.g = p.g AND h.src = p.t
WHERE len(p.path) < 15 AND NOT list_contains(p.path, h.dst)""")
cte("supply_reach", """SELECT src AS s, dst AS t FROM supply_edges
UNION SELECT r.s, e.dst FROM supply_reach r JOIN supply_edges e ON e.src = r.t""")
cte("dund", """SELECT u.g, u.a, u.b FROM und u JOIN decl x ON x.g = u.g AND x.v = u.a JOIN decl y ON y.g = u.g AND y.v = u.b""")
cte("dclo", "SELECT g, a, b FROM dund UNION SELECT u.g, u.a, e.b FROM dclo u JOIN dund e ON e.g = u.g AND e.a = u.b")
cte("uban", """SELECT u.g, x.v, u.a, u.b FROM dund u JOIN decl x ON x.g = u.g WHERE u.a <> x.v AND u.b <> x.v
UNION SELECT b.g, b.v, b.a, u.b FROM uban b JOIN dund u ON u.g = b.g AND u.a = b.b WHERE u.b <> b.v""")
cte("tcore", """SELECT h.g, h.src, h.dst FROM hop h JOIN decl a ON a.g = h.g AND a.v = h.src AND a.type NOT IN ('Database', 'External System')
JOIN decl b ON b.g = h.g AND b.v = h.dst AND b.type NOT IN ('Database', 'External System')""")
cte("tclo", "SELECT g, src AS a, dst AS b FROM tcore UNION SELECT t.g, t.a, c.dst FROM tclo t JOIN tcore c ON c.g = t.g AND c.src = t.b")
cte("tscc", """SELECT d.g, d.v, least(d.v, coalesce(min(x.b), d.v)) AS c FROM decl d
LEFT JOIN (SELECT p.g, p.a, p.b FROM tclo p JOIN tclo q ON q.g = p.g AND q.a = p.b AND q.b = p.a) x ON x.g = d.g AND x.a = d.v
WHERE d.type NOT IN ('Database', 'External System') GROUP BY d.g, d.v""")
cte("tentry", """SELECT d.g, d.v FROM decl d WHERE d.type NOT IN ('Database', 'External System') AND (d.type = 'Application'
 OR NOT EXISTS (SELECT 1 FROM lk h JOIN decl a ON a.g = h.g AND a.v = h.src WHERE h.g = d.g AND h.dst = d.v))""")
cte("tstart", """SELECT g, v FROM tentry UNION SELECT g, min_by(v, pos) FROM decl WHERE type NOT IN ('Database', 'External System')
AND g NOT IN (SELECT g FROM tentry) GROUP BY g""")
cte("tlev", """SELECT DISTINCT e.g, c.c AS v, 0 AS k FROM tstart e JOIN tscc c ON c.g = e.g AND c.v = e.v
UNION SELECT l.g, b.c, l.k + 1 FROM tlev l JOIN tscc a ON a.g = l.g AND a.c = l.v JOIN tcore h ON h.g = a.g AND h.src = a.v
JOIN tscc b ON b.g = h.g AND b.v = h.dst WHERE b.c <> a.c""")

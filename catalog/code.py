"""Queries over derived source repositories, documents and pages (a, b, c, d, e, h, k)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from depfleet.functions import kinds as k
from depfleet.functions import paths as p
from depfleet.functions import tiers as ti
from depfleet.operators import diff as d
from depfleet.operators import extract as x
from depfleet.operators import find as fi
from depfleet.operators import inventory as inv
from depfleet.operators import resolve as rs
from depfleet.plans.repository import extract_graph
from depfleet.sources import blueprint as bp
from depfleet.sources import code as cs
from depfleet.sources import runs as rn
from depfleet.sources import tables as t
from depfleet.staging import stage, staging_root

from .base import CTES, cte, memo, query
from .worlds import analysis, fleet, versions

for _name, (_, _sql) in t.RELATIONS.items():
    CTES.setdefault(_name, _sql)


def files(spark, sf):
    return memo(spark, sf, "files", lambda: stage(cs.code_files(spark, sf)).df)


def lines(spark, sf):
    return memo(spark, sf, "lines", lambda: stage(x.code_lines(files(spark, sf))).df)


def graph(spark, sf):
    return memo(spark, sf, "repository", lambda: extract_graph(files(spark, sf), lines(spark, sf)))


def docs(spark, sf, version):
    return memo(spark, sf, f"docs{version}", lambda: stage(cs.doc_version(spark, sf, version)).df)


def all_docs(spark, sf):
    table = lambda: cs.describe(t.derive(spark, sf, "doc_files").select("graph_id", "path", F.col("text").alias("content")))
    return memo(spark, sf, "all_docs", lambda: stage(table()).df)


def sql_list(values):
    return "(" + ", ".join("'" + v + "'" for v in values) + ")"


cte("cf", r"""SELECT graph_id AS g, path, regexp_extract(path, '[^/]*$') AS name, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\.[^.]*)$', 1)) AS ext,
 regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, count(*) AS n, count(text) AS nt, CASE WHEN count(text) = 0 THEN 0 ELSE sum(length(coalesce(text, ''))) + count(*) - 1 END AS size
FROM code_lines GROUP BY graph_id, path""")


def category_sql(path: str, name: str, ext: str) -> str:
    return f"""CASE WHEN {ext} IN {sql_list(k.MODEL_EXT)} THEN 'model_artifact'
 WHEN {ext} IN {sql_list(k.DATA_EXT)} OR contains(lower({path}), '/datafiles/') OR contains(lower({path}), '/datasets/') THEN 'dataset'
 WHEN lower({name}) IN {sql_list(k.MANIFEST_NAMES)} OR {ext} IN {sql_list(k.MANIFEST_EXT)} THEN 'manifest'
 WHEN regexp_matches(lower({path}), '/(test|tests|__tests__|spec|specs)/') OR starts_with(lower({name}), 'test_') OR ends_with(lower({name}), '_test' || {ext}) OR regexp_matches(lower({name}), '\\.(test|spec)\\.') THEN 'test'
 WHEN starts_with(lower({name}), '.env') OR {ext} IN ('.env', '.conf', '.ini', '.cfg') OR lower({name}) IN {sql_list(k.CONFIG_NAMES)} OR regexp_matches(lower({name}), '^\\.(eslint|prettier)')
  OR ({ext} IN ('.yaml', '.yml', '.toml', '.json') AND regexp_matches(lower({name}), 'config|settings|application|properties|env')) THEN 'config'
 WHEN {ext} IN {sql_list(k.SCRIPT_EXT)} OR regexp_matches(lower({path}), '/(scripts|bin)/') THEN 'script'
 WHEN {ext} IN {sql_list(k.DOC_EXT)} OR lower({name}) IN {sql_list(k.DOC_NAMES)} OR regexp_matches(lower({path}), '/(docs|review)/') THEN 'documentation'
 WHEN {ext} IN {sql_list(k.SOURCE_EXT)} THEN 'source' ELSE 'other' END""".replace("\\\\", "\\")


LANG_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in k.LANGUAGES.items())
cte("cfx", f"SELECT c.*, {category_sql('c.path', 'c.name', 'c.ext')} AS category, l.lang FROM cf c LEFT JOIN (VALUES {LANG_VALUES}) l(e, lang) ON l.e = c.ext")
cte("src_lines", r"""SELECT l.graph_id AS g, l.path, l.line, l.text, trim(l.text) AS t, c.ext, c.category, c.dir FROM code_lines l JOIN cfx c ON c.g = l.graph_id AND c.path = l.path WHERE c.nt > 0""")


# --- a: files -----------------------------------------------------------------------------------

@query("a04_file_table", "SELECT g AS graph_id, path, name, category, CASE WHEN ext = '' THEN 'no-ext' ELSE ext END AS extension, CAST(size AS BIGINT) AS size_bytes, CASE WHEN nt > 0 THEN n END AS lines_count, lang AS language FROM cfx")
def file_table(spark, sf):
    return cs.code_files(spark, sf).drop("content_hash", "content")


@query("a05_guard_issues", "SELECT graph_id, 'too_many_files' AS issue FROM doc_files GROUP BY graph_id HAVING count(*) > 100 UNION ALL SELECT graph_id, 'too_large' FROM doc_files GROUP BY graph_id HAVING sum(octet_length(encode(text))) > 500000")
def guard_issues(spark, sf):
    return inv.guard_files(all_docs(spark, sf), max_files=100, max_bytes=500_000)[0]


@query("a05_guarded_files", "SELECT g AS graph_id, path, CASE WHEN nt > 0 AND ext <> '.png' THEN n END AS lines_count FROM cf")
def guarded_files(spark, sf):
    kept = inv.guard_files(files(spark, sf))[1]
    return kept.select("graph_id", "path", k.line_count(F.col("content")).alias("lines_count"))


@query("a06_decode_text", "SELECT doc_id, text AS plain, text AS wide FROM documents")
def decoded(spark, sf):
    doc = t.read(spark, sf, "documents").select("doc_id", "text")
    wide = F.unhex(F.concat(F.lit("FFFE"), F.hex(F.encode("text", "UTF-16LE"))))
    return doc.select("doc_id", k.decode_text(F.encode("text", "UTF-8")).alias("plain"), k.decode_text(wide).alias("wide"))


@query("a08_latest_run", "SELECT CAST(o_custkey AS VARCHAR) AS project_id, max(o_orderdate) AS analyzed_at FROM orders GROUP BY o_custkey")
def latest_run(spark, sf):
    runs = t.read(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("project_id"), F.col("o_orderdate").alias("analyzed_at"))
    return rn.latest_runs(runs)


def _run_store(spark, sf):
    """Both versions of the fleet stored as two runs of each system, with their whole results."""
    def build():
        root, a = f"{staging_root(spark)}/runs-{uuid.uuid4().hex}", analysis(spark, sf)
        for version, at in (("v2", "2024-02-01 12:00:00"), ("v1", "2024-01-01 08:00:00")):
            of = {part: a[part].filter(F.col("graph_id").endswith(f"-{version}")).withColumn("graph_id", F.substring_index("graph_id", "-", 1))
                  for part in rn.PARTS}
            rn.append_run(of, root, F.lit(at).cast("timestamp"), F.lit(version))
        return root
    return memo(spark, sf, "run store", build)


cte("stored", """SELECT split_part(c.g, '-', 1) AS project_id, split_part(c.g, '-', 2) AS version, c.g, CASE WHEN c.g LIKE '%-v1' THEN TIMESTAMP '2024-01-01 08:00:00' ELSE TIMESTAMP '2024-02-01 12:00:00' END AS analyzed_at, c.* FROM cx c""")
cte("last_stored", "SELECT project_id, max_by(g, analyzed_at) AS g, max(version) AS version FROM stored GROUP BY project_id")


@query("a07_run_rows", """SELECT c.project_id, c.version, CAST(c.analyzed_at AS VARCHAR) AS analyzed_at, (SELECT count(*) FROM crit x WHERE x.g = c.g AND x.tier = 'CRITICAL') AS critical_count, (SELECT count(*) FROM erisk e WHERE e.g = c.g AND e.lvl IN ('CRITICAL', 'HIGH')) AS high_risk_count,
 (SELECT count(*) FROM spof s WHERE s.g = c.g AND s.is_spof) AS spof_count, c.rating AS complexity_rating FROM stored c""")
def run_rows(spark, sf):
    return rn.committed(spark, _run_store(spark, sf)).withColumn("analyzed_at", F.col("analyzed_at").cast("string")).drop("commit", "run_date")


@query("a07_stored_result", """SELECT m.g AS graph_id, m.v AS node_id, m.ind AS in_degree, m.outd AS out_degree, m.blast AS blast_radius, m.foot AS footprint, m.cb AS betweenness, m.pr AS pagerank FROM met m""")
def stored_result(spark, sf):
    root = _run_store(spark, sf)
    m = rn.run_view(spark, root, "metrics", rn.committed(spark, root))
    return m.select(F.concat_ws("-", "project_id", "version").alias("graph_id"), "node_id", "in_degree", "out_degree", "blast_radius", "footprint", "betweenness", "pagerank")


def _latest(spark, sf, part):
    root = _run_store(spark, sf)
    return rn.run_view(spark, root, part, rn.latest_runs(rn.committed(spark, root)))


@query("a09_run_view", """SELECT l.project_id, l.version, c.n AS node_count, c.e AS edge_count, c.density, c.depth AS max_dependency_depth, c.points, c.rating AS complexity_rating FROM last_stored l JOIN cx c ON c.g = l.g""")
def run_view(spark, sf):
    return _latest(spark, sf, "complexity").select("project_id", "version", "node_count", "edge_count", "density", "max_dependency_depth", "points", "complexity_rating")


@query("a09_run_spof", """SELECT l.project_id, s.v AS node_id, s.is_spof, s.severity, s.lost AS disconnected_paths FROM last_stored l JOIN spof s ON s.g = l.g""")
def run_spof(spark, sf):
    return _latest(spark, sf, "spof").select("project_id", "node_id", "is_spof", "severity", "disconnected_paths")


@query("a09_run_critical", """SELECT l.project_id, c.v AS node_id, c.score AS criticality, c.tier, c.rk AS rank FROM last_stored l JOIN crit c ON c.g = l.g""")
def run_critical(spark, sf):
    return _latest(spark, sf, "criticality").select("project_id", "node_id", "criticality", "tier", "rank")


@query("a09_run_risk", """SELECT l.project_id, e.edge_id, e.score AS risk_score, e.lvl AS risk_level, e.rk AS risk_rank FROM last_stored l JOIN erisk e ON e.g = l.g""")
def run_risk(spark, sf):
    return _latest(spark, sf, "edge_risk").select("project_id", "edge_id", "risk_score", "risk_level", "risk_rank")


def _exported(spark, sf):
    """The fleet written as JSON below the staging root and read back."""
    def build():
        path = f"{staging_root(spark)}/export-{uuid.uuid4().hex}"
        n, e = fleet(spark, sf)
        place = lambda df: F.to_json(F.struct(*[F.col(c).alias(c[3:]) for c in df.columns if c.startswith("ev_")]))
        packed = lambda df: df.withColumn("evidence", F.when(F.col("ev_file").isNotNull(), place(df)))
        stats = n.groupBy("graph_id").agg(F.count(F.lit(1)).alias("total_nodes")).select(
            "graph_id", F.col("graph_id").alias("system_name"), F.substring_index("graph_id", "-", -1).alias("version"),
            F.to_json(F.struct("total_nodes")).alias("stats"), F.lit(None).cast("string").alias("inventory"))
        bp.model_documents(packed(n), packed(e), stats).repartition("graph_id").write.json(path)
        return bp.import_json(spark, path)
    return memo(spark, sf, "exported", build)


@query("a10_model_documents", """SELECT graph_id, 'entity' AS kind, node_id AS id, pos, name AS a, type AS b, technology AS c, description, ev_file AS file, NULL AS snippet FROM fleet_nodes
UNION ALL SELECT graph_id, 'relationship', edge_id, pos, src, dst, protocol, description, ev_file, ev_snippet FROM fleet_edges""")
def model_documents(spark, sf):
    back = _exported(spark, sf)
    ev = lambda name: F.get_json_object("evidence", f"$.{name}")
    n = back["nodes"].select("graph_id", F.lit("entity").alias("kind"), F.col("node_id").alias("id"), "pos", F.col("name").alias("a"), F.col("type").alias("b"),
                             F.col("technology").alias("c"), "description", ev("file").alias("file"), ev("snippet").alias("snippet"))
    e = back["edges"].select("graph_id", F.lit("relationship").alias("kind"), F.col("edge_id").alias("id"), "pos", F.col("src").alias("a"), F.col("dst").alias("b"),
                             F.col("protocol").alias("c"), "description", ev("file").alias("file"), ev("snippet").alias("snippet"))
    return n.unionByName(e)


@query("a10_model_stats", "SELECT graph_id, graph_id AS system_name, split_part(graph_id, '-', 2) AS version, CAST(count(*) AS VARCHAR) AS total_nodes FROM fleet_nodes GROUP BY graph_id")
def model_stats_back(spark, sf):
    return _exported(spark, sf)["models"].select("graph_id", "system_name", "version", F.get_json_object("stats", "$.total_nodes").alias("total_nodes"))


def _documents(spark, sf):
    """One document per order, in files below the staging root; some are broken, some of another form."""
    def build():
        o, k_ = t.read(spark, sf, "orders"), F.col("o_orderkey")
        oid, sid = F.concat(F.lit(" o"), k_.cast("string")), F.concat(F.lit("s"), "o_orderstatus")
        graph = F.concat(F.lit("g"), k_.cast("string"))
        part = F.struct(oid.alias("id"), F.struct(F.col("o_custkey").alias("cust")).alias("metadata"))
        link = F.struct(oid.alias("source"), sid.alias("target"), F.when(k_ % 2 == 0, "CALLS").otherwise("LOADS").alias("type"),
                        F.struct(F.concat(F.lit("f"), k_.cast("string")).alias("file")).alias("evidence"))
        good = F.to_json(F.struct(graph.alias("graph_id"), F.array(part).alias("services"), F.array(link).alias("relationships")))
        model = F.to_json(F.struct(graph.alias("graph_id"), F.array(part).alias("entities"), F.array(link).alias("relationships"),
                                   F.struct(F.lit(1).alias("total_nodes")).alias("stats")))
        no_list = F.concat(F.lit('{"graph_id":"'), graph, F.lit('","entities":"none","relationships":{}}'))
        loose = F.concat(F.lit('{"graph_id":"'), graph, F.lit('","entities":[1,{"id":[2]}]}'))
        doc = (F.when(k_ % 11 == 1, F.substring(good, 1, 20)).when(k_ % 11 == 2, F.concat(F.lit("["), k_.cast("string"), F.lit("]")))
               .when(k_ % 11 == 3, no_list).when(k_ % 11 == 4, loose).when(k_ % 11 < 8, good).otherwise(model))
        path = f"{staging_root(spark)}/blueprints-{uuid.uuid4().hex}"
        o.select(doc.alias("value")).write.text(path)
        return path
    return memo(spark, sf, "blueprint files", build)


cte("blue", "SELECT o_orderkey AS k, o_orderkey % 11 AS m, 'g' || o_orderkey AS g, 'o' || o_orderkey AS o, 's' || o_orderstatus AS s, o_custkey FROM orders")


@query("a01_blueprint_load", """SELECT g AS graph_id, 'rel-' || o || '-' || s || '-0' AS edge_id, o AS src, s AS dst, CASE WHEN k % 2 = 0 THEN 'CALLS' ELSE 'LOADS' END AS type,
 CASE WHEN k % 2 = 0 THEN 'HTTP/REST' ELSE 'Direct Link' END AS protocol, '{"file":"f' || k || '"}' AS evidence FROM blue WHERE m NOT IN (1, 2, 3, 4)""")
def blueprint_load(spark, sf):
    return bp.read_blueprints(spark, _documents(spark, sf), lines=True)["edges"].drop("pos", "description", "metadata")


@query("a02_model_load", """SELECT g AS graph_id, o AS node_id, o AS name, 'Generic / Undefined' AS technology, 'Component ' || o AS description, '{"cust":' || o_custkey || '}' AS metadata, '{"total_nodes":1}' AS stats FROM blue WHERE m >= 8""")
def model_load(spark, sf):
    m = bp.read_models(spark, _documents(spark, sf), lines=True)
    return m["nodes"].join(m["models"].select("graph_id", "stats"), "graph_id").select("graph_id", "node_id", "name", "technology", "description", "metadata", "stats")


@query("a01_document_issues", """SELECT code, subject, pos, count(*) AS n FROM (
SELECT 'invalid_json' AS code, '' AS subject, NULL AS pos FROM blue WHERE m = 1 UNION ALL SELECT 'root_not_object', 'ARRAY', NULL FROM blue WHERE m = 2
UNION ALL SELECT 'components_not_list', 'STRING', NULL FROM blue WHERE m = 3 UNION ALL SELECT 'relationships_not_list', 'OBJECT', NULL FROM blue WHERE m = 3
UNION ALL SELECT 'missing_relationships', '', NULL FROM blue WHERE m = 4 UNION ALL SELECT 'component_not_object', 'BIGINT', 0 FROM blue WHERE m = 4
UNION ALL SELECT 'component_id_not_text', '', 1 FROM blue WHERE m = 4) x GROUP BY ALL""")
def document_issues(spark, sf):
    found = bp.read_blueprints(spark, _documents(spark, sf), lines=True)["issues"]
    return found.groupBy("code", "subject", "pos").agg(F.count(F.lit(1)).alias("n"))


cte("code_folders", """SELECT DISTINCT g, folder FROM (SELECT g, array_to_string(string_split(path, '/')[1:i], '/') AS folder FROM (
SELECT g, path, unnest(range(1, len(string_split(path, '/')))) AS i FROM cf) a) b""")


@query("a11_snapshot", """SELECT f.g AS graph_id, 'First' AS label, '1' AS version, '2024-03-01 00:00:00' AS taken_at, count(DISTINCT m.module_id) AS node_count,
 (SELECT count(*) FROM mdep d WHERE d.g = f.g) AS edge_count, count(DISTINCT f.path) AS file_count, (SELECT count(*) FROM code_folders c WHERE c.g = f.g) AS folder_count
FROM cf f JOIN modu m ON m.g = f.g GROUP BY f.g""")
def snapshot(spark, sf):
    # modules and their dependencies as the graph, with the files and folders they come from
    f, g = files(spark, sf), graph(spark, sf)
    root = f"{staging_root(spark)}/snapshots-{uuid.uuid4().hex}"
    nodes = g["modules"].select("graph_id", F.col("module_id").alias("node_id")).distinct()
    edges = g["module_deps"].select("graph_id", F.col("src_module").alias("src"), F.col("dst_module").alias("dst"))
    rn.append_snapshot({"nodes": nodes, "edges": edges, "files": f.select("graph_id", "path"), "folders": inv.folders(f)}, root, "1", "First", F.lit("2024-03-01"))
    return rn.read_snapshots(spark, root).withColumn("taken_at", F.col("taken_at").cast("string")).drop("commit")


# --- b: scalars -----------------------------------------------------------------------------------

@query("b01_to_b04_keys", r"""SELECT graph_id, path, lower(trim('  ' || path)) AS node_key, lower(graph_id) || '->' || lower(path) || ':Uses' AS edge_key,
 trim(regexp_replace(regexp_replace(replace(lower(path), chr(92), '/'), '^\./', ''), '^/', '')) AS file_key,
 trim(regexp_replace(regexp_replace(regexp_replace(lower(path || '/'), '^\./', ''), '^/', ''), '/$', '')) AS folder_key FROM doc_files""")
def keys(spark, sf):
    f = t.derive(spark, sf, "doc_files")
    path = F.col("path")
    return f.select("graph_id", "path", p.node_key(F.concat(F.lit("  "), path)).alias("node_key"),
                    p.edge_key(F.col("graph_id"), path, F.lit("Uses")).alias("edge_key"), p.file_key(path).alias("file_key"),
                    p.folder_key(F.concat(path, F.lit("/"))).alias("folder_key"))


@query("b05_b06_names", r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(trim(p_name || '_' || p_brand)), '[^a-zA-Z0-9_\-]', '-', 'g'), '-+', '-', 'g'), '-') AS safe_id,
 substr(regexp_replace(lower(trim(p_name || '_' || p_brand)), '[^a-zA-Z0-9_\-]', '-', 'g'), 1, 48) AS safe_id_lite,
 array_to_string(list_transform(list_filter(regexp_split_to_array(p_name || '--' || p_brand, '[-_]+'), lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS display FROM part""")
def names(spark, sf):
    part = t.read(spark, sf, "part")
    raw = F.concat_ws("_", "p_name", "p_brand")
    return part.select("p_partkey", p.safe_id(raw).alias("safe_id"), p.safe_id(raw, "lite").alias("safe_id_lite"),
                       p.display_name(F.concat("p_name", F.lit("--"), "p_brand")).alias("display"))


@query("b07_path_parts", r"SELECT g AS graph_id, path, name, ext AS extension, CASE WHEN regexp_matches(name, '^.+\.[^.]*$') THEN regexp_extract(name, '^(.+)\.[^.]*$', 1) ELSE name END AS stem, dir AS parent FROM cf")
def path_parts(spark, sf):
    path = F.col("path")
    return files(spark, sf).select("graph_id", "path", p.base_name(path).alias("name"), p.extension(path).alias("extension"),
                                   p.stem(path).alias("stem"), p.parent_dir(path).alias("parent"))


@query("b08_category", f"SELECT graph_id, path, {category_sql('path', 'name', 'ext')} AS category FROM (SELECT graph_id, path, regexp_extract(path, '[^/]*$') AS name, lower(regexp_extract(path, '(\\.[^.]*)$', 1)) AS ext FROM doc_files) x")
def category(spark, sf):
    return t.derive(spark, sf, "doc_files").select("graph_id", "path", k.category(F.col("path")).alias("category"))


@query("b08_category_lite", """SELECT g AS graph_id, path, CASE WHEN lower(name) IN ('package.json', 'requirements.txt', 'pyproject.toml', 'pom.xml', 'build.gradle', 'go.mod', 'cargo.toml', 'pubspec.yaml', 'composer.json', 'gemfile', 'dockerfile') OR starts_with(lower(name), 'docker-compose') THEN 'manifest'
 WHEN ext = '.env' OR starts_with(lower(name), '.env') OR starts_with(lower(name), '.git') OR ext IN ('.ini', '.cfg') OR contains(lower(path), '/config/') OR starts_with(lower(path), 'config/') OR contains(lower(name), 'config') OR contains(lower(name), 'setting') THEN 'config'
 WHEN ext IN ('.csv', '.tsv', '.parquet', '.arrow') THEN 'dataset' WHEN ext IN ('.pkl', '.pickle', '.dat', '.joblib', '.h5', '.onnx', '.pt', '.pth') THEN 'model_artifact'
 WHEN ext IN ('.md', '.rst', '.txt', '.pdf', '.docx', '.doc') THEN 'documentation' WHEN ext IN ('.png', '.jpg', '.jpeg', '.gif', '.svg', '.ico', '.webp', '.mp4') THEN 'asset'
 WHEN ext IN ('.js', '.jsx', '.ts', '.tsx', '.py', '.dart', '.java', '.go', '.rs', '.c', '.cpp', '.h', '.hpp', '.cs', '.rb', '.php', '.ipynb', '.html', '.css', '.scss') THEN 'source' ELSE 'other' END AS category FROM cf""")
def category_lite(spark, sf):
    return files(spark, sf).select("graph_id", "path", k.category(F.col("path"), "lite").alias("category"))


@query("b09_b10_language", f"""SELECT c.g AS graph_id, c.path, l.lang AS language, m.lang AS language_lite, coalesce(z.x, 'Source Module') AS technology FROM cf c LEFT JOIN (VALUES {LANG_VALUES}) l(e, lang) ON l.e = c.ext
 LEFT JOIN (VALUES {', '.join(f"('{a}', '{b}')" for a, b in k.LANGUAGES_LITE.items())}) m(e, lang) ON m.e = c.ext LEFT JOIN (VALUES {', '.join(f"('{a}', '{b}')" for a, b in k.TECHNOLOGIES.items())}) z(e, x) ON z.e = c.ext""")
def language(spark, sf):
    path = F.col("path")
    return files(spark, sf).select("graph_id", "path", k.language(path).alias("language"),
                                   k.language(path, "lite").alias("language_lite"), k.technology(path).alias("technology"))


@query("b11_line_count", "SELECT doc_id, len(string_split(text, chr(10))) AS lines_lite, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS lines FROM documents")
def line_count(spark, sf):
    return t.read(spark, sf, "documents").select("doc_id", k.line_count(F.col("text"), "lite").alias("lines_lite"),
                                                 k.line_count(F.col("text")).alias("lines"))


@query("b12_fingerprint", "SELECT doc_id, sha256(text) AS mark FROM documents")
def fingerprint(spark, sf):
    return t.read(spark, sf, "documents").select("doc_id", k.fingerprint(F.col("text")).alias("mark"))


@query("b13_folders", "SELECT g AS graph_id, folder FROM code_folders")
def folders(spark, sf):
    return inv.folders(files(spark, sf))


@query("b14_common_root", r"SELECT graph_id, path, regexp_replace(lower(path), '^\./repo/', '') AS key FROM doc_files")
def common_root(spark, sf):
    keyed = t.derive(spark, sf, "doc_files").select("graph_id", "path", p.file_key(F.col("path")).alias("full"))
    return p.strip_common_root(keyed, "full", "key").drop("full")


@query("b15_service_from_path", """SELECT g AS graph_id, path, CASE WHEN len(s) < 2 THEN NULL WHEN s[1] IN ('services', 'apps', 'packages', 'microservices') AND len(s) > 2 THEN s[2]
 WHEN s[1] NOT IN ('src', 'app', 'lib', 'main', 'tests', 'test', 'docs', 'review') THEN s[1] END AS service FROM (SELECT g, path, string_split(path, '/') AS s FROM cf) x""")
def service_from_path(spark, sf):
    return files(spark, sf).select("graph_id", "path", p.service_from_path(F.col("path")).alias("service"))


@query("b16_b17_flags", r"""SELECT g AS graph_id, path, contains(path, '/test') OR starts_with(path, 'test') OR contains(path, 'spec') OR contains(path, 'test_') OR contains(path, '/scripts/') OR contains(path, 'kustomize') OR regexp_matches(lower(name), '^(test|scratch)') AS is_test,
 ext IN ('.png', '.pdf', '.dat', '.bin') AS is_binary FROM (SELECT g, lower(path) AS path_low, path, name, ext FROM cf) x""")
def flags(spark, sf):
    return files(spark, sf).select("graph_id", "path", k.is_test(F.col("path")).alias("is_test"), k.is_binary(F.col("path")).alias("is_binary"))


@query("b18_path_distance", """SELECT a.g AS graph_id, a.path, b.path AS other, CAST(len(x) + len(y) - 2 * len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[1:i] = y[1:i])) AS INT) AS distance
FROM (SELECT g, path, string_split(path, '/') AS x FROM cf) a JOIN (SELECT g, path, string_split(path, '/') AS y FROM cf WHERE name = '.env') b ON b.g = a.g""")
def path_distance(spark, sf):
    f = files(spark, sf).select("graph_id", "path")
    env = f.filter(p.base_name(F.col("path")) == ".env").withColumnRenamed("path", "other")
    return f.join(env, "graph_id").withColumn("distance", p.path_distance(F.col("path"), F.col("other")))


@query("b19_endpoint", "SELECT page_id, split_part(regexp_replace(url, '^https?://[^/]+', ''), '?', 1) AS endpoint FROM pages")
def endpoint(spark, sf):
    return t.read(spark, sf, "pages").select("page_id", p.endpoint(F.col("url")).alias("endpoint"))


@query("b20_line_range", "SELECT graph_id, edge_id, CASE WHEN ev_line_end <> ev_line THEN ev_line || '–' || ev_line_end ELSE CAST(ev_line AS VARCHAR) END AS line_range FROM fleet_edges")
def line_range(spark, sf):
    return fleet(spark, sf)[1].select("graph_id", "edge_id", p.line_range(F.col("ev_line"), F.col("ev_line_end")).alias("line_range"))


@query("b21_human_size", "SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.1f', floor(n_chars / 1024.0 * 10 + 0.5) / 10) || ' KB' ELSE 'x' END AS size FROM documents")
def human_size(spark, sf):
    return t.read(spark, sf, "documents").select("doc_id", p.human_size(F.col("n_chars")).alias("size"))


@query("b22_to_b24_scores", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, CASE WHEN l_discount * 10 >= 0.70 THEN 'CRITICAL' WHEN l_discount * 10 >= 0.45 THEN 'HIGH' WHEN l_discount * 10 >= 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS tier,
 floor((l_quantity - m.lo) / (m.hi - m.lo) * 1e4 + 0.500001) / 1e4 AS scaled FROM lineitem l JOIN (SELECT l_returnflag AS f, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1) m ON m.f = l.l_returnflag""")
def scores(spark, sf):
    l = t.read(spark, sf, "lineitem")
    span = l.groupBy("l_returnflag").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    return l.join(span, "l_returnflag").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
        ti.tier(F.col("l_discount") * 10, ti.CRITICALITY_BOUNDS).alias("tier"),
        ti.fair_round(ti.min_max(F.col("l_quantity"), F.col("lo"), F.col("hi")), 4).alias("scaled"))


@query("b25_evidence_texts", """SELECT n.g AS graph_id, n.v AS node_id, coalesce(nullif(concat_ws(' | ', CASE WHEN n.tier = 'CRITICAL' THEN 'criticality ' || CAST(c.score AS VARCHAR) END,
 CASE WHEN n.is_spof THEN 'single point of failure' END, CASE WHEN n.in_cycle THEN 'on a cycle' END), ''), 'no factor stands out') AS texts
FROM nrisk n LEFT JOIN crit c ON c.g = n.g AND c.v = n.v""")
def evidence_texts(spark, sf):
    return analysis(spark, sf)["node_risk"].select("graph_id", "node_id", F.array_join("evidence", " | ").alias("texts"))


# --- c: extraction --------------------------------------------------------------------------------

SQ = "[''\"]"
NSQ = "[^''\"]"
cte("imp", f"""SELECT g, path, line, kind, spec FROM (
SELECT g, path, line, 'js' AS kind, coalesce(nullif(regexp_extract(t, 'import\\s+(?:(?:[\\w*\\s{{}},]+)\\s+from\\s+)?{SQ}({NSQ}+){SQ}', 1), ''), nullif(regexp_extract(t, 'export\\s+(?:[\\w*\\s{{}},]+)\\s+from\\s+{SQ}({NSQ}+){SQ}', 1), ''),
  nullif(regexp_extract(t, 'require\\s*\\(\\s*{SQ}({NSQ}+){SQ}\\s*\\)', 1), '')) AS spec FROM src_lines WHERE ext IN ('.ts', '.js') AND category = 'source' AND NOT starts_with(t, '//')
UNION ALL SELECT g, path, line, 'py_from', regexp_extract(t, '^from\\s+([\\.a-zA-Z0-9_]+)\\s+import\\s+', 1) FROM src_lines WHERE ext = '.py' AND category = 'source'
UNION ALL SELECT g, path, line, 'py_import', trim(split_part(unnest(string_split(regexp_extract(t, '^import\\s+([a-zA-Z0-9_\\.,\\s]+)', 1), ',')), ' as ', 1)) FROM src_lines WHERE ext = '.py' AND category = 'source'
UNION ALL SELECT g, path, line, 'dart', regexp_extract(t, '^(?:import|export)\\s+{SQ}({NSQ}+){SQ}(?:\\s+as\\s+[a-zA-Z0-9_]+)?;', 1) FROM src_lines WHERE ext = '.dart'
UNION ALL SELECT g, path, line, 'java', regexp_extract(t, '^import\\s+(?:static\\s+)?([a-zA-Z0-9_\\.]+);', 1) FROM src_lines WHERE ext = '.java'
UNION ALL SELECT g, path, line, 'cpp', regexp_extract(t, '^#include\\s*["<]([^">]+)[">]', 1) FROM src_lines WHERE ext = '.cpp'
UNION ALL SELECT g, path, line, 'cs', regexp_extract(t, '^using\\s+([a-zA-Z0-9_\\.]+);', 1) FROM src_lines WHERE ext = '.cs'
UNION ALL SELECT g, path, line, 'rb', regexp_extract(t, '^(?:require_relative|require)\\s*{SQ}({NSQ}+){SQ}', 1) FROM src_lines WHERE ext = '.rb'
UNION ALL SELECT g, path, line, 'php', regexp_extract(t, '^(?:require|require_once|include|include_once)\\s*\\(?{SQ}({NSQ}+){SQ}\\)?;', 1) FROM src_lines WHERE ext = '.php'
UNION ALL SELECT g, path, line, 'php_use', regexp_extract(t, '^use\\s+([a-zA-Z0-9_\\\\]+);', 1) FROM src_lines WHERE ext = '.php'
UNION ALL SELECT g, path, line, 'rust', regexp_extract(t, '^(?:pub\\s+)?mod\\s+([a-zA-Z0-9_]+);', 1) FROM src_lines WHERE ext = '.rs'
UNION ALL SELECT g, path, line, 'go', regexp_extract(t, '"([^"]+)"', 1) FROM src_lines WHERE ext = '.go' AND line = 3) x WHERE spec <> ''""")


@query("c01_to_c10_imports", "SELECT g AS graph_id, path, line, kind, spec FROM imp")
def imports(spark, sf):
    return x.import_hits(lines(spark, sf)).select("graph_id", "path", "line", "kind", "spec")


@query("c02_external_libraries", """SELECT DISTINCT graph_id, path, library FROM (
SELECT i.g AS graph_id, i.path, split_part(i.spec, '.', 1) AS library FROM imp i WHERE i.kind IN ('py_from', 'py_import') AND NOT starts_with(i.spec, '.')
 AND split_part(i.spec, '.', 1) NOT IN ('sys', 'os', 're', 'math', 'time', 'datetime', 'json', 'io', 'typing', 'collections', 'pathlib')
 AND NOT EXISTS (SELECT 1 FROM target r WHERE r.g = i.g AND r.path = i.path AND r.line = i.line AND r.kind = i.kind AND r.spec = i.spec)
UNION ALL SELECT i.g, i.path, regexp_extract(i.spec, '^package:([^/]+)', 1) FROM imp i WHERE i.kind = 'dart' AND starts_with(i.spec, 'package:')
 AND (starts_with(i.spec, 'package:flutter/') OR NOT EXISTS (SELECT 1 FROM target r WHERE r.g = i.g AND r.path = i.path AND r.line = i.line AND r.kind = i.kind AND r.spec = i.spec))) x""")
def external_libraries(spark, sf):
    g = graph(spark, sf)
    return rs.external_libraries(x.import_hits(lines(spark, sf)), g["resolved"], x.STDLIB, x.DART_LIBS)


@query("c11_artefact_hits", """SELECT g AS graph_id, path, line, kind, spec, type FROM (
SELECT g, path, line, 'model' AS kind, regexp_extract(t, '[''"]([^''"]+\\.(?:pkl|dat))[''"]', 1) AS spec, CASE WHEN regexp_matches(t, 'dump|wb|save') THEN 'PUBLISHES' ELSE 'USES' END AS type FROM src_lines WHERE ext = '.py' AND category = 'source'
UNION ALL SELECT g, path, line, 'data', regexp_extract(t, '[''"]([^''"]+\\.csv)[''"]', 1), 'QUERIES' FROM src_lines WHERE ext = '.py' AND category = 'source') x WHERE spec <> ''
UNION ALL SELECT g, path, line, 'env', '', 'USES' FROM src_lines WHERE ext = '.py' AND category = 'source' AND contains(t, 'dotenv')""".replace("\\\\", "\\"))
def artefact_hits(spark, sf):
    return x.artefact_hits(lines(spark, sf)).select("graph_id", "path", "line", "kind", "spec", "type")


cte("rt", r"""SELECT g, path, line, CASE WHEN regexp_matches(t, '@app\.route') THEN 'POST' WHEN regexp_matches(t, '^(@router\.get|@GetMapping|r\.GET|http\.get|axios\.get)') THEN 'GET' ELSE 'POST' END AS verb, regexp_extract(t, '[''"](/[^"''\s]*)[''"]', 1) AS endpoint
FROM src_lines WHERE NOT starts_with(t, '//') AND NOT starts_with(t, '#') AND regexp_matches(t, '^(@app\.route|@?router\.(get|post)|@(Get|Post)Mapping|r\.GET)\(')""")


@query("c12_routes", "SELECT g AS graph_id, path, line, verb, endpoint FROM rt")
def routes(spark, sf):
    return x.routes(lines(spark, sf))


cte("apin", r"""SELECT g, path, line, verb, endpoint, 'api-' || lower(verb) || '-' || trim(regexp_replace(regexp_replace(lower(endpoint), '[^a-z0-9_\-]', '-', 'g'), '-+', '-', 'g'), '-') AS node_id FROM (
SELECT g, path, line, CASE WHEN regexp_matches(t, '^router\.post') THEN 'POST' ELSE 'GET' END AS verb, regexp_extract(t, '(/api/[a-zA-Z0-9_\-/]+)[''"]', 1) AS endpoint FROM src_lines WHERE category = 'source'
AND regexp_matches(t, '^(@?router\.(get|post)|@GetMapping|r\.GET|\[HttpGet)\([''"]/api/')) x""")


@query("c13_api_nodes", "SELECT g AS graph_id, path, line, node_id, verb || ' ' || endpoint AS name FROM apin")
def api_nodes(spark, sf):
    return x.api_nodes(lines(spark, sf))


@query("c13_api_edges", """SELECT a.g AS graph_id, o.node_id AS src, a.node_id AS dst, min(a.path) AS path FROM apin a JOIN owner o ON o.g = a.g AND o.path = a.path GROUP BY a.g, o.node_id, a.node_id""")
def api_edges(spark, sf):
    g = graph(spark, sf)
    return x.owned_edges(x.api_nodes(lines(spark, sf)), g["owner"], "USES", "Internal Route").select("graph_id", "src", "dst", "path")


@query("c14_spring_routes", r"""SELECT l.g AS graph_id, l.path, l.line, CASE WHEN starts_with(l.t, '@Post') THEN 'POST' ELSE 'GET' END AS verb, CASE WHEN p.prefix IS NULL THEN r.raw ELSE p.prefix || r.raw END AS endpoint
FROM src_lines l, LATERAL (SELECT regexp_extract(l.t, '[''"]([^''"]+)[''"]', 1) AS raw) r LEFT JOIN (SELECT g, path, min_by(regexp_extract(t, '"([^"]+)"', 1), line) AS prefix FROM src_lines WHERE ext = '.java' AND starts_with(t, '@RequestMapping') GROUP BY g, path) p ON p.g = l.g AND p.path = l.path
WHERE l.ext = '.java' AND regexp_matches(l.t, '^@(Get|Post|Request)Mapping')""")
def spring_routes(spark, sf):
    return x.spring_routes(files(spark, sf), lines(spark, sf))


PKG = """SELECT graph_id AS g, path, key AS dependency, value AS version FROM (
SELECT graph_id, path, unnest(json_keys(j)) AS key, j FROM (SELECT graph_id, path, CAST(text AS JSON) -> '$.dependencies' AS j FROM code_lines WHERE ends_with(path, 'package.json')) x) y, LATERAL (SELECT json_extract_string(j, '$."' || key || '"') AS value) z
UNION ALL SELECT graph_id, path, key, json_extract_string(j, '$."' || key || '"') FROM (SELECT graph_id, path, unnest(json_keys(j)) AS key, j FROM (SELECT graph_id, path, CAST(text AS JSON) -> '$.devDependencies' AS j FROM code_lines WHERE ends_with(path, 'package.json') AND contains(text, 'devDependencies')) x) y"""
cte("pkg", PKG)
cte("req", r"SELECT g, path, line, trim(regexp_extract(t, '^([^=<>~;]+)', 1)) AS dependency FROM src_lines WHERE ends_with(path, 'requirements.txt') AND NOT starts_with(t, '#')")


@query("c15_package_json", "SELECT g AS graph_id, path, dependency, version FROM pkg")
def package_json(spark, sf):
    return x.package_json_deps(files(spark, sf)).drop("package")


@query("c15_requirements", "SELECT g AS graph_id, path, line, dependency FROM req")
def requirements(spark, sf):
    return x.requirement_deps(lines(spark, sf))


@query("c15_top_packages", "SELECT g AS graph_id, dependency, CAST(row_number() OVER (PARTITION BY g ORDER BY dependency) AS INT) AS place FROM (SELECT DISTINCT g, dependency FROM (SELECT g, dependency FROM pkg UNION ALL SELECT g, dependency FROM req) x) y")
def top_packages(spark, sf):
    both = x.package_json_deps(files(spark, sf)).select("graph_id", "path", "dependency").unionByName(
        x.requirement_deps(lines(spark, sf)).select("graph_id", "path", "dependency"))
    return inv.top_packages(both)


cte("repo_variant", "SELECT DISTINCT 'r' || repo AS g, repo % 3 AS variant FROM repo_orders")
cte("mani", """SELECT v.g, m.path, m.node_id, m.type, m.technology FROM repo_variant v JOIN (VALUES
 (0, 'package.json', 'web-app', 'Service', 'Node.js / Express'), (1, 'package.json', 'node-service', 'Application', 'React / Web UI'), (2, 'frontend/package.json', 'ui_kit', 'Application', 'React / Web UI')) m(variant, path, node_id, type, technology) ON m.variant = v.variant
UNION ALL SELECT v.g, m.path, m.node_id, m.type, m.technology FROM repo_variant v, (VALUES ('backend/requirements.txt', 'backend', 'Application', 'Python / FastAPI'), ('services/java/pom.xml', 'java', 'Service', 'Java / Spring Boot'),
 ('go.mod', 'go-service', 'Service', 'Go / Gin'), ('rust/Cargo.toml', 'rust-core', 'Service', 'Rust'), ('dotnet/Billing.csproj', 'billing', 'Service', 'ASP.NET Core')) m(path, node_id, type, technology)""")


@query("c16_manifests", "SELECT g AS graph_id, path, node_id, type, technology FROM mani")
def manifests(spark, sf):
    return x.manifests(files(spark, sf)).select("graph_id", "path", "node_id", "type", "technology")


@query("c16_manifest_edges", """SELECT v.g AS graph_id, e.path, e.src, e.dst, e.type FROM repo_variant v JOIN (VALUES (0, 'package.json', 'web-app', 'postgres-db', 'USES'), (0, 'package.json', 'web-app', 'redis-cache', 'USES'), (1, 'package.json', 'node-service', 'stripe-api', 'CALLS'),
 (1, 'package.json', 'node-service', 'mongodb-cluster', 'USES'), (2, 'frontend/package.json', 'ui_kit', 'aws-cloud-services', 'CALLS')) e(variant, path, src, dst, type) ON e.variant = v.variant
UNION ALL SELECT v.g, e.path, e.src, e.dst, 'USES' FROM repo_variant v, (VALUES ('backend/requirements.txt', 'backend', 'postgres-db'), ('backend/requirements.txt', 'backend', 'redis-cache'), ('services/java/pom.xml', 'java', 'postgres-db'),
 ('go.mod', 'go-service', 'redis-cache'), ('dotnet/Billing.csproj', 'billing', 'sql-server-db')) e(path, src, dst)""")
def manifest_edges(spark, sf):
    return x.manifest_edges(x.manifests(files(spark, sf))).select("graph_id", "path", "src", "dst", "type")


@query("c17_compose", """SELECT v.g AS graph_id, e.src, e.dst, e.type, e.protocol FROM repo_variant v, (VALUES ('api-gateway', 'orders', 'DEPENDS_ON', 'Docker Network'), ('api-gateway', 'redis-cache', 'DEPENDS_ON', 'Docker Network'),
 ('api-gateway', 'orders-db', 'USES', 'TCP / Connection URI'), ('api-gateway', 'users', 'CALLS', 'Internal Network')) e(src, dst, type, protocol)""")
def compose(spark, sf):
    return x.compose(lines(spark, sf))[1].select("graph_id", "src", "dst", "type", "protocol")


@query("c17_compose_services", "SELECT v.g AS graph_id, e.node_id, e.type, e.technology FROM repo_variant v, (VALUES ('api-gateway', 'Service', 'acme/api'), ('orders', 'Service', 'acme/orders'), ('redis-cache', 'Database', 'redis:7')) e(node_id, type, technology)")
def compose_services(spark, sf):
    return x.compose(lines(spark, sf))[0].select("graph_id", "node_id", "type", "technology")


@query("c18_kubernetes", "SELECT v.g AS graph_id, e.src, e.dst, e.type, e.protocol FROM repo_variant v, (VALUES ('checkout', 'catalog', 'CALLS', 'gRPC'), ('checkout', 'redis-cart', 'USES', 'Redis Protocol')) e(src, dst, type, protocol)")
def kubernetes(spark, sf):
    return x.kubernetes(lines(spark, sf))[1].select("graph_id", "src", "dst", "type", "protocol")


@query("c19_datasources", "SELECT g AS graph_id, path, line, 'mysql-database-shop' AS node_id, 'MySQL Database (shop)' AS name, 'MySQL' AS technology FROM src_lines WHERE contains(t, 'jdbc:mysql')")
def datasources(spark, sf):
    return x.datasources(lines(spark, sf))


@query("c20_host_calls", r"""SELECT g AS graph_id, path, line, node_id FROM (SELECT g, path, line, lower(regexp_extract(t, '(?i)(?:(?:axios|requests|fetch|http)\.(?:get|post|put|delete)|restTemplate\.(?:getForObject|postForObject))\([''"](?:https?://)?([a-zA-Z0-9_\-]+)(?::\d+)?(?:/[^"''\s]*)?[''"]', 1)) AS node_id
FROM src_lines WHERE category = 'source') x WHERE node_id <> ''""")
def host_calls(spark, sf):
    return x.host_calls(lines(spark, sf))


cte("calls_raw", r"""SELECT DISTINCT g, path, line, split_part(regexp_replace(u, '^https?://[^/]+', ''), '?', 1) AS endpoint FROM (
SELECT g, path, line, unnest([regexp_extract(t, '(?i)(?:fetch|axios\.(?:get|post|put|delete)|requests\.(?:get|post|put|delete)|http\.(?:Get|Post))\s*\(\s*[`''"]([^`''"\s]+)[`''"]', 1), regexp_extract(t, '(?i)(?:base_url|endpoint|url)\s*[:=]\s*[`''"]([^`''"\s]+)[`''"]', 1),
 regexp_extract(t, '(?i)https?://(?:[a-zA-Z0-9\.\-]+)(?::\d+)?(/[^`''"\s\?\#]+)', 1)]) AS u FROM src_lines WHERE ext IN ('.ts', '.py', '.dart', '.go', '.java', '.cs', '.php', '.rb') AND category = 'source' AND NOT starts_with(t, '//') AND NOT starts_with(t, '#')) x WHERE starts_with(split_part(regexp_replace(u, '^https?://[^/]+', ''), '?', 1), '/')""")


@query("c21_endpoint_calls", "SELECT g AS graph_id, path, line, endpoint FROM calls_raw")
def endpoint_calls(spark, sf):
    return x.endpoint_calls(lines(spark, sf))


@query("c22_markers", """SELECT g AS graph_id, path, line, CASE WHEN contains(t, 'jsonwebtoken') THEN 'lib-jsonwebtoken' ELSE 'google-gemini-api' END AS node_id, CASE WHEN contains(t, 'jsonwebtoken') THEN 'DEPENDS_ON' ELSE 'CALLS' END AS type
FROM src_lines WHERE category = 'source' AND (contains(t, 'jsonwebtoken') OR contains(t, 'google.generativeai'))""")
def markers(spark, sf):
    return x.marker_hits(lines(spark, sf)).select("graph_id", "path", "line", "node_id", "type")


@query("c23_type_references", r"""SELECT l.g AS graph_id, l.path, min(l.line) AS line, lower(regexp_extract(l.path, '(Class\d+)', 1)) AS src, lower(regexp_extract(l.t, '^(Class\d+) next', 1)) AS dst
FROM src_lines l JOIN cf c ON c.g = l.g AND c.path = 'services/java/com/acme/' || regexp_extract(l.t, '^(Class\d+) next', 1) || '.java' WHERE l.ext = '.java' AND regexp_matches(l.t, '^Class\d+ next') GROUP BY ALL""")
def type_references(spark, sf):
    f = files(spark, sf)
    return x.type_references(lines(spark, sf), x.java_classes(f)).select("graph_id", "path", "line", "src", "dst")


@query("c24_frameworks", """SELECT DISTINCT g AS graph_id, f AS framework FROM (SELECT g, unnest([CASE WHEN contains(text, 'flutter') THEN 'Flutter' END, CASE WHEN contains(text, 'express') THEN 'Express' END, CASE WHEN contains(text, 'react') THEN 'React' END,
 CASE WHEN contains(text, 'fastapi') THEN 'FastAPI' END, CASE WHEN contains(text, 'spring-boot') THEN 'Spring Boot' END, CASE WHEN contains(text, 'genai') OR contains(text, 'google.generativeai') THEN 'Google Gemini' END, CASE WHEN contains(text, 'sklearn') THEN 'Scikit-Learn' END]) AS f FROM src_lines) x WHERE f IS NOT NULL""")
def frameworks(spark, sf):
    return x.frameworks(files(spark, sf))


@query("c25_subsystems", """SELECT g AS graph_id, node_id, count(*) AS files_count, min(path) AS first_path FROM (SELECT g, path, unnest([CASE WHEN ext = '.dart' THEN 'app-mobile' END, CASE WHEN ext = '.pkl' THEN 'ml-model-artifacts' END, CASE WHEN ext = '.csv' THEN 'training-datasets' END,
 CASE WHEN contains(name, 'train') THEN 'model-training-pipeline' END, CASE WHEN starts_with(path, 'extension/') THEN 'ext-helper-tool' END]) AS node_id FROM cf) x WHERE node_id IS NOT NULL GROUP BY g, node_id""")
def subsystems(spark, sf):
    return x.subsystems(files(spark, sf)).select("graph_id", "node_id", "files_count", "first_path")


cte("modu", r"""SELECT g, folder, 'mod-' || replace(lower(folder), '/', '-') AS module_id, count(*) AS n, min(path) AS first_path FROM (SELECT g, path, CASE WHEN starts_with(path, 'src/web/') THEN 'src/web' WHEN starts_with(path, 'services/') THEN 'services'
 WHEN starts_with(path, 'backend/app/') THEN 'backend/app' WHEN starts_with(path, 'pkg/') THEN regexp_extract(path, '^(pkg/[^/]+)', 1) WHEN starts_with(path, 'mobile/lib/') THEN 'mobile/lib' ELSE dir END AS folder FROM cfx WHERE category = 'source') x GROUP BY g, folder""")


@query("c26_module_imports", r"""SELECT m.g AS graph_id, m.module_id AS src, n.module_id AS dst FROM (SELECT DISTINCT g, path, word FROM (SELECT g, path, unnest(regexp_split_to_array(regexp_extract(text, '(?:from|import|require)(.*)$', 1), '[^A-Za-z0-9_\-]+')) AS word FROM src_lines WHERE category = 'source' AND regexp_matches(text, '(?:from|import|require)\b')) a WHERE word <> '') w
JOIN fmod m ON m.g = w.g AND m.path = w.path JOIN modu n ON n.g = w.g AND regexp_extract(n.folder, '[^/]*$') = w.word AND n.module_id <> m.module_id GROUP BY ALL""")
def module_imports(spark, sf):
    g = graph(spark, sf)
    return x.module_imports(lines(spark, sf), g["modules"], g["file_module"]).select("graph_id", "src", "dst")


@query("c27_brace_blocks", r"""SELECT g AS graph_id, path, line AS first_line, line + 1 AS last_line FROM src_lines WHERE ext IN ('.ts', '.go', '.cpp', '.cs', '.php', '.rs', '.dart', '.java') AND starts_with(t, 'function f_')""")
def brace_blocks(spark, sf):
    code = lines(spark, sf).filter(F.col("extension").isin(".ts", ".go", ".cpp", ".cs", ".php", ".rs", ".dart", ".java"))
    return x.brace_blocks(code, F.col("trimmed").startswith("function f_"))


@query("c27_indent_blocks", "SELECT g AS graph_id, path, line AS first_line, line + 1 AS last_line FROM src_lines WHERE ext = '.py' AND starts_with(t, 'def f_')")
def indent_blocks(spark, sf):
    return x.indent_blocks(lines(spark, sf).filter(F.col("extension") == ".py"), F.col("trimmed").startswith("def f_"))


@query("c27_window_blocks", "SELECT l.g AS graph_id, l.path, greatest(1, l.line - 1) AS first_line, least(c.n, l.line + 3) AS last_line FROM src_lines l JOIN cf c ON c.g = l.g AND c.path = l.path WHERE contains(l.t, 'jdbc') OR starts_with(l.t, 'import ')")
def window_blocks(spark, sf):
    hit = F.col("trimmed").contains("jdbc") | F.col("trimmed").startswith("import ")
    return x.window_blocks(lines(spark, sf), hit)


# --- d: resolution --------------------------------------------------------------------------------

cte("guess", r"""SELECT g, path, line, kind, spec, CASE WHEN kind = 'js' THEN 'src/web/' || regexp_extract(spec, '(comp_\d+)', 1) || '.ts' WHEN kind IN ('py_from', 'py_import') AND spec <> '.' THEN 'backend/app/' || regexp_extract(spec, '(mod_\d+)', 1) || '.py'
 WHEN kind = 'java' THEN 'services/java/com/acme/' || regexp_extract(spec, '(Class\d+)', 1) || '.java' WHEN kind = 'go' THEN 'pkg/' || regexp_extract(spec, '(p\d+)$', 1) || '/main.go' WHEN kind = 'cpp' THEN 'native/' || regexp_extract(spec, '(unit_\d+)', 1) || '.cpp'
 WHEN kind = 'cs' THEN 'dotnet/' || regexp_extract(spec, '(Svc\d+)', 1) || '.cs' WHEN kind = 'rb' THEN 'ruby/' || regexp_extract(spec, '(task_\d+)', 1) || '.rb' WHEN kind IN ('php', 'php_use') THEN 'php/' || regexp_extract(spec, '(Page\d+)', 1) || '.php'
 WHEN kind = 'rust' THEN 'rust/' || spec || '.rs' ELSE 'mobile/lib/' || regexp_extract(spec, '(screen_\d+)', 1) || '.dart' END AS dst FROM imp""")
cte("near_csv", r"""SELECT g, path, line, 'data' AS kind, spec, CASE WHEN f IN ('1', '2') THEN 'backend/data/set_' || f || '.csv' ELSE spec END AS dst FROM (SELECT g, path, line, regexp_extract(t, '(data/set_\d\.csv)', 1) AS spec, regexp_extract(t, 'set_(\d)', 1) AS f FROM src_lines WHERE ext = '.py' AND contains(t, 'read_csv')) x""")
cte("target", r"""SELECT i.* FROM guess i JOIN cf c ON c.g = i.g AND c.path = i.dst
UNION ALL SELECT n.* FROM near_csv n JOIN cf c ON c.g = n.g AND c.path = n.dst
UNION ALL SELECT l.g, l.path, l.line, 'model', regexp_extract(l.t, '(models/m_\d\.pkl)', 1), c.path FROM src_lines l JOIN cf c ON c.g = l.g AND c.path = regexp_extract(l.t, '(models/m_\d\.pkl)', 1) WHERE l.ext = '.py'
UNION ALL SELECT g, path, line, 'env', '', 'backend/.env' FROM src_lines WHERE ext = '.py' AND contains(t, 'dotenv')""")
cte("dep0", """SELECT g, path AS src, dst, CASE WHEN kind IN ('cs', 'php_use') THEN 'USES' WHEN kind = 'rb' THEN 'REQUIRES' WHEN kind = 'php' THEN 'INCLUDES' WHEN kind = 'data' THEN 'QUERIES' WHEN kind = 'model' THEN 'PUBLISHES' WHEN kind = 'env' THEN 'USES' ELSE 'IMPORTS' END AS type, line FROM target WHERE path <> dst
UNION ALL SELECT g, src, dst, 'CALLS', line FROM ecall""")
cte("deps", "SELECT g, src, dst, type, min(line) AS line FROM dep0 GROUP BY g, src, dst, type")
cte("reps", "SELECT g, endpoint, min((path, line)) AS defined FROM rt GROUP BY g, endpoint")
cte("cmatch", """SELECT c.g, c.path, c.line, c.endpoint, coalesce(max(CASE WHEN r.endpoint = c.endpoint THEN r.endpoint END), min_by(r.endpoint, r.defined)) AS ep FROM calls_raw c
JOIN reps r ON r.g = c.g AND (r.endpoint = c.endpoint OR (r.endpoint <> '/' AND starts_with(c.endpoint, rtrim(r.endpoint, '/') || '/'))) GROUP BY c.g, c.path, c.line, c.endpoint""")
cte("ecall0", """SELECT m.g, m.path AS src, m.line, m.endpoint, min((len(x) + len(y) - 2 * len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[1:i] = y[1:i])), len(y), r.path, r.line, r.verb)) AS best
FROM (SELECT *, string_split(path, '/') AS x FROM cmatch) m JOIN (SELECT *, string_split(path, '/') AS y FROM rt) r ON r.g = m.g AND r.endpoint = m.ep GROUP BY m.g, m.path, m.line, m.endpoint""")
cte("ecall", """SELECT g, src, dst, endpoint, min(line) AS line, min_by(verb || ' ' || endpoint, line) AS statement FROM (SELECT g, src, line, endpoint, struct_extract(best, 3) AS dst, struct_extract(best, 5) AS verb FROM ecall0) x WHERE src <> dst GROUP BY g, src, dst, endpoint""")


@query("d01_to_d04_resolved", "SELECT g AS graph_id, path AS src_path, line, kind, spec, dst AS dst_path FROM target")
def resolved(spark, sf):
    return graph(spark, sf)["resolved"].select("graph_id", "src_path", "line", "kind", "spec", "dst_path")


# path segments one by one: each step appends, drops or takes back
NORMAL = r"""array_to_string(list_reduce([[]::VARCHAR[]] || list_transform(string_split({0}, '/'), lambda s: [s]),
 lambda a, x: CASE WHEN x[1] IN ('', '.') THEN a WHEN x[1] = '..' AND len(a) > 0 AND a[-1] <> '..' THEN a[1:len(a) - 1] ELSE a || x END), '/')"""


@query("d02_normal_path", rf"SELECT page_id, href, {NORMAL.format("split_part(url, '/', 3) || '/x/.././' || href")} AS resolved FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href=\"(/[^\"]+)\"', 1)) AS href FROM pages) x")
def link_paths(spark, sf):
    pages = t.read(spark, sf, "pages")
    hrefs = pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]+)"'), F.lit(1))).alias("href"))
    host = F.element_at(F.split("url", "/"), 3)
    return hrefs.select("page_id", "href", p.join_path(host, F.concat(F.lit("x/.././"), "href")).alias("resolved"))


@query("d05_endpoint_match", "SELECT g AS graph_id, src AS src_path, dst AS dst_path, endpoint, line, statement FROM ecall")
def endpoint_match(spark, sf):
    return graph(spark, sf)["calls"].select("graph_id", "src_path", "dst_path", "endpoint", "line", "statement")


@query("e04_file_dependencies", "SELECT g AS graph_id, src AS src_path, dst AS dst_path, type, line FROM deps")
def file_dependencies(spark, sf):
    return graph(spark, sf)["deps"].select("graph_id", "src_path", "dst_path", "type", "line")


cte("redis_lists", "SELECT DISTINCT graph_id AS g, path FROM code_lines WHERE regexp_matches(path, '(requirements.txt|go.mod|package.json)$') AND contains(lower(text), 'redis')")
cte("owner", """SELECT c.g, c.path, CASE WHEN x.path IS NOT NULL THEN 'redis-cache' WHEN c.path IN ('docker-compose.yml') THEN 'api-gateway' WHEN c.path IN ('go.mod') THEN 'go-service' WHEN c.path = 'package.json' THEN CASE v.variant WHEN 0 THEN 'web-app' ELSE 'node-service' END
 WHEN c.path = 'rust/Cargo.toml' OR starts_with(c.path, 'rust/') THEN 'rust-core' WHEN starts_with(c.path, 'dotnet/') THEN 'billing' WHEN starts_with(c.path, 'services/java') THEN 'java' WHEN starts_with(c.path, 'frontend/') THEN 'ui_kit'
 WHEN c.path = 'k8s/deploy.yaml' THEN 'checkout' WHEN ends_with(c.path, 'application.properties') THEN 'mysql-database-shop' WHEN c.ext = '.dart' THEN 'app-mobile' WHEN c.ext = '.pkl' THEN 'ml-model-artifacts' WHEN c.ext = '.csv' THEN 'training-datasets'
 WHEN contains(c.name, 'train') THEN 'model-training-pipeline' WHEN starts_with(c.path, 'extension/') THEN 'ext-helper-tool' WHEN starts_with(c.path, 'backend/') THEN 'backend' ELSE 'api-gateway' END AS node_id
FROM cf c JOIN repo_variant v ON v.g = c.g LEFT JOIN redis_lists x ON x.g = c.g AND x.path = c.path""")


@query("d06_owning_node", "SELECT g AS graph_id, path, node_id FROM owner")
def owning_node(spark, sf):
    return graph(spark, sf)["owner"]


cte("fmod", """SELECT f.g, f.path, max_by(m.module_id, len(m.folder)) AS module_id FROM cf f JOIN modu m ON m.g = f.g AND (f.path = m.folder OR starts_with(f.path, m.folder || '/')) GROUP BY f.g, f.path""")


@query("d07_owning_module", "SELECT g AS graph_id, path, module_id FROM fmod")
def owning_module(spark, sf):
    return graph(spark, sf)["file_module"]


@query("d08_lifted_edges", """SELECT d.g AS graph_id, a.node_id AS src, b.node_id AS dst, CASE WHEN d.type IN ('IMPORTS', 'REQUIRES', 'INCLUDES') THEN 'USES' ELSE d.type END AS type, min(d.src) AS ev_file
FROM deps d JOIN owner a ON a.g = d.g AND a.path = d.src JOIN owner b ON b.g = d.g AND b.path = d.dst WHERE a.node_id <> b.node_id GROUP BY 1, 2, 3, 4""")
def lifted_edges(spark, sf):
    g = graph(spark, sf)
    return rs.lift_to_nodes(g["deps"], g["owner"]).drop("ev_line")


cte("mdep", "SELECT d.g, a.module_id AS src_module, b.module_id AS dst_module, count(*) AS n, min(d.src) AS ev_file FROM deps d JOIN fmod a ON a.g = d.g AND a.path = d.src JOIN fmod b ON b.g = d.g AND b.path = d.dst WHERE a.module_id <> b.module_id GROUP BY 1, 2, 3")


@query("e10_module_dependencies", "SELECT g AS graph_id, src_module, dst_module, n, ev_file FROM mdep")
def module_dependencies(spark, sf):
    return graph(spark, sf)["module_deps"].drop("ev_line")


@query("d09_lifted_modules", "SELECT m.g AS graph_id, m.src_module AS src, m.dst_module AS dst, m.n FROM mdep m")
def lifted_modules(spark, sf):
    # modules stand for the graph's nodes
    g = graph(spark, sf)
    as_nodes = g["modules"].select("graph_id", F.col("module_id").alias("node_id"))
    return rs.lift_module_dependencies(g["module_deps"], as_nodes).select("graph_id", "src", "dst", "n")


# --- e: roll-ups ----------------------------------------------------------------------------------

@query("e06_inventory", """SELECT c.g AS graph_id, count(*) AS total_files, CAST(sum(CASE WHEN nt > 0 THEN n ELSE 0 END) AS BIGINT) AS total_lines, count(*) FILTER (category = 'manifest') AS manifests, count(*) FILTER (category = 'config') AS config_files,
 (SELECT count(*) FROM code_folders f WHERE f.g = c.g) AS total_folders, count(*) FILTER (lang = 'Python') AS python_files, count(*) FILTER (category = 'source') AS source_files FROM cfx c GROUP BY c.g""")
def inventory(spark, sf):
    return inv.inventory(files(spark, sf)).select(
        "graph_id", "total_files", "total_lines", "manifests", "config_files", "total_folders",
        F.element_at("languages", "Python").alias("python_files"), F.element_at("categories", "source").alias("source_files"))


@query("e07_language_counts", "SELECT g AS graph_id, lang AS language, count(*) AS n FROM cfx WHERE lang IS NOT NULL GROUP BY g, lang")
def language_counts(spark, sf):
    return inv.language_counts(files(spark, sf)).orderBy("graph_id", F.desc("n"), "language")


@query("e08_modules", "SELECT g AS graph_id, folder, module_id, n AS files_count, first_path FROM modu")
def modules(spark, sf):
    return inv.modules(files(spark, sf)).select("graph_id", "folder", "module_id", "files_count", "first_path")


@query("e08_modules_lite", "SELECT g AS graph_id, array_to_string(string_split(path, '/')[1:2], '/') AS folder, count(*) AS files_count FROM cf WHERE len(string_split(path, '/')) > 2 GROUP BY 1, 2")
def modules_lite(spark, sf):
    return inv.modules(files(spark, sf), "lite").select("graph_id", "folder", "files_count")


@query("e09_elevated_modules", r"""SELECT g AS graph_id, module_id AS node_id, 'Module' AS type FROM modu WHERE g NOT IN (SELECT g FROM mani WHERE type IN ('Service', 'Application') GROUP BY g HAVING count(DISTINCT node_id) > 2)
UNION ALL SELECT DISTINCT graph_id, 'mod-repo-' || regexp_extract(path, '^\./Repo/([a-z]+)/', 1), 'Module' FROM doc_files WHERE regexp_matches(path, '\.(py|ts)$')""")
def elevated_modules(spark, sf):
    # repositories with the nodes that their code gives, and plain document trees with their fallback node
    repos, trees = files(spark, sf), all_docs(spark, sf)
    core = _fallback(trees).select("graph_id", "node_id", F.lit("Application").alias("type"))
    nodes = graph(spark, sf)["nodes"].select("graph_id", "node_id", "type").unionByName(core)
    mods = inv.modules(repos).unionByName(inv.modules(trees))
    return inv.elevate_modules(mods, nodes).select("graph_id", "node_id", "type")


@query("e11_import_lists", "SELECT g AS graph_id, src AS path, 'imports' AS side, dst AS other FROM deps UNION ALL SELECT g, dst, 'imported_by', src FROM deps")
def import_lists(spark, sf):
    return inv.import_lists(files(spark, sf), graph(spark, sf)["deps"])


@query("e11_graph_totals", "SELECT c.g AS graph_id, count(*) AS total_nodes, (SELECT count(*) FROM deps d WHERE d.g = c.g) AS total_edges, (SELECT count(*) FROM deps d WHERE d.g = c.g AND d.type IN ('IMPORTS', 'REQUIRES', 'INCLUDES', 'USES')) AS total_imports FROM cf c GROUP BY c.g")
def graph_totals(spark, sf):
    return inv.code_graph_totals(files(spark, sf), graph(spark, sf)["deps"])


@query("e12_file_degrees", "SELECT c.g AS graph_id, c.path, (SELECT count(*) FROM deps d WHERE d.g = c.g AND d.dst = c.path) AS in_degree, (SELECT count(*) FROM deps d WHERE d.g = c.g AND d.src = c.path) AS out_degree FROM cf c")
def file_degrees(spark, sf):
    return inv.file_degrees(files(spark, sf), graph(spark, sf)["deps"])


@query("e17_analysis_status", """SELECT c.g AS graph_id, c.path, CASE WHEN c.path = 'backend/requirements.txt' THEN 'Analyzed — mapped to backend' WHEN c.category = 'manifest' THEN 'Analyzed — package / build manifest'
 WHEN EXISTS (SELECT 1 FROM deps d WHERE d.g = c.g AND (d.src = c.path OR d.dst = c.path)) THEN 'Analyzed — internal code dependency' WHEN c.category = 'config' THEN 'Analyzed — configuration file'
 WHEN c.category = 'dataset' AND EXISTS (SELECT 1 FROM src_lines l WHERE l.g = c.g AND contains(l.text, c.name)) THEN 'Analyzed — datastore ingested by code'
 WHEN c.category IN ('dataset', 'model_artifact', 'other') OR c.ext = '.png' THEN 'Retained / Not Analyzed (Reason: Unsupported or binary format)' ELSE 'Retained — semantic analysis unavailable' END AS analysis_status FROM cfx c""")
def analysis_status(spark, sf):
    f = files(spark, sf)
    mapped = f.filter("path = 'backend/requirements.txt'").select("graph_id", "path", F.lit("backend").alias("node_name"))
    return inv.analysis_status(f, mapped, graph(spark, sf)["deps"])


@query("e18_limited_flags", r"""SELECT graph_id, true AS limited, true AS limited_lite, count(*) <= 3 AS partial FROM doc_files GROUP BY graph_id
UNION ALL SELECT c.g, n.nodes <= 1, (n.nodes <= 1 AND coalesce(e.edges, 0) = 0) OR (count(*) FILTER (c.category = 'source') <= 1 AND coalesce(e.edges, 0) <= 2) OR (count(*) <= 3 AND count(*) FILTER (c.category = 'manifest') = 0),
 count(*) <= 3 AND count(*) FILTER (c.category = 'manifest') = 0 FROM cfx c JOIN (SELECT g, count(DISTINCT module_id) AS nodes FROM modu GROUP BY g) n ON n.g = c.g
 LEFT JOIN (SELECT g, count(*) AS edges FROM mdep GROUP BY g) e ON e.g = c.g GROUP BY c.g, n.nodes, e.edges""")
def limited_flags(spark, sf):
    # document trees with their fallback node, and repositories with their modules and module dependencies
    trees, g = all_docs(spark, sf), graph(spark, sf)
    core = _fallback(trees).select("graph_id", "node_id")
    mods = g["modules"].select("graph_id", F.col("module_id").alias("node_id")).distinct()
    edges = g["module_deps"].select("graph_id", F.col("src_module").alias("src"), F.col("dst_module").alias("dst"))
    f = files(spark, sf)
    return inv.limited_flags(f.unionByName(trees.select(*f.columns)), core.unionByName(mods), edges)


def _fallback(trees):
    archives = trees.select("graph_id", F.concat("graph_id", F.lit(".zip")).alias("archive")).distinct()
    return inv.fallback_nodes(trees, archives.filter("false").select("graph_id"), archives)


@query("e19_fallback_nodes", r"""SELECT graph_id, 'application-core' AS node_id, 'Docs Src' || substr(graph_id, 9) AS name, min_by(lang, (-n, lang)) || ' Application' AS technology, 'Standalone application (' || CAST(max(total) AS BIGINT) || ' total files cataloged in inventory).' AS description FROM (
SELECT graph_id, CASE regexp_extract(path, '\.([a-z]+)$', 1) WHEN 'py' THEN 'Python' WHEN 'ts' THEN 'TypeScript' WHEN 'yaml' THEN 'YAML' END AS lang, count(*) AS n, sum(count(*)) OVER (PARTITION BY graph_id) AS total FROM doc_files GROUP BY 1, 2) x WHERE lang IS NOT NULL GROUP BY graph_id""")
def fallback_nodes(spark, sf):
    return _fallback(all_docs(spark, sf)).drop("type")


# --- h, k over files ------------------------------------------------------------------------------

cte("fdiff", r"""SELECT coalesce(a.graph_id, b.graph_id) AS g, coalesce(b.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.content <> b.content THEN 'modified' ELSE 'unchanged' END AS ch,
 len(string_split(a.content, chr(10))) AS l1, len(string_split(b.content, chr(10))) AS l2 FROM doc_v1 a FULL JOIN doc_v2 b ON a.graph_id = b.graph_id AND a.path = b.path""")


@query("h03_file_diff", r"SELECT g AS graph_id, regexp_replace(lower(path), '^\./repo/', '') AS key, ch AS change_type, path, CASE WHEN ch = 'modified' THEN 'File modified (' || l1 || ' lines -> ' || l2 || ' lines)' END AS diff_reason FROM fdiff")
def file_diff(spark, sf):
    return d.file_diff(docs(spark, sf, 1), docs(spark, sf, 2)).drop("version_origin")


cte("dfold", "SELECT DISTINCT g, v, folder FROM (SELECT g, v, array_to_string(s[1:i], '/') AS folder FROM (SELECT graph_id AS g, 1 AS v, string_split(path, '/') AS s, unnest(range(1, len(string_split(path, '/')))) AS i FROM doc_v1 UNION ALL SELECT graph_id, 2, string_split(path, '/'), unnest(range(1, len(string_split(path, '/')))) FROM doc_v2) x) y")
cte("fodiff", r"SELECT coalesce(a.g, b.g) AS g, coalesce(a.k, b.k) AS key, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'unchanged' END AS ch FROM (SELECT g, regexp_replace(lower(folder), '^\./', '') AS k FROM dfold WHERE v = 1) a FULL JOIN (SELECT g, regexp_replace(lower(folder), '^\./', '') AS k FROM dfold WHERE v = 2) b ON a.g = b.g AND a.k = b.k")


@query("h04_folder_diff", "SELECT g AS graph_id, key, ch AS change_type FROM fodiff")
def folder_diff(spark, sf):
    return d.folder_diff(inv.folders(docs(spark, sf, 1)), inv.folders(docs(spark, sf, 2))).select("graph_id", "key", "change_type")


_F = ", ".join(f"count(*) FILTER (ch = '{c}') AS {c}_files" for c in d.CHANGES)
_O = ", ".join(f"count(*) FILTER (ch = '{c}') AS {c}_folders" for c in ("removed", "added", "unchanged"))


@query("h06_repository_summary", f"SELECT a.g AS graph_id, a.* EXCLUDE (g), b.* EXCLUDE (g) FROM (SELECT g, {_F} FROM fdiff GROUP BY g) a JOIN (SELECT g, {_O} FROM fodiff GROUP BY g) b ON a.g = b.g")
def repository_summary(spark, sf):
    f1, f2 = docs(spark, sf, 1), docs(spark, sf, 2)
    return d.repository_summary(d.file_diff(f1, f2), d.folder_diff(inv.folders(f1), inv.folders(f2)))


@query("k05_file_filter", "SELECT g AS graph_id, path FROM cfx WHERE category = 'source' AND (contains(lower(path), 'class1') OR contains(lower(lang), 'class1'))")
def file_filter(spark, sf):
    return fi.file_filter(files(spark, sf), "source", "Class1").select("graph_id", "path")


@query("k05_manifest_files", "SELECT g AS graph_id, path FROM cf WHERE regexp_matches(path, '(package\\.json|pom\\.xml|requirements\\.txt|go\\.mod|build\\.gradle|Cargo\\.toml)$')")
def manifest_files(spark, sf):
    return fi.file_filter(files(spark, sf), manifests_only=True).select("graph_id", "path")


@query("k06_code_slice", "SELECT d.g AS graph_id, d.src AS src_path, d.dst AS dst_path FROM deps d JOIN cfx a ON a.g = d.g AND a.path = d.src AND a.category = 'source' AND contains(lower(a.path), '1') JOIN cfx b ON b.g = d.g AND b.path = d.dst AND b.category = 'source' AND contains(lower(b.path), '1') WHERE d.type = 'IMPORTS'")
def code_slice(spark, sf):
    g = graph(spark, sf)
    owned = g["files"].join(g["owner"], ["graph_id", "path"], "left")
    return fi.code_slice(owned, g["deps"], kind="source", dep_type="IMPORTS", query="1")[1].select("graph_id", "src_path", "dst_path")


@query("k07_global_search", """SELECT graph_id, item_id, o AS kind_no FROM (
SELECT graph_id, 1 AS o, 'entity-' || node_id AS item_id, CAST(pos AS VARCHAR) AS pos, name || '|' || type || ' • ' || coalesce(technology, '') || ' ' || coalesce('• ' || description, '') || '|' || upper(type) AS txt FROM fleet_nodes
UNION ALL SELECT graph_id, 2, 'rel-' || edge_id, CAST(pos AS VARCHAR), src || ' → ' || dst || '|' || type || ' via ' || coalesce(protocol, 'Default') || ' (Confidence: ' || coalesce(ev_confidence, 'MEDIUM') || ')|DEPENDENCY' FROM fleet_edges
UNION ALL SELECT g, 3, 'file-' || path, path, path || '|' || 'Size: ' || printf('%.1f', size / 1024.0) || ' KB • Status: Retained|FILE' FROM cf
UNION ALL SELECT graph_id, 4, 'evidence-' || edge_id, CAST(pos AS VARCHAR), 'Citation in ' || ev_file || '|' || description || '|EVIDENCE' FROM fleet_edges WHERE ev_file IS NOT NULL) x WHERE contains(lower(txt), 'c1')""")
def global_search(spark, sf):
    n, e = fleet(spark, sf)
    f = files(spark, sf).withColumn("analysis_status", F.lit(None).cast("string"))
    return fi.global_search(fi.search_index(n, e, f), "c1").select("graph_id", "item_id", "kind_no")


@query("k13_file_lookup", "SELECT g AS graph_id, path FROM cf WHERE ends_with(lower(path), 'app/mod_11.py') OR lower(name) = 'app/mod_11.py'")
def file_lookup(spark, sf):
    return fi.file_lookup(files(spark, sf), "App/mod_11.py").select("graph_id", "path")


VALID = "f.path IS NOT NULL AND e.ev_line > 0 AND length(e.ev_snippet) > 0 AND length(e.ev_method) > 0"


@query("k16_evidence_validity", f"""SELECT e.graph_id, count(*) AS edge_count, count(*) FILTER ({VALID}) AS valid, floor(count(*) FILTER ({VALID}) * 100.0 / count(*) * 1e4 + 0.500001) / 1e4 AS validity_pct
FROM fleet_edges e LEFT JOIN fleet_files f ON f.graph_id = e.graph_id AND f.path = e.ev_file GROUP BY e.graph_id""")
def evidence_validity(spark, sf):
    return fi.evidence_validity(fleet(spark, sf)[1], t.derive(spark, sf, "fleet_files"))

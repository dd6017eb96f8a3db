"""Graph, file and change tables derived from warehouse tables.

Each relation is plain SQL over the base tables that both Spark and an ANSI
engine can run, so a check can start from the same rows.  The number of graphs,
edges and files grows with the base tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# name -> (relations it reads, SQL)
RELATIONS: dict[str, tuple[tuple[str, ...], str]] = {}


def relation(name: str, reads: tuple[str, ...], sql: str) -> None:
    RELATIONS[name] = (reads, sql.strip())


# --- fleet: a system per ten customers, two versions each, twelve components ----------------

relation("fleet_pairs", ("lineitem", "orders"), """
SELECT CAST(floor(o.o_custkey / 10) AS BIGINT) AS sys,
       CAST(least(l.l_partkey % 12, l.l_suppkey % 12) AS INT) AS lo,
       CAST(greatest(l.l_partkey % 12, l.l_suppkey % 12) AS INT) AS hi,
       l.l_returnflag AS flag, l.l_orderkey AS okey
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE l.l_partkey % 12 <> l.l_suppkey % 12
""")

relation("fleet_common", ("fleet_pairs",), """
SELECT sys, s, d, n, okey, rn, 0 AS back FROM (
  SELECT sys, lo AS s, hi AS d, count(*) AS n, min(okey) AS okey,
         row_number() OVER (PARTITION BY sys, lo ORDER BY count(*) DESC, hi) AS rn
  FROM fleet_pairs GROUP BY sys, lo, hi) f
WHERE rn <= 2
UNION ALL
SELECT sys, s, d, n, okey, rn, 1 AS back FROM (
  SELECT sys, hi AS s, lo AS d, count(*) AS n, min(okey) AS okey,
         row_number() OVER (PARTITION BY sys, hi ORDER BY count(*) DESC, lo) AS rn
  FROM fleet_pairs WHERE flag = 'R' AND hi IN (5, 9) GROUP BY sys, hi, lo) b
WHERE rn = 1
""")

relation("fleet_links", ("fleet_common",), """
SELECT sys, 1 AS ver, s, d, n, okey, rn, back FROM fleet_common WHERE (sys * 2 + s * 5 + d) % 23 <> 0
UNION ALL
SELECT sys, 2 AS ver, s, d, n, okey, rn, back FROM fleet_common WHERE (sys + s * 3 + d * 2) % 19 <> 0
""")

relation("fleet_edges", ("fleet_links",), """
SELECT 's' || CAST(sys AS STRING) || '-v' || CAST(ver AS STRING) AS graph_id,
       'e-' || CAST(s AS STRING) || '-' || CAST(d AS STRING) || '-' || CAST(kind AS STRING) AS edge_id,
       CAST(s * 100 + kind * 10 + rn AS INT) AS pos,
       'c' || CAST(10 + s AS STRING) AS src, 'c' || CAST(10 + d AS STRING) AS dst,
       CASE WHEN kind = 1 THEN 'PUBLISHES' WHEN kind = 2 THEN 'QUERIES'
            WHEN rn = 1 THEN 'CALLS' ELSE 'USES' END AS type,
       CASE WHEN kind = 1 THEN NULL WHEN kind = 2 THEN 'SQL'
            WHEN rn = 1 THEN 'HTTP/REST' ELSE 'TCP/Driver' END AS protocol,
       'c' || CAST(10 + s AS STRING) || ' to c' || CAST(10 + d AS STRING) AS description,
       CASE WHEN n % 5 = 0 THEN NULL
            ELSE 'src/c' || CAST(10 + s AS STRING) || '/order_' || CAST(okey AS STRING) || '.ts' END AS ev_file,
       CASE WHEN n % 5 = 0 THEN NULL ELSE CAST(n AS INT) END AS ev_line,
       CASE WHEN n % 5 = 0 THEN NULL ELSE CAST(n + n % 4 AS INT) END AS ev_line_end,
       CASE WHEN n % 5 = 0 OR n % 4 = 0 THEN NULL
            ELSE 'call(c' || CAST(10 + d AS STRING) || ')' END AS ev_snippet,
       CASE WHEN n % 5 = 0 THEN NULL WHEN n % 2 = 0 THEN 'Python AST Import'
            WHEN n % 3 = 0 THEN 'Manifest Analysis' ELSE 'Route Controller Scan' END AS ev_method,
       CASE WHEN n % 5 = 0 THEN NULL WHEN n % 3 = 0 THEN 'HIGH'
            WHEN n % 3 = 1 THEN 'MEDIUM' ELSE 'LOW' END AS ev_confidence
FROM (
  SELECT sys, ver, s, d, n, okey, rn, back AS kind FROM fleet_links
  UNION ALL
  SELECT sys, ver, s, d, n, okey, rn, 2 AS kind FROM fleet_links WHERE back = 0 AND rn = 1 AND sys % 4 = 0
) x
""")

relation("fleet_nodes", ("fleet_links",), """
SELECT 's' || CAST(sys AS STRING) || '-v' || CAST(ver AS STRING) AS graph_id,
       'c' || CAST(10 + k AS STRING) AS node_id, CAST(k AS INT) AS pos,
       CASE WHEN ver = 2 AND (sys + k) % 7 = 0 THEN 'Component ' || CAST(k AS STRING) || ' NG'
            ELSE 'Component ' || CAST(k AS STRING) END AS name,
       CASE WHEN k = 11 OR k = 8 THEN 'Database' WHEN k = 10 THEN 'External System'
            WHEN k = 0 THEN 'Application' WHEN k = 3 THEN 'API' WHEN k = 6 THEN 'Module'
            ELSE 'Service' END AS type,
       CASE WHEN (sys + k) % 5 = 0 THEN NULL WHEN (sys + k) % 11 = 0 AND ver = 2 THEN 'Go'
            ELSE 'TypeScript' END AS technology,
       'Detected' AS source,
       'component ' || CAST(k AS STRING) AS description,
       CASE WHEN k % 3 = 0 THEN NULL ELSE 'src/c' || CAST(10 + k AS STRING) || '/main.ts' END AS ev_file
FROM (
  SELECT sys, ver, s AS k FROM fleet_links UNION SELECT sys, ver, d AS k FROM fleet_links
) x
WHERE NOT (sys % 5 = 0 AND k = 10)
  AND NOT (ver = 2 AND (sys * 3 + k) % 13 = 0) AND NOT (ver = 1 AND (sys + k) % 17 = 0)
""")

# the source files of both versions: those of orders with a line that was returned or accepted
relation("fleet_files", ("fleet_pairs",), """
SELECT DISTINCT 's' || CAST(sys AS STRING) || '-v' || CAST(ver AS STRING) AS graph_id,
       'src/c' || CAST(10 + k AS STRING) || '/order_' || CAST(okey AS STRING) || '.ts' AS path
FROM (
  SELECT sys, 1 AS ver, lo AS k, okey FROM fleet_pairs WHERE flag <> 'N' UNION SELECT sys, 1, hi, okey FROM fleet_pairs WHERE flag <> 'N'
  UNION SELECT sys, 2, lo, okey FROM fleet_pairs WHERE flag <> 'N' UNION SELECT sys, 2, hi, okey FROM fleet_pairs WHERE flag <> 'N'
) x
""")

# --- proposed edits: four scenarios per system on its first version -------------------------

relation("fleet_systems", ("fleet_common",), """
SELECT DISTINCT sys, 's' || CAST(sys AS STRING) AS graph_id FROM fleet_common
""")

relation("fleet_changes", ("fleet_systems", "fleet_common"), """
SELECT graph_id, 'grow' AS scenario_id, 0 AS seq, 'add_component' AS action, 'x1' AS node_id, 'Extra One' AS name,
       CASE WHEN sys % 2 = 0 THEN 'External System' ELSE 'Service' END AS type, 'Go' AS technology,
       CAST(NULL AS STRING) AS edge_id, CAST(NULL AS STRING) AS src, CAST(NULL AS STRING) AS dst,
       CAST(NULL AS STRING) AS edge_type, CAST(NULL AS STRING) AS protocol
FROM fleet_systems
UNION ALL
SELECT graph_id, 'grow', 1, 'add_dependency', NULL, NULL, NULL, NULL, 'n1', 'c' || CAST(10 + sys % 9 AS STRING), 'x1', 'CALLS', 'HTTP/REST'
FROM fleet_systems
UNION ALL
SELECT graph_id, 'drop', 0, 'remove_component', 'c' || CAST(10 + sys % 12 AS STRING), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM fleet_systems
UNION ALL
SELECT graph_id, 'back', 0, 'remove_component', 'c' || CAST(11 + sys % 7 AS STRING), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM fleet_systems
UNION ALL
SELECT graph_id, 'back', 1, 'add_dependency', NULL, NULL, NULL, NULL, 'n2', 'c20', 'c' || CAST(11 + sys % 7 AS STRING), 'USES', NULL
FROM fleet_systems
UNION ALL
SELECT 's' || CAST(sys AS STRING), 'cut', 0, 'remove_dependency', NULL, NULL, NULL, NULL,
       CASE WHEN sys % 3 = 0 THEN 'e-' || CAST(s AS STRING) || '-' || CAST(d AS STRING) || '-0' END,
       CASE WHEN sys % 3 <> 0 THEN 'c' || CAST(10 + s AS STRING) END, CASE WHEN sys % 3 <> 0 THEN 'c' || CAST(10 + d AS STRING) END, NULL, NULL
FROM fleet_common WHERE s = sys % 8 AND rn = 1 AND back = 0
""")

# --- raw: blueprints with faults, for validation ----------------------------------------------

relation("raw_nodes", ("fleet_nodes",), """
SELECT split_part(graph_id, '-', 1) AS graph_id,
       CASE WHEN length(graph_id) % 2 = 0 AND pos = 7 THEN '' ELSE ' ' || node_id || ' ' END AS node_id,
       pos + 100 * CASE WHEN graph_id LIKE '%-v2' THEN 1 ELSE 0 END AS pos,
       CASE WHEN pos = 5 THEN NULL ELSE name END AS name,
       CASE WHEN pos = 4 THEN 'Gateway' ELSE type END AS type, technology, source, description
FROM fleet_nodes WHERE graph_id LIKE '%-v1' OR pos IN (2, 9, 11)
""")

relation("raw_edges", ("fleet_edges",), """
SELECT split_part(graph_id, '-', 1) AS graph_id, edge_id, pos,
       CASE WHEN pos = 301 THEN '' ELSE src END AS src,
       CASE WHEN pos = 402 THEN NULL WHEN pos = 602 THEN 'ghost' ELSE dst END AS dst,
       CASE WHEN pos = 101 THEN 'LINKS' ELSE type END AS type, protocol, description
FROM fleet_edges WHERE graph_id LIKE '%-v1'
""")

# --- supply: one large graph, order -> customer/supplier -> nation -> region ----------------

relation("supply_edges", ("orders", "lineitem", "customer", "supplier", "nation"), """
SELECT 'supply' AS graph_id, src, dst FROM (
  SELECT 'o' || CAST(o_orderkey AS STRING) AS src, 'c' || CAST(o_custkey AS STRING) AS dst FROM orders
  UNION
  SELECT 'o' || CAST(l_orderkey AS STRING), 's' || CAST(l_suppkey AS STRING) FROM lineitem
  UNION
  SELECT 'c' || CAST(c_custkey AS STRING), 'n' || CAST(c_nationkey AS STRING) FROM customer
  UNION
  SELECT 's' || CAST(s_suppkey AS STRING), 'n' || CAST(s_nationkey AS STRING) FROM supplier
  UNION
  SELECT 'n' || CAST(n_nationkey AS STRING), 'r' || CAST(n_regionkey AS STRING) FROM nation
) x
""")

# --- transitions: which event type follows which, per user ----------------------------------

relation("transition_edges", ("events",), """
SELECT 'events' AS graph_id, event_type AS src, next_type AS dst, count(*) AS n FROM (
  SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type
  FROM events) x
WHERE next_type IS NOT NULL GROUP BY event_type, next_type
""")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One base table."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def derive(spark: SparkSession, sf_dir: str, name: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """A relation, with what it reads expanded below it (Catalyst sees one plan); ``given``: relations that are written already."""
    if given and name in given:
        return given[name]
    if name in BASE_TABLES:
        return read(spark, sf_dir, name)
    reads, sql = RELATIONS[name]
    frames = {r: derive(spark, sf_dir, r, given) for r in reads}
    text = sql.replace("{", "{{").replace("}", "}}")
    for r in sorted(reads, key=len, reverse=True):
        text = re.sub(rf"\b(FROM|JOIN) {r}\b", rf"\1 {{{r}}}", text)
    return spark.sql(text, **frames)


EVIDENCE_FIELDS = ("file", "line", "line_end", "snippet", "method", "confidence")


def with_evidence(df: DataFrame) -> DataFrame:
    """Pack the ``ev_*`` columns into the evidence struct (null when there is no file)."""
    have = [f for f in EVIDENCE_FIELDS if f"ev_{f}" in df.columns]
    packed = F.struct(*[F.col(f"ev_{f}").alias(f) for f in have])
    return df.withColumn("evidence", F.when(F.col("ev_file").isNotNull(), packed)).drop(
        *[f"ev_{f}" for f in have]
    )


def fleet(spark: SparkSession, sf_dir: str, given: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all systems in both versions."""
    return derive(spark, sf_dir, "fleet_nodes", given), derive(spark, sf_dir, "fleet_edges", given)


def fleet_version(spark: SparkSession, sf_dir: str, version: int, given: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one version, keyed by system only (for comparing versions)."""
    nodes, edges = fleet(spark, sf_dir, given)
    def pick(df):
        return df.filter(F.col("graph_id").endswith(f"-v{version}")).withColumn(
            "graph_id", F.substring_index("graph_id", "-", 1))
    return pick(nodes), pick(edges)

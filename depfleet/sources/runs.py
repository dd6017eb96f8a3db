"""Stored analysis runs and version snapshots, as append-only tables.

A run is written part by part below ``root/<part>``, partitioned by date and commit; the rows of ``root/commits`` come last
and name the commit of every project in it, so a reader sees whole runs or nothing of them.  The newest run of a project
is found in that small table, without reading results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = ("metrics", "criticality", "spof", "edge_risk", "node_risk", "complexity", "system")
MANIFEST = ("project_id string, version string, analyzed_at timestamp, critical_count long, high_risk_count long, spof_count long, "
            "complexity_rating string, commit string, run_date date")


def run_rows(tables: dict[str, DataFrame], analyzed_at: Column, version: Column | None = None) -> DataFrame:
    """One row per graph: the headline counts of an analysis."""
    c = tables["criticality"].groupBy("graph_id").agg(F.count_if(F.col("tier") == "CRITICAL").alias("critical_count"))
    e = tables["edge_risk"].groupBy("graph_id").agg(F.count_if(F.col("risk_level").isin("CRITICAL", "HIGH")).alias("high_risk_count"))
    s = tables["spof"].groupBy("graph_id").agg(F.count_if("is_spof").alias("spof_count"))
    return (tables["complexity"].select("graph_id", "complexity_rating").join(c, "graph_id", "left").join(e, "graph_id", "left")
            .join(s, "graph_id", "left").na.fill(0, ["critical_count", "high_risk_count", "spof_count"])
            .select(F.col("graph_id").alias("project_id"), (version if version is not None else F.lit(None).cast("string")).alias("version"),
                    analyzed_at.cast("timestamp").alias("analyzed_at"), "critical_count", "high_risk_count", "spof_count", "complexity_rating"))


def append_run(tables: dict[str, DataFrame], root: str, analyzed_at: Column, version: Column | None = None) -> str:
    """Stores the whole result of an analysis; the commit's name is given back."""
    commit = uuid.uuid4().hex
    date = F.to_date(analyzed_at.cast("timestamp"))
    for part in PARTS:
        if part in tables:
            (tables[part].withColumnRenamed("graph_id", "project_id").withColumn("run_date", date).withColumn("commit", F.lit(commit))
             .write.mode("append").partitionBy("run_date", "commit").parquet(f"{root}/{part}"))
    (run_rows(tables, analyzed_at, version).withColumn("commit", F.lit(commit)).withColumn("run_date", date)
     .write.mode("append").partitionBy("run_date").parquet(f"{root}/commits"))
    return commit


def committed(spark: SparkSession, root: str) -> DataFrame:
    """The manifest: every project of every whole run."""
    return spark.read.schema(MANIFEST).parquet(f"{root}/commits")


def latest_runs(runs: DataFrame) -> DataFrame:
    """Newest run of every project; a partial maximum, no sort of a project's history."""
    rest = [c for c in runs.columns if c != "project_id"]
    return runs.groupBy("project_id").agg(F.max_by(F.struct(*rest), "analyzed_at").alias("r")).select("project_id", "r.*")


def run_view(spark: SparkSession, root: str, part: str, runs: DataFrame) -> DataFrame:
    """One part of the given runs (rows of the manifest), as the analysis gave it."""
    stored = spark.read.parquet(f"{root}/{part}")
    return stored.join(runs.select("project_id", "commit", "version", "analyzed_at"), ["project_id", "commit"]).drop("run_date")


SNAPSHOT = ("graph_id string, label string, taken_at timestamp, node_count long, edge_count long, file_count long, folder_count long, "
            "commit string, version string")


def snapshots(nodes: DataFrame, edges: DataFrame, files: DataFrame, folders: DataFrame, label: str) -> DataFrame:
    """Counts of one version; without files the node count stands in for the file count."""
    n = lambda df, name: df.groupBy("graph_id").agg(F.count(F.lit(1)).alias(name))
    row = (n(nodes, "node_count").join(n(edges, "edge_count"), "graph_id", "left")
           .join(n(files, "file_count"), "graph_id", "left").join(n(folders, "folder_count"), "graph_id", "left"))
    return row.select("graph_id", F.lit(label).alias("label"), "node_count",
                      F.coalesce("edge_count", F.lit(0)).alias("edge_count"),
                      F.coalesce("file_count", "node_count").alias("file_count"),
                      F.coalesce("folder_count", F.lit(0)).alias("folder_count"))


def append_snapshot(tables: dict[str, DataFrame], root: str, version: str, label: str, taken_at: Column) -> str:
    """Stores nodes, edges, files and folders of one version unchangeably, and then their counts."""
    commit = uuid.uuid4().hex
    for part in ("nodes", "edges", "files", "folders"):
        (tables[part].withColumn("version", F.lit(version)).withColumn("commit", F.lit(commit))
         .write.mode("append").partitionBy("version", "commit").parquet(f"{root}/{part}"))
    (snapshots(*(tables[p] for p in ("nodes", "edges", "files", "folders")), label)
     .withColumn("taken_at", taken_at.cast("timestamp")).withColumn("commit", F.lit(commit)).withColumn("version", F.lit(version))
     .write.mode("append").partitionBy("version").parquet(f"{root}/snapshots"))
    return commit


def read_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Counts of every stored version."""
    return spark.read.schema(SNAPSHOT).parquet(f"{root}/snapshots")


def snapshot_part(spark: SparkSession, root: str, part: str, version: str) -> DataFrame:
    """Nodes, edges, files or folders of a stored version."""
    done = read_snapshots(spark, root).filter(F.col("version") == version).select("graph_id", "commit")
    return spark.read.parquet(f"{root}/{part}").filter(F.col("version") == version).join(done, ["graph_id", "commit"], "left_semi").drop("commit", "version")

"""File tables from directory trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kinds import decode_text, is_binary
from .code import describe


def read_files(spark: SparkSession, root: str, graph_depth: int = 1, max_text: int | None = None) -> DataFrame:
    """One row per file below ``root``, on any file system; the first ``graph_depth`` folders name the graph.

    Every file is kept; text is left out for binary files, and for those over ``max_text`` bytes if set.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    above = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toUri().getPath().rstrip("/")
    inner = F.regexp_replace(F.col("path"), r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")  # the path without scheme and host
    rel = F.substr(inner, F.lit(len(above) + 2))
    parts = F.split(rel, "/")
    readable = ~is_binary(rel)
    if max_text is not None:
        readable &= F.col("length") <= max_text
    return describe(raw.select(
        F.array_join(F.slice(parts, F.lit(1), F.lit(graph_depth)), "/").alias("graph_id"),
        F.array_join(F.slice(parts, F.lit(graph_depth + 1), F.size(parts)), "/").alias("path"),
        F.col("length").alias("size_bytes"), F.when(readable, decode_text(F.col("content"))).alias("content")))

"""Reading graphs from JSON documents of unknown form, and writing them back.

Documents are parsed as variants, so a document of any shape is read: what is there is taken, and every fault is
a row (graph_id, level, code, subject, pos) of the same form as those of ``register.validate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import union_all


def _or(column, default):
    """The trimmed text, or the default where it is empty."""
    return F.when(F.trim(F.coalesce(column, F.lit(""))) == "", default).otherwise(F.trim(column))


def _get(value: str, path: str, kind: str) -> Column:
    return F.try_variant_get(F.col(value), f"$.{path}", kind)


def _json(value: str, path: str) -> Column:
    return F.to_json(_get(value, path, "variant"))


def _shape(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, ...; null where there is nothing."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def read_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(source, doc): the texts of all files below a path, whole or line by line, whatever is in them."""
    texts = spark.read.option("wholetext", not lines).option("recursiveFileLookup", True).text(path)
    return texts.select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("doc")).filter(
        F.lit(not lines) | (F.trim("doc") != ""))


def parse_documents(docs: DataFrame, strict: bool = False) -> dict[str, DataFrame]:
    """``nodes``, ``edges``, ``models`` and ``issues`` of documents (graph_id or source, doc).

    A document's own ``graph_id`` names the graph, else that of the table, else its file's name without ending.  The list of
    components may be called ``entities`` or ``services``.  ``strict`` wants ``entities`` and ``relationships`` and takes
    nothing from documents without them.  Evidence, metadata, statistics and inventory are kept as JSON.
    """
    given = F.col("graph_id") if "graph_id" in docs.columns else F.lit(None).cast("string")
    file = F.regexp_replace(F.col("source"), r"\.[^.]*$", "") if "source" in docs.columns else F.lit(None).cast("string")
    read = docs.withColumn("v", F.try_parse_json("doc")).withColumn("graph_id", F.coalesce(_get("v", "graph_id", "string"), given, file))
    read = read.select("graph_id", "doc", "v", _shape(F.col("v")).alias("root"),
                       _shape(_get("v", "entities", "variant")).alias("e_shape"), _shape(_get("v", "services", "variant")).alias("s_shape"),
                       _shape(_get("v", "relationships", "variant")).alias("r_shape"))
    is_list = lambda c: F.coalesce(F.col(c) == "ARRAY", F.lit(False))
    absent = lambda c: F.col(c).isNull() | (F.col(c) == "VOID")
    parts = F.when(is_list("e_shape"), _get("v", "entities", "array<variant>"))
    if not strict:
        parts = F.when(is_list("e_shape"), _get("v", "entities", "array<variant>")).when(is_list("s_shape"), _get("v", "services", "array<variant>"))
    has_parts = is_list("e_shape") if strict else is_list("e_shape") | is_list("s_shape")
    links = F.when(is_list("r_shape"), _get("v", "relationships", "array<variant>"))
    fine = F.col("root") == "OBJECT"
    if strict:
        fine &= has_parts & is_list("r_shape")

    def issue(rows: DataFrame, code: str, subject: Column | None = None, level: str = "error") -> DataFrame:
        pos = F.col("pos") if "pos" in rows.columns else F.lit(None).cast("int")
        return rows.select("graph_id", F.lit(level).alias("level"), F.lit(code).alias("code"), (F.lit("") if subject is None else subject).alias("subject"), pos.alias("pos"))

    blank = F.trim(F.coalesce("doc", F.lit(""))) == ""
    whole = read.filter("root = 'OBJECT'")
    p = read.filter(fine).select("graph_id", F.posexplode(parts).alias("pos", "e")).withColumn("shape", _shape(F.col("e")))
    r = read.filter(fine).select("graph_id", F.posexplode(links).alias("pos", "r")).withColumn("shape", _shape(F.col("r")))
    no_text = lambda value, path: _shape(_get(value, path, "variant")).isin("OBJECT", "ARRAY")
    issues = union_all([
        issue(read.filter(blank), "empty_document"), issue(read.filter(~blank & F.col("v").isNull()), "invalid_json"),
        issue(read.filter("root <> 'OBJECT'"), "root_not_object", F.col("root")),
        issue(whole.filter(~has_parts & (absent("e_shape") & (absent("s_shape") | F.lit(strict)))), "missing_components"),
        issue(whole.filter(~has_parts & ~(absent("e_shape") & (absent("s_shape") | F.lit(strict)))), "components_not_list", F.coalesce("e_shape", "s_shape")),
        issue(whole.filter(absent("r_shape")), "missing_relationships", level="error" if strict else "warning"),
        issue(whole.filter(~absent("r_shape") & ~is_list("r_shape")), "relationships_not_list", F.col("r_shape")),
        issue(p.filter("shape <> 'OBJECT'"), "component_not_object", F.col("shape")),
        issue(p.filter((F.col("shape") == "OBJECT") & no_text("e", "id")), "component_id_not_text"),
        issue(r.filter("shape <> 'OBJECT'"), "relationship_not_object", F.col("shape")),
        issue(r.filter((F.col("shape") == "OBJECT") & (no_text("r", "source") | no_text("r", "target"))), "relationship_end_not_text")])

    node_id = F.trim(_get("e", "id", "string"))
    nodes = p.filter("shape = 'OBJECT'").select(
        "graph_id", node_id.alias("node_id"), "pos", _or(_get("e", "name", "string"), node_id).alias("name"),
        F.coalesce(_get("e", "type", "string"), F.lit("Service")).alias("type"),
        _or(_get("e", "technology", "string"), F.lit("Generic / Undefined")).alias("technology"),
        F.coalesce(_get("e", "source", "string"), F.lit("User Provided")).alias("source"),
        _or(_get("e", "description", "string"), F.concat(F.lit("Component "), node_id)).alias("description"),
        _json("e", "evidence").alias("evidence"), _json("e", "metadata").alias("metadata"))
    src, dst = F.trim(_get("r", "source", "string")), F.trim(_get("r", "target", "string"))
    kind = F.coalesce(_get("r", "type", "string"), F.lit("CALLS"))
    protocol = F.when(kind == "CALLS", "HTTP/REST").when(kind == "USES", "TCP/Driver").otherwise("Direct Link")
    edges = r.filter("shape = 'OBJECT'").select(
        "graph_id", _or(_get("r", "id", "string"), F.concat_ws("-", F.lit("rel"), src, dst, F.col("pos").cast("string"))).alias("edge_id"),
        "pos", src.alias("src"), dst.alias("dst"), kind.alias("type"), _or(_get("r", "protocol", "string"), protocol).alias("protocol"),
        _or(_get("r", "description", "string"), F.concat_ws(" ", src, kind, dst)).alias("description"),
        _json("r", "evidence").alias("evidence"), _json("r", "metadata").alias("metadata"))
    models = read.filter(fine).select(
        "graph_id", _get("v", "systemName", "string").alias("system_name"), _get("v", "version", "string").alias("version"),
        _json("v", "stats").alias("stats"), _json("v", "inventory").alias("inventory"))
    return {"nodes": nodes, "edges": edges, "models": models, "issues": issues}


def read_blueprints(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """All blueprint documents below a path."""
    return parse_documents(read_documents(spark, path, lines))


def read_models(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """Strict reading: both lists must be there; documents without them give issues only."""
    return parse_documents(read_documents(spark, path, lines), strict=True)


NODE_TEXT = ("name", "type", "technology", "source", "description")
EDGE_TEXT = ("type", "protocol", "description")


def model_documents(nodes: DataFrame, edges: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """One JSON document per node, per edge and per model, keyed by graph: no document has to hold a whole graph.

    What a table does not have is left out; evidence and metadata, kept as JSON, are nested as what they are.
    """
    nested = lambda df: [F.try_parse_json(c).alias(c) for c in ("evidence", "metadata", "stats", "inventory") if c in df.columns]
    named = lambda df, cols: [F.col(c) for c in cols if c in df.columns]
    n = nodes.select("graph_id", F.lit("entity").alias("kind"), F.to_json(F.struct(
        F.col("node_id").alias("id"), *named(nodes, ("pos", *NODE_TEXT)), *nested(nodes))).alias("doc"))
    e = edges.select("graph_id", F.lit("relationship").alias("kind"), F.to_json(F.struct(
        F.col("edge_id").alias("id"), F.col("src").alias("source"), F.col("dst").alias("target"), *named(edges, ("pos", *EDGE_TEXT)), *nested(edges))).alias("doc"))
    out = n.unionByName(e)
    if models is None:
        return out
    m = models.select("graph_id", F.lit("model").alias("kind"), F.to_json(F.struct(
        F.col("system_name").alias("systemName"), "version", *nested(models))).alias("doc"))
    return out.unionByName(m)


def export_json(df: DataFrame, path: str) -> None:
    """JSON lines, one folder per graph."""
    df.write.mode("overwrite").partitionBy("graph_id").json(path)


def import_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that ``export_json`` wrote, as they were."""
    lines = spark.read.schema("graph_id string, kind string, doc string").json(path).withColumn("v", F.try_parse_json("doc"))
    text = lambda *cols: [_get("v", c, "string").alias(c) for c in cols]
    pos = _get("v", "pos", "int").alias("pos")
    kept = [_json("v", c).alias(c) for c in ("evidence", "metadata")]
    of = lambda kind: lines.filter(F.col("kind") == kind)
    return {
        "nodes": of("entity").select("graph_id", _get("v", "id", "string").alias("node_id"), pos, *text(*NODE_TEXT), *kept),
        "edges": of("relationship").select("graph_id", _get("v", "id", "string").alias("edge_id"), pos, _get("v", "source", "string").alias("src"),
                                           _get("v", "target", "string").alias("dst"), *text(*EDGE_TEXT), *kept),
        "models": of("model").select("graph_id", _get("v", "systemName", "string").alias("system_name"), *text("version"),
                                     _json("v", "stats").alias("stats"), _json("v", "inventory").alias("inventory"))}

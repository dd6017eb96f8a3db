"""Reading and writing: blueprints, directory trees, runs."""

import json

from conftest import EDGE_SCHEMA, NODE_SCHEMA, edge_rows, node_rows
from pyspark.sql import functions as F

from depfleet.operators import register as rg
from depfleet.sources import blueprint as bp
from depfleet.sources import runs
from depfleet.sources.files import read_files


def test_blueprints(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({
        "graph_id": "a", "services": [{"id": " x "}, {"id": "y", "name": "Why"}, {"id": "x"}],
        "relationships": [{"source": "x", "target": "y"}, {"source": "x", "target": "zzz", "type": "USES"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"graph_id": "b", "entities": [{"id": "q"}], "relationships": []}))
    read = bp.read_blueprints(spark, str(tmp_path))
    nodes, edges = read["nodes"], read["edges"]
    assert {(r["graph_id"], r["node_id"], r["name"]) for r in nodes.collect()} == {
        ("a", "x", "x"), ("a", "y", "Why"), ("b", "q", "q")}
    first = edges.filter("dst = 'y'").first()
    assert (first["edge_id"], first["protocol"], first["type"]) == ("rel-x-y-0", "HTTP/REST", "CALLS")
    issues, clean, kept, verdict = rg.validate(nodes, edges)
    assert {r["code"] for r in issues.collect()} == {"duplicate_node_id", "undefined_edge_end"}
    assert {r["graph_id"]: r["accepted"] for r in verdict.collect()} == {"a": False, "b": True}
    assert kept.count() == 1 and clean.count() == 3
    strict = bp.read_models(spark, str(tmp_path))
    assert [(r["graph_id"], r["code"]) for r in strict["issues"].collect()] == [("a", "missing_components")]
    assert {r["graph_id"] for r in strict["nodes"].collect()} == {"b"}


def test_documents_of_any_form(spark, tmp_path):
    """Every fault is a row, and what is there is still read."""
    texts = {"cut": '{"entities": [', "list": "[1]", "empty": "  ", "text": '"x"', "none": "{}", "null": '{"entities": null, "relationships": null}',
             "odd": json.dumps({"entities": {"id": "x"}, "services": [{"id": "kept"}], "relationships": "none"}),
             "mixed": json.dumps({"graph_id": "own", "entities": [{"id": 7}, "x", {"id": {"a": 1}}, {"name": "no id"}], "version": "2", "systemName": "S", "stats": {"n": 1},
                                  "relationships": [{"source": "7", "target": ["q"]}, 5, {"source": "7", "target": "8", "evidence": {"file": "f"}, "metadata": {"k": [1]}}]})}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = bp.read_blueprints(spark, str(tmp_path))
    found = {}
    for r in got["issues"].collect():
        found.setdefault(r["graph_id"], set()).add((r["code"], r["pos"]))
    assert found == {
        "cut": {("invalid_json", None)}, "list": {("root_not_object", None)}, "text": {("root_not_object", None)}, "empty": {("empty_document", None)},
        "none": {("missing_components", None), ("missing_relationships", None)}, "null": {("missing_components", None), ("missing_relationships", None)},
        "odd": {("relationships_not_list", None)},
        "own": {("component_not_object", 1), ("component_id_not_text", 2), ("relationship_not_object", 1), ("relationship_end_not_text", 0)}}
    assert {(r["graph_id"], r["node_id"]) for r in got["nodes"].collect() if r["node_id"]} >= {("odd", "kept"), ("own", "7")}
    edge = got["edges"].filter("dst = '8'").first()
    assert json.loads(edge["evidence"]) == {"file": "f"} and json.loads(edge["metadata"]) == {"k": [1]}
    model = got["models"].filter("graph_id = 'own'").first()
    assert (model["system_name"], model["version"], model["stats"]) == ("S", "2", '{"n":1}')
    assert bp.parse_documents(spark.createDataFrame([], "graph_id string, doc string"))["issues"].count() == 0


def test_export_round_trip(spark, tmp_path):
    """A model survives being written and read."""
    n = spark.createDataFrame(node_rows("g", "AB"), NODE_SCHEMA).withColumn("evidence", F.lit('{"file":"a.py","line":3}')).withColumn("metadata", F.lit('{"k":[1,2]}'))
    e = spark.createDataFrame(edge_rows("g", ["A>B"]), EDGE_SCHEMA).withColumn("evidence", F.lit(None).cast("string"))
    m = spark.createDataFrame([("g", "Shop", "3", '{"total_nodes":2}', None)], "graph_id string, system_name string, version string, stats string, inventory string")
    bp.export_json(bp.model_documents(n, e, m), str(tmp_path / "out"))
    back = bp.import_json(spark, str(tmp_path / "out"))
    same = lambda df, other: {tuple(r[c] for c in other.columns) for r in df.collect()} == {tuple(r) for r in other.collect()}
    assert same(back["nodes"], n.select("graph_id", "node_id", "pos", "name", "type", "technology", "description", "evidence", "metadata"))
    assert same(back["edges"], e.select("graph_id", "edge_id", "pos", "src", "dst", "type", "protocol", "description", "evidence"))
    assert same(back["models"], m)


def test_read_files(spark, tmp_path):
    root = tmp_path / "repos"
    (root / "one" / "src").mkdir(parents=True)
    (root / "one" / "src" / "main.py").write_text("import os\nprint(1)\n")
    (root / "one" / "logo.png").write_bytes(b"\x89PNG\x00")
    (root / "one" / "wide.txt").write_bytes("hi".encode("utf-16"))
    got = {r["path"]: r for r in read_files(spark, str(root)).collect()}
    assert set(got) == {"src/main.py", "logo.png", "wide.txt"}
    assert got["src/main.py"]["lines_count"] == 3 and got["src/main.py"]["graph_id"] == "one"
    assert got["logo.png"]["content"] is None and got["wide.txt"]["content"].endswith("hi")


def test_run_store(spark, tmp_path):
    """Two runs of one project: both are kept, the newest opens, and a run without its commit row is not seen."""
    from depfleet.plans.analysis import analyse
    root = str(tmp_path / "runs")
    n = spark.createDataFrame(node_rows("p", "ABC") + node_rows("q", "AB"), NODE_SCHEMA)
    first = analyse(n, spark.createDataFrame(edge_rows("p", ["A>B"]) + edge_rows("q", ["A>B"]), EDGE_SCHEMA))
    second = analyse(n.filter("graph_id = 'p'"), spark.createDataFrame(edge_rows("p", ["A>B", "B>C"]), EDGE_SCHEMA))
    at = lambda text: F.lit(text).cast("timestamp")
    runs.append_run(second, root, at("2024-02-01 00:00:00"), F.lit("two"))
    runs.append_run(first, root, at("2024-01-01 00:00:00"), F.lit("one"))
    manifest = runs.committed(spark, root)
    assert sorted((r["project_id"], r["version"]) for r in manifest.collect()) == [("p", "one"), ("p", "two"), ("q", "one")]
    latest = runs.latest_runs(manifest)
    assert {r["project_id"]: r["version"] for r in latest.collect()} == {"p": "two", "q": "one"}
    degrees = {(r["project_id"], r["node_id"]): r["out_degree"] for r in runs.run_view(spark, root, "metrics", latest).collect()}
    assert degrees == {("p", "A"): 1, ("p", "B"): 1, ("p", "C"): 0, ("q", "A"): 1, ("q", "B"): 0}
    old = runs.run_view(spark, root, "metrics", manifest.filter("version = 'one' AND project_id = 'p'"))
    assert {r["node_id"]: r["out_degree"] for r in old.collect()} == {"A": 1, "B": 0, "C": 0}
    lost = first["metrics"].withColumnRenamed("graph_id", "project_id").withColumn("run_date", F.lit("2024-03-01").cast("date")).withColumn("commit", F.lit("half"))
    lost.write.mode("append").partitionBy("run_date", "commit").parquet(f"{root}/metrics")
    assert runs.run_view(spark, root, "metrics", runs.latest_runs(runs.committed(spark, root))).count() == 5


def test_snapshots(spark, tmp_path):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    for version, nodes in (("1", "AB"), ("2", "ABC")):
        runs.append_snapshot({"nodes": table([("g", v) for v in nodes], "graph_id string, node_id string"), "edges": table([("g", "A", "B")], "graph_id string, src string, dst string"),
                              "files": table([], "graph_id string, path string"), "folders": table([("g", "src")], "graph_id string, folder string")},
                             str(tmp_path), version, f"V{version}", F.lit("2024-01-0" + version))
    rows = {r["version"]: (r["label"], r["node_count"], r["edge_count"], r["file_count"], r["folder_count"], str(r["taken_at"])) for r in runs.read_snapshots(spark, str(tmp_path)).collect()}
    assert rows == {"1": ("V1", 2, 1, 2, 1, "2024-01-01 00:00:00"), "2": ("V2", 3, 1, 3, 1, "2024-01-02 00:00:00")}
    assert {r["node_id"] for r in runs.snapshot_part(spark, str(tmp_path), "nodes", "1").collect()} == {"A", "B"}

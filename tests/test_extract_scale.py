"""What the extraction does once, and for which lines, instead of again and again; the rows stay the same."""

import random

from pyspark.sql import functions as F

from depfleet.functions import paths as p
from depfleet.operators import extract as x
from depfleet.operators import resolve as rs
from depfleet.sources import code as cs
from depfleet.sources.tables import derive


def test_files_are_built_from_one_reading_of_the_items(spark, tmp_path):
    """Rows of the relation ``code_lines``, with null and repeated keys, orders without items and items without orders."""
    rng = random.Random(3)
    some = lambda top: rng.choice([None, *range(top)])
    orders = [(some(40), some(60)) for _ in range(70)] + [(41, 7)]
    items = [(some(45), some(30), some(12), rng.randrange(4), float(rng.randrange(3))) for _ in range(200)] + [(1, 2, 3, 1, 1.0)] * 2
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    made = cs.code_files(spark, str(tmp_path))
    key = lambda r: tuple(str(v) for v in r)
    want = sorted(cs.files_from_lines(derive(spark, str(tmp_path), "code_lines")).collect(), key=key)
    assert len(want) > 70 and sorted(made.collect(), key=key) == want
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1


LINES = [
    "import x from './a';", "export { b } from './c'", "const z = require('q')", "from a.b import c, d", "import a, b as c", "import 'm.dart';",
    "import com.a.B;", '#include "u.h"', "#include <v>", "using A.B;", "require 'j'", "require_once('P.php');", "use A\\B;", "pub mod m;", "mod n;",
    "import (", '  "acme/x"', ")", "IMPORT FAISS", "import faiss", "Faiss.Index()", "AMQP://x", "amqplib", "pika.Connect", "MongoDB://h", "MongoClient()",
    "api.github.com", "pickle.load(f)", "import openai", 'Configuration["REDIS_ADDR"]', "AddStackExchangeRedisCache", 'MapEnv(&s, "CART_SERVICE_ADDR")',
    "genai.configure", "import google.generativeai", "import jwt from 'jsonwebtoken'", "@app.route('/x', methods=['POST'])", "@Router.Get('/API/y')",
    "router.post('/api/items/1')", '@GetMapping("/api/z")', "@PostMapping", '@RequestMapping(value = "/b")', 'r.GET("/api/q")', '[HttpGet("/API/w")]',
    "axios.GET('http://svc:80/api/v')", 'restTemplate.getForObject("http://s-1/x")', "fetch(`/a/b`)", 'base_url = "/c/d"', "see HTTPS://h.io/e/f",
    "open('m.pkl', 'wb')", "pd.read_csv(f)", "file_uploader(csv)", "load_dotenv()", "pd.read_table(f)", "spring.datasource.url=JDBC:mysql://h/shop",
    "interface R extends JpaRepository<A>", "value = 1", "return 1", "# import no", "// import 'no'", "",
]


def test_lines_without_a_needed_word_are_left_out_early_only(spark, monkeypatch):
    """Every rule finds the same lines with and without its cheap test before the patterns."""
    rng = random.Random(5)
    texts = LINES + [" ".join(rng.sample(LINES, 2)) for _ in range(60)] + [t.swapcase() for t in LINES]
    files = [("g", f"src/f{e}", e, "config" if e == ".yml" else "source") for e in (".py", ".ts", ".java", ".go", ".cs", ".php", ".rb", ".rs", ".dart", ".cpp", ".yml")]
    lines = spark.createDataFrame([(*f, i + 1, t, t.strip()) for f in files for i, t in enumerate(texts)],
                                  "graph_id string, path string, extension string, category string, line int, text string, trimmed string").cache()
    whole = spark.createDataFrame([(f[0], f[1], f[2], "\n".join(texts)) for f in files], "graph_id string, path string, extension string, content string")
    owner = lines.select("graph_id", "path", F.lit("o").alias("node_id")).distinct()
    stores = spark.createDataFrame([("g", "db", "Database")], "graph_id string, node_id string, type string")
    finders = [x.import_hits, x.artefact_hits, x.routes, x.api_nodes, x.endpoint_calls, x.host_calls, x.marker_hits, x.datasources,
               lambda t: x.spring_routes(whole, t), lambda t: x.repository_stores(t, stores, owner)]
    found = lambda: [sorted(map(str, f(lines).collect())) for f in finders]
    got = found()
    always = lambda *words, **_: F.lit(True)
    for name in ("_holds", "_holds_any_case"):
        monkeypatch.setattr(x, name, always)
    assert all(got) and got == found()


def test_only_crowded_names_are_sought_by_their_paths_starts(spark, monkeypatch):
    """Who asks for the same name from the same place looks it up once, and a name of one file not at all."""
    index = spark.createDataFrame([("g", "base", "a.csv", f"{d}/a.csv") for d in ("x", "y", "y/z")] + [("g", "base", "b.csv", "x/b.csv")],
                                  "graph_id string, idx string, key string, target string")
    asks = spark.createDataFrame([("g", i, "y/w", "y/w/m.py", 0, "base", k) for i, k in enumerate(["a.csv"] * 20 + ["b.csv"] * 20 + ["none"] * 20)],
                                 "graph_id string, hit_id long, folder string, ref string, rank int, idx string, key string")
    rows = []
    staged = rs.stage
    monkeypatch.setattr(rs, "stage", lambda df: rows.append(staged(df)) or rows[-1])
    near = rs.nearest(asks, index)
    assert {(r.hit_id, r.target) for r in near.collect()} == {(i, "y/a.csv") for i in range(20)} | {(i, "x/b.csv") for i in range(20, 40)}
    assert [t.rows for t in rows] == [2]
    plan = near._jdf.queryExecution().optimizedPlan().toString().splitlines()
    sought = [i for i, line in enumerate(plan) if "Generate explode(sequence(0, length(ref" in line]
    assert sought and all(any("Aggregate" in line for line in plan[i + 1 : i + 4]) for i in sought)


def test_a_folder_is_looked_up_once_for_all_of_its_files(spark, monkeypatch):
    files = spark.createDataFrame([("g", f"a/b/f{i}") for i in range(30)] + [("g", "go.mod"), ("g", "/r"), ("g", "a//c"), ("h", "a/b/f")], "graph_id string, path string")
    nodes = spark.createDataFrame([("g", "n", "Module", "1", "a/b"), ("g", "m", "Module", "2", "a"), ("g", "go", "Module", "3", "go.mod"), ("g", "a", "Module", "4", None),
                                   ("h", "mod-b", "Module", "1", None), ("h", "s", "Service", "2", None)], "graph_id string, node_id string, type string, pos string, folder string")
    listed = spark.createDataFrame([("g", "m", "a/b/f7")], "graph_id string, node_id string, path string")
    rows = []
    staged = rs.stage
    monkeypatch.setattr(rs, "stage", lambda df: rows.append(staged(df)) or rows[-1])
    got = {(r.graph_id, r.path): r.node_id for r in rs.owning_node(files, nodes, listed).collect()}
    assert got == {**{("g", f"a/b/f{i}"): "n" for i in range(30)}, ("g", "a/b/f7"): "m", ("g", "go.mod"): "go", ("g", "/r"): None, ("g", "a//c"): "m", ("h", "a/b/f"): "mod-b"}
    assert [t.rows for t in rows] == [4]


def test_paths_with_nothing_to_resolve_stay_as_they_are(spark):
    paths = ["", "a", "a/b.c", "/a", "a/", "a//b", "./a", "a/./b", "a/../b", "..", "../a", "a/..b", "a/.b", "a/...", "...", "a/.../b", None]
    want = ["", "a", "a/b.c", "a", "a", "a/b", "a", "a/b", "b", "..", "../a", "a/..b", "a/.b", "a/...", "...", "a/.../b", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(paths)], "i int, t string").select("i", p.normal_path(F.col("t")).alias("n"), p.folder_of(F.col("t")).alias("d"))
    rows = df.orderBy("i").collect()
    assert [r.n for r in rows] == want
    assert [r.d for r in rows][:6] == [None, None, "a", "", "a", "a/"]


def test_versions_and_changes_are_made_of_links_joined_once(spark, tmp_path, monkeypatch):
    """Items and orders meet once for both versions and the scenarios; the rows are those of the relations."""
    from catalog import worlds
    from depfleet.sources import tables as t

    rng = random.Random(9)
    orders = [(k, rng.choice([None, *range(60)])) for k in range(120)]
    items = [(rng.randrange(125), rng.randrange(200), rng.randrange(50), rng.choice("RAN")) for _ in range(900)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    sf, plans, staged = str(tmp_path), [], worlds.stage
    monkeypatch.setattr(worlds, "stage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or staged(df))
    got = [*worlds.versions(spark, sf), t.derive(spark, sf, "fleet_changes", worlds.common(spark, sf))]
    assert sum("Relation [l_orderkey" in plan for plan in plans) == 1 and len(plans) == 5
    want = [x for v in (1, 2) for x in t.fleet_version(spark, sf, v)] + [t.derive(spark, sf, "fleet_changes")]
    for a, b in zip(got, want):
        assert a.count() == b.count() > 0 and a.exceptAll(b).count() == 0

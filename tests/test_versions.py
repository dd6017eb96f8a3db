"""Two-version comparison and what-if scenarios."""

import random

import pytest
from conftest import EDGE_SCHEMA, NODE_SCHEMA, edge_rows, node_rows
from pyspark.sql import functions as F

from depfleet.operators import diff as d
from depfleet.operators import whatif as x
from depfleet.plans.analysis import analyse
from depfleet.plans.compare import compare, what_if

CASES = {
    "same": (["A>B"], ["A>B"]), "added": (["A>B"], ["A>B", "A>C"]), "removed": (["A>B", "A>C"], ["A>B"]),
    "redirect": (["A>B", "X>C"], ["A>C", "X>C"]), "retype": (["A>B USES"], ["A>B"]),
}


def ids_of(pairs):
    return sorted({v for p in pairs for v in p.split(" ")[0].split(">")})


@pytest.fixture(scope="module")
def compared(spark):
    n1, e1, n2, e2 = [], [], [], []
    for name, (a, b) in CASES.items():
        n1 += node_rows(name, ids_of(a))
        n2 += node_rows(name, ids_of(b))
        e1 += edge_rows(name, a)
        e2 += edge_rows(name, b)
    n1 += node_rows("stripe", ["api-gw", "payment-svc", "account-db"], {"account-db": "Database"})
    e1 += edge_rows("stripe", ["api-gw>payment-svc", "payment-svc>account-db"])
    n2 += node_rows("stripe", ["api-gw", "payment-svc", "account-db", "stripe-ext"],
                    {"account-db": "Database", "stripe-ext": "External System"})
    e2 += edge_rows("stripe", ["api-gw>payment-svc", "payment-svc>account-db", "payment-svc>stripe-ext"])
    n1 += node_rows("broken", ["auth", "orders", "db", "logger"])
    e1 += edge_rows("broken", ["auth>orders", "orders>db", "logger>orders"])
    n2 += node_rows("broken", ["auth", "orders", "logger"])
    e2 += edge_rows("broken", ["auth>orders", "logger>orders"])
    n1 += node_rows("safe", ["auth", "orders", "db", "logger"])
    e1 += edge_rows("safe", ["auth>orders", "orders>db", "logger>orders"])
    n2 += node_rows("safe", ["auth", "orders", "db"])
    e2 += edge_rows("safe", ["auth>orders", "orders>db"])
    mk = lambda r, s: spark.createDataFrame(r, s)
    return compare(mk(n1, NODE_SCHEMA), mk(e1, EDGE_SCHEMA), mk(n2, NODE_SCHEMA), mk(e2, EDGE_SCHEMA))


def changes(df, graph):
    kinds = [r["change_type"] for r in df.filter(F.col("graph_id") == graph).collect()]
    return {k: kinds.count(k) for k in set(kinds)}


def test_diff_cases(compared):
    n, e = compared["nodes"], compared["edges"]
    assert changes(n, "same") == {"unchanged": 2} and changes(e, "same") == {"unchanged": 1}
    assert changes(n, "added") == {"unchanged": 2, "added": 1} and changes(e, "added") == {"unchanged": 1, "added": 1}
    assert changes(n, "removed") == {"unchanged": 2, "removed": 1} and changes(e, "removed") == {"unchanged": 1, "removed": 1}
    assert changes(e, "redirect") == {"added": 1, "removed": 1, "unchanged": 1}
    assert changes(e, "retype") == {"added": 1, "removed": 1} and changes(n, "retype") == {"unchanged": 2}


def test_diff_mirrors(compared):
    back = d.edge_diff(compared["e2"], compared["e1"]).select("graph_id", "key", "change_type", "version_origin")
    turned = d.reversed_diff(compared["edges"]).select("graph_id", "key", "change_type", "version_origin")
    assert back.exceptAll(turned).count() == 0 and turned.exceptAll(back).count() == 0


def test_impact_and_ledger(compared):
    hit = {r["impacted_id"] for r in compared["paths"].filter("graph_id = 'stripe'").collect()}
    assert hit == {"api-gw"}
    assert compared["delta"].filter("graph_id = 'stripe'").first()["delta"] > 0
    book = {(r["graph_id"], r["factor"]): r["points"] for r in compared["ledger"].collect()}
    assert book[("broken", "callers_cut_off")] == 15.0
    assert ("safe", "callers_cut_off") not in book
    assert book[("same", "unchanged")] == 0.0
    assert book[("stripe", "externals_added")] == 6.0


CHANGE_SCHEMA = ("graph_id string, scenario_id string, seq int, action string, node_id string, name string, type string, "
                 "technology string, edge_id string, src string, dst string, edge_type string, protocol string")


def change(scenario, seq, action, **given):
    cols = ("node_id", "name", "type", "technology", "edge_id", "src", "dst", "edge_type", "protocol")
    return ("W", scenario, seq, action, *[given.get(c) for c in cols])


@pytest.fixture(scope="module")
def simulated(spark):
    ids = ["api-gw", "order-svc", "payment-svc", "payment-db"]
    n = spark.createDataFrame(node_rows("W", ids, {"payment-db": "Database"}), NODE_SCHEMA)
    e = spark.createDataFrame(edge_rows("W", ["api-gw>order-svc", "order-svc>payment-svc", "payment-svc>payment-db USES"]), EDGE_SCHEMA)
    table = spark.createDataFrame([
        change("add", 0, "add_component", node_id="fraud-svc", name="Fraud", type="Service", technology="T"),
        change("add", 1, "add_dependency", edge_id="rX", src="payment-svc", dst="fraud-svc", edge_type="CALLS"),
        change("cut", 0, "remove_dependency", edge_id="r1"),
        change("cut2", 0, "remove_dependency", src="order-svc", dst="payment-svc"),
        change("drop", 0, "remove_component", node_id="payment-svc"),
        change("back", 0, "remove_component", node_id="payment-svc"),
        change("back", 1, "add_component", node_id="payment-svc", name="New", type="Service", technology="T"),
        change("back", 2, "add_dependency", edge_id="rY", src="order-svc", dst="payment-svc", edge_type="CALLS"),
        change("none", 0, "remove_component", node_id="unknown"),
    ], CHANGE_SCHEMA)
    return what_if(n, e, table)


def of(df, scenario):
    return df.filter(F.col("graph_id") == f"W#{scenario}").collect()


def test_what_if_shapes(simulated):
    sizes = {s: (len(of(simulated["nodes"], s)), len(of(simulated["edges"], s))) for s in ("add", "cut", "cut2", "drop", "back", "none")}
    assert sizes == {"add": (5, 4), "cut": (4, 2), "cut2": (4, 2), "drop": (3, 1), "back": (4, 2), "none": (4, 3)}
    assert {r["edge_id"] for r in of(simulated["edges"], "back")} == {"r0", "rY"}
    assert {r["node_id"] for r in of(simulated["touched"], "add")} == {"fraud-svc", "payment-svc"}
    assert {r["source"] for r in of(simulated["paths"], "add")} == {"order-svc", "api-gw"}


def replay(edges, steps):
    """Edge ids left after changes one by one; edges are (id, src, dst) in order."""
    live = list(edges)
    for s in steps:
        if s["action"] == "add_dependency":
            live.append((s["edge_id"], s["src"], s["dst"]))
        elif s["action"] == "remove_component":
            live = [e for e in live if s["node_id"] not in e[1:]]
        else:
            fit = [e for e in live if (e[0] == s["edge_id"] if s["edge_id"] else e[1:] == (s["src"], s["dst"]))]
            live = [e for e in live if not fit or e[0] != fit[0][0]]
    return sorted(e[0] for e in live)


def test_removals_one_by_one(spark):
    """Several removals of one pair, by pair and by id, between additions and lost ends, against a replay."""
    pairs = ["A>B", "A>B USES", "A>B", "B>C", "A>B"]
    nodes = spark.createDataFrame(node_rows("W", "ABC"), NODE_SCHEMA)
    edges = spark.createDataFrame(edge_rows("W", pairs), EDGE_SCHEMA)
    base = [(f"r{i}", *p.split(" ")[0].split(">")) for i, p in enumerate(pairs)]
    fields = [f.split(" ")[0] for f in CHANGE_SCHEMA.split(", ")]
    every, want = [], {}
    for seed in range(25):
        rng, steps = random.Random(seed), []
        for k in range(rng.randint(1, 7)):
            step = rng.choice([
                {"action": "remove_dependency", "src": "A", "dst": "B"}, {"action": "remove_dependency", "src": "A", "dst": "B"},
                {"action": "remove_dependency", "edge_id": f"r{rng.randrange(5)}"}, {"action": "remove_dependency", "src": "B", "dst": "C"},
                {"action": "add_dependency", "edge_id": f"x{k}", "src": "A", "dst": "B", "edge_type": "CALLS"},
                {"action": "remove_component", "node_id": "C"}])
            steps.append(dict.fromkeys(fields) | {"graph_id": "W", "scenario_id": f"s{seed}", "seq": k} | step)
        every += [tuple(s[f] for f in fields) for s in steps]
        want[f"W#s{seed}"] = replay(base, steps)
    got = {g: [] for g in want}
    for r in x.apply_changes(nodes, edges, spark.createDataFrame(every, CHANGE_SCHEMA))["edges"].collect():
        got[r["graph_id"]].append(r["edge_id"])
    assert {g: sorted(ids) for g, ids in got.items()} == want


def random_scenarios(seed):
    """Random graphs with parallel edges, self edges and undeclared ends, and scenarios of a few changes each."""
    rng = random.Random(seed)
    nodes, edges, steps = [], [], []
    fields = [f.split(" ")[0] for f in CHANGE_SCHEMA.split(", ")]
    for k in range(6):
        graph, ids = f"R{k}", [f"n{i}" for i in range(rng.randint(3, 8))]
        kinds = {v: rng.choice(["Service", "Database", "External System", "Service"]) for v in ids}
        nodes += node_rows(graph, ids, kinds)
        ends = [*ids, "ghost"]
        pairs = [f"{rng.choice(ends)}>{rng.choice(ends)}" for _ in range(rng.randint(2, 14))]
        edges += edge_rows(graph, pairs + pairs[:2])
        for j in range(7):
            for n in range(rng.randint(1, 4)):
                new = f"x{n}"
                step = rng.choice([
                    {"action": "add_component", "node_id": rng.choice([new, rng.choice(ids)]), "name": "N", "type": rng.choice(["Service", "External System"]), "technology": "T"},
                    {"action": "remove_component", "node_id": rng.choice([*ends, new])},
                    {"action": "add_dependency", "edge_id": f"e{n}", "src": rng.choice([*ends, "x0"]), "dst": rng.choice([*ends, "x0"]), "edge_type": "CALLS"},
                    {"action": "remove_dependency", "edge_id": f"r{rng.randrange(len(pairs))}"},
                    {"action": "remove_dependency", **dict(zip(("src", "dst"), rng.choice(pairs).split(">")))}])
                row = dict.fromkeys(fields) | {"graph_id": graph, "scenario_id": f"s{j}", "seq": n} | step
                steps.append(tuple(row[f] for f in fields))
    return nodes, edges, steps


def test_rescoring_equals_whole_analyses(spark):
    """Scores, verdicts, cycles and paths from changes alone against analyses of every hypothetical graph."""
    nodes, edges, steps = random_scenarios(3)
    got = what_if(spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame(edges, EDGE_SCHEMA), spark.createDataFrame(steps, CHANGE_SCHEMA))
    both = lambda part: part.unionByName(got["graphs"].join(got[f"base_{part_name[id(part)]}"].withColumnRenamed("graph_id", "base_id"), "base_id")
                                         .withColumn("graph_id", F.concat("graph_id", F.lit("@"))).select(*part.columns))
    part_name = {id(got["nodes"]): "nodes", id(got["edges"]): "edges"}
    whole = analyse(both(got["nodes"]), both(got["edges"]).withColumn("description", F.lit(None).cast("string")), list_cycles=True)
    table = lambda df, *cols: {tuple(r[c] for c in cols) for r in df.collect()}
    system = {g: v for g, v in table(whole["system"], "graph_id", "system_risk")}
    mine = {g: v for g, v in table(got["after"]["system"], "graph_id", "system_risk")}
    assert mine == {g: v for g, v in system.items() if not g.endswith("@")} and len(mine) > 30
    assert {(r["graph_id"], r["current_score"], r["modelled_score"]) for r in got["score"].collect()} == {
        (g, system[g + "@"], system.get(g, 0.0)) for g in table(got["graphs"], "graph_id") for g in g if g + "@" in system}
    hit = table(whole["spof"].filter("is_spof"), "graph_id", "node_id")
    now, was = {x for x in hit if not x[0].endswith("@")}, {(g[:-1], v) for g, v in hit if g.endswith("@")}
    assert table(got["after"]["spof"].filter("is_spof"), "graph_id", "node_id") == now - was
    assert table(got["after"]["spof"].filter("was"), "graph_id", "node_id") == was - now
    rings = {}
    for g, path in [(r["graph_id"], r["path"]) for r in whole["cycles"].collect()]:
        rings.setdefault(g, set()).add(tuple(path))
    born = {r["graph_id"]: r["n"] for r in got["after"]["born"].groupBy("graph_id").agg(F.count("*").alias("n")).collect()}
    dead = {r["graph_id"]: r["n"] for r in got["after"]["dead"].groupBy("graph_id").agg(F.count("*").alias("n")).collect()}
    for (g,) in table(got["graphs"], "graph_id"):
        new, old = rings.get(g, set()), rings.get(g + "@", set())
        assert (born.get(g, 0), dead.get(g, 0)) == (len(new - old), len(old - new)), g
    touched = table(got["touched"], "graph_id", "node_id")
    want = {}
    for r in whole["walks"].select("graph_id", "src", "dst", "path").collect():
        g, now = r["graph_id"].rstrip("@"), not r["graph_id"].endswith("@")
        if (g, r["dst"]) in touched and (g, r["src"]) not in touched:
            key = (g, r["src"], r["dst"], tuple(r["path"]))
            want[key] = "hypothetical" if now else want.get(key, "current")
    assert {(r["graph_id"], r["source"], r["target"], tuple(r["path"])): r["topology"] for r in got["paths"].collect()} == want


def test_many_cuts_of_one_pair_need_no_more_jobs(spark):
    """A thousand removals of one pair in one scenario, some of them when nothing is left."""
    edges = spark.createDataFrame(edge_rows("W", ["A>B"] * 700), EDGE_SCHEMA)
    table = spark.createDataFrame([change("s", k, "remove_dependency", src="A", dst="B") for k in range(300)] +
                                  [change("s", 300, "add_dependency", edge_id="late", src="A", dst="B", edge_type="CALLS")] +
                                  [change("s", k, "remove_dependency", src="A", dst="B") for k in range(301, 1001)] +
                                  [change("t", 0, "remove_dependency", src="A", dst="B")], CHANGE_SCHEMA)
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    got = x.apply_changes(spark.createDataFrame(node_rows("W", "AB"), NODE_SCHEMA), edges, table)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - before < 120
    assert of(got["edges"], "s") == [] and len(of(got["edges"], "t")) == 699


def test_what_if_ledger(simulated):
    factors = {s: {r["factor"] for r in of(simulated["ledger"], s)} for s in ("add", "cut", "drop", "none")}
    assert "links_more" in factors["add"]
    assert "links_fewer" in factors["cut"]
    assert "callers_cut_off" in factors["drop"]
    assert factors["none"] == {x.NEUTRAL}
    score = of(simulated["score"], "drop")[0]
    assert score["delta"] == score["ledger_sum"] and 0 <= score["new_score"] <= 100


def test_delta_read_backwards(compared):
    there = {r["graph_id"]: r for r in compared["delta"].collect()}
    for r in d.reversed_delta(compared["delta"]).collect():
        one = there[r["graph_id"]]
        assert (r["original_score"], r["changed_score"], r["delta"]) == (one["changed_score"], one["original_score"], -one["delta"])
        assert {one["shift"], r["shift"]} in ({"Higher structural risk", "Lower structural risk"}, {"No structural risk change"})

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    session = (SparkSession.builder.master("local[8]").appName("depfleet-tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g")
               .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="depfleet-tests-")).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def usual_settings(request):
    """Settings that registered queries lower for their session go back after each test, as the tests share one session."""
    if "spark" not in request.fixturenames:
        yield
        return
    from depfleet.staging import BROADCAST
    session = request.getfixturevalue("spark")
    before = {name: session.conf.get(name, None) for name in (*BROADCAST, "spark.sql.execution.arrow.maxBytesPerBatch")}
    yield
    for name, value in before.items():
        session.conf.unset(name) if value is None else session.conf.set(name, value)


NODE_SCHEMA = "graph_id string, node_id string, pos int, name string, type string, technology string, description string"
EDGE_SCHEMA = ("graph_id string, edge_id string, pos int, src string, dst string, type string, protocol string, "
               "description string, ev_file string, ev_confidence string")


def node_rows(graph, ids, types=None):
    types = types or {}
    return [(graph, n, i, n, types.get(n, "Service"), "T", n) for i, n in enumerate(ids)]


def edge_rows(graph, pairs):
    """Pairs "a>b" or "a>b TYPE"."""
    out = []
    for i, pair in enumerate(pairs):
        ends, _, kind = pair.partition(" ")
        src, dst = ends.split(">")
        out.append((graph, f"r{i}", i, src, dst, kind or "CALLS", None, None, None, None))
    return out


DEMO_NODES = ("web-client mobile-app api-gateway auth-service user-service order-service payment-service inventory-service "
              "notification-service analytics-worker postgres-primary redis-cluster stripe-gateway").split()
DEMO_TYPES = {"analytics-worker": "Module", "postgres-primary": "Database", "redis-cluster": "Database",
              "stripe-gateway": "External System"}
DEMO_EDGES = [
    "web-client>api-gateway", "mobile-app>api-gateway", "api-gateway>auth-service", "api-gateway>user-service",
    "api-gateway>order-service", "auth-service>redis-cluster USES", "auth-service>postgres-primary USES",
    "user-service>postgres-primary USES", "user-service>redis-cluster USES", "order-service>payment-service",
    "order-service>inventory-service", "order-service>notification-service", "order-service>postgres-primary USES",
    "payment-service>stripe-gateway", "payment-service>postgres-primary USES", "inventory-service>postgres-primary USES",
    "notification-service>analytics-worker", "analytics-worker>notification-service", "analytics-worker>postgres-primary USES",
    "notification-service>redis-cluster USES"]

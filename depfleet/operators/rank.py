"""PageRank of many graphs: small graphs whole in a task, any other in rounds over the cluster.

A graph of at most ``SMALL`` rows (nodes and links) is iterated where its rows lie, many such graphs of a partition at once
in bounded chunks; that takes one shuffle instead of one for every round.  Larger graphs go round by round, keyed by
(graph, node), so no task holds one.  Both follow the same iteration and stop by the same rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage, union_all
from .graph import G

SMALL = 50_000    # rows of a graph that a task may hold
CHUNK = 400_000   # rows of small graphs iterated together


def pagerank(vertex: DataFrame, link: DataFrame, alpha: float = 0.85, tol: float = 1e-6,
             max_rounds: int | None = None, per_node: bool = True, small: int = SMALL) -> DataFrame:
    """Power iteration with uniform dangling mass; a graph stops when its L1 change is
    below n * tol (``tol`` itself if ``per_node`` is off).  A column ``n`` of ``link`` counts parallel edges.

    A round shrinks the change by ``alpha``, so every graph settles; with ``max_rounds`` those that have not are told
    by ``converged``.
    """
    many = F.col("n") if "n" in link.columns else F.lit(1)
    hop = stage(link.select(G, "src", "dst", many.cast("long").alias("many"))).df
    out = hop.groupBy(G, F.col("src").alias("node_id")).agg(F.sum("many").alias("out_degree"))
    n = vertex.groupBy(G).agg(F.count(F.lit(1)).alias("n"))
    size = n.join(hop.groupBy(G).agg(F.count(F.lit(1)).alias("e")), G, "left").select(G, (F.col("n") + F.coalesce("e", F.lit(0))).alias("rows"))
    start = vertex.select(G, "node_id").join(n, G).join(out, [G, "node_id"], "left").na.fill(0, ["out_degree"])
    give = lambda shares: shares.join(hop, [G, "src"]).select(G, "dst", (F.col("share") * F.col("many")).alias("share"))
    return ranks(start, size, lambda graphs: hop.join(graphs, G, "left_semi"), give, alpha, tol, max_rounds, per_node, small)


def ranks(start: DataFrame, size: DataFrame, links_of: Callable[[DataFrame], DataFrame], give: Callable[[DataFrame], DataFrame],
          alpha: float = 0.85, tol: float = 1e-6, max_rounds: int | None = None, per_node: bool = True, small: int = SMALL) -> DataFrame:
    """Ranks over ``start`` (node_id, n, out_degree and columns that ``give`` needs) of graphs of ``size`` (rows).

    ``links_of`` gives the links (src, dst, many) of the given graphs; ``give`` sends each node's share (src, share) along its
    links: (dst, share).
    """
    sized = stage(size.select(G, (F.col("rows") > small).alias("large")), large=F.count_if("large"))
    few = sized.df.filter("NOT large").select(G)
    done = _ranks_in_place(start.join(few, G, "left_semi"), links_of(few), alpha, tol, max_rounds, per_node)
    if not sized.facts["large"]:
        return done
    rest = start.join(sized.df.filter("large"), G, "left_semi")
    return done.unionByName(_rank_rounds(rest, give, alpha, tol, max_rounds, per_node))


def iterate(graph, n, out_degree, src, dst, many, alpha: float, tol: float, max_rounds: int | None, per_node: bool):
    """Ranks of the nodes of several graphs at once, and whether each graph settled; all as arrays over nodes, links and graphs."""
    import numpy as np

    graphs = len(n)
    size = n[graph].astype(np.float64)
    rank, settled = 1.0 / size, np.zeros(graphs, bool)
    loose, weight = out_degree == 0, many / np.maximum(out_degree[src], 1)
    limit = n * tol if per_node else np.full(graphs, tol)
    rounds = 0
    while not settled.all() and (max_rounds is None or rounds < max_rounds):
        got = np.bincount(dst, rank[src] * weight, len(graph))
        spare = np.bincount(graph[loose], rank[loose], graphs)[graph]
        new = np.where(settled[graph], rank, (1 - alpha) / size + alpha * (got + spare / size))
        settled = settled | (np.bincount(graph, np.abs(new - rank), graphs) < limit)
        rank = new
        rounds += 1
    return rank, settled


def _ranks_in_place(start: DataFrame, link: DataFrame, alpha: float, tol: float, max_rounds: int | None, per_node: bool) -> DataFrame:
    rows = (start.select(G, F.col("node_id").alias("a"), F.lit(None).cast("string").alias("b"), F.col("n").cast("long").alias("n"), F.col("out_degree").cast("long").alias("k"))
            .unionByName(link.select(G, F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0).cast("long").alias("n"), F.col("many").cast("long").alias("k"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pandas as pd

        def ranked(part: pd.DataFrame) -> pa.RecordBatch:
            node = part["b"].isna().to_numpy()
            key = part[G] + "\u0001" + part["a"]
            names = pd.Index(key[node])
            codes, graphs = pd.factorize(part[G][node])
            n = np.zeros(len(graphs), np.int64)
            n[codes] = part["n"][node]
            src, dst = names.get_indexer(key[~node]), names.get_indexer((part[G] + "\u0001" + part["b"])[~node])
            inside = (src >= 0) & (dst >= 0)
            many = part["k"][~node].to_numpy()[inside]
            rank, settled = iterate(codes, n, part["k"][node].to_numpy(), src[inside], dst[inside], many, alpha, tol, max_rounds, per_node)
            return pa.RecordBatch.from_arrays([pa.array(part[G][node]), pa.array(part["a"][node]), pa.array(rank), pa.array(settled[codes])],
                                              names=[G, "node_id", "pagerank", "converged"])

        held, size = [], 0
        for batch in batches:
            part = batch.to_pandas()
            if size + len(part) > CHUNK and held:
                whole = pd.concat(held)
                last = whole[G] == whole[G].iloc[-1]  # this graph may go on
                if not last.all():
                    yield ranked(whole[~last])
                held, size = [whole[last]], int(last.sum())
            held.append(part)
            size += len(part)
        if held:
            yield ranked(pd.concat(held))

    return rows.repartition(G).sortWithinPartitions(G).mapInArrow(run, f"{G} string, node_id string, pagerank double, converged boolean")


def _rank_rounds(start: DataFrame, give: Callable[[DataFrame], DataFrame], alpha: float, tol: float, max_rounds: int | None, per_node: bool) -> DataFrame:
    """One shuffle a round; settled graphs are left out of later rounds."""
    carried = [c for c in start.columns if c not in (G, "node_id", "n", "out_degree")]
    state = stage(start.withColumn("rank", 1.0 / F.col("n")).withColumn("change", F.col("rank") + F.col("n"))).df
    finished: list[DataFrame] = []
    rounds = 0
    while True:
        # a round first tells which graphs the last one settled, then moves the others on
        limit = F.col("n") * tol if per_node else F.lit(tol)
        total = state.groupBy(G).agg(F.sum("change").alias("total"), F.sum(F.when(F.col("out_degree") == 0, F.col("rank")).otherwise(0.0)).alias("loose"))
        told = state.join(total, G).withColumn("settled", F.col("total") < limit)
        if max_rounds is not None and rounds >= max_rounds:
            finished.append(told.withColumn("converged", F.col("settled")))
            break
        live = told.filter("NOT settled AND out_degree > 0")
        given = give(live.select(G, *carried, F.col("node_id").alias("src"), (F.col("rank") / F.col("out_degree")).alias("share")))
        given = given.groupBy(G, F.col("dst").alias("node_id")).agg(F.sum("share").alias("got"))
        moved = (told.join(given, [G, "node_id"], "left").na.fill(0.0, ["got"])
                 .withColumn("new", F.when(F.col("settled"), F.col("rank")).otherwise(
                     (1 - alpha) / F.col("n") + alpha * (F.col("got") + F.col("loose") / F.col("n")))))
        after = stage(moved.select(G, "node_id", *carried, "n", "out_degree", F.col("new").alias("rank"),
                                   F.abs(F.col("new") - F.col("rank")).alias("change"), "settled"),
                      live=F.count_if(~F.col("settled")))
        finished.append(after.df.filter("settled").withColumn("converged", F.lit(True)))
        state = after.df.filter("NOT settled").drop("settled")
        rounds += 1
        if not after.facts["live"]:
            break
    return union_all([f.select(G, "node_id", F.col("rank").alias("pagerank"), "converged") for f in finished])

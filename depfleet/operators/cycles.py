"""Elementary cycles by a search in which only paths that can close grow.

Paths start at each start node's links and grow by one link a round.  Each start first gets its way back: for every node
that can return to it under the search's rule, a shortest way.  A path may step to a node only if that node has a way
back.  Where the way avoids the path, the step is certified: it lies on at least one cycle, so certified paths of one
length are no more than the cycles still to come.  The other steps may be dead ends, as all ways back may cross the
path; they go on unchecked only while they are fewer than the certified ones (plus a constant), and else are
checked by a search that avoids the path.  Rows written are thus bounded by the number of cycles times their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import Staged, stage, union_all
from .graph import G

START = [G, "start", "floor"]
UNCHECKED = 10_000  # steps that may go on without a certificate whatever the number of certified ones
FREE = 2**62        # rank of a link that the search may use at any time


def inner_links(link: DataFrame, labels: DataFrame) -> DataFrame:
    """(src, dst, component): links between different nodes of one strong component."""
    a = labels.select(G, F.col("node_id").alias("src"), "component")
    b = labels.select(G, F.col("node_id").alias("dst"), F.col("component").alias("cd"))
    return (link.filter("src <> dst").select(G, "src", "dst").join(a, [G, "src"]).join(b, [G, "dst"])
            .filter("component = cd").select(G, "src", "dst", "component"))


def _ways_back(hop: DataFrame, firsts: DataFrame) -> DataFrame:
    """(start, floor, node, way): a shortest way from each node back to the start, without the start itself."""
    starts = firsts.select(*START).distinct()
    into = hop.select(G, F.col("src").alias("prev"), F.col("dst").alias("node"), "rank")
    found = [stage(starts.join(into.withColumnRenamed("node", "start"), [G, "start"]).filter("rank >= floor")
                   .select(*START, F.col("prev").alias("node"), F.array("prev").alias("way")))]
    while found[-1].rows:
        step = (found[-1].df.join(into, [G, "node"]).filter("rank > floor AND prev <> start")
                .groupBy(*START, F.col("prev").alias("node")).agg(F.min(F.concat(F.array("prev"), "way")).alias("way")))
        found.append(stage(step.join(union_all([f.df.select(*START, "node") for f in found]), [*START, "node"], "left_anti")))
    return union_all([f.df for f in found])


def _checked(doubtful: DataFrame, hop: DataFrame) -> DataFrame:
    """Of the given paths those that can still close, with a way that avoids the path."""
    asked = stage(doubtful.withColumn("ask", F.monotonically_increasing_id())).df
    onward = hop.select(G, F.col("src").alias("node"), F.col("dst").alias("next"), "rank")
    home = hop.select(G, F.col("src").alias("node"), F.col("dst").alias("start"), F.col("rank").alias("last_rank"))
    seen = [stage(asked.select("ask", *START, "path", F.col("last").alias("node"), F.array("last").alias("trail")))]
    closed = []
    while seen[-1].rows:
        at = seen[-1].df
        back = stage(at.join(home, [G, "node", "start"]).filter("last_rank >= floor").groupBy("ask").agg(F.min("trail").alias("trail")))
        closed.append(back.df)
        step = (at.join(back.df, "ask", "left_anti").join(onward, [G, "node"])
                .filter((F.col("rank") > F.col("floor")) & (F.col("next") != F.col("start")) & ~F.array_contains("path", F.col("next")))
                .groupBy("ask", *START, "path", F.col("next").alias("node")).agg(F.min(F.concat("trail", F.array("next"))).alias("trail")))
        seen.append(stage(step.join(union_all([s.df.select("ask", "node") for s in seen]), ["ask", "node"], "left_anti")))
    return asked.join(union_all(closed), "ask").withColumn("way", F.col("trail")).drop("ask", "trail")


def _closed_paths(hop: DataFrame, firsts: DataFrame, unchecked: int, keep: int | None = None) -> list[Staged]:
    """Levels of paths; rows with ``closes`` are cycles.

    ``hop``: src, dst, rank.  ``firsts``: start, last, floor, path.  A path with ``floor`` may use links of a higher rank, and to
    return to its start also one of the same.
    """
    back = stage(_ways_back(hop, firsts)).df.select(*START, F.col("node").alias("last"), F.col("way").alias("shortest"))
    closes = (F.size("shortest") == 1).alias("closes")
    levels = [stage(firsts.join(back, [*START, "last"]).select(*START, "last", "path", F.col("shortest").alias("way"), closes))]
    onward = hop.select(G, F.col("src").alias("last"), F.col("dst").alias("next"), "rank")
    while levels[-1].rows:
        at = levels[-1].df
        if keep is not None:
            full = union_all([x.df.filter("closes") for x in levels]).groupBy(G).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > keep)
            at = at.join(full.select(G), G, "left_anti")
        step = (at.join(onward, [G, "last"])
                .filter((F.col("rank") > F.col("floor")) & (F.col("next") != F.col("start")) & ~F.array_contains("path", F.col("next")))
                .drop("last", "closes").withColumnRenamed("next", "last").join(back, [*START, "last"]))
        sure = F.when(~F.arrays_overlap("shortest", "path"), F.col("shortest")).when(
            F.get("way", F.lit(1)) == F.col("last"), F.slice("way", F.lit(2), F.size("way")))
        level = stage(step.select(*START, "last", F.concat("path", F.array("last")).alias("path"), sure.alias("way"), closes),
                      sure=F.count("way"))
        if level.rows - level.facts["sure"] > level.facts["sure"] + unchecked:
            right = _checked(level.df.filter("way IS NULL"), hop)
            level = stage(level.df.filter("way IS NOT NULL").unionByName(right))
        levels.append(level)
    return levels


def simple_cycles(link: DataFrame, labels: DataFrame, keep: int | None = None, unchecked: int = UNCHECKED) -> DataFrame:
    """Elementary cycles from their smallest node, numbered by (length, path).

    All of them, or the first ``keep`` with a flag ``truncated`` that tells of more: with ``keep`` a graph leaves the search
    once a finished length has given more than that, as longer ones cannot rank before.
    """
    hop = stage(inner_links(link, labels).select(G, "src", "dst", F.col("dst").alias("rank"))).df
    firsts = hop.filter("src < dst").select(G, F.col("src").alias("start"), F.col("dst").alias("last"), F.col("src").alias("floor"),
                                            F.array("src", "dst").alias("path"))
    levels = _closed_paths(hop, firsts, unchecked, keep)
    found = union_all([link.filter("src = dst").select(G, F.array("src").alias("path"))]
                      + [x.df.filter("closes").select(G, "path") for x in levels])
    order = Window.partitionBy(G).orderBy(F.size("path"), "path")
    ranked = found.withColumn("cycle_no", F.row_number().over(order))
    if keep is None:
        return ranked
    more = found.groupBy(G).agg((F.count(F.lit(1)) > keep).alias("truncated"))
    return ranked.filter(F.col("cycle_no") <= keep).join(more, G).orderBy(G, "cycle_no")


def cycles_through(link: DataFrame, labels: DataFrame, marked: DataFrame, unchecked: int = UNCHECKED) -> DataFrame:
    """The elementary cycles that use at least one of the ``marked`` links, each from the first of them that it uses."""
    inner = stage(inner_links(link, labels)).df
    order = Window.partitionBy(G).orderBy("src", "dst")
    mine = stage(inner.join(marked.select(G, "src", "dst").distinct(), [G, "src", "dst"], "left_semi")
                 .withColumn("floor", F.row_number().over(order).cast("long"))).df
    hop = stage(inner.join(mine.select(G, "component").distinct(), [G, "component"], "left_semi")
                .join(mine.select(G, "src", "dst", "floor"), [G, "src", "dst"], "left")
                .select(G, "src", "dst", F.coalesce("floor", F.lit(FREE)).alias("rank"))).df
    firsts = mine.select(G, F.col("src").alias("start"), F.col("dst").alias("last"), "floor", F.array("src", "dst").alias("path"))
    loops = (link.filter("src = dst").select(G, "src", "dst").distinct().join(marked.select(G, "src", "dst").distinct(), [G, "src", "dst"], "left_semi"))
    levels = _closed_paths(hop, firsts, unchecked)
    return union_all([loops.select(G, F.array("src").alias("path"))] + [x.df.filter("closes").select(G, "path") for x in levels])


def few_cycles(link: DataFrame, labels: DataFrame) -> DataFrame:
    """(cycles_least): how many cycles each graph has, counted up to two, without listing any.

    A strong component with as many links as nodes is one cycle; with more links it has at least two.
    """
    by_part = inner_links(link, labels).groupBy(G, "component").agg(F.count(F.lit(1)).alias("e"), F.count_distinct("src").alias("v"))
    some = by_part.select(G, F.when(F.col("e") > F.col("v"), 2).otherwise(1).alias("n"))
    loops = link.filter("src = dst").select(G, "src").distinct().select(G, F.lit(1).alias("n"))
    return some.unionByName(loops).groupBy(G).agg(F.least(F.sum("n"), F.lit(2)).cast("int").alias("cycles_least"))

"""How many nodes reach a node and how many it reaches, without listing the pairs.

The components of a graph form an acyclic graph.  Components that can be reached from are numbered, 64 to a word, and
every component gets the words of those that reach it: sets travel along edges as bits and only bits that are new go on.  A
word stands for 64 pairs at best, and a component of many nodes counts with its size, so a strongly connected graph costs
one row.  Sources go in passes of bounded number: what a pass holds is at most a row for each component and word of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage, together, union_all
from .graph import G, condense, strong_labels

PASS = 1 << 22  # source components of one pass


def _numbered(source: DataFrame) -> DataFrame:
    """(node_id, word, bits, weight) of source components: 64 of one node each share a word, larger ones have their own."""
    place = F.monotonically_increasing_id()
    ordered = source.withColumn("single", F.col("weight") == 1).repartitionByRange(G, "single", "node_id").sortWithinPartitions(G, "single", "node_id")
    at = stage(ordered.withColumn("at", place)).df
    return at.select(G, "node_id", F.when(F.col("single"), F.shiftright("at", 6)).otherwise(-1 - F.col("at")).alias("word"),
                     F.when(F.col("single"), F.expr("shiftleft(1L, cast(at % 64 as int))")).otherwise(F.lit(1).cast("long")).alias("bits"), "weight")


def _reached_by(dag: DataFrame, size: DataFrame, sources_of_pass: int) -> DataFrame:
    """(node_id, total): nodes in the components that reach each component of an acyclic graph."""
    word = [G, "node_id", "word", "weight"]
    along = dag.select(G, F.col("src").alias("node_id"), F.col("dst").alias("next"))
    source = _numbered(size.join(dag.select(G, F.col("src").alias("node_id")).distinct(), [G, "node_id"], "left_semi"))
    numbered = stage(source)
    passes = max(1, -(-numbered.rows // sources_of_pass))
    totals = []
    for k in range(passes):
        mine = numbered.df if passes == 1 else numbered.df.filter(F.pmod("word", F.lit(passes)) == k)
        send = lambda rows: (rows.join(along, [G, "node_id"]).groupBy(G, F.col("next").alias("node_id"), "word", "weight")
                             .agg(F.bit_or("bits").alias("bits")))
        levels = [stage(send(mine))]
        while levels[-1].rows:
            known = union_all([x.df for x in levels]).groupBy(*word).agg(F.bit_or("bits").alias("had"))
            new = send(levels[-1].df).join(known, word, "left").withColumn(
                "bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long")))))
            levels.append(stage(new.filter("bits <> 0").select(*word, "bits")))
        count = union_all([x.df for x in levels]).groupBy(G, "node_id").agg(F.sum(F.bit_count("bits") * F.col("weight")).alias("total"))
        totals.append(stage(count).df)
        for x in levels:
            x.drop()
    return union_all(totals).groupBy(G, "node_id").agg(F.sum("total").alias("total"))


def reach_sizes(vertex: DataFrame, link: DataFrame, labels: DataFrame | None = None, sources_of_pass: int = PASS) -> DataFrame:
    """Blast radius (who reaches me) and footprint (whom I reach) of every vertex."""
    labels = stage(labels if labels is not None else strong_labels(vertex, link)).df
    dag = stage(condense(link, labels)).df
    turned = dag.select(G, F.col("dst").alias("src"), F.col("src").alias("dst"))
    size = stage(labels.groupBy(G, F.col("component").alias("node_id")).agg(F.count(F.lit(1)).alias("weight"))).df
    blast, foot = together(lambda: _reached_by(dag, size, sources_of_pass), lambda: _reached_by(turned, size, sources_of_pass))
    per_part = (size.join(blast.withColumnRenamed("total", "b"), [G, "node_id"], "left").join(foot.withColumnRenamed("total", "f"), [G, "node_id"], "left")
                .na.fill(0, ["b", "f"])
                .select(G, F.col("node_id").alias("component"), (F.col("b") + F.col("weight") - 1).alias("blast_radius"),
                        (F.col("f") + F.col("weight") - 1).alias("footprint")))
    return labels.join(per_part, [G, "component"]).select(G, "node_id", "blast_radius", "footprint")

"""Joins of staged tables: what they send through the driver."""

from pyspark.sql import functions as F

from catalog.base import QUERIES, query
from depfleet.staging import BROADCAST, measured_joins, stage


def test_registered_queries_do_not_broadcast_what_only_its_file_makes_small(spark):
    """A staged table of some KB in its file and 20 MB in memory meets another in a shuffle; a small one is still sent."""
    usual = {name: spark.conf.get(name, None) for name in BROADCAST}
    long = spark.range(50_000).select(F.col("id").cast("string").alias("k"), F.lit("src/app/" * 50).alias("path"))
    few = spark.createDataFrame([("1", 1)], "k string, n int")

    @query("of this test")
    def both(spark, sf):
        table = stage(long).df
        return table.join(stage(long.withColumnRenamed("path", "other")).df, "k").join(few, "k")
    try:
        df = QUERIES["of this test"](spark, "")
        assert df.count() == 1
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        measured_joins(spark)
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    finally:
        del QUERIES["of this test"]
        for name, value in usual.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_texts_reach_workers_in_batches_of_bounded_size(spark):
    """A stage and a registered text query hand long texts over a few megabytes at once; a lower limit of the session stays."""
    import pyarrow as pa

    from depfleet.llm.queries import QUERIES as TEXT_QUERIES
    from depfleet.llm.queries import query as text_query
    from depfleet.llm.stages import STAGES
    from depfleet.staging import BATCH_BYTES

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    usual = spark.conf.get(name)
    texts = spark.range(0, 60, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a b "), 100_000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    def largest():
        return max(r.n for r in texts.mapInArrow(sizes, "n long").collect())

    @text_query("of this test")
    def both(spark, sf):
        return texts
    try:
        assert largest() > 20 << 20
        STAGES[0][1](spark, texts, "")
        assert largest() <= BATCH_BYTES + 500_000
        spark.conf.set(name, usual)
        TEXT_QUERIES["of this test"](spark, "")
        assert largest() <= BATCH_BYTES + 500_000
        spark.conf.set(name, "100000")
        STAGES[0][1](spark, texts, "")
        assert spark.conf.get(name) == "100000b" or int(spark.conf.get(name)) == 100_000
    finally:
        del TEXT_QUERIES["of this test"]
        spark.conf.set(name, usual)

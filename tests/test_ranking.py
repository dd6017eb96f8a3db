"""Ranks and nearest files against the plain definitions."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from depfleet.operators import ranking, resolve


def test_rank_in_blocks_equals_row_number(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 3)
    rng = random.Random(1)
    data = [("big" if i % 3 else "small", rng.choice([0.0, 0.1, 0.5]), i) for i in range(200)]
    df = spark.createDataFrame(data, "g string, score double, pos int")
    got = ranking.rank_desc(df, "g", "score", "pos")
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), "pos")))
    assert sorted(map(tuple, got.select("g", "score", "pos", "rank").collect())) == sorted(map(tuple, want.collect()))


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_nearest_equals_full_search(spark):
    rng = random.Random(2)
    dirs = ["", "a", "a/b", "a/b/c", "ab", "x/y", "x"]
    files = sorted({f"{rng.choice(dirs)}/{rng.choice('pq')}{i % 4}.csv".lstrip("/") for i in range(40)})
    sources = [f"{d}/main{i}.py".lstrip("/") for i, d in enumerate(dirs)]
    names = [f"{c}{i}.csv" for c in "pq" for i in range(4)]
    index = spark.createDataFrame([("g", "base", f.rsplit("/", 1)[-1], f) for f in files],
                                  "graph_id string, idx string, key string, target string")
    asks = spark.createDataFrame(
        [("g", f"{s}|{n}", s.rsplit("/", 1)[0] if "/" in s else "", s, 0, "base", n) for s in sources for n in names],
        "graph_id string, hit_id string, folder string, ref string, rank int, idx string, key string")
    got = {r["hit_id"]: r["target"] for r in resolve.nearest(asks, index).collect()}
    for s in sources:
        folder = s.rsplit("/", 1)[0] if "/" in s else ""
        for n in names:
            options = [f for f in files if f.rsplit("/", 1)[-1] == n]
            if options:
                assert got[f"{s}|{n}"] == min(options, key=lambda f: (f.startswith(folder), -common(f, s), f))
            else:
                assert f"{s}|{n}" not in got

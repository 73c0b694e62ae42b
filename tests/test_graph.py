"""Connected components and joins with hot keys."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from tidewater.operators import graph


def test_components_brute_force(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(5, 5)]
    parent = list(range(300))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: find(i) for i in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chain_and_star(spark):
    chain = spark.range(1000).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    star = spark.range(150_000).select(F.lit(-7).cast("long").alias("a"), F.col("id").alias("b"))
    for edges, nodes in ((chain, 1001), (star, 150_001)):
        edges = graph.durable(edges)
        out = graph.components(edges)
        low = edges.agg(F.least(F.min("a"), F.min("b"))).first()[0]
        assert tuple(out.agg(F.count("*"), F.count_distinct("node"), F.min("root"), F.max("root")).first()) == (nodes, nodes, low, low)
        assert int(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length() < 40


def test_join_hot_equals_join(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 50).alias("k"), "id")
    keyed = rows.groupBy("k").agg(F.max("id").alias("top"), F.count("*").alias("n")).where("k <> 4")
    got, want = graph.join_hot(rows, keyed, "k", ["id"]), rows.join(keyed.drop("n"), "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect())) and "hot_part" in got._jdf.queryExecution().toString()


def test_stored_leaves_no_shuffle_files(spark):
    """A chain of writes would keep the shuffles of all of them on the disk."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {disk.getAllFiles().apply(i).getName() for i in range(disk.getAllFiles().size()) if disk.getAllFiles().apply(i).getName().startswith("shuffle_")}
    before = files()
    kept = graph.stored(spark.range(20_000).repartition(3, "id").groupBy((F.col("id") % 5000).alias("k")).agg(F.sum("id").alias("s")), "kept")
    assert not files() - before and kept.count() == 5000 and spark.conf.get(graph.CLEANUP) == "false"
    path = kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
    graph.drop_stored(kept)
    assert not Path(path).exists()

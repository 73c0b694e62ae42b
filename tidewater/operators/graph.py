"""Durable intermediate results, joins that split hot keys, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key of more rows than this and than one in HOT_KEYS of all rows is hot; so at most HOT_KEYS keys are.
HOT_ROWS, HOT_KEYS = 1000, 10_000
#: Edges from which on components() splits hubs.
SPLIT_EDGES = 100_000
#: Has Spark delete the shuffle files of a query when it ends, not when its plan is collected as garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. In local mode a temporary one where that is unset; on a cluster that is an error."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tidewater-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured or sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: computed once, kept in the shared folder, lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def cleaned(spark: SparkSession):
    """What is written inside leaves no shuffle files behind: a chain of writes takes the disk of its largest one, not of all."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as compressed Parquet in the shared folder. Unlike a checkpoint's, size estimates are those of the files."""
    path = stored_path(df.sparkSession, name)
    with cleaned(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_stored(*frames: DataFrame) -> None:
    """Deletes the files of stored() frames, once nothing reads them any more."""
    for df in frames:
        discard(df.sparkSession, sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}))


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes what stored_path() has named, once nothing reads it any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, by: list[str], counts: DataFrame | None = None) -> DataFrame:
    """rows.join(keyed, key) for `keyed` of one row a key; `counts` (key, n) says how many of `rows` a key has.

    Without `counts` n is a column of `keyed`, which is dropped. A hot key's rows are dealt by the columns `by` over as
    many parts as it has limits of rows, and its row of `keyed` is copied to each. Only the numbers of parts of hot
    keys, at most HOT_KEYS of them, are broadcast.
    """
    counts = keyed.select(key, "n") if counts is None else counts
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    limit = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    if (most or 0) <= limit:
        return rows.join(keyed.drop("n"), key)
    hot = F.broadcast(counts.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("hot_parts")))
    parts = F.coalesce("hot_parts", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("hot_part", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("hot_parts")
    copied = keyed.drop("n").join(hot, key, "left").withColumn("hot_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("hot_parts")
    return dealt.join(copied, [key, "hot_part"]).drop("hot_part")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) longs as (node, root), root the smallest node reached.

    Alternating large-star and small-star rounds, about twice the logarithm of the longest chain. A round joins edges
    to one minimum for each node, so a hub is one row for each of its edges, never a list, and its rows are split.
    Each round is written as Parquet, so that lineage and size estimates don't grow, and deleted after the next one.
    Nodes without an edge to another don't appear; an empty table gives an empty table.
    """
    spark, spent = edges.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        spent.append(stored_path(spark, name))
        with cleaned(spark):
            df.write.parquet(spent[-1])
        return spark.read.parquet(spent[-1])

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def least_of(e: DataFrame, split: bool) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        return kept(least, "components-least") if split else least

    now = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    before = mark(now)
    while before[0]:
        # With few edges a hub is small too, and splitting it costs more than it saves.
        split = before[0] > SPLIT_EDGES
        join = (lambda rows, keyed: join_hot(rows, keyed, "u", ["v"])) if split else (lambda rows, keyed: rows.join(keyed.drop("n"), "u"))
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = least_of(both, split).withColumn("m", F.least("u", "m"))
        large = join(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = kept(large, "components") if split else large
        small = join(large, least_of(large, split)).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = kept(small.where("u <> v").distinct(), "components")
        after = mark(now)
        discard(spark, spent[:-1])
        del spent[:-1]
        if after == before:
            break
        before = after
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())

"""Group summaries, membership lookups and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("place") <= n)


def genre_baseline(cells: DataFrame, items: DataFrame) -> DataFrame:
    g = cells.join(items.select("item_id", F.explode("genres").alias("genre")), "item_id")
    return g.groupBy("genre").agg(F.round(F.sum("value") / F.count("*"), 6).alias("baseline"), F.count("*").alias("n"))


def size_rating(cells: DataFrame, labels: DataFrame) -> DataFrame:
    sizes = labels.where("cluster >= 0").groupBy("cluster").agg(F.count("*").alias("size"))
    means = cells.join(labels, "user_id").where("cluster >= 0").groupBy("cluster").agg(F.round(F.sum("value") / F.count("*"), 3).alias("avg_rating"))
    return sizes.join(means, "cluster", "left")


def genre_pref(cells: DataFrame, labels: DataFrame, items: DataFrame, n: int = 5) -> DataFrame:
    base = genre_baseline(cells, items).select("genre", "baseline")
    g = cells.join(labels, "user_id").where("cluster >= 0").join(items.select("item_id", F.explode("genres").alias("genre")), "item_id")
    means = g.groupBy("cluster", "genre").agg((F.sum("value") / F.count("*")).alias("m")).join(base, "genre")
    rows = means.select("cluster", "genre", F.round("m", 3).alias("avg_rating"), F.round(F.col("m") - F.col("baseline"), 3).alias("delta"))
    return top(rows, ["cluster"], [F.desc("delta"), "genre"], n)


def rep_items(cells: DataFrame, labels: DataFrame, items: DataFrame, n: int = 5, least: int = 10, good: float = 4.0) -> DataFrame:
    g = cells.join(labels, "user_id").where("cluster >= 0").groupBy("cluster", "item_id").agg(F.count("*").alias("n"), F.round(F.sum("value") / F.count("*"), 6).alias("avg_rating"))
    named = g.where((F.col("n") >= least) & (F.col("avg_rating") >= good)).join(items.select("item_id", "title"), "item_id")
    return top(named, ["cluster"], [F.desc("avg_rating"), F.desc("n"), "item_id"], n)


def demographics(labels: DataFrame, users: DataFrame) -> DataFrame:
    """Male share, most frequent age and occupation; the smallest code on a tie."""
    m = labels.where("cluster >= 0").join(users, "user_id")
    ratio = m.groupBy("cluster").agg(F.round(F.avg((F.col("gender") == "M").cast("double")), 3).alias("male_ratio"))
    mode = lambda c: top(m.groupBy("cluster", c).count(), ["cluster"], [F.desc("count"), c], 1).select("cluster", F.col(c).alias(f"top_{c}"))
    return ratio.join(mode("age"), "cluster").join(mode("occupation"), "cluster")


def summarize(cells: DataFrame, labels: DataFrame, users: DataFrame, items: DataFrame, least: int = 10, good: float = 4.0) -> DataFrame:
    """One row a cluster, with lists of genres and items as arrays of structs."""
    listed = lambda df, *c: df.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("place", *c))).alias("x"))
    g = listed(genre_pref(cells, labels, items), "genre", "avg_rating", "delta").withColumnRenamed("x", "genres")
    r = listed(rep_items(cells, labels, items, least=least, good=good), "item_id", "title", "avg_rating", "n").withColumnRenamed("x", "items")
    return size_rating(cells, labels).join(g, "cluster", "left").join(r, "cluster", "left").join(demographics(labels, users), "cluster", "left")


def expand_user_spec(specs: DataFrame, widest: int = 2000) -> DataFrame:
    """(spec) such as `1,2,5-9` to sorted distinct (user_id); ranges may run backwards; parts that are neither or too wide are left out."""
    part = specs.select(F.explode(F.split("spec", ",")).alias("p")).select(F.trim("p").alias("p")).where(F.col("p").rlike("^[0-9]{1,9}(-[0-9]{1,9})?$"))
    a, b = F.split("p", "-")[0].cast("long"), F.element_at(F.split("p", "-"), -1).cast("long")
    ends = part.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col("b") - F.col("a") <= widest)
    return ends.select(F.explode(F.sequence("a", "b")).alias("user_id")).distinct()


def membership(asked: DataFrame, labels: DataFrame, users: DataFrame, low: DataFrame) -> DataFrame:
    flag = lambda df, n: df.select("user_id").distinct().withColumn(n, F.lit(True))
    x = asked.select("user_id").distinct().join(labels, "user_id", "left").join(flag(users, "attr"), "user_id", "left").join(flag(low, "low"), "user_id", "left")
    status = F.when(F.col("cluster").isNotNull(), "clustered").when(F.col("attr"), "no_profile").otherwise("unknown")
    in_ = F.col("cluster").isNotNull()
    return x.select("user_id", status.alias("status"), "cluster", (F.col("cluster") == -1).alias("noise"), F.when(in_, F.coalesce("low", F.lit(False))).alias("low_history"), F.when(in_, F.col("attr").isNull()).alias("no_demographics"))


def touched_groups(members: DataFrame, genres: DataFrame, items: DataFrame, n: int = 3) -> DataFrame:
    """(cluster, kind, place, name, avg_rating, delta): the first genres and items of the clusters that members are in."""
    hit = members.where("cluster >= 0").select("cluster").distinct()
    g = genres.select("cluster", F.lit("genre").alias("kind"), "place", F.col("genre").alias("name"), "avg_rating", "delta")
    i = items.select("cluster", F.lit("item").alias("kind"), "place", F.col("title").alias("name"), "avg_rating", F.lit(None).cast("double").alias("delta"))
    return g.union(i).where(F.col("place") <= n).join(hit, "cluster", "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: str = "artifact_id") -> DataFrame:
    """Rows of the same id are replaced."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def overview(grids: DataFrame) -> DataFrame:
    """All grid rows of (task, algorithm, position, metric) with the selected one marked."""
    best = F.row_number().over(W.partitionBy("task", "algorithm").orderBy(F.col("metric").desc_nulls_last(), "position")) == 1
    return grids.withColumn("selected", best)


def reduction_report(grid: DataFrame, algorithm: str, dim: int) -> DataFrame:
    """The grid's row of a registered dimension, else a row with that status."""
    asked = grid.sparkSession.createDataFrame([(algorithm, dim)], "algorithm string, dim int")
    return asked.join(grid, ["algorithm", "dim"], "left").withColumn("status", F.when(F.col("evr").isNull(), "not_registered").otherwise("ok"))


def top_loading_items(loadings: DataFrame, items: DataFrame, components: int = 5, n: int = 8) -> DataFrame:
    """(component, place, item_id, title, loading): largest by absolute value among items with attributes."""
    named = loadings.where(F.col("component") < components).join(items.select("item_id", "title"), "item_id")
    return top(named, ["component"], [F.desc(F.abs("loading")), "item_id"], n).select("component", "place", "item_id", "title", F.round("loading", 4).alias("loading"))

"""Split by time, user x item cells, train-period statistics."""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewater.config import Rules
from tidewater.operators.graph import stored_path
from tidewater.operators.order import ranked
from tidewater.operators.sparse import sparse_rows


def time_split(ratings: DataFrame, rules: Rules) -> DataFrame:
    return ratings.withColumn("period", F.when(F.col("ts") <= rules.t1, "train").when(F.col("ts") <= rules.t2, "val").otherwise("test"))


def vocabulary(split: DataFrame, column: str) -> DataFrame:
    """(id, idx): distinct train ids in order, from 0; see ranked()."""
    ids = split.where("period = 'train'").select(F.col(column).alias("id")).distinct()
    return ranked(ids, "id").select("id", F.col("place").alias("idx"))


def train_ids(split: DataFrame, column: str) -> DataFrame:
    return split.where("period = 'train'").select(column).distinct()


def in_vocabulary(split: DataFrame) -> DataFrame:
    return split.join(train_ids(split, "user_id"), "user_id", "left_semi").join(train_ids(split, "item_id"), "item_id", "left_semi")


def user_item_cells(split: DataFrame) -> DataFrame:
    """(period, user_id, item_id, value): ratings of train users and items, repeated cells added up."""
    return in_vocabulary(split).groupBy("period", "user_id", "item_id").agg(F.sum("rating").cast("long").alias("value"))


def train_cells(split: DataFrame) -> DataFrame:
    """(user_id, item_id, value) of user_item_cells() of the train period, whose users and items are the vocabulary."""
    return split.where("period = 'train' and user_id is not null and item_id is not null").select("user_id", "item_id", "rating").repartition("item_id").groupBy("user_id", "item_id").agg(F.sum("rating").cast("long").alias("value"))


def profile_vectors(cells: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """(user_id, vector): a row for each vocabulary user, also of users without cells; sparse vectors over the item vocabulary.

    The fields of a sparse vector are written as Parquet and read back under the vector type, so no row passes through Python.
    """
    rows = sparse_rows(cells, users, items)
    vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(items.count()).cast("int").alias("size"), F.col("idx").alias("indices"), F.col("val").alias("values"))
    path = stored_path(rows.sparkSession, "profile-vectors")
    rows.select(F.col("id").alias("user_id"), vector.alias("vector")).write.parquet(path)
    return rows.sparkSession.read.schema(StructType([StructField("user_id", LongType()), StructField("vector", VectorUDT())])).parquet(path)


def profile_tables(split: DataFrame, users: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    """All that a later stage reads of a profile: the cells of each period by vocabulary places, vocabularies, attributes and train statistics."""
    who, what = vocabulary(split, "user_id"), vocabulary(split, "item_id")
    cells = user_item_cells(split).join(who.select(F.col("id").alias("user_id"), F.col("idx").alias("row")), "user_id").join(what.select(F.col("id").alias("item_id"), F.col("idx").alias("column")), "item_id")
    stats = user_stats(split)
    tables = {f"cells_{p}": cells.where(F.col("period") == p).select("row", "column", "value") for p in ("train", "val", "test")}
    return tables | {
        "user_vocabulary": who, "item_vocabulary": what, "users": users, "items": items, "user_stats": stats, "item_stats": item_stats(split), "global_mean": global_mean(split),
        "low_history": low_history(stats), "new_items": new_items(split), "meta": profile_meta(split),
    }


def user_stats(split: DataFrame) -> DataFrame:
    return split.where("period = 'train'").groupBy("user_id").agg(F.round(F.avg("rating"), 6).alias("user_mean"), F.count("*").alias("user_count"))


def item_stats(split: DataFrame) -> DataFrame:
    return split.where("period = 'train'").groupBy("item_id").agg(F.count("*").alias("item_count"))


def global_mean(split: DataFrame) -> DataFrame:
    return split.where("period = 'train'").agg(F.round(F.avg("rating"), 6).alias("global_mean"))


def low_history(stats: DataFrame, least: int = 5) -> DataFrame:
    return stats.where(F.col("user_count") < least).select("user_id", "user_count")


def new_items(split: DataFrame) -> DataFrame:
    later = split.where("period <> 'train'").select("period", "item_id").distinct()
    fresh = later.join(train_ids(split, "item_id"), "item_id", "left_anti")
    return later.groupBy("period").agg(F.count("*").alias("items")).join(fresh.groupBy("period").agg(F.count("*").alias("fresh")), "period", "left").select("period", F.coalesce("fresh", F.lit(0)).cast("long").alias("new_items"))


def profile_meta(split: DataFrame) -> DataFrame:
    sizes = split.groupBy("period").agg(F.count("*").alias("events"), F.round(F.avg((F.col("rating") >= 4).cast("double")), 6).alias("positive_ratio"))
    kept = in_vocabulary(split).groupBy("period").agg(F.count("*").alias("kept_events"))
    return sizes.join(kept, "period", "left").select("period", "events", "positive_ratio", F.coalesce("kept_events", F.lit(0)).cast("long").alias("kept_events"))

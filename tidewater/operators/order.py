"""Places of rows in a global order, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.graph import stored


def ranked(rows: DataFrame, *columns: str) -> DataFrame:
    """Adds place, from 0, in the order of columns: places in range partitions, carried over the partitions' counts.

    Rows are written once, so that a place doesn't change when a task runs again. The driver sees a number for each partition.
    """
    # The id counts a partition's rows from its number's start.
    sorted_ = rows.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("at", F.monotonically_increasing_id())
    at = stored(sorted_, "ranked").withColumn("part", F.shiftrightunsigned("at", 33))
    front, fronts = 0, []
    for r in at.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("n")).orderBy("part").collect():
        fronts.append((r["part"], front - r["first"]))
        front += r["n"]
    carried = F.broadcast(rows.sparkSession.createDataFrame(fronts, "part long, shift long"))
    return at.join(carried, "part").withColumn("place", F.col("at") + F.col("shift")).drop("at", "part", "shift")

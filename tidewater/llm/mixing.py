"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1, linear from a start to an end weight. Its integral, beside
those of the other sources, is the source's share of the budget. Documents of a source line up in a fixed random order
(md5 of doc_id); a document's place in that line is a quantity of cumulative token demand, and the inverse of the
source's cumulative schedule turns it into a training position. Documents are then range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm.common import WORD, durable, fresh, stored, table

#: Start and end weights of the sources in code point order, null last, repeating; the means are 5, 2 and 1.
CYCLE = ((7.0, 3.0), (2.0, 2.0), (0.5, 1.5))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, budget: float = 1.5, most: float = 2.0, cycle=CYCLE) -> DataFrame:
    """(source, source_size, target, slope) from rows (source, size).

    Targets share budget x all sizes by weight; where one would exceed most x its source's size it stops there and
    the excess is shared again by weight. That water level has a closed form over sources sorted by the level at
    which each fills up. An empty source has target 0.
    """
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(F.col("place"), F.lit(len(cycle))).cast("int") + 1)
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = per.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    rated = placed.select(
        "source", "source_size", pick([(a + b) / 2 for a, b in cycle]).alias("weight"), pick([(b - a) / (a + b) for a, b in cycle]).alias("slope"),
        (F.col("source_size") * F.lit(most)).alias("cap"),
    )
    by_level = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, total = by_level.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    levels = rated.withColumns({
        "full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "open": F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "all": F.sum("source_size").over(total) * F.lit(budget),
    }).withColumn("level", (F.col("all") - F.col("full")) / F.col("open"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    water = levels.withColumn("water", F.max(fits).over(total))
    return water.select("source", "source_size", F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target"), "slope")


def plan(docs: DataFrame, budget: float = 1.5, most: float = 2.0, cycle=CYCLE) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken, mark, at (its place in its source's line), slope.

    Whole passes over a source take every document once; the rest of the target takes documents from the front of
    the line and cuts the last, so a source's taken words equal its target rounded down. Null text has size 0, null
    source is a source, null doc_id sorts as an empty string, repeated rows are documents of their own. No document
    is taken more than `most` times, rounded up. Prefix sums are taken inside 4096 bins of each source's line and
    carried over the bins' sums, so no source lands in one task.
    """
    rows = durable(docs.select(
        F.col("doc_id"), F.col("source"), n_words(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("line"), F.xxhash64("text").alias("mark"),
    ))
    binned = rows.withColumn("bin", F.substring("line", 1, 3))
    bins = binned.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    earlier = F.sum("bin_size").over(W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1))
    front = bins.select(F.col("source").alias("s"), F.col("bin").alias("b"), F.coalesce(earlier, F.lit(0)).alias("front"))
    targets = source_targets(rows, budget, most, cycle)
    starts = front.join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    inside = W.partitionBy("source", "bin").orderBy("line", "doc_id", "mark", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = binned.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
    goal, size_of = F.floor("target"), F.greatest("source_size", F.lit(1))
    passes = F.expr("floor(target) div greatest(source_size, 1)")
    at = F.col("front") + F.col("inside")
    rest = F.least(F.greatest(goal - passes * size_of - at, F.lit(0)), F.col("size"))
    return placed.select("doc_id", "size", "source", "source_size", "target", (passes * F.col("size") + rest).cast("long").alias("taken"), "mark", at.alias("at"), "slope")


def positions(planned: DataFrame) -> DataFrame:
    """One row per copy taken: copy (from 0), words (of this copy), position (0..1 along training) added."""
    copies = F.sequence(F.lit(0), F.ceil(F.col("taken") / F.greatest("size", F.lit(1))).cast("int") - 1)
    out = planned.where("taken > 0").withColumn("copy", F.explode(copies))
    done = F.col("copy") * F.col("source_size") + F.col("at")
    u, a = F.least(done / F.greatest("target", F.lit(1.0)), F.lit(1.0)), F.col("slope")
    # Demand up to time t is t + a (t^2 - t) of the target; solved for t.
    t = F.when(a == 0, u).otherwise((a - 1 + F.sqrt(F.greatest((1 - a) * (1 - a) + 4 * a * u, F.lit(0.0)))) / (2 * a))
    return out.withColumns({"words": F.least("size", F.col("taken") - F.col("copy") * F.col("size")), "position": t})


def in_training_order(planned: DataFrame) -> DataFrame:
    """The copies of positions(), range-sorted by position as a training run reads them."""
    return positions(planned).repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy")


def taken_of(planned: DataFrame, copies: DataFrame) -> DataFrame:
    """The rows of plan() with taken (words of all copies), copies and first_position from the copies; documents without a copy have 0 and null.

    Rows that are equal in doc_id, source and text share their copies by their place in the source's line.
    """
    key = ["doc_id", "source", "mark", "at", "size"]
    dealt = copies.select(*key, "words", "position", F.lit(1).alias("is_copy"), "source_size", "target")
    own = planned.select(*key, F.lit(0).cast("long").alias("words"), F.lit(None).cast("double").alias("position"), F.lit(0).alias("is_copy"), "source_size", "target")
    both = own.union(dealt).groupBy(*key).agg(
        F.sum(1 - F.col("is_copy")).alias("rows"), F.sum("is_copy").alias("copies"), F.sum("words").cast("long").alias("all_words"), F.min("position").alias("first_position"),
        F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    # Rows of one key have size 0 or are one row, since the place grows by the size.
    each = both.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return each.select("doc_id", "size", "source", "source_size", "target", F.col("all_words").alias("taken"), "copies", "first_position")


def mix(docs: DataFrame, budget: float = 1.5, most: float = 2.0, cycle=CYCLE) -> DataFrame:
    """The training mix: the columns of docs, a row per copy, range-sorted by position; the last copy of a source is cut.

    Null texts and texts without words have size 0 and no place in the mix; an empty table gives an empty mix.
    Rows that are equal in doc_id, source and text take as many copies together as each alone would.
    """
    taken = positions(plan(docs, budget, most, cycle)).groupBy("doc_id", "source", "mark", "copy").agg(F.max("words").alias("words"), F.max("size").alias("size"), F.min("position").alias("position"))
    mix = {c: fresh(f"mix_{c}", docs.columns) for c in taken.columns}
    taken = taken.withColumnsRenamed(mix)
    key = F.col("doc_id").eqNullSafe(F.col(mix["doc_id"])) & F.col("source").eqNullSafe(F.col(mix["source"])) & (F.xxhash64("text") == F.col(mix["mark"]))
    joined = docs.join(taken, key)
    parts = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"), F.lit(0))
    spaced = F.array_join(F.slice(parts, 1, F.col(mix["words"]).cast("int")), "")
    text = F.when(F.col(mix["words"]) < F.col(mix["size"]), spaced).otherwise(F.col("text"))
    fixed = {"text": text} | ({"n_chars": F.length(text).cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {})
    cut = joined.withColumns(fixed)
    order = [mix[c] for c in ("position", "doc_id", "copy")]
    return cut.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, first_position (0..1 along training, null without a copy), in training order.

    Words and positions are those of the copies as a training run reads them; see plan() for nulls, empty texts and
    repeats, and taken_of() for documents that nothing is taken of.
    """
    planned = stored(plan(table(spark, sf_dir, "documents")), "planned")
    copies = stored(in_training_order(planned), "positions")
    return taken_of(planned, copies).drop("source").orderBy("first_position", "doc_id")


OP4_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size, md5(coalesce(doc_id::varchar, '')) line from documents),
per as (select source, sum(size)::bigint source_size from d group by source),
placed as (select *, (row_number() over (order by source nulls last) - 1) % 3 place from per),
rated as (select source, place, source_size, case place when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end weight, source_size * 2.0::double cap from placed),
levels as (select *, coalesce(sum(cap) over b, 0) filled, sum(weight) over () - coalesce(sum(weight) over b, 0) unfilled, (sum(source_size) over ())::double * 1.5::double everything
  from rated window b as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
water as (select *, max(case when (everything - filled) / unfilled * weight <= cap then (everything - filled) / unfilled end) over () w from levels),
targets as (select source, source_size, least(cap, coalesce(w * weight, cap)) target, case place when 0 then -4.0::double / 10 when 1 then 0.0::double else 1.0::double / 2 end slope from water),
placed_d as (select d.*, t.source_size, t.target, t.slope, coalesce(sum(size) over (partition by d.source order by line, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint spot
  from d join targets t on d.source is not distinct from t.source),
counted as (select *,
  ((floor(target)::bigint // greatest(source_size, 1)) * size
   + least(greatest(floor(target)::bigint - (floor(target)::bigint // greatest(source_size, 1)) * greatest(source_size, 1) - spot, 0), size))::bigint taken,
  least(spot / greatest(target, 1.0::double), 1.0::double) u from placed_d)
select doc_id, size, source_size, target, taken, ceil(taken::double / greatest(size, 1))::bigint copies,
  case when taken = 0 then null when slope = 0 then u
    else (slope - 1 + sqrt(greatest((1 - slope) * (1 - slope) + 4 * slope * u, 0.0::double))) / (2 * slope) end first_position
from counted
"""

"""Preference formatting in DataFrame functions: a shared prompt and two masked completions from a pair of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm.common import table


def one_row_a_turn(turns: DataFrame, key: str) -> DataFrame:
    """(key, turn, role, text); of rows that repeat a turn the smallest stays, rows of null key or turn go, null role and text are empty."""
    filled = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kept = turns.where(F.col(key).isNotNull() & F.col("turn").isNotNull()).groupBy(key, "turn").agg(F.min(filled).alias("x"))
    return kept.select(key, "turn", "x.role", "x.text")


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row per pair_id from turns (pair_id, turn, role, text) of its chosen and its rejected conversation.

    prompt: the longest common prefix of turns (equal turn, role and text), rendered once; prompt_turns: its length.
    chosen, rejected: the other turns rendered; chosen_mask, rejected_mask: the spans start-end of the completion,
    comma-separated, that train (assistants' texts with their end mark). A pair with one side only has an empty prompt
    and an empty other completion; equal conversations have empty completions. Prefixes come from a join on
    (pair_id, turn) and a minimum; only the rendered conversation of a pair is gathered, as it is one row.
    """
    a, b = one_row_a_turn(chosen, "pair_id"), one_row_a_turn(rejected, "pair_id")
    named = lambda df, s: df.select("pair_id", "turn", F.struct("role", "text").alias(s))
    both = named(a, "c").join(named(b, "r"), ["pair_id", "turn"], "full")
    parted = both.groupBy("pair_id").agg(F.min(F.when(~F.col("c").eqNullSafe(F.col("r")), F.col("turn"))).alias("fork"))
    after = F.col("fork").isNotNull() & (F.col("turn") >= F.col("fork"))
    sides = F.array(
        F.struct(F.when(after, F.lit("c")).otherwise(F.lit("p")).alias("part"), F.col("c").alias("m")),
        F.struct(F.when(after, F.lit("r")).alias("part"), F.col("r").alias("m")),
    )
    rows = both.join(parted, "pair_id").select("pair_id", "turn", F.explode(sides).alias("s")).where("s.part is not null and s.m is not null")
    head, body = F.concat(F.lit("<|im_start|>"), F.col("s.m.role"), F.lit("\n")), F.concat(F.col("s.m.text"), F.lit("<|im_end|>\n"))
    pieces = rows.select("pair_id", "turn", F.col("s.part").alias("part"), F.concat(head, body).alias("piece"), F.length(head).alias("skip"), (F.col("s.m.role") == "assistant").alias("trains"))
    before = F.coalesce(F.sum(F.length("piece")).over(W.partitionBy("pair_id", "part").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # The line feed after the end mark doesn't train.
    span = F.when(F.col("trains"), F.concat_ws("-", before + F.col("skip"), before + F.length("piece") - 1))
    spanned = pieces.withColumn("span", span)
    joined = lambda part, field, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("turn", F.col(field).alias("x"))))), lambda s: s["x"]), by)
    out = spanned.groupBy("pair_id").agg(
        joined("p", "piece", "").alias("prompt"), F.count(F.when(F.col("part") == "p", 1)).alias("prompt_turns"),
        joined("c", "piece", "").alias("chosen"), joined("c", "span", ",").alias("chosen_mask"),
        joined("r", "piece", "").alias("rejected"), joined("r", "span", ",").alias("rejected_mask"),
    )
    return out


def swapped_answers(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen: each conversation that has an answer. Rejected: its turns before its last answer, then the last answer of conversation conv_id + 1, if any."""
    clean = one_row_a_turn(turns, "conv_id")
    last = clean.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("x")).select("conv_id", "x.turn", "x.text")
    ends = last.select(F.col("conv_id").alias("id"), F.col("turn").alias("end"))
    chosen = clean.join(ends, F.col("conv_id") == F.col("id")).where("turn <= end")
    other = last.select((F.col("conv_id") - 1).alias("id"), F.col("text"))
    swapped = ends.join(other, "id").select("id", F.col("end").alias("turn"), F.lit("assistant").alias("role"), "text")
    rejected = chosen.where("turn < end").select("id", "turn", "role", "text").union(swapped)
    return chosen.select(F.col("id").alias("pair_id"), "turn", "role", "text"), rejected.withColumnRenamed("id", "pair_id")


def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of format_pairs() for all conversations that have an answer, with the rejected side of swapped_answers()."""
    return format_pairs(*swapped_answers(table(spark, sf_dir, "conversations")))


OP7_SQL = r"""
with t as (select conv_id, turn, min({'role': coalesce(role, ''), 'text': coalesce(text, '')}) x from conversations where conv_id is not null and turn is not null group by conv_id, turn),
l as (select conv_id id, max({'turn': turn, 'text': x.text}) y from t where x.role = 'assistant' group by conv_id),
c as (select id, turn, x.role role, x.text text, y.turn fin from t join l on conv_id = id where turn <= y.turn),
r as (select id, turn, role, text from c where turn < fin
  union all select a.id, a.y.turn, 'assistant', b.y.text from l a join l b on b.id = a.id + 1),
j as (select coalesce(c.id, r.id) pair_id, coalesce(c.turn, r.turn) turn, c.role cr, c.text ct, r.role rr, r.text rt, c.id is not null hc, r.id is not null hr
  from c full join r on c.id = r.id and c.turn = r.turn),
f as (select pair_id, min(case when cr is distinct from rr or ct is distinct from rt then turn end) fork from j group by pair_id),
s as (select j.pair_id, turn, case when fork is not null and turn >= fork then 'c' else 'p' end part, cr role, ct text from j join f using (pair_id) where hc
  union all select j.pair_id, turn, 'r', rr, rt from j join f using (pair_id) where hr and fork is not null and turn >= fork),
p as (select *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) piece, 13 + length(role) skip from s),
o as (select *, coalesce(sum(length(piece)) over (partition by pair_id, part order by turn rows between unbounded preceding and 1 preceding), 0)::bigint b from p),
m as (select *, case when role = 'assistant' then (b + skip)::varchar || '-' || (b + length(piece) - 1)::varchar end span from o)
select pair_id, coalesce(string_agg(piece, '' order by turn) filter (part = 'p'), '') prompt, count(*) filter (part = 'p') prompt_turns,
  coalesce(string_agg(piece, '' order by turn) filter (part = 'c'), '') chosen, coalesce(string_agg(span, ',' order by turn) filter (part = 'c'), '') chosen_mask,
  coalesce(string_agg(piece, '' order by turn) filter (part = 'r'), '') rejected, coalesce(string_agg(span, ',' order by turn) filter (part = 'r'), '') rejected_mask
from m group by pair_id
"""

"""Cleaning and quality scores of raw records. Every input row is kept, merged, or quarantined with a reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.config import Rules
from tidewater.functions import rules as R
from tidewater.operators.graph import stored
from tidewater.sources.records import read_ids


def _first_failure(checks: list[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for failed, reason in reversed(checks):
        out = F.when(failed, reason).otherwise(out)
    return out


def known(df: DataFrame, ids: DataFrame, column: str, flag: str) -> DataFrame:
    """Adds whether a string column's value is among the ids; always true for an empty id set.

    Left to the planner: it broadcasts ids under its size threshold and else shuffles both sides.
    """
    marked = df.join(ids.select(F.col("id").alias(f"{flag}_id")), F.col(column) == F.col(f"{flag}_id"), "left")
    if ids.isEmpty():
        return marked.withColumn(flag, F.lit(True)).drop(f"{flag}_id")
    return marked.withColumn(flag, F.col(f"{flag}_id").isNotNull()).drop(f"{flag}_id")


def referential_check(events: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The events whose id is unknown."""
    return events.limit(0) if ids.isEmpty() else events.join(ids, F.col(column) == F.col("id"), "left_anti")


def clean_ratings(raw: DataFrame, user_ids: DataFrame, item_ids: DataFrame, rules: Rules) -> DataFrame:
    f = R.split_fields(R.normalize_separator(F.col("line")), 4, rules.sentinel)
    rows = raw.where("kind = 'ratings'").select("kind", "line", R.at(f, 0).alias("u"), R.at(f, 1).alias("m"))
    # Lines are split again after the joins: the fields would be shuffled beside the line.
    rows = known(known(rows, user_ids, "u", "has_user"), item_ids, "m", "has_item").withColumn("f", f)
    ts = R.at(F.col("f"), 3).try_cast("bigint")
    rows = rows.select("kind", "line", "f", "u", "m", R.at(F.col("f"), 2).alias("r"), F.when(R.is_long(R.at(F.col("f"), 3)), ts).alias("long_ts"), "has_user", "has_item")
    rows = rows.withColumn("sec", R.normalize_epoch(F.col("long_ts"), rules))
    n = F.size("f")
    reason = _first_failure([
        (n < 4, "missing_fields"), (n > 4, "extra_fields"), (~(R.is_int(F.col("u")) & R.is_int(F.col("m"))), "id_not_int"), (~R.is_int(F.col("r")), "rating_not_int"),
        (~F.coalesce(F.col("r").try_cast("int").between(*rules.ratings), F.lit(False)), "rating_out_of_range"), (F.col("long_ts").isNull(), "ts_not_integer"),
        (~R.valid_ts(F.col("sec"), rules), "ts_out_of_range"), (~F.col("has_user"), "unknown_user"), (~F.col("has_item"), "unknown_item"),
    ])
    return _tagged(rows, reason, F.concat_ws("::", "u", "m", "r", F.col("sec").cast("string")), F.concat_ws("::", "u", "m", F.col("sec").cast("string")))


def clean_users(raw: DataFrame, rules: Rules) -> DataFrame:
    rows = raw.where("kind = 'users'").select("kind", "line", R.split_fields(R.normalize_separator(F.col("line")), 5, rules.sentinel).alias("f"))
    f, n = F.col("f"), F.size("f")
    reason = _first_failure([
        (n < 5, "missing_fields"), (n > 5, "extra_fields"), (~R.is_int(R.at(f, 0)), "id_not_int"), (~R.at(f, 1).isin(*rules.genders), "gender_invalid"),
        (~R.at(f, 2).isin(*rules.ages), "age_invalid"), (~R.at(f, 3).isin(*rules.occupations), "occupation_invalid"), (R.is_blank(R.at(f, 4)), "zip_missing"),
    ])
    return _tagged(rows, reason, F.array_join("f", "::"), R.at(f, 0))


def clean_items(raw: DataFrame, rules: Rules) -> DataFrame:
    rows = raw.where("kind = 'movies'").select("kind", "line", R.split_fields(R.normalize_separator(F.col("line")), 3, rules.sentinel).alias("f"))
    f, n = F.col("f"), F.size("f")
    reason = _first_failure([
        (n < 3, "missing_fields"), (n > 3, "extra_fields"), (~R.is_int(R.at(f, 0)), "id_not_int"), (R.is_blank(R.at(f, 1)), "title_missing"),
        (~R.has_year(R.at(f, 1), rules), "year_invalid"), (R.is_blank(R.at(f, 2)), "genres_missing"), (~R.valid_genres(R.at(f, 2), rules), "genre_unknown"),
    ])
    return _tagged(rows, reason, F.array_join("f", "::"), R.at(f, 0))


def _tagged(rows: DataFrame, reason: Column, cleaned: Column, key: Column) -> DataFrame:
    ok = F.col("reason").isNull()
    out = rows.withColumn("reason", reason).select("kind", "line", "reason", F.when(ok, cleaned).alias("cleaned"), F.when(ok, key).alias("key"))
    return out.withColumn("fixed", ok & (F.col("cleaned") != F.col("line")))


def tag_all(raw: DataFrame, rules: Rules, ids_from: DataFrame | None = None, ids: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(kind, line, reason, cleaned, key, fixed) for each raw row; ids are those of `ids_from`, else of the raw rows, unless their stored_ids() are given."""
    ratings = clean_ratings(raw, *(ids or stored_ids(raw if ids_from is None else ids_from)), rules)
    return ratings.union(clean_users(raw, rules)).union(clean_items(raw, rules))


def dedup_or_conflict(tagged: DataFrame) -> DataFrame:
    """(kind, key, copies, cleaned, conflict): one row a business key; conflict where its rows differ. Minimum and maximum decide, so a hot key stays one partial row for each task."""
    grouped = tagged.where("reason is null").groupBy("kind", "key").agg(F.count("*").alias("copies"), F.min("cleaned").alias("cleaned"), F.max("cleaned").alias("last"))
    return grouped.select("kind", "key", "copies", "cleaned", (F.col("cleaned") != F.col("last")).alias("conflict"))


def kept_lines(tagged: DataFrame) -> DataFrame:
    return dedup_or_conflict(tagged).where("not conflict").select("kind", F.col("cleaned").alias("line"))


def quarantine_rows(tagged: DataFrame) -> DataFrame:
    """(kind, line, reason): failed lines as they came; for a conflict each distinct cleaned line."""
    failed = tagged.where("reason is not null").select("kind", "line", "reason")
    bad = dedup_or_conflict(tagged).where("conflict").select("kind", "key")
    both = tagged.where("reason is null").join(bad, ["kind", "key"], "left_semi").select("kind", F.col("cleaned").alias("line"), F.lit("conflict").alias("reason")).distinct()
    return failed.union(both)


def clean_summary(tagged: DataFrame) -> DataFrame:
    """One row: raw, kept, fixed, dedup, quarantine, conflict (all copies), quarantine_total, balanced (conservation)."""
    by_rule = tagged.agg(F.count("*").alias("raw"), F.count_if("fixed").alias("fixed"), F.count("reason").alias("quarantine"))
    copies, clash = F.col("copies"), F.col("conflict")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    by_key = dedup_or_conflict(tagged).agg(
        F.count_if(~clash).alias("kept"), zero(F.sum(F.when(~clash, copies - 1))).alias("dedup"), zero(F.sum(F.when(clash, copies))).alias("conflict"))
    total = F.col("quarantine") + F.col("conflict")
    return by_rule.join(by_key).select("raw", "kept", "fixed", "dedup", "quarantine", "conflict", total.alias("quarantine_total"), (F.col("raw") == F.col("kept") + F.col("dedup") + total).alias("balanced"))


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def with_total(counts: DataFrame, column: str) -> DataFrame:
    """counts_by() of one column and a row `total`."""
    return counts.union(counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("total").alias(column), "n"))


def first_rows(df: DataFrame, group: list[str], n: int) -> DataFrame:
    """The n rows of each group with the smallest lines."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy("line"))).where(F.col("place") <= n)


def stored_ids(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The user and item ids of the raw rows, written once: each is asked whether it is empty and joined."""
    return stored(read_ids(raw, "users"), "user-ids"), stored(read_ids(raw, "movies"), "item-ids")


def score(raw: DataFrame, ids_from: DataFrame, rules: Rules, ids: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row: five dimensions and overall, 0..100, two digits, half up. A dimension without records is 0.

    Consistency checks ids only if both id sets have members, on leading ids; `ids_from` is the raw input also
    when cleaned rows are scored; `ids` are its stored_ids(), where those are at hand. Two id joins and one group by the
    whole line; the rest is conditional sums.
    """
    users, items = ids or stored_ids(ids_from)
    # Most lines are ratings without a fault; only others are split.
    line, f, kind, fine = F.col("line"), F.col("f"), F.col("kind"), F.col("fine")
    rows = raw.select("kind", "line", ((F.col("kind") == "ratings") & R.valid_rating_line(line, rules)).alias("fine"))
    rows = rows.withColumn("f", F.when(~fine, R.raw_fields(line)))
    width = fine | (F.size("f") == F.when(kind == "ratings", 4).when(kind == "users", 5).otherwise(3))
    good = F.when(kind == "ratings", fine).when(kind == "users", R.valid_user(f, rules)).otherwise(R.valid_item(f, rules))
    ts = F.when(fine, R.rating_time(line)).when(R.is_long(R.at(f, 3)), R.at(f, 3).try_cast("bigint"))
    on_time = (kind == "ratings") & (fine | (F.size("f") == 4)) & R.valid_ts(R.normalize_epoch(ts, rules), rules)
    # A row's marks, a bit each, and its ids are all that the id joins carry.
    marks = {"ratings": kind == "ratings", "accurate": good, "complete": fine | (width & R.all_non_empty(f)), "width": width, "timely": on_time}
    bits = reduce(lambda out, c: out + c, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(marks.values())])
    rated = lambda i: F.when(fine, F.substring_index(F.substring_index(line, "::", i + 1), "::", -1)).when(kind == "ratings", R.leading_id(R.at(f, i)))
    rows = rows.select(bits.cast("tinyint").alias("bits"), rated(0).alias("lead0"), rated(1).alias("lead1"))
    has = {name: F.col("bits").bitwiseAND(F.lit(1 << i)) != 0 for i, name in enumerate(marks)}
    linked = has["width"]
    if not (users.isEmpty() or items.isEmpty()):
        rows = known(known(rows, users, "lead0", "has_user"), items, "lead1", "has_item")
        linked &= ~has["ratings"] | (F.col("has_user") & F.col("has_item"))
    c = rows.agg(F.count("*").alias("total"), *[F.count_if(has[name]).alias(name) for name in ("ratings", "accurate", "complete", "timely")], F.count_if(linked).alias("consistent"))
    d = raw.groupBy("kind", "line").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeats"))
    share = lambda a, b: F.when(b > 0, a * 100.0 / b).otherwise(0.0)
    total = F.col("total")
    x = c.join(d).select(
        share(F.col("accurate"), total).alias("accuracy"), share(F.col("complete"), total).alias("completeness"), share(total - F.col("repeats"), total).alias("uniqueness"),
        share(F.col("consistent"), total).alias("consistency"), share(F.col("timely"), F.col("ratings")).alias("timeliness"))
    overall = 0.25 * F.col("accuracy") + 0.25 * F.col("completeness") + 0.2 * F.col("uniqueness") + 0.2 * F.col("consistency") + 0.1 * F.col("timeliness")
    cut = lambda v: (F.floor(v * 100 + 0.5) / 100).cast("double")
    return x.select(*[cut(F.col(n)).alias(n) for n in x.columns], cut(overall).alias("overall"))


DIMENSIONS = ("accuracy", "completeness", "uniqueness", "consistency", "timeliness", "overall")


def compare_scores(before: DataFrame, after: DataFrame) -> DataFrame:
    """(dimension, before, after, delta)."""
    long = lambda df, name: df.unpivot([], list(DIMENSIONS), "dimension", name)
    return long(before, "before").join(long(after, "after"), "dimension").withColumn("delta", F.round(F.col("after") - F.col("before"), 2))

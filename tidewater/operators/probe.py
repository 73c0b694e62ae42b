"""Profiling probes over raw lines (kind, line). Each is one or two aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.config import Rules
from tidewater.functions import rules as R
from tidewater.operators.graph import stored


def fields(raw: DataFrame, kind: str, width: int | None = None) -> DataFrame:
    out = raw.where(F.col("kind") == kind).select("line", R.raw_fields(F.col("line")).alias("f"))
    return out if width is None else out.where(F.size("f") == width)


def ratings4(raw: DataFrame) -> DataFrame:
    f = F.col("f")
    return fields(raw, "ratings", 4).select("line", *[R.at(f, i).alias(n) for i, n in enumerate("umrt")])


def long_of(c: Column) -> Column:
    return F.when(R.is_long(c), c.try_cast("bigint"))


def field_count_histogram(raw: DataFrame) -> DataFrame:
    return raw.groupBy("kind", F.size(R.raw_fields(F.col("line"))).alias("fields")).agg(F.count("*").alias("n"))


def non_integer_counts(raw: DataFrame) -> DataFrame:
    bad = lambda c: F.count_if(~R.is_long(F.col(c)))
    return ratings4(raw).agg(bad("u").alias("user_bad"), bad("m").alias("item_bad"), bad("r").alias("rating_bad"), bad("t").alias("ts_bad"))


def rating_range_report(raw: DataFrame, rules: Rules) -> DataFrame:
    r = long_of(F.col("r"))
    return ratings4(raw).agg(F.count_if(r.isNotNull() & ~r.between(*rules.ratings)).alias("out_of_range"), F.count_if(r.isNull()).alias("not_int"))


def ts_report(raw: DataFrame) -> DataFrame:
    t = long_of(F.col("t"))
    ok = (t > 0) & (t < 2_000_000_000)
    x = ratings4(raw).agg(F.min(F.when(ok, t)).alias("min_ts"), F.max(F.when(ok, t)).alias("max_ts"), F.count_if(ok).alias("valid"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("invalid"))
    day = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd")
    return x.select("*", day("min_ts").alias("min_day"), day("max_ts").alias("max_day"))


def exact_duplicates(raw: DataFrame) -> DataFrame:
    each = ratings4(raw).groupBy("u", "m", "r", "t").count()
    return each.agg(F.sum(F.col("count") - 1).alias("repeats"))


def conflicts(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Keys with more than one value: minimum and maximum differ."""
    return df.groupBy(*keys).agg(F.min(value).alias("a"), F.max(value).alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("keys"))


def key_conflicts(raw: DataFrame) -> DataFrame:
    f = F.col("f")
    users = fields(raw, "users", 5).select(R.at(f, 0).alias("id"), F.array_join(F.slice(f, 2, 4), "::").alias("v"))
    items = fields(raw, "movies", 3).select(R.at(f, 0).alias("id"), R.at(f, 1).alias("title"), F.array_join(F.slice(f, 2, 2), "::").alias("v"))
    parts = {"rating_by_key": conflicts(ratings4(raw), ["u", "m", "t"], F.col("r")), "user_attributes": conflicts(users, ["id"], F.col("v")), "item_attributes": conflicts(items, ["id"], F.col("v")), "title_ids": conflicts(items, ["title"], F.col("id"))}
    out = None
    for name, df in parts.items():
        row = df.select(F.lit(name).alias("probe"), "keys")
        out = row if out is None else out.union(row)
    return out


def distinct_counts(raw: DataFrame) -> DataFrame:
    """Two aggregations side by side rather than one that expands every row twice."""
    users, items = (ratings4(raw).select(c).distinct().agg(F.count("*").alias(n)) for c, n in (("u", "users"), ("m", "items")))
    return users.join(items)


def monthly_sketches(raw: DataFrame, size: int = 14) -> DataFrame:
    """(month, users, items): a HyperLogLog sketch of 2^size registers of each month's distinct ids, of ratings with a time before 2033. Sketches of months, and of later loads, merge."""
    timed = ratings4(raw).withColumn("ts", long_of(F.col("t"))).where(F.col("ts").between(1, 1_999_999_999))
    return timed.groupBy(F.date_format(F.timestamp_seconds("ts"), "yyyy-MM").alias("month")).agg(F.hll_sketch_agg("u", F.lit(size)).alias("users"), F.hll_sketch_agg("m", F.lit(size)).alias("items"))


def distinct_of_sketches(sketches: DataFrame) -> DataFrame:
    """(month, users, items): estimated distinct ids of each month, and of all by the sketches' union, with a null month."""
    each = sketches.select("month", *[F.hll_sketch_estimate(c).alias(c) for c in ("users", "items")])
    return each.union(sketches.agg(F.lit(None).cast("string").alias("month"), *[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in ("users", "items")]))


def value_distribution(raw: DataFrame, rules: Rules) -> DataFrame:
    f = F.col("f")
    sets = {"gender": (1, rules.genders), "age": (2, rules.ages), "occupation": (3, rules.occupations)}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("attribute"), R.at(f, i).alias("value"), R.at(f, i).isin(*ok).alias("legal")) for n, (i, ok) in sets.items()]))
    return fields(raw, "users", 5).select(each.alias("x")).groupBy("x.attribute", "x.value", "x.legal").agg(F.count("*").alias("n"))


def zip_report(raw: DataFrame) -> DataFrame:
    z = R.at(F.col("f"), 4)
    return fields(raw, "users", 5).agg(F.count_if(R.is_int(z)).alias("digits"), F.count_if(F.length(z) < 5).alias("short"), F.count_if(z.startswith("0")).alias("leading_zero"), F.count_if(~R.is_int(z)).alias("not_digits"))


def title_report(raw: DataFrame, rules: Rules) -> DataFrame:
    title, genres = R.at(F.col("f"), 1), R.at(F.col("f"), 2)
    year = F.nullif(F.regexp_extract(title, r"\(([0-9]{4})\)\s*$", 1), F.lit("")).cast("int")
    return fields(raw, "movies", 3).agg(F.count_if(R.is_blank(title)).alias("blank"), F.count_if(year.isNull()).alias("no_year"), F.count_if(year.isNotNull() & ~year.between(*rules.years)).alias("bad_year"), F.count_if(R.is_blank(genres)).alias("no_genre"))


def genre_histogram(raw: DataFrame, top: int = 30) -> DataFrame:
    g = fields(raw, "movies", 3).select(F.explode(F.split(R.at(F.col("f"), 2), "[|]", -1)).alias("g")).select(F.trim("g").alias("genre")).where("genre <> ''")
    return g.groupBy("genre").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "genre").limit(top)


def orphan_counts(raw: DataFrame) -> DataFrame:
    r = ratings4(raw)
    users, items = (fields(raw, k, w).select(R.at(F.col("f"), 0).alias("id")).distinct() for k, w in (("users", 5), ("movies", 3)))
    no_user = r.join(users, F.col("u") == F.col("id"), "left_anti").agg(F.count("*").alias("unknown_user"))
    return no_user.join(r.join(items, F.col("m") == F.col("id"), "left_anti").agg(F.count("*").alias("unknown_item")))


def valid_times(raw: DataFrame, rules: Rules, lo: int, hi: int) -> DataFrame:
    line = F.col("line")
    rows = raw.where((F.col("kind") == "ratings") & R.valid_rating_line(line, rules)).select(R.rating_time(line).alias("ts"))
    return rows.where(F.col("ts").between(lo, hi))


def monthly_histogram(raw: DataFrame, rules: Rules, lo: int, hi: int) -> DataFrame:
    return valid_times(raw, rules, lo, hi).groupBy(F.date_format(F.timestamp_seconds("ts"), "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def order_statistics(times: DataFrame, shares: list[float]) -> DataFrame:
    """(share, ts): the sorted times' element at int(n * share), from 0. Counts for each second are summed inside days and over days, so no task holds all seconds. The times are read once."""
    day = F.floor(F.col("ts") / 86400)
    seconds = stored(times.groupBy("ts").agg(F.count("*").alias("k")).withColumn("day", day), "seconds")
    days = seconds.groupBy("day").agg(F.sum("k").alias("k"))
    fronts = days.select("day", F.coalesce(F.sum("k").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("front"))
    up_to = seconds.withColumn("inside", F.sum("k").over(W.partitionBy("day").orderBy("ts"))).join(fronts, "day").select("ts", (F.col("front") + F.col("inside")).alias("upto"), (F.col("front") + F.col("inside") - F.col("k")).alias("before"))
    total = days.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"))
    asked = total.select("n", F.explode(F.array(*[F.lit(p) for p in shares])).alias("share")).select("share", F.least((F.col("n") * F.col("share")).cast("long"), F.col("n") - 1).alias("at"))
    return up_to.join(F.broadcast(asked), (F.col("before") <= F.col("at")) & (F.col("at") < F.col("upto"))).select("share", "ts")


def dirty_samples(raw: DataFrame, rules: Rules, n: int = 3) -> DataFrame:
    """(kind, defect, line): the n smallest lines of each class of defect."""
    f, kind = R.raw_fields(F.col("line")), F.col("kind")
    w, a = F.size(f), lambda i: R.at(f, i)
    is_r, is_u, is_m = (kind == "ratings") & (w == 4), (kind == "users") & (w == 5), (kind == "movies") & (w == 3)
    no = lambda c: ~F.coalesce(c, F.lit(False))
    classes = {
        "width": ((kind == "ratings") & (w != 4)) | ((kind == "users") & (w != 5)) | ((kind == "movies") & (w != 3)), "late_ts": is_r & F.coalesce(long_of(a(3)) > 2_000_000_000, F.lit(False)),
        "rating": is_r & no(long_of(a(2)).between(*rules.ratings)), "gender": is_u & ~a(1).isin(*rules.genders), "age": is_u & ~a(2).isin(*rules.ages), "occupation": is_u & ~a(3).isin(*rules.occupations),
        "year": is_m & ~R.has_year(a(1), rules), "genre": is_m & ~R.valid_genres(a(2), rules),
    }
    defects = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in classes.items()]))
    rows = raw.select("kind", "line", F.explode(defects).alias("defect"))
    place = F.row_number().over(W.partitionBy("kind", "defect").orderBy("line"))
    return rows.withColumn("place", place).where(F.col("place") <= n).select("kind", "defect", "place", "line")

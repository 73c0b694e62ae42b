"""Sources and sinks: raw lines, ids, typed tables, reports; and rating-shaped records made from the star schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import rules as R
from tidewater.operators.graph import stored_path

KINDS = ("ratings", "users", "movies")


def read_raw(spark: SparkSession, path: str, charset: str = "ISO-8859-1") -> DataFrame:
    """(kind, line, path) of the non-blank lines below path. kind is the first of rating, user, movie in a file's name and folder; other files are left out.
    Bytes that are no UTF-8 are read as U+FFFD, which detect_bad_decoding() counts; with other charsets bytes that they lack are an error."""
    text = F.make_valid_utf8("value") if charset.upper() in ("UTF-8", "UTF8") else F.decode(F.col("value").cast("binary"), charset)
    rows = spark.read.option("recursiveFileLookup", "true").text(path).select(text.alias("line"), F.col("_metadata.file_path").alias("path"))
    name = F.lower(F.concat_ws("/", F.element_at(F.split("path", "/"), -1), F.element_at(F.split("path", "/"), -2)))
    kind = F.when(name.contains("rating"), "ratings").when(name.contains("user"), "users").when(name.contains("movie"), "movies")
    return rows.withColumn("kind", kind).where(F.col("kind").isNotNull() & ~R.is_blank(F.col("line"))).select("kind", "line", "path")


def write_raw(raw: DataFrame, out: str, charset: str = "ISO-8859-1") -> None:
    """The lines of (kind, line) as text in a charset that keeps the newline's byte, a folder for each kind; read_raw() reads them back."""
    raw.select("kind", F.encode("line", charset).cast("string").alias("value")).write.mode("overwrite").partitionBy("kind").text(out)


def read_ids(raw: DataFrame, kind: str) -> DataFrame:
    """Distinct leading ids of the raw lines of a kind, as strings."""
    return raw.where(F.col("kind") == kind).select(R.leading_id(F.col("line")).alias("id")).where("id is not null").distinct()


def to_typed(lines: DataFrame, kind: str) -> DataFrame:
    """Typed rows of cleaned lines (line); those that fail to cast are left out."""
    return typed_columns(lines, kind).dropna()


def write_typed(lines: DataFrame, kind: str, out: str) -> dict[str, int]:
    """Writes to_typed() and counts in the same pass: lines, failed, and `no_<column>` for each column that some line has no value for."""
    typed = typed_columns(lines, kind)
    seen = Observation()
    missing = [F.col(c).isNull() for c in typed.columns]
    counts = [F.count("*").alias("lines"), F.count_if(reduce(lambda a, b: a | b, missing)).alias("failed"), *[F.count_if(m).alias(f"no_{c}") for c, m in zip(typed.columns, missing)]]
    typed.observe(seen, *counts).dropna().write.mode("overwrite").parquet(out)
    return seen.get


def typed_columns(lines: DataFrame, kind: str) -> DataFrame:
    """The columns of a kind's lines, null where a field is missing or fails to cast."""
    f = R.raw_fields(F.col("line"))
    number = lambda i, t: R.at(f, i).try_cast(t)
    if kind == "ratings":
        return lines.select(number(0, "bigint").alias("user_id"), number(1, "bigint").alias("item_id"), number(2, "int").alias("rating"), number(3, "bigint").alias("ts"))
    if kind == "users":
        return lines.select(number(0, "bigint").alias("user_id"), R.at(f, 1).alias("gender"), number(2, "int").alias("age"), number(3, "int").alias("occupation"), R.at(f, 4).alias("zip"))
    genres = F.filter(F.split(R.at(f, 2), "[|]"), lambda g: g != "")
    return lines.select(number(0, "bigint").alias("item_id"), F.trim(R.at(f, 1)).alias("title"), genres.alias("genres"))


def detect_bad_decoding(raw: DataFrame) -> DataFrame:
    return raw.groupBy("kind").agg(F.count("*").alias("lines"), F.sum(F.col("line").contains("�").cast("long")).alias("bad_lines"))


def write_clean(kept: DataFrame, quarantine: DataFrame, out: str) -> None:
    """A folder for each kind and one for the quarantine."""
    kept.select("kind", "line").write.mode("overwrite").partitionBy("kind").parquet(f"{out}/clean")
    quarantine.write.mode("overwrite").parquet(f"{out}/quarantine")


def write_report(report: DataFrame, out: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(out)


def write_profile(tables: dict[str, DataFrame], out: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")


def write_bucketed(df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
    """Writes the rows to a new table in buckets of a column, a sorted file each, and reads it. Tables in as many buckets of the same column are grouped and joined on it without a shuffle."""
    spark = df.sparkSession
    path = stored_path(spark, name)
    unique = path.rsplit("/", 1)[-1].replace("-", "_")
    df.repartition(buckets, by).write.format("parquet").option("path", path).bucketBy(buckets, by).sortBy(by).saveAsTable(unique)
    return spark.table(unique)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    seconds: Column = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    joined = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("o_custkey").alias("u"), F.col("l_partkey").alias("m"), (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("int").alias("r"), seconds.alias("ts"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 97).alias("h"))


def star_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, line): customers as users, parts as items, order lines as ratings, with every defect at fixed rates."""
    line = lambda *c, by="::": F.concat_ws(by, *[F.lit(x).cast("string") if not isinstance(x, Column) else x.cast("string") for x in c])
    u, m, r, ts, h = (F.col(c) for c in ("u", "m", "r", "ts", "h"))
    # One line of the fields as the defects leave them; concat_ws leaves out null ones.
    text = lambda c: c.cast("string")
    item = F.when(h == 5, text(m + 10000000)).otherwise(text(m))
    rating = F.when(h == 2, "9").when(h == 7, "x").when(h == 9, "").otherwise(text(r))
    time = F.when(h == 3, text(ts * 1000)).when(h == 6, "0").when(h == 4, None).otherwise(text(ts))
    more = F.when(h == 1, "EXTRA_FIELD").when(h == 8, "a")
    made = [text(u), item, rating, time, more]
    own = _events(spark, sf_dir).select("*", F.when(h == 0, F.concat_ws(",", *made)).otherwise(F.concat_ws("::", *made)).alias("own"))
    both = F.when(h == 20, F.array("own", "own")).when(h == 21, F.array(F.col("own"), line(u, m, r % 5 + 1, ts))).otherwise(F.array("own"))
    ratings = own.select(F.lit("ratings").alias("kind"), F.explode(both).alias("line"))

    c = F.col("c_custkey")
    gender, zip_ = F.when(c % 3 == 0, "F").otherwise("M"), F.lpad((F.col("c_nationkey") * 997).cast("string"), 5, "0")
    age = F.element_at(F.array(*[F.lit(a) for a in (1, 18, 25, 35, 45, 50, 56)]), (F.col("c_nationkey") % 7 + 1).cast("int"))
    job, k = c % 21, c % 41
    user = (
        F.when(k == 0, line(c, "X", 25, job, zip_)).when(k == 1, line(c, gender, 30, job, zip_)).when(k == 2, line(c, gender, 25, 99, zip_)).when(k == 3, line(c, gender, 25, job, ""))
        .when(k == 4, line(c, gender, 25, job, zip_, by="|")).when(k == 5, line(c, gender, 25, job)).otherwise(line(c, gender, age, job, zip_))
    )
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lit("users"), user)

    p, name = F.col("p_partkey"), F.col("p_name")
    title, t = F.concat(name, F.lit(" ("), (F.col("p_size") + 1940).cast("string"), F.lit(")")), F.col("p_type")
    genres = F.when(t == "ECONOMY", "Comedy|Romance").when(t == "MEDIUM", "Drama").when(t == "STANDARD", "Action|Sci-Fi|Thriller").when(t == "PROMO", "Horror").when(t == "SMALL", "Children's|Animation").otherwise("Western|War")
    k = p % 37
    item = (
        F.when(k == 0, line(p, name, genres)).when(k == 1, line(p, F.concat(name, F.lit(" (1700)")), genres)).when(k == 2, line(p, title, "UnknownGenre")).when(k == 3, line(p, title, ""))
        .when(k == 4, line(p, title, genres, by=",")).when(k == 5, line(p, title)).when(k == 6, line(p, title, F.concat(genres, F.lit("|")))).otherwise(line(p, title, genres))
    )
    items = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lit("movies"), item)
    return ratings.union(users).union(items)

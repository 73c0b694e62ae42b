import pytest
from pyspark.sql import functions as F

from tidewater.config import STAR, Rules
from tidewater.functions import rules as R


def ask(spark, column, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("s"))).collect()]


def test_separator(spark):
    assert ask(spark, R.normalize_separator, ["1::2", "1,2|3", "1|2:3", "1:2", "12", "1::2,3"]) == ["1::2", "1::2|3", "1::2:3", "1::2", "12", "1::2,3"]


def test_fields(spark):
    assert ask(spark, lambda s: R.split_fields(s, 2), ["1::2::EXTRA_FIELD", "1::2::3", "1::", ""]) == [["1", "2"], ["1", "2", "3"], ["1", ""], [""]]


def test_numbers(spark):
    values = ["5", "+5", "-1", " 5 ", "", "9" * 20, "x"]
    assert ask(spark, R.is_int, values) == [True, False, False, False, False, True, False]
    assert ask(spark, R.is_long, values) == [True, True, True, False, False, False, False]
    assert ask(spark, R.leading_id, ["12::a", "a12", ""]) == ["12", None, None]


def test_titles_and_genres(spark):
    assert ask(spark, R.has_year, ["A (1234) (1999)", "A (1999) tail", "A", "A (2010)", "A (2011)"]) == [False, True, False, True, False]
    assert ask(spark, R.valid_genres, ["|", "Action|", "|Action", "Action| Drama", "Action|Drama", " ", ""]) == [True, True, False, False, True, False, False]


def test_records(spark):
    rating = lambda s: R.valid_rating(R.raw_fields(s))
    assert ask(spark, rating, ["1::2::3::4", "1::2::6::4", "1::2::3", "1::2::99999999999::4", "a::2::3::4"]) == [True, False, False, False, False]
    user = lambda s: R.valid_user(R.raw_fields(s))
    assert ask(spark, user, ["1::M::25::0::z", "1::X::25::0::z", "1::M::30::0::z", "1::M::25::99::z"]) == [True, False, False, False]


@pytest.mark.parametrize(("ts", "sec", "ok"), [(956_000_000, 956_000_000, True), (1_048_000_000, 1_048_000_000, True), (10**12, 10**12, False), (10**12 + 1, 10**9, True)])
def test_times(spark, ts, sec, ok):
    row = spark.createDataFrame([(ts,)], "t long").select(R.normalize_epoch(F.col("t"), Rules()).alias("s")).select("s", R.valid_ts(F.col("s"), Rules())).first()
    assert tuple(row) == (sec, ok)


def test_empty_id_set_disables_the_check(spark):
    from tidewater.operators.govern import clean_ratings

    raw = spark.createDataFrame([("ratings", "1::2::3::800000000")], "kind string, line string")
    none, some = spark.createDataFrame([], "id string"), spark.createDataFrame([("9",)], "id string")
    assert [clean_ratings(raw, u, none, STAR).first()["reason"] for u in (none, some)] == [None, "unknown_user"]


def test_only_lines_and_ids_pass_the_id_joins(spark):
    from tidewater.operators.govern import clean_ratings

    raw = spark.createDataFrame([("ratings", "1::2::3::800000000")], "kind string, line string")
    ids = spark.createDataFrame([("1",), ("2",)], "id string")
    rows = clean_ratings(raw, ids, ids, STAR)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert " AS f#" not in plan[plan.index("Join") :] and rows.first()["reason"] is None


def test_valid_rating_line_equals_the_fields_rule(spark):
    lines = ["1::2::3::4", "1::2::3::-4", "1::2::3::+4\n", "1::2::3\n::4", "1::2::6::4", "1::2::99999999999::4", "1::2::3::99999999999999999999", "1::2::3", "1::2::3::4::5", "1::2:::3::4", "1::2::3:::4", "1:: 2::3::4", "::2::3::4", "1::2::3::", "١::2::3::4", "1,2,3,4", "", "1::2::3::4 ", "1::2::3::4\r"]
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    line = F.col("line")
    got = rows.select("line", R.valid_rating_line(line).alias("a"), R.valid_rating(R.raw_fields(line)).alias("b"), R.rating_time(line).alias("t"), R.at(R.raw_fields(line), 3).try_cast("bigint").alias("u")).collect()
    assert [r["line"] for r in got if r["a"]] == [r["line"] for r in got if r["b"]]
    assert all(r["t"] == r["u"] for r in got if r["a"])


def test_id_joins_of_scores_carry_no_lines(spark):
    from tidewater.config import STAR
    from tidewater.operators import govern as C

    raw = spark.createDataFrame([("ratings", "1::2::3::800000000"), ("users", "1::F::25::1::12345"), ("movies", "2::A (1990)::Drama")], "kind string, line string")
    score = C.score(raw, raw, STAR)
    todo, joined = [score._jdf.queryExecution().optimizedPlan()], []
    while todo:
        node = todo.pop()
        below = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join":
            joined += [x.output().apply(i).name() for x in below for i in range(x.output().size())]
        todo += below
    assert "lead0" in joined and not {"line", "f", "kind"} & set(joined)
    assert score.first()["overall"] == 100.0


def test_order_statistics_reads_the_times_once(spark):
    from tidewater.operators import probe as P

    seen = spark.sparkContext.accumulator(0)
    once = F.udf(lambda x: seen.add(1) or x, "long")
    times = spark.range(1000).select((once("id") * 1000).alias("ts"))
    got = {r["share"]: r["ts"] for r in P.order_statistics(times, [0.0, 0.5, 0.99]).collect()}
    assert got == {0.0: 0, 0.5: 500000, 0.99: 990000} and seen.value == 1000

"""The decision tree against a plain one, and tables and raw files that are written and read back."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidewater.operators import classify as L
from tidewater.plans.queries import star
from tidewater.sources import records as S

DIR = "/root/testdata/sf0.001"


def gini(y, w):
    p = (w * y).sum() / w.sum()
    return 2 * p * (1 - p)


def grow(x, y, w, depth, leaf):
    """Share of positive weight for each row: at each node the split between neighbouring values that lowers the Gini impurity most."""
    out = np.full(len(y), (w * y).sum() / w.sum())
    best, total = (1e-12, None), w.sum()
    if depth == 0:
        return out
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for cut in (values[:-1] + values[1:]) / 2:
            left = x[:, j] <= cut
            if min(left.sum(), (~left).sum()) >= leaf:
                gain = gini(y, w) - sum(w[m].sum() / total * gini(y[m], w[m]) for m in (left, ~left))
                if gain > best[0]:
                    best = (gain, left)
    if best[1] is not None:
        for m in (best[1], ~best[1]):
            out[m] = grow(x[m], y[m], w[m], depth - 1, leaf)
    return out


def plain_ap(y, score):
    hits = total = ap = 0.0
    for v in sorted(set(score), reverse=True):
        m = score == v
        hits, total = hits + y[m].sum(), total + m.sum()
        ap += y[m].sum() * hits / total
    return ap / y.sum()


@pytest.mark.parametrize("depth, leaf", [(1, 1), (3, 5), (5, 20), (None, 40)])
def test_tree_equals_a_plain_one(spark, depth, leaf):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(500, 4)), 1)
    x[:, 3] = rng.integers(0, 2, 500)
    y = (rng.random(500) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] * x[:, 3])))).astype(int)
    rows = spark.createDataFrame([(i, [float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, x array<double>, label int")
    train = L.balanced(rows.withColumn("features", array_to_vector("x"))).cache()
    scores = L.scored(L.train_tree(train, depth, leaf), train).select("id", "label", "score").cache()
    got = np.array([r.score for r in scores.orderBy("id").collect()])
    w = np.where(y == 1, 500 / (2 * y.sum()), 500 / (2 * (500 - y.sum())))
    want = grow(x, y, w, 30 if depth is None else depth, leaf)
    assert np.allclose(got, want) and len(set(got.round(9))) > 1
    assert np.isclose(L.average_precision(scores).first()[0], plain_ap(y, want.round(12)))


def test_metrics_by_group_equal_those_of_each_group(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([("ab"[i % 2], int(rng.random() < 0.4), float(round(rng.random(), 2))) for i in range(300)], "period string, label int, score double").cache()
    for metric in (L.average_precision, L.threshold_metrics):
        for r in metric(rows, by=("period",)).collect():
            alone = metric(rows.where(F.col("period") == r.period)).first()
            assert all(np.isclose(r[c], alone[c]) for c in alone.asDict())


def test_buckets_need_no_shuffle(spark):
    s = star(spark, DIR)
    a, b = (S.write_bucketed(s.cells, n, "user_id", 4) for n in ("a", "b"))
    both = a.groupBy("user_id").agg(F.sum("value").alias("total")).join(b.hint("merge"), "user_id")
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    want = s.cells.groupBy("user_id").agg(F.sum("value").alias("total")).join(s.cells, "user_id")
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, want.collect()))
    assert a.rdd.getNumPartitions() <= 8 and len({f.rsplit("/", 1)[-1] for f in a.inputFiles()}) <= 4


@pytest.mark.parametrize("charset", ["ISO-8859-1", "UTF-8"])
def test_raw_lines_round_trip_in_folders(spark, tmp_path, charset):
    rows = [("movies", "2::Café (1990)::Drama"), ("movies", "3::Ægir (1991)::War"), ("users", "1::F::25::3::é1"), ("ratings", "1::2::3::5")]
    S.write_raw(spark.createDataFrame(rows, "kind string, line string"), str(tmp_path / "a" / "raw"), charset)
    got = S.read_raw(spark, str(tmp_path / "a"), charset)
    assert sorted((r.kind, r.line) for r in got.collect()) == sorted(rows)
    assert S.detect_bad_decoding(S.read_raw(spark, str(tmp_path / "a"), "UTF-8")).agg(F.sum("bad_lines")).first()[0] == (3 if charset == "ISO-8859-1" else 0)

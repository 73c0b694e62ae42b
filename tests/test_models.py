"""Models, reductions, clusterings and sinks on small tables, against plain computations."""

import numpy as np
import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from tidewater.config import STAR
from tidewater.operators import classify as L
from tidewater.operators import cluster as K
from tidewater.operators import profile as FE
from tidewater.operators import reduce as D
from tidewater.plans.queries import star
from tidewater.sources import records as S

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def train(spark):
    s = star(spark, DIR)
    return L.balanced(L.feature_vectors(L.standardize(s.features), STAR).where("period = 'train'")).cache()


@pytest.fixture(scope="module")
def models(train):
    return {"lr": L.train_logreg(train, 0.1), "tree": L.train_tree(train, 4, 20)}


def test_feature_vectors_have_named_columns(spark, train):
    names = L.feature_names(STAR)
    r = train.first()
    x = r.features.toArray()
    assert len(names) == len(x) == 44 and np.isclose(x[0], r.z1) and np.isclose(x[1], r.z2)
    assert list(x[2:20]) == list(r.genres) and x[names.index("age")] == r.age_code
    assert x[names.index(r.gender)] == 1 and x[names.index(f"occupation_{r.occupation}")] == 1 and x[20 + 1 :].sum() == 2


def test_logreg_gradient_is_zero_at_the_solution(train, models):
    rows = train.select("features", "label", "weight").collect()
    x, y, w = np.array([r.features.toArray() for r in rows]), np.array([r.label for r in rows]), np.array([r.weight for r in rows])
    b, c = models["lr"].coefficients.toArray(), models["lr"].intercept
    p = 1 / (1 + np.exp(-(x @ b + c)))
    gradient = x.T @ (w * (p - y)) + b / 0.1
    assert abs(gradient).max() < 1e-2 and abs((w * (p - y)).sum()) < 1e-2


def test_top_features(models):
    for m in models.values():
        got = L.top_features(m, L.feature_names(STAR), 5)
        assert len(got) == 5 and [abs(v) for _, v in got] == sorted((abs(v) for _, v in got), reverse=True)


def test_predict_pairs_and_compare_models(spark, train, models):
    s = star(spark, DIR)
    known = train.select("user_id", "item_id").distinct().limit(20)
    pairs = known.union(spark.createDataFrame([(10**9, 1), (1, 10**9)], "user_id long, item_id long"))
    args = (pairs, s.split, s.typed("users"), s.typed("movies"), STAR)
    got = {(r.user_id, r.item_id): r for r in L.compare_models(models, *args).collect()}
    assert len(got) == 22
    want = {(r.user_id, r.item_id): r.score for r in L.scored(models["lr"], train).select("user_id", "item_id", "score").collect()}
    for key, r in got.items():
        if r.status == "ok" and key in want:
            assert np.isclose(r.prob_lr, want[key]) and r.pred_lr == (r.prob_lr >= 0.5) and r.agree == (r.pred_lr == r.pred_tree)
        elif r.status != "ok":
            assert r.prob_lr is None and r.pred_tree is None and r.agree is None
    assert got[10**9, 1].status == "unknown_user" and sum(r.status == "ok" for r in got.values()) >= 20


def test_explained_variance_projection_and_slices(spark):
    rows = star(spark, DIR).vectors
    x = np.array([r["x"] for r in rows.orderBy("id").collect()])
    y = x - x.mean(0)
    u, d, v = np.linalg.svd(y, full_matrices=False)
    m = D.fit(rows, 8, True, passes=25)
    assert abs(m["explained"] - (d[:8] ** 2).sum() / (d**2).sum()) < 2e-3
    four = D.leading(m, 4)
    assert four["components"].shape == (x.shape[1], 4) and abs(four["explained"] - (d[:4] ** 2).sum() / (d**2).sum()) < 2e-3
    z = np.array([r["coords"] for r in D.project(rows, m).orderBy("id").collect()])
    assert np.allclose(z, y @ m["components"]) and np.allclose(m["components"].T @ m["components"], np.eye(8), atol=1e-9)


def test_profile_vectors_are_sparse_and_whole(spark):
    cells = spark.createDataFrame([(1, 10, 4), (1, 30, 2), (3, 20, 5)], "user_id long, item_id long, value long")
    users = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "id long, idx long")
    items = spark.createDataFrame([(10, 0), (20, 1), (30, 2)], "id long, idx long")
    got = {r.user_id: r.vector for r in FE.profile_vectors(cells, users, items).collect()}
    assert got == {1: SparseVector(3, {0: 4.0, 2: 2.0}), 2: SparseVector(3, {}), 3: SparseVector(3, {1: 5.0})}


def test_kmeans_and_dbscan_grids(spark):
    r = np.random.default_rng(2)
    points = np.vstack([r.normal(c, 0.05, (40, 3)) for c in np.eye(3)])
    rows = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "id long, x array<double>")
    (labelled, cost), = K.kmeans_grid(rows, [3], n_init=3).values()
    assert sorted(x.n for x in K.cluster_sizes(labelled, 4).collect()) == [0, 40, 40, 40]
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    assert abs(cost - sum(((unit[i : i + 40] - unit[i : i + 40].mean(0)) ** 2).sum() for i in (0, 40, 80))) < 0.01
    grid = K.dbscan_grid(rows, [50, 90], [5])
    best = K.select_dbscan(grid).first()
    assert grid.count() == 2 and best.clusters == 3 and best.largest <= 40 and best.silhouette > 0.9


def test_dbscan_metrics_have_sizes_and_silhouette(spark):
    """Zero rows and noise take no part; a cluster of one row counts as 0."""
    r = np.random.default_rng(3)
    points = np.vstack([r.normal(c, 0.1, (n, 3)) for c, n in zip(np.eye(3), (20, 12, 1))] + [np.zeros((2, 3)), [[-1.0, -1, -1]]])
    rows = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "id long, x array<double>")
    own = np.r_[np.zeros(20, int), np.ones(12, int), 2, -1, -1, -1]
    labels = spark.createDataFrame([(i, int(c)) for i, c in enumerate(own)], "id long, cluster int")
    got = K.dbscan_metrics(labels, rows).first()
    x = points[:33] / np.linalg.norm(points[:33], axis=1)[:, None]
    d, c, each = 1 - x @ x.T, own[:33], []
    for i in range(32):
        a, b = d[i, c == c[i]].sum() / ((c == c[i]).sum() - 1), min(d[i, c == o].mean() for o in {0, 1, 2} - {int(c[i])})
        each.append((b - a) / max(a, b))
    assert (got.clusters, got.noise, got.sizes) == (3, round(1 / 34, 4), [20, 12, 1]) and abs(got.silhouette - sum(each) / 33) < 1e-5
    alone = K.dbscan_metrics(labels.withColumn("cluster", F.lit(-1)), rows).first()
    assert (alone.clusters, alone.noise, alone.sizes, alone.silhouette) == (0, 1.0, [], None)


def test_sources_and_sinks_round_trip(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "ratings.dat").write_bytes("1::2::3::978300760\n\n1::2::é::5\n".encode("latin-1"))
    (tmp_path / "raw" / "movies.dat").write_bytes("2::Café (1990)::Drama\n".encode("latin-1"))
    (tmp_path / "raw" / "notes.txt").write_text("nothing\n")
    raw = S.read_raw(spark, str(tmp_path / "raw"))
    assert sorted((r.kind, r.line) for r in raw.collect()) == [("movies", "2::Café (1990)::Drama"), ("ratings", "1::2::3::978300760"), ("ratings", "1::2::é::5")]
    kept, bad = raw.where("kind = 'movies'"), raw.where("kind = 'ratings'").withColumn("reason", F.lit("x"))
    S.write_clean(kept, bad.select("kind", "line", "reason"), str(tmp_path / "out"))
    assert [r.line for r in spark.read.parquet(f"{tmp_path}/out/clean/kind=movies").collect()] == ["2::Café (1990)::Drama"]
    assert spark.read.parquet(f"{tmp_path}/out/quarantine").count() == 2
    S.write_report(spark.range(1).select(F.lit(0.5).alias("score")), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().score == 0.5
    tables = {"a": spark.range(3), "b": spark.range(2)}
    S.write_profile(tables, str(tmp_path / "profile"))
    assert {n: spark.read.parquet(f"{tmp_path}/profile/{n}").count() for n in tables} == {"a": 3, "b": 2}


def test_pairs_of_blocks_copy_each_row_once_a_block(spark):
    rows = spark.createDataFrame([(i, [float(i % 7) + 1, 1.0]) for i in range(120)], "id long, x array<double>")
    assert K._pairs(rows, 20).count() == 120 * 6  # with both sides of every ordered pair 1440
    assert K._blocks(rows, None) == 1 and K._blocks(rows.crossJoin(spark.range(200).select(F.col("id").alias("copy"))).select("id", "x"), None) == 8


def test_features_without_attributes_and_moments_equal_those_of_events(spark):
    s = star(spark, DIR)
    plain = s.features.select("period", "label", "f1", "f2")
    own = L.history_features(s.split)
    assert sorted(own.collect()) == sorted(plain.collect())
    want = plain.where("period = 'train'").agg(F.avg("f1"), F.stddev_pop("f1"), F.avg("f2"), F.stddev_pop("f2")).first()
    assert np.allclose(list(L.train_moments(s.split).select("m_f1", "s_f1", "m_f2", "s_f2").first()), list(want), rtol=1e-9)
    one = spark.createDataFrame([(1, 2, 5, "train"), (3, 4, 5, "train")], "user_id long, item_id long, rating int, period string")
    assert tuple(L.train_moments(one).select("s_f1", "s_f2").first()) == (0.0, 0.0)


def test_pairs_train_only_the_model_they_ask(spark, monkeypatch):
    from tidewater.plans.queries import QUERIES

    monkeypatch.setattr(L, "train_tree", lambda *a: pytest.fail("no tree is asked"))
    got = QUERIES["predict_pairs"](spark, DIR)
    assert got.where("(status = 'ok') <> (prob is not null)").count() == 0 and got.where("prob is not null").count() > 0


def test_user_rows_join_items_alone_and_equal_the_plain_means(spark):
    s = star(spark, "/root/testdata/sf0.001")
    assert "Join" not in s.cells._jdf.queryExecution().optimizedPlan().toString()
    plain = FE.user_item_cells(s.split).where("period = 'train'").drop("period")
    assert sorted(map(tuple, s.cells.collect())) == sorted(map(tuple, plain.collect()))
    g = plain.join(s.typed("movies").select("item_id", F.explode("genres").alias("genre")), "item_id")
    want = g.groupBy("user_id").agg(*[F.coalesce(F.avg(F.when(F.col("genre") == n, F.col("value"))), F.lit(0.0)).alias(n) for n in sorted(STAR.genres)])
    assert {r["id"]: r["x"] for r in s.user_rows.collect()} == {r[0]: list(r[1:]) for r in want.collect()}

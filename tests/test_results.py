"""The stored results, counts in the writing pass, mergeable sketches and vectors without Python."""

from pyspark.sql import functions as F

from tidewater.operators import probe as P
from tidewater.operators import profile as FE
from tidewater.operators import results as G
from tidewater.plans.queries import star
from tidewater.sources import records as S

DIR = "/root/testdata/sf0.001"


def grid(spark, rows, version="v1"):
    return G.rows_of(spark.createDataFrame(rows, "k int, silhouette double, sse double"), "cluster", "kmeans", ["k"], ["k", "silhouette", "sse"], version, "k")


def test_a_rerun_replaces_its_own_ids_alone(spark, tmp_path):
    path = f"{tmp_path}/results"
    G.record(path, grid(spark, [(5, 0.1, 9.0), (6, 0.3, 8.0)]))
    G.record(path, G.rows_of(spark.createDataFrame([(2, 0.5, 0.7), (10, 0.8, 0.4)], "dim int, evr double, error double"), "reduce", "pca", ["dim"], ["dim", "evr", "error"], "v1", "dim"))
    before = {r.artifact_id: (r.version, r.metrics) for r in G.read_results(spark, path).collect()}
    G.record(path, grid(spark, [(6, 0.05, 7.0)], "v2"))
    after = {r.artifact_id: (r.version, r.metrics) for r in G.read_results(spark, path).collect()}
    assert G.read_results(spark, path).count() == 4 and before.keys() == after.keys()
    assert after["cluster/kmeans/k=6"] == ("v2", {"k": 6.0, "silhouette": 0.05, "sse": 7.0})
    assert all(after[k] == before[k] for k in before if k != "cluster/kmeans/k=6")
    seen = {(r.algorithm, r.params): r.selected for r in G.results_overview(G.read_results(spark, path), {("cluster", "kmeans"): "silhouette", ("reduce", "pca"): "evr"}).collect()}
    assert seen == {("kmeans", "k=5"): True, ("kmeans", "k=6"): False, ("pca", "dim=2"): False, ("pca", "dim=10"): True}
    r = G.read_results(spark, path)
    assert [tuple(x) for x in G.reduction_row(r, "pca", 10).collect()] == [("pca", 10, 0.8, 0.4, "ok")]
    assert G.reduction_row(r, "pca", 11).first().status == "not_registered"


def test_casts_are_counted_while_writing(spark, tmp_path):
    lines = spark.createDataFrame([("1::2::3::4",), ("x::2::3::4",), ("1::2::y::z",), ("1::2::3",)], "line string")
    assert S.write_typed(lines, "ratings", f"{tmp_path}/ratings") == {"lines": 4, "failed": 3, "no_user_id": 1, "no_item_id": 0, "no_rating": 1, "no_ts": 2}
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/ratings").collect()] == [(1, 2, 3, 4)]


def test_union_of_monthly_sketches_is_near_the_exact_count(spark):
    raw = star(spark, DIR).raw
    all_ = P.distinct_of_sketches(P.monthly_sketches(raw)).where("month is null").first()
    timed = P.ratings4(raw).withColumn("ts", P.long_of(F.col("t"))).where(F.col("ts").between(1, 1_999_999_999))
    exact = timed.agg(F.count_distinct("u").alias("users"), F.count_distinct("m").alias("items")).first()
    assert abs(all_.users - exact.users) <= 0.03 * exact.users and abs(all_.items - exact.items) <= 0.03 * exact.items


def test_profile_vectors_pass_no_python(spark):
    cells = spark.createDataFrame([(1, 10, 4), (1, 30, 2)], "user_id long, item_id long, value long")
    users, items = spark.createDataFrame([(1, 0), (2, 1)], "id long, idx long"), spark.createDataFrame([(10, 0), (30, 1)], "id long, idx long")
    plan = FE.profile_vectors(cells, users, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_grids_are_fitted_for_the_queries_that_read_them(spark, monkeypatch):
    """A query of the reductions waits for no classifier or clustering; a grid is recorded once."""
    from tidewater.plans import queries as Q

    s, made = Q.Star(spark, "/root/testdata/sf0.001"), []
    fitted = Q._fitted(s)
    monkeypatch.setattr(Q, "_fitted", lambda star: {n: (lambda n=n, f=f: made.append(n) or f()) for n, f in fitted.items()})
    rows = {(r.algorithm, r.dim): r.status for r in Q._results_reduction(s).collect()}
    assert made == ["pca", "svd"] and rows == {("pca", 10): "ok", ("svd", 50): "ok", ("pca", 12): "not_registered"}
    assert s.results("pca").where("algorithm = 'pca'").count() == len(Q.DIMS) and made == ["pca", "svd"]

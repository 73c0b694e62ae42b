"""Sparse reductions, k-means, neighbours and DBSCAN grids against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import cluster as K
from tidewater.operators import kmeans as KM
from tidewater.operators import neighbours as N
from tidewater.operators import reduce as D
from tidewater.operators import sparse as SP
from tidewater.operators.order import ranked


def table(rng, n, columns, filled, groups=0):
    x = np.where(rng.random((n, columns)) < filled, rng.integers(1, 6, (n, columns)), 0).astype(float)
    for g in range(groups):
        own = np.arange(g, n, groups)
        x[own] = 0
        x[np.ix_(own, np.arange(g * 6, g * 6 + 6))] = rng.integers(3, 6, (len(own), 6))
    return x


def frame(spark, x, period=None):
    rows = [(*([] if period is None else [period]), i, np.flatnonzero(v).tolist(), v[v != 0].tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, ("" if period is None else "period string, ") + "id long, idx array<int>, val array<double>")


def unit(x):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


@pytest.mark.parametrize("centred", [True, False])
def test_reduction_of_sparse_rows_equals_exact(spark, centred):
    x = table(np.random.default_rng(1), 300, 80, 0.1, groups=5)
    x[7] = 0
    y = x - x.mean(0) if centred else x
    u, s, v = np.linalg.svd(y, full_matrices=False)
    m = D.fit(frame(spark, x), 4, centred, width=80, passes=15)
    assert m["components"].shape == (80, 4) and np.allclose(np.abs(np.sum(m["components"] * v[:4].T, axis=0)), 1, atol=1e-6)
    assert abs(m["error"] - np.sqrt(1 - (s[:4] ** 2).sum() / (s**2).sum())) < 1e-6
    assert abs(m["explained"] - (y @ m["components"]).var(0).sum() / x.var(0).sum()) < 1e-9
    z = {r.id: r.coords for r in D.project(frame(spark, x), m).collect()}
    assert np.allclose([z[i] for i in range(300)], y @ m["components"])


def test_kernels(spark):
    rng = np.random.default_rng(2)
    x, right, left = table(rng, 50, 30, 0.2), rng.normal(size=(30, 7)), rng.normal(size=(50, 4))
    x[[0, 10, 49]] = 0
    m = SP.csr_of(frame(spark, x).toArrow())
    out = np.zeros((30, 4))
    old, SP.HELD = SP.HELD, 60
    try:
        SP.add_transposed(out, m, left)
        assert np.allclose(SP.times(m, right), x @ right) and np.allclose(out, x.T @ left)
    finally:
        SP.HELD = old


def plain_silhouette(x, labels):
    ok = (labels >= 0) & (np.linalg.norm(x, axis=1) > 0)
    x, labels = unit(x[ok]), labels[ok]
    if len(x) < 2 or len(set(labels)) < 2:
        return None
    d, out = 1 - x @ x.T, []
    for i, own in enumerate(labels):
        n = (labels == own).sum()
        if n == 1:
            out.append(0.0)
            continue
        a, b = d[i, labels == own].sum() / (n - 1), min(d[i, labels == c].mean() for c in set(labels) - {own})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(out))


def test_kmeans_runs_find_planted_groups_in_all_periods(spark):
    rng = np.random.default_rng(3)
    tables = {p: table(rng, 120, 40, 0.0, groups=g) for p, g in (("train", 4), ("val", 5))}
    tables["train"][:3] = 0
    rows = frame(spark, unit(tables["train"]), "train").union(frame(spark, unit(tables["val"]), "val"))
    grid, centres = KM.fit_runs(rows, 40, [4, 5], seeds=5)
    assert len(grid) == 20
    best = {r[:2]: r for r in KM.best_runs(grid)}
    for (period, k), r in best.items():
        x = unit(tables[period])
        labels = np.array([c.cluster for c in KM.labels_of(rows.where(F.col("period") == period), centres[KM.Run(*r[:3])]).orderBy("id").collect()])
        cost = sum(((x[labels == c] - x[labels == c].mean(0)) ** 2).sum() for c in set(labels))
        assert abs(r[3] - cost) < 0.01 and abs(r[4] - plain_silhouette(x, labels)) < 1e-9 and r[5] == np.bincount(labels, minlength=k).tolist()
        assert r[3] == min(g[3] for g in grid if g[:2] == (period, k))
    sets = lambda period: {frozenset(range(g, 120, n)) for n in [{"val": 5, "train": 4}[period]] for g in range(n)}
    got = KM.labels_of(rows.where("period = 'val'"), centres[KM.Run(*best["val", 5][:3])]).collect()
    assert {frozenset(r.id for r in got if r.cluster == c) for c in range(5)} == sets("val")


def test_kmeans_costs_no_more_than_single_fits(spark):
    x = unit(table(np.random.default_rng(4), 200, 30, 0.15))
    grid, _ = KM.fit_runs(frame(spark, x, "train"), 30, [5], seeds=10)
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").withColumn("features", array_to_vector("x")).cache()
    single = min(KMeans(k=5, seed=s).fit(data).summary.trainingCost for s in range(5))
    assert min(g[3] for g in grid) <= single * 1.02


def plain_dbscan(x, eps, ms):
    live = np.flatnonzero(np.linalg.norm(x, axis=1) > 0)
    y = unit(x[live])
    near = np.maximum(1 - y @ y.T, 0) <= eps + 1e-12
    core, labels, k = near.sum(1) >= ms, np.full(len(x), -1), 0
    for s in range(len(live)):
        if core[s] and labels[live[s]] < 0:
            stack = [s]
            labels[live[s]] = k
            while stack:
                for j in np.flatnonzero(near[stack.pop()] & core):
                    if labels[live[j]] < 0:
                        labels[live[j]] = k
                        stack.append(j)
            k += 1
    for s in np.flatnonzero(~core):
        own = labels[live[np.flatnonzero(near[s] & core)]]
        labels[live[s]] = own.min() if len(own) else -1
    return labels


@pytest.mark.parametrize("block", [7, 512])
def test_pairs_knn_and_dbscan_settings(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rng = np.random.default_rng(5)
    x = np.r_[table(rng, 90, 40, 0.12), table(rng, 60, 40, 0.0, groups=4)]
    x[[3, 50]] = 0
    x[100:104] = x[99]
    rows = N.unit_sparse(frame(spark, x)).cache()
    live = np.flatnonzero(np.linalg.norm(x, axis=1) > 0)
    reps, _ = N.classes(rows)
    ids = np.array([r.first for r in reps.orderBy("rep").select("first").collect()])
    assert ids.tolist() == sorted(set(live.tolist()) - {100, 101, 102, 103})
    s = unit(x[ids]) @ unit(x[ids]).T
    for least in (0.9, 0.5, 0.2):
        pairs, compared = N.cosine_pairs(reps, least)
        want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(s >= least, 1)))}
        assert {(r.a, r.b) for r in pairs.collect()} == want and len(want) <= compared < len(ids) * (len(ids) - 1) // 2
    d = np.maximum(1 - unit(x[live]) @ unit(x[live]).T, 0)
    np.fill_diagonal(d, np.inf)
    got = {(r.k, r.id): r.distance for r in N.sparse_knn(rows, [1, 5]).collect()}
    assert got.keys() == {(k, int(i)) for k in (1, 5) for i in live}
    assert all(abs(got[k, int(i)] - np.sort(d[n])[k - 1]) < 1e-9 for k in (1, 5) for n, i in enumerate(live))
    settings = [(e, m) for e in (0.05, 0.2, 0.45) for m in (3, 6)]
    labels = N.dbscan_settings(rows, settings).cache()
    spread = {(r.eps, r.min_samples): r.silhouette for r in N.sparse_silhouette(rows, labels).collect()}
    for e, m in settings:
        own = np.full(len(x), -9)
        for r in labels.where((F.col("eps") == e) & (F.col("min_samples") == m)).collect():
            own[r.id] = r.cluster
        want = plain_dbscan(x, e, m)
        assert (own == want).all()
        plain = plain_silhouette(x, want)
        assert spread[e, m] is None if plain is None else abs(spread[e, m] - plain) < 1e-9
    dense = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    assert [r.cluster for r in K.dbscan(dense, 0.2, 3).orderBy("id").collect()] == plain_dbscan(x, 0.2, 3).tolist()


def test_dense_graphs_and_wide_settings(spark):
    rng = np.random.default_rng(7)
    x = np.abs(1 + 0.2 * rng.normal(size=(300, 12)))
    x[0] = 0
    rows = N.unit_sparse(frame(spark, x))
    settings = [(0.02, 5), (0.3, 5), (1.0, 5), (1.0, 400)]
    got = N.dbscan_settings(rows, settings).cache()
    for e, m in settings:
        own = {r.id: r.cluster for r in got.where((F.col("eps") == e) & (F.col("min_samples") == m)).collect()}
        assert [own[i] for i in range(300)] == plain_dbscan(x, e, m).tolist()
    small = frame(spark, np.eye(3)[:, :2])
    assert N.sparse_knn(small, [1, 5]).where("k = 5").count() == 0 and [r.distance for r in N.sparse_knn(small, [1]).collect()] == [1.0, 1.0]


def test_periods_are_apart(spark):
    rng = np.random.default_rng(8)
    a, b = table(rng, 60, 30, 0.15), table(rng, 60, 30, 0.0, groups=3)
    rows = N.unit_sparse(frame(spark, a, "a").union(frame(spark, b, "b")))
    got = N.dbscan_settings(rows, [(0.3, 3), (0.6, 3)]).collect()
    for period, x in (("a", a), ("b", b)):
        for e in (0.3, 0.6):
            own = {r.id: r.cluster for r in got if r.period == period and r.eps == e}
            assert [own[i] for i in range(60)] == plain_dbscan(x, e, 3).tolist()


def test_ranked(spark):
    rng = np.random.default_rng(6)
    ids = rng.integers(-(2**62), 2**62, 5000).tolist()
    got = ranked(spark.createDataFrame([(i,) for i in ids], "id long").repartition(7), "id").orderBy("place").collect()
    assert [r.place for r in got] == list(range(5000)) and [r.id for r in got] == sorted(ids)
    assert ranked(spark.createDataFrame([], "id long"), "id").count() == 0


def test_kmeans_in_groups_of_runs_is_the_same(spark, monkeypatch):
    """No more centres are held than the bound, or one run's."""
    x = unit(table(np.random.default_rng(6), 150, 40, 0.2))
    rows = frame(spark, x, "train").union(frame(spark, x[:90], "val"))
    grid, centres = KM.fit_runs(rows, 40, [3, 4], seeds=2)
    held = []
    plain = KM._stacked
    monkeypatch.setattr(KM, "CENTRES", 300)
    monkeypatch.setattr(KM, "_stacked", lambda runs, c: held.append(sum(c[r].size for r in runs)) or plain(runs, c))
    again, other = KM.fit_runs(rows, 40, [3, 4], seeds=2)
    assert again == grid and max(held) <= 300 and all(np.allclose(other[r], centres[r]) for r in centres)


@pytest.mark.parametrize("centred", [True, False])
def test_reduction_in_slices_equals_exact(spark, monkeypatch, centred):
    x = table(np.random.default_rng(1), 200, 60, 0.1, groups=5)
    x[7] = 0
    monkeypatch.setattr(D, "SLICE", 800)  # 60 x 13 fits 800 only in slices of rows, 200 x 4
    monkeypatch.setattr(D, "SPAN", 5)
    y = x - x.mean(0) if centred else x
    u, s, v = np.linalg.svd(y, full_matrices=False)
    m = D.fit(frame(spark, x), 4, centred, width=62, extra=9, passes=4)
    assert not isinstance(m["components"], np.ndarray) and np.allclose(m["values"], s[:4] ** 2, rtol=1e-3)
    w = np.zeros((62, 4))
    for r in m["components"].collect():
        w[r.id] = r.x
    assert np.allclose(w.T @ w, np.eye(4), atol=1e-9) and (w[np.abs(w).argmax(0), np.arange(4)] > 0).all()
    z = {r.id: r.coords for r in D.project(frame(spark, x), D.leading(m, 2)).collect()}
    want = (np.pad(x, ((0, 0), (0, 2))) - (np.pad(x, ((0, 0), (0, 2))).mean(0) if centred else 0)) @ w[:, :2]
    assert len(z) == 200 and np.allclose([z[i] for i in range(200)], want, atol=1e-9)
    items = spark.createDataFrame([(i + 1000, i) for i in range(62)], "id long, idx int")
    got = {(r.component, r.item_id): r.loading for r in D.loadings(m, items).collect()}
    assert len(got) == 248 and all(np.isclose(got[c, i + 1000], w[i, c]) for i in range(62) for c in range(4))
    plain = D.leading(m, 2)
    assert np.isclose(plain["error"], np.sqrt(1 - (s[:2] ** 2).sum() / (s**2).sum()), atol=1e-4)


def test_short_items_share_pieces(spark, monkeypatch):
    """A piece for each item would cost a call each: short ones share pieces of bounded pairs, and compare each pair once."""
    monkeypatch.setattr(N, "PAIRS", 1 << 9)
    monkeypatch.setattr(N, "HELD", 100)
    x = table(np.random.default_rng(9), 200, 300, 0.03)
    reps, _ = N.classes(N.unit_sparse(frame(spark, x)))
    index = N.Index(reps, 0.1)
    pieces = index.over(lambda g: g.select(["piece", "rep"]).slice(0, 1), "piece long, rep long").count()
    assert 1 < pieces <= 12 < index.blocks.count() / 10
    ids = np.array([r.first for r in reps.orderBy("rep").select("first").collect()])
    s = unit(x[ids]) @ unit(x[ids]).T
    pairs, compared = N.cosine_pairs(reps, 0.1)
    got = {(r.a, r.b): r.cosine for r in pairs.collect()}
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(s >= 0.1, 1)))}
    assert got.keys() == want and len(got) == pairs.count() and all(abs(got[p] - s[p]) < 1e-12 for p in want)
    assert len(want) <= compared <= np.triu(s > 0, 1).sum()


def test_rows_are_copied_once_a_block_and_levels_nest(spark, monkeypatch):
    """Not once for each of their items; components of a level start from those before."""
    monkeypatch.setattr(N, "BLOCK", 70)
    x = table(np.random.default_rng(9), 200, 300, 0.05)
    reps, _ = N.classes(N.unit_sparse(frame(spark, x)))
    held = N.Index(reps, 0.0).over(lambda g: g.select(["piece", "rep"]), "piece long, rep long").groupBy("rep").count()
    assert {r["count"] for r in held.collect()} == {-(-reps.count() // 70)}
    links = spark.createDataFrame([(0, 5, 3, 0), (0, 9, 8, 0), (1, 5, 9, 0), (0, 9, 5, 1), (0, 2, 1, 1), (0, 3, 1, 2)], "setting long, a long, b long, level long")
    got = [{(r.node // 2, r.node % 2): r.root // 2 for r in level.collect()} for level in N.nested_components(links, 2, 3)]
    first = {(5, 0): 3, (3, 0): 3, (9, 0): 8, (8, 0): 8, (5, 1): 5, (9, 1): 5}
    second = first | {(9, 0): 3, (8, 0): 3, (2, 0): 1, (1, 0): 1}
    assert got == [first, second, {k: 5 if k[1] else 1 for k in second}]


def test_products_hold_few_entries_at_once(monkeypatch):
    """Not all rows of a task, whose product with all slices would be held beside them."""
    held, times = [], D.times
    monkeypatch.setattr(D, "TAKEN", 50)
    monkeypatch.setattr(D, "times", lambda m, right: held.append(len(m.idx)) or times(m, right))
    rng = np.random.default_rng(3)
    x, right = table(rng, 90, 20, 0.2), rng.normal(size=(20, 5))
    rows = [(i, np.flatnonzero(v).tolist(), v[v > 0].tolist()) for i, v in enumerate(x)]
    schema = D.pa.schema([("id", D.pa.int64()), ("idx", D.pa.list_(D.pa.int32())), ("val", D.pa.list_(D.pa.float64()))])
    batches = [D.pa.RecordBatch.from_arrays([D.pa.array(c, t) for c, t in zip(zip(*rows[k : k + 5]), schema.types)], schema=schema) for k in range(0, 90, 5)]

    class Sent:
        def __init__(self, value):
            self.value = value

    out = list(D._times_batches(iter(batches), [Sent(right[:, :3]), Sent(right[:, 3:])], 5))
    assert max(held) < 50 + max(len(b["idx"].flatten()) for b in batches)
    assert [i for b in out for i in b["id"].to_pylist()] == list(range(90)) and np.allclose(np.concatenate([D._matrix(b) for b in out]), x @ right)


def test_runs_take_the_places_of_done_ones(spark, monkeypatch):
    """With groups that are fitted one after the other, each would scan until its slowest run is done."""
    x = unit(table(np.random.default_rng(6), 150, 40, 0.2))
    scans, plain = [], KM._sums
    monkeypatch.setattr(KM, "CENTRES", 4 * 40 * 3)
    monkeypatch.setattr(KM, "_sums", lambda rows, columns, centres: scans.append(len(centres)) or plain(rows, columns, centres))
    grid, centres = KM.fit_runs(frame(spark, x, "train"), 40, [4], seeds=9)
    assert [r[2] for r in grid] == list(range(9)) and len(centres) == 9
    # All scans are full while runs wait.
    assert scans[0] == 3 and scans == sorted(scans, reverse=True)
    parts = KM.parts_of({"a": np.arange(3000.0), "b": np.ones(5)})
    both = SP._add_parts(SP.pa.Table.from_batches([parts, parts]))
    assert sorted((n, b, sum(v)) for n, b, v in zip(*(both[c].to_pylist() for c in ("name", "block", "values")))) == sorted((n, b, 2 * sum(v)) for n, b, v in zip(*(parts[c].to_pylist() for c in ("name", "block", "values"))))

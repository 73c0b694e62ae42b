"""Near-duplicate embeddings against all pairs."""

import numpy as np
import pytest

from tidewater.llm import pq

VECTORS = "vec_id long, embedding array<double>"


def all_pairs(ids, x, least=0.95):
    x = x / np.abs(x).max(1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= least
    root = np.arange(len(x))
    while True:
        now = np.array([root[n].min() for n in near])
        now = np.minimum(now, root)
        if (now == root).all():
            break
        root = now
    low = [ids[root == root[i]].min() for i in range(len(x))]
    return {int(i): (int(i), int(n) - 1, int(c), int(i) == int(c)) for i, n, c in zip(ids, near.sum(1), low)}


def found(spark, ids, x, **more):
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], VECTORS)
    return {r[0]: tuple(r) for r in pq.near_vectors(df, **more).collect()}


def near_copies(rng, x, cosines):
    """For each cosine a row turned by exactly that much."""
    base = x[: len(cosines)] / np.linalg.norm(x[: len(cosines)], axis=1, keepdims=True)
    turn = rng.normal(size=base.shape)
    turn -= (turn * base).sum(1, keepdims=True) * base
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    return cosines[:, None] * base + np.sqrt(1 - cosines**2)[:, None] * turn


@pytest.mark.parametrize("dimensions, rows", [(64, 3000), (64, 300), (8, 1500), (2, 400), (1, 30)])
def test_links_and_components(spark, dimensions, rows):
    rng = np.random.default_rng(dimensions + rows)
    x = rng.normal(size=(rows, dimensions))
    if dimensions > 8:
        x = np.r_[x, near_copies(rng, x, rng.uniform(0.94, 1, rows // 2))]
    ids = rng.permutation(len(x) * 3)[: len(x)]
    assert found(spark, ids, x) == all_pairs(ids, x)


def test_recall_at_the_threshold_itself(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 64))
    x = np.r_[x, near_copies(rng, x, np.full(2000, 0.9501))]
    got = found(spark, np.arange(4000), x)
    assert sum(r[1] for r in got.values()) >= 0.99 * 4000


def test_large_group_of_near_copies_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(pq, "BLOCK", 64)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=32)
    x = np.r_[centre + rng.normal(size=(500, 32)) * 0.1, rng.normal(size=(500, 32)), -centre + rng.normal(size=(200, 32)) * 0.24]
    ids = rng.permutation(1200)
    assert found(spark, ids, x) == all_pairs(ids, x)


def test_copies_count_each(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 16))
    x = np.r_[x, np.repeat(x[:2], 1200, 0), near_copies(rng, x, np.array([0.97, 0.99]))]
    ids = rng.permutation(len(x))
    assert found(spark, ids, x) == all_pairs(ids, x)


@pytest.mark.parametrize("scale", [1e-300, 1e-6, 1e6, 1e300])
def test_magnitudes(spark, scale):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(100, 16)) + 1.0
    assert found(spark, np.arange(100), x * scale) == all_pairs(np.arange(100), x)


def test_nulls_zeros_lengths_repeats_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.01]), (11, [0.0, 1.0]), (11, [-1.0, 0.0]), (11, [-1.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], VECTORS + ", list int, n int, vector string, copies int")
    alone = {i: (i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 11)}
    assert {r[0]: tuple(r) for r in pq.near_vectors(df).collect()} == alone | {1: (1, 2, 1, True), 2: (2, 2, 1, False), 10: (10, 2, 1, False)}


def test_empty_table_and_no_usable_vector(spark):
    assert pq.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []
    assert [tuple(r) for r in pq.near_vectors(spark.createDataFrame([(1, [0.0])], VECTORS)).collect()] == [(1, 0, 1, True)]


def test_table_distances_equal_distances_to_decoded_members():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 20))
    m = pq.fit(x, 6, 0.3, 1)
    rest = x - m["centroids"][0]
    codes = np.stack([pq.nearest(rest[:, a:b], k) for a, b, k in zip(m["parts"], m["parts"][1:], m["books"])], 1)
    decoded = m["centroids"][0] + np.concatenate([k[codes[:, i]] for i, k in enumerate(m["books"])], 1)
    want = ((x[:50, None, :] - decoded[None, :, :]) ** 2).sum(2)
    assert np.allclose(pq.table_distances(x[:50], m["centroids"][0], codes, m["books"], m["parts"]), want)

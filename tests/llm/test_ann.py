"""Nearest neighbours against brute force: large, small and odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import ann

SCHEMA = "vec_id long, embedding array<double>, label int, vector string, leaf int, tree int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "v", 2, 3) for r in rows], SCHEMA)


def found_by(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(x) for q, x in got.items()}


def nearest(ids, x, query, k=20):
    s = x @ x[ids.index(query)]
    return [ids[i] for i in np.lexsort((ids, -s)) if ids[i] != query][:k]


def test_recall_ties_and_odd_vectors(spark):
    x = np.random.default_rng(1).normal(size=(3000, 16)).round(3)
    x[100:140] = x[100]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(9000, None), (9020, [0.0] * 16), (9040, [float("nan")] * 16), (9060, [None] * 16), (None, [1.0] * 16), (9080, []), (9100, [1.0, float("inf")] * 8), (20, rows[20][1])]
    got = found_by(ann.search(frame(spark, rows + odd), F.col("vec_id") % 20 == 0))
    assert sorted(got) == list(range(0, 3000, 20))
    hits = 0
    for q, own in got.items():
        assert [r for r, _, _ in own] == list(range(1, 21)) and len({v for _, v, _ in own}) == 20 and q not in {v for _, v, _ in own}
        assert all(np.isclose(s, x[v] @ x[q], rtol=0, atol=1e-12) for _, v, s in own) and [(-s, v) for _, v, s in own] == sorted((-s, v) for _, v, s in own)
        hits += len({v for _, v, _ in own} & set(nearest(list(range(3000)), x, q)))
    assert hits / (20 * len(got)) >= 0.9
    assert [v for _, v, _ in got[100]] == list(range(101, 121))


@pytest.mark.parametrize("n", [1, 2, 5, 10, 20, 21, 22, 30, 60])
def test_small_tables_give_all_that_is_due(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 8))
    got = found_by(ann.search(frame(spark, [(20 * i, [float(c) for c in v]) for i, v in enumerate(x)]), F.col("vec_id") % 20 == 0))
    assert {q: len(v) for q, v in got.items()} == ({20 * i: min(20, n - 1) for i in range(n)} if n > 1 else {})


def test_lengths_apart_pieces_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 16)
    monkeypatch.setattr(ann, "QUERIES", 8)
    r = np.random.default_rng(5)
    rows = [(i, [float(c) for c in r.normal(size=4)]) for i in range(200)] + [(1000 + i, [float(c) for c in r.normal(size=3)]) for i in range(4)] + [(2000, [1.0])]
    got = found_by(ann.search(frame(spark, rows), F.lit(True)))
    assert all(len(got[i]) == 20 for i in range(200)) and all({v for _, v, _ in got[1000 + i]} == {1000 + j for j in range(4)} - {1000 + i} for i in range(4)) and 2000 not in got
    assert ann.search(frame(spark, []), F.lit(True)).count() == 0


@pytest.mark.parametrize("n", [500, 2000, 20_000])
def test_recall_of_random_unit_vectors(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = found_by(ann.search(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]), F.col("vec_id") % 20 == 0))
    ids = list(range(n))
    hits = [len({v for _, v, _ in own} & set(nearest(ids, x, q))) for q, own in got.items()]
    assert len(got) == n // 20 and all(len(own) == 20 for own in got.values()) and np.mean(hits) / 20 >= 0.9


@pytest.mark.parametrize("scale", [1e-6, 1.0, 1e6])
def test_every_query_gets_its_rows_at_any_scale(spark, scale):
    x = np.random.default_rng(8).normal(size=(3000, 16)) * scale
    got = found_by(ann.search(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]), F.col("vec_id") % 20 == 0))
    assert len(got) == 150 and {len(own) for own in got.values()} == {20}

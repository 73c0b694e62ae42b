"""Every query with SQL against DuckDB at the smallest scale."""

import math

import duckdb
import pytest

from tidewater.plans.oracles import ORACLES
from tidewater.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "lineitem orders customer part embeddings".split():
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((norm(tuple(r)) for r in df.select(*columns).collect()), key=str)
    want = sorted((norm(r) for r in duck.sql(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()), key=str)
    assert got == want


def test_cleaning_twice_changes_nothing(spark):
    from tidewater.config import STAR
    from tidewater.operators import govern as C
    from tidewater.plans.queries import star

    s = star(spark, DIR)
    again = C.clean_summary(C.tag_all(s.kept, STAR, s.raw)).first()
    assert (again["raw"], again["fixed"], again["quarantine_total"]) == (again["kept"], 0, 0)


def test_randomised_pca_equals_exact(spark):
    import numpy as np

    from tidewater.operators import reduce as D
    from tidewater.plans.queries import star

    rows = star(spark, DIR).vectors
    x = np.array([r["x"] for r in rows.collect()])
    for centred in (True, False):
        y = x - x.mean(0) if centred else x
        s = np.linalg.svd(y, compute_uv=False)
        m = D.fit(rows, 10, centred, passes=12)
        assert abs(m["error"] - math.sqrt(1 - (s[:10] ** 2).sum() / (s**2).sum())) < 2e-3

"""Near-duplicate embeddings by product quantisation.

Coarse centroids and codebooks of residual subspaces are fitted on a bounded sample; every distinct vector then lies in
the inverted list of its nearest centroid, with a byte for each subspace and the error of its code. A vector visits the
lists whose border it is near. There its distances to the list's codes are sums of table look-ups, and as
|x - y| >= |x - code of y| - error of y, no link is lost by dropping what is farther; the rest is compared exactly.

Two vectors at the wanted similarity are at most `far` apart, and so are their distances from the plane between two
centroids together. Visiting all lists within `far` of the border would find every link. In many dimensions little of a
difference falls in one direction, about far / sqrt(dimensions), so SPREADS times that is enough; where the sample has few effective
dimensions the exact border is used.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import components, durable, join_hot, stored, table

#: Vectors that the driver fits on, inverted lists at most, subspaces, codes of one, rounds of k-means.
SAMPLE, LISTS, PARTS, CODES, ROUNDS = 50_000, 2048, 8, 256, 8
#: Standard deviations of a difference's share in one direction that a visit covers.
SPREADS = 4.5
#: Members and visitors of a list that are compared in one piece, and visitors at a time.
BLOCK, AT_ONCE = 4096, 256


def k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        at = nearest(x, c)
        sums = np.stack([np.bincount(at, x[:, j], k) for j in range(x.shape[1])], 1)
        n = np.bincount(at, minlength=k)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def apart(c: np.ndarray, least: float) -> np.ndarray:
    """Centroids at least so far from all before them, so a dense group of near copies has one list and not many that all visit each other."""
    kept: list[int] = []
    for i in range(len(c)):
        if not kept or (((c[kept] - c[i]) ** 2).sum(1) >= least * least).all():
            kept.append(i)
    return c[kept]


def fit(x: np.ndarray, lists: int, far: float, seed: int) -> dict:
    """centroids, codebooks (one array for each subspace), bounds of the subspaces, and border: how far from a list's border a visitor may be."""
    rng = np.random.default_rng(seed)
    centroids = apart(k_means(x, min(lists, len(x)), rng), far / 2)
    rest = x - centroids[nearest(x, centroids)]
    parts = np.linspace(0, x.shape[1], min(PARTS, x.shape[1]) + 1).astype(int)
    books = [k_means(rest[:, a:b], min(CODES, len(x)), rng) for a, b in zip(parts, parts[1:])]
    spread = np.linalg.eigvalsh(np.atleast_2d(np.cov(x.T))) if len(x) > 1 else np.ones(1)
    dimensions = spread.sum() ** 2 / max((spread**2).sum(), 1e-300)
    return {"centroids": centroids, "books": books, "parts": parts, "border": far * min(1.0, SPREADS / np.sqrt(max(dimensions, 1.0))), "far": far}


def unit_matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as rows of length 1, in doubles; scaled first, so that squares neither overflow nor vanish."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _index_batches(batches, model):
    m = model.value
    c, parts = m["centroids"], m["parts"]
    half = (c * c).sum(1) / 2
    between = np.sqrt(np.maximum(2 * (half[:, None] + half[None, :] - c @ c.T), 1e-24))
    for b in batches:
        if not len(b):
            continue
        x = unit_matrix(b["vector"])
        score = x @ c.T - half
        own = score.argmax(1)
        rest = x - c[own]
        codes = np.stack([nearest(rest[:, p:q], book) for p, q, book in zip(parts, parts[1:], m["books"])], 1).astype(np.uint8)
        coded = np.concatenate([book[codes[:, i]] for i, book in enumerate(m["books"])], 1)
        error = np.linalg.norm(rest - coded, axis=1)
        # Distance from the plane between the own centroid and each other one. Of two lists, members of the later visit the earlier.
        away = (score[np.arange(len(x)), own][:, None] - score) / between[own]
        visits = (away <= m["border"]) & (np.arange(len(c)) < own[:, None])
        yield pa.RecordBatch.from_arrays(
            [b["vec_id"], b["vector"], b["copies"], pa.array(own.astype(np.int32)), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(error), pa.array([np.flatnonzero(v).tolist() for v in visits], pa.list_(pa.int32()))],
            ["vec_id", "vector", "copies", "list", "code", "error", "visits"])


def table_distances(x: np.ndarray, centroid: np.ndarray, codes: np.ndarray, books: list[np.ndarray], parts: np.ndarray) -> np.ndarray:
    """Squared distances of rows to coded members of one list: look-ups in a table for each row and subspace."""
    rest, out = x - centroid, 0.0
    for i, (p, q) in enumerate(zip(parts, parts[1:])):
        r, book = rest[:, p:q], books[i]
        at = np.maximum((r * r).sum(1)[:, None] - 2 * r @ book.T + (book * book).sum(1), 0)
        out = out + np.take(at, codes[:, i], axis=1)
    return out


def _links(x: np.ndarray, y: np.ndarray, codes, error, centroid, m, least: float, skip=None):
    """Pairs (i, j) of rows of x and coded members y whose cosine is `least` or more; skip: rows of x are the members from there on, and only later members count."""
    left, right = [], []
    limit = (m["far"] + error) ** 2 + 1e-9
    for a in range(0, len(x), AT_ONCE):
        near = table_distances(x[a : a + AT_ONCE], centroid, codes, m["books"], m["parts"]) <= limit
        if skip is not None:
            near &= np.arange(len(y))[None, :] > (np.arange(a, a + len(near)) + skip)[:, None]
        i, j = np.nonzero(near)
        for s in range(0, len(i), 1 << 16):
            p, q = i[s : s + (1 << 16)] + a, j[s : s + (1 << 16)]
            true = np.einsum("ij,ij->i", x[p], y[q]) >= least
            left.append(p[true])
            right.append(q[true])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def _compare(group, model, least):
    """For one piece of a list: (a, null, n), the copies of others that a links to, and (a, b, null), a forest that joins what links join."""
    m, side = model.value, group["side"].to_numpy()
    members, others = group.filter(pa.array(side == 0)), group.filter(pa.array(side == 1))
    if not len(members):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    y, codes = unit_matrix(members["vector"]), np.frombuffer(b"".join(members["code"].to_pylist()), np.uint8).reshape(len(members), -1)
    error, centroid = members["error"].to_numpy(), m["centroids"][group["list"][0].as_py()]
    own = group["p"][0].as_py() == group["q"][0].as_py()
    whom = members if own else others
    x = y if own else unit_matrix(others["vector"]) if len(others) else np.zeros((0, y.shape[1]))
    i, j = _links(x, y, codes, error, centroid, m, least, 0 if own else None)
    ids = np.concatenate([members["vec_id"].to_numpy(), whom["vec_id"].to_numpy()[: 0 if own else None]])
    copies = np.concatenate([members["copies"].to_numpy(), whom["copies"].to_numpy()[: 0 if own else None]])
    i = i if own else i + len(members)
    n = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[i], root[j])
        now = root.copy()
        np.minimum.at(now, i, low)
        np.minimum.at(now, j, low)
        now = now[now]
        if (now == root).all():
            break
        root = now
    linked, joined = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(ids)))
    none = lambda k: pa.nulls(k, pa.int64())
    return pa.table({
        "a": pa.array(np.concatenate([ids[linked], ids[joined]])), "b": pa.concat_arrays([none(len(linked)), pa.array(ids[root[joined]])]),
        "n": pa.concat_arrays([pa.array(n[linked].astype(np.int64)), none(len(joined))])})


def linked(distinct: DataFrame, least: float, sample: int = SAMPLE, lists: int = LISTS, seed: int = 11) -> DataFrame:
    """(a, b, n) of _compare() for rows (vec_id, vector, copies) of different vectors of one length."""
    spark = distinct.sparkSession
    kind = dict(distinct.dtypes)["vector"]
    total = distinct.count()
    picked = distinct.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).select("vec_id", "vector").orderBy("vec_id").toArrow()
    far = float(np.sqrt(max(0.0, 2 - 2 * least)))
    model = spark.sparkContext.broadcast(fit(unit_matrix(picked["vector"]), min(lists, max(1, int(np.sqrt(total)))), far, seed))
    schema = f"vec_id long, vector {kind}, copies long, list int, code binary, error double, visits array<int>"
    index = stored(distinct.mapInArrow(partial(_index_batches, model=model), schema), "pq-index")
    visitors = index.select("vec_id", "vector", "copies", F.explode("visits").alias("list"))
    # Two numbers for each list, of which there are LISTS at most.
    held = {r[0]: r[1] for r in index.groupBy("list").count().collect()}
    come = {r[0]: r[1] for r in visitors.groupBy("list").count().collect()}
    blocks = lambda n: -(-n // BLOCK)
    pieces = F.broadcast(spark.createDataFrame([(k, blocks(n), blocks(come.get(k, 0))) for k, n in held.items()], "list int, own int, foreign int"))
    block = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(5)), F.col(n)).cast("int")
    upto = lambda a, b: F.explode(F.filter(F.sequence(a, F.greatest(a, b)), lambda v: v <= b))
    # Members of block p meet those of block q >= p, and visitors, whose blocks follow the list's own.
    mine = index.join(pieces, "list").withColumn("block", block("own"))
    members = mine.select("list", F.col("block").alias("p"), upto(F.col("block"), F.col("own") + F.col("foreign") - 1).alias("q"), F.lit(0).alias("side"), "vec_id", "vector", "copies", "code", "error")
    blank = (F.lit(1).alias("side"), "vec_id", "vector", "copies", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("error"))
    later = mine.where("block > 0").select("list", upto(F.lit(0), F.col("block") - 1).alias("p"), F.col("block").alias("q"), *blank)
    guests = visitors.join(pieces, "list").select("list", upto(F.lit(0), F.col("own") - 1).alias("p"), (F.col("own") + block("foreign")).alias("q"), *blank)
    return members.union(later).union(guests).groupBy("list", "p", "q").applyInArrow(partial(_compare, model=model, least=least), "a long, b long, n long")


def near_vectors(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of rows (vec_id, embedding); links are pairs of vectors at cosine `least` or more.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing; vectors of different
    lengths don't link. Rows of null vec_id are left out; of rows that repeat a vec_id the least vector counts. Equal
    vectors are compared as one and counted each. An empty table gives no rows; other columns are not read.
    """
    v = F.transform("vector", lambda c: c.cast("double"))
    ok = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))) & F.exists(v, lambda c: c != 0), F.lit(False))
    rows = vectors.where(F.col("vec_id").isNotNull()).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("vector"))
    rows = stored(rows.withColumn("ok", ok), "pq-rows")
    distinct = stored(rows.where("ok").groupBy("vector").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")), "pq-distinct")
    lengths = [r[0] for r in distinct.select(F.size("vector")).distinct().orderBy(F.size("vector")).collect()]
    found = [linked(distinct.where(F.size("vector") == d).select("vec_id", "vector", "copies"), least) for d in lengths]
    none = vectors.sparkSession.createDataFrame([], "a long, b long, n long")
    found = stored(reduce(DataFrame.union, found), "pq-links") if found else none
    degrees = found.where("b is null").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("links"))
    roots = components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("vec_id"), "root")
    classes = distinct.join(degrees, "vec_id", "left").join(roots, "vec_id", "left")
    classes = durable(classes.select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"), F.col("copies").alias("n")))
    out = join_hot(rows.where("ok").select("vec_id", "vector"), classes, "vector", ["vec_id"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of all embeddings at cosine 0.95; see near_vectors() for nulls, zeros, repeats and empty tables."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP11_SQL = r"""
with recursive r as (select vec_id, min(embedding::double[]) v from embeddings where vec_id is not null group by vec_id),
g as (select * from r where len(v) > 0 and len(list_filter(v, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(v, lambda c: c <> 0)) > 0),
l as (select a.vec_id a, b.vec_id b from g a join g b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.95),
w as (select a, b from l union select w.a, l.b from w join l on w.b = l.a),
m as (select a, least(a, min(b)) c from w group by a),
n as (select a, count(*) n from l group by a)
select r.vec_id, coalesce(n.n, 0)::bigint n_links, coalesce(m.c, r.vec_id) component_id, coalesce(m.c, r.vec_id) = r.vec_id kept from r left join n on n.a = r.vec_id left join m on m.a = r.vec_id
"""

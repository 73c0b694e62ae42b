"""Clustering of user rows: k-means grids, cosine silhouette, nearest-neighbour distances, DBSCAN."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.operators.graph import components, durable

#: Rows of a tile of distances; numbers of a block's rows in the pairwise passes; blocks that are made of smaller tables, for the cores.
TILE, HELD, SPREAD = 2000, 1 << 21, 8


def unit_rows(rows: DataFrame) -> DataFrame:
    """(id, x): rows scaled to length 1; zero rows stay zero."""
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    return rows.withColumn("n", norm).select("id", F.when(F.col("n") > 0, F.transform("x", lambda v: v / F.col("n"))).otherwise(F.col("x")).alias("x"))


def l2_normalize(cells: DataFrame) -> DataFrame:
    """Cells (user_id, item_id, value) scaled so that each user's row has length 1."""
    n = cells.groupBy("user_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("n"))
    return cells.join(n, "user_id").select("user_id", "item_id", F.round(F.when(F.col("n") > 0, F.col("value") / F.col("n")).otherwise(0.0), 6).alias("value"))


def kmeans_grid(rows: DataFrame, ks: list[int], n_init: int = 10, max_iter: int = 300) -> dict[int, tuple[DataFrame, float]]:
    """For each k the labels (id, x, cluster) and cost of the best of n_init seeds, fitted on the unit rows, zero rows included."""
    return fit_kmeans(durable(unit_rows(rows).withColumn("features", array_to_vector("x"))), ks, n_init, max_iter)


def fit_kmeans(data: DataFrame, ks: list[int], n_init: int = 10, max_iter: int = 300) -> dict[int, tuple[DataFrame, float]]:
    """The same for rows with a vector `features`, dense or sparse, scaled by the caller."""
    out = {}
    for k in ks:
        fits = [KMeans(k=k, seed=s, maxIter=max_iter, predictionCol="cluster").fit(data) for s in range(n_init)]
        best = min(fits, key=lambda m: m.summary.trainingCost)
        out[k] = (best.transform(data), round(best.summary.trainingCost, 2))
    return out


def cosine_silhouette(labelled: DataFrame) -> float | None:
    """Mean over rows that aren't zero and have a label; None with fewer than two rows or labels. Linear in the rows."""
    ok = labelled.where((F.col("cluster") >= 0) & F.exists("x", lambda v: v != 0))
    if ok.count() < 2 or ok.select("cluster").distinct().count() < 2:
        return None
    vectors = ok.select(array_to_vector("x").alias("features"), F.col("cluster").cast("double").alias("prediction"))
    return ClusteringEvaluator(distanceMeasure="cosine", metricName="silhouette").evaluate(vectors)


def cluster_sizes(labelled: DataFrame, k: int) -> DataFrame:
    counts = labelled.groupBy("cluster").agg(F.count("*").alias("n"))
    return labelled.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster")).join(counts, "cluster", "left").select("cluster", F.coalesce("n", F.lit(0)).alias("n"))


def _blocks(rows: DataFrame, block: int | None) -> int:
    """Blocks of rows (id, x): of at most `block` rows, else of about HELD numbers. Each row is copied once a block, so few large ones keep shuffles small."""
    n, width = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    own = block or max(TILE, HELD // max(width or 1, 1))
    return max(-(-n // own), min(SPREAD, -(-n // TILE)), 1)


def _pairs(rows: DataFrame, block: int | None) -> DataFrame:
    """Unit rows (id, x) dealt to pairs of blocks (p, q), p <= q: side 0 is compared with side 1, in a pair of one block with itself."""
    n = _blocks(rows, block)
    dealt = rows.select("id", "x", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("b"))
    mine = dealt.select("id", "x", F.col("b").alias("p"), F.explode(F.sequence("b", F.lit(n - 1))).alias("q"), F.lit(0).alias("side"))
    return mine.union(dealt.where("b > 0").select("id", "x", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("p"), "b", F.lit(1)))


def _sides(pdf: pd.DataFrame, own: bool | None = None):
    """(own, ids, ids, tiles) of a pair of blocks; tiles are (first row, first column, distances)."""
    own = bool(pdf.p.iloc[0] == pdf.q.iloc[0]) if own is None else own
    a = pdf[pdf.side == 0]
    b = a if own else pdf[pdf.side == 1]
    x, y = (np.stack(s.x.to_numpy()).astype(float) if len(s) else np.zeros((0, 1)) for s in (a, b))

    def tiles():
        if len(x) and len(y):
            for i in range(0, len(x), TILE):
                for j in range(0, len(y), TILE):
                    yield i, j, np.maximum(1 - x[i : i + TILE] @ y[j : j + TILE].T, 0)

    return own, a.id.to_numpy(), b.id.to_numpy(), tiles()


def _nearest(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    own, a, b, tiles = _sides(pdf)
    left, right = np.full((len(a), k), np.inf), np.full((len(b), k), np.inf)

    def keep(best, at, d):
        part = best[at : at + len(d)]
        part[:] = np.partition(np.concatenate([part, d], axis=1), k - 1, axis=1)[:, :k]

    for i, j, d in tiles:
        if own:
            d[a[i : i + len(d), None] == b[None, j : j + d.shape[1]]] = np.inf
        keep(left, i, d)
        if not own:
            keep(right, j, d.T)
    ids, best = (a, left) if own else (np.r_[a, b], np.concatenate([left, right]))
    return pd.DataFrame({"id": np.repeat(ids, k), "distance": best.ravel()}).replace(np.inf, np.nan).dropna()


def knn_distance(rows: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """(id, distance): cosine distance to the k-th other row; rows that are zero take no part. k rows leave each pair of blocks for each row."""
    clean = durable(unit_rows(rows).where(F.exists("x", lambda v: v != 0)))
    near = _pairs(clean, block).groupBy("p", "q").applyInPandas(partial(_nearest, k=k), "id long, distance double")
    place = F.row_number().over(W.partitionBy("id").orderBy("distance"))
    return near.withColumn("place", place).where(F.col("place") == k).select("id", "distance")


def eps_candidates(knn: DataFrame, percents: list[int]) -> DataFrame:
    """(percent, eps): interpolated percentiles, four digits."""
    return knn.agg(F.percentile("distance", [p / 100 for p in percents]).alias("e")).select(F.posexplode("e").alias("i", "eps")).select(F.element_at(F.array(*[F.lit(p) for p in percents]), F.col("i") + 1).alias("percent"), F.round("eps", 4).alias("eps"))


def _degree(pdf: pd.DataFrame, eps: float) -> pd.DataFrame:
    own, a, b, tiles = _sides(pdf)
    left, right = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    for i, j, d in tiles:
        near = d <= eps
        left[i : i + len(d)] += near.sum(1)
        right[j : j + d.shape[1]] += near.sum(0)
    return pd.DataFrame({"id": a, "n": left} if own else {"id": np.r_[a, b], "n": np.r_[left, right]})


def _core_edges(pdf: pd.DataFrame, eps: float) -> pd.DataFrame:
    """Edges that join what the links in one pair of blocks join: fewer than rows."""
    own, a, b, tiles = _sides(pdf)
    ids, shift, out = (a, 0, []) if own else (np.r_[a, b], len(a), [])
    root = np.arange(len(ids))
    for i, j, d in tiles:
        x, y = np.nonzero((d <= eps) & (root[i : i + len(d), None] != root[None, shift + j : shift + j + d.shape[1]]))
        x, y = x + i, y + j + shift
        while len(x):
            low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
            # Each root goes to one smaller one.
            high, at = np.unique(high, return_index=True)
            out.append((ids[high], ids[low[at]]))
            to = np.arange(len(ids))
            to[high] = low[at]
            while (to[to] != to).any():
                to = to[to]
            root = to[root]
            apart = root[x] != root[y]
            x, y = x[apart], y[apart]
    return pd.DataFrame({"a": np.concatenate([e[0] for e in out] or [[]]), "b": np.concatenate([e[1] for e in out] or [[]])}, dtype="int64")


def _border(pdf: pd.DataFrame, eps: float) -> pd.DataFrame:
    """For each border row (side 0) the smallest cluster among the cores (side 1) near it."""
    _, a, _, tiles = _sides(pdf, own=False)
    c, most = pdf[pdf.side == 1].cluster.to_numpy(), np.iinfo(np.int32).max
    best = np.full(len(a), most)
    for i, j, d in tiles:
        best[i : i + len(d)] = np.minimum(best[i : i + len(d)], np.where(d <= eps, c[None, j : j + d.shape[1]], most).min(1))
    return pd.DataFrame({"id": a, "cluster": best})[best < most]


def dbscan(rows: DataFrame, eps: float, min_samples: int, block: int | None = None) -> DataFrame:
    """(id, cluster) by cosine distance <= eps; a row is its own neighbour. Zero rows and noise are -1; clusters are numbered
    by their smallest core id; a border row takes the smallest cluster near it. Three passes over pairs of blocks: degrees,
    edges that join what core links join, borders. No pass emits pairs."""
    unit = durable(unit_rows(rows))
    live = unit.where(F.exists("x", lambda v: v != 0))
    degree = _pairs(live, block).groupBy("p", "q").applyInPandas(partial(_degree, eps=eps), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    marked = durable(live.join(degree, "id").select("id", "x", (F.col("n") >= min_samples).alias("core")))
    core = marked.where("core").select("id", "x")
    edges = durable(_pairs(core, block).groupBy("p", "q").applyInPandas(partial(_core_edges, eps=eps), "a long, b long"))
    roots = core.select("id").join(components(edges), F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root"))
    numbers = roots.select("root").distinct().withColumn("cluster", (F.row_number().over(W.orderBy("root")) - 1).cast("int"))
    cores = durable(roots.join(numbers, "root").select("id", "cluster"))
    n = _blocks(marked, block)
    b = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = marked.where("not core").select("id", "x", b.alias("p"), every.alias("q"), F.lit(0).alias("side"), F.lit(-1).alias("cluster"))
    right = core.join(cores, "id").select("id", "x", every.alias("p"), b.alias("q"), F.lit(1), "cluster")
    border = left.union(right).groupBy("p", "q").applyInPandas(partial(_border, eps=eps), "id long, cluster int").groupBy("id").agg(F.min("cluster").alias("cluster"))
    return unit.select("id").join(cores.union(border), "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def dbscan_shares(labels: DataFrame, rows: DataFrame) -> DataFrame:
    """clusters, noise (share of the rows that aren't zero)."""
    live = rows.where(F.exists("x", lambda v: v != 0)).select("id")
    return labels.join(live, "id").agg(F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters"), F.round(F.avg((F.col("cluster") == -1).cast("double")), 4).alias("noise"))


def dbscan_metrics(labels: DataFrame, rows: DataFrame) -> DataFrame:
    """dbscan_shares() with sizes, those of the clusters in order, and silhouette: the cosine silhouette of the rows in clusters, null where it isn't defined."""
    sizes = dbscan_sizes(labels.where("cluster >= 0")).agg(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "n"))), lambda x: x["n"]).alias("sizes"))
    return dbscan_shares(labels, rows).join(sizes).withColumn("silhouette", F.round(F.lit(cosine_silhouette(rows.join(labels, "id"))).cast("double"), 6))


def select_kmeans(grid: DataFrame) -> DataFrame:
    return grid.orderBy(F.coalesce("silhouette", F.lit(-1e9)).desc(), "k").limit(1)


def select_dbscan(grid: DataFrame) -> DataFrame:
    good = F.col("clusters").between(2, 15) & (F.col("noise") < 0.5)
    return grid.orderBy(good.desc(), F.coalesce("silhouette", F.lit(-1.0)).desc(), "position").limit(1)


def dbscan_sizes(labels: DataFrame) -> DataFrame:
    """(cluster, n), noise as -1."""
    return labels.groupBy("cluster").agg(F.count("*").alias("n"))


def dbscan_grid(rows: DataFrame, percents: list[int], min_samples: list[int]) -> DataFrame:
    """(position, eps, min_samples, clusters, noise, largest, silhouette) for eps at percentiles of the distance to the min_samples-th neighbour."""
    rows, out = durable(rows), []
    for m in min_samples:
        for r in eps_candidates(knn_distance(rows, m), percents).collect():  # one row a percentile
            labels = durable(dbscan(rows, r["eps"], m))
            head = dbscan_metrics(labels, rows).first()
            out.append((len(out), r["eps"], m, head["clusters"], head["noise"], max(head["sizes"], default=0), head["silhouette"]))
    return rows.sparkSession.createDataFrame(out, "position int, eps double, min_samples int, clusters long, noise double, largest long, silhouette double")

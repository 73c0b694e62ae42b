"""Approximate nearest neighbours by a forest of random-projection trees.

Trees split a bounded sample of the vectors by hyperplanes between two random members until leaves hold `leaf`
sample rows (fewer in a small table); every vector is then indexed by its leaf in each tree. A query walks all trees
through one priority queue, nearest hyperplane margin first, until the leaves it has opened hold the wanted share of the
vectors and more than k of them. That share is measured: the least at which the sample's own nearest are found to TARGET. Index and opened leaves are joined on (tree, leaf), and a leaf's vectors are ranked
exactly for the queries that opened it.
"""

from __future__ import annotations

import heapq
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm.common import durable, table

#: Bounds of what the driver fits trees on, and of the rows and queries of a leaf that are compared in one piece.
SAMPLE, SHARD, QUERIES = 10_000, 8192, 2048
#: Recall of the sample's own nearest that the stop is set for, and sample rows that measure it.
TARGET, PROBES = 0.96, 96
#: Shares that may be wanted.
SHARES = (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 1.0)
#: Rounding of an inner product, beside the product of both lengths.
ROUNDING = 1e-12


def build_tree(s: np.ndarray, leaf: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """normals, offsets, children; a child below 0 is the leaf -child - 1."""
    normals, offsets, children, leaves = [], [], [], 0

    def node(rows):
        nonlocal leaves
        if len(rows) > leaf:
            for _ in range(3):
                a, b = s[rng.choice(rows, 2, replace=False)]
                w = (a - b) / (np.linalg.norm(a - b) or 1.0)
                p = s[rows] @ w
                cut = float(np.median(p))
                low = p <= cut
                if 0 < low.sum() < len(rows):
                    k = len(normals)
                    normals.append(w)
                    offsets.append(cut)
                    children.append([0, 0])
                    children[k] = [node(rows[low]), node(rows[~low])]
                    return k
        leaves += 1
        return -leaves

    root = node(np.arange(len(s)))
    return {"normals": np.array(normals).reshape(-1, s.shape[1]), "offsets": np.array(offsets), "children": np.array(children, int).reshape(-1, 2), "root": root, "leaves": leaves}


def leaf_of(tree, x: np.ndarray) -> np.ndarray:
    at = np.full(len(x), tree["root"])
    if len(tree["normals"]):
        margin = x @ tree["normals"].T - tree["offsets"]
        while (live := np.flatnonzero(at >= 0)).size:
            at[live] = tree["children"][at[live], (margin[live, at[live]] > 0).astype(int)]
    return -at - 1


def walk(trees, counts, total: int, margins, wanted: float, least: int) -> list[list[int]]:
    """Leaves to open in each tree for one query; margins: its distances to each tree's hyperplanes.

    Goes on until the share is reached and one tree's opened leaves hold `least` vectors, or all are open.
    """
    heap = [(0.0, t, tree["root"]) for t, tree in enumerate(trees)]
    opened: list[list[int]] = [[] for _ in trees]
    missed, held = 1.0, [0] * len(trees)
    while heap and (1 - missed < wanted or max(held) < least):
        far, t, k = heapq.heappop(heap)
        if k < 0:
            opened[t].append(-k - 1)
            held[t] += counts[t][-k - 1]
            # Shares of different trees overlap as if they were independent.
            missed = float(np.prod([1 - x / total for x in held]))
            continue
        d = margins[t][k]
        low, high = trees[t]["children"][k]
        near, other = (high, low) if d > 0 else (low, high)
        heapq.heappush(heap, (far, t, near))
        heapq.heappush(heap, (max(far, abs(d)), t, other))
    return opened


def calibrate(trees, members, k: int, seed: int) -> tuple[float, float]:
    """(wanted, recall): the least of SHARES at which the nearest k of sample rows in the sample are found to TARGET, and the recall there.

    Where the sample is part of a table the table's nearest are nearer, and so easier to find, than the sample's.
    """
    ids, s, leaves = members
    probes = np.sort(np.random.default_rng(seed).choice(len(s), min(PROBES, len(s)), replace=False)) if len(s) else []
    k = min(k, len(s) - 1)
    if k < 1:
        return 1.0, 1.0
    counts = [np.bincount(own, minlength=t["leaves"]) for t, own in zip(trees, leaves)]
    asked = []
    for i in probes:
        score = s @ s[i]
        score[i] = -np.inf
        asked.append(([t["normals"] @ s[i] - t["offsets"] for t in trees], np.argpartition(score, -k)[-k:]))

    def recall(wanted: float) -> float:
        hit = 0
        for margins, best in asked:
            own = walk(trees, counts, len(s), margins, wanted, k + 1)
            hit += int(np.logical_or.reduce([np.isin(leaves[t][best], o) for t, o in enumerate(own)]).sum())
        return hit / (k * len(asked))

    low, high = 0, len(SHARES) - 1
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if recall(SHARES[mid]) >= TARGET else (mid + 1, high)
    return SHARES[low], recall(SHARES[low])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _index_batches(batches, forest):
    trees = forest.value
    for b in batches:
        if len(b):
            x = _matrix(b["vector"])
            leaves = np.stack([leaf_of(t, x) for t in trees], 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["vector"], pa.array(leaves.tolist(), pa.list_(pa.int32()))], ["vec_id", "vector", "leaves"])


def _route_batches(batches, forest, members, counts, total: int, k: int, wanted: float):
    """Opened leaves as (tree, leaf) and `low`, the k-th best score among the sample's vectors in these leaves.

    At least k vectors that the query will meet score `low` or more, so the leaves need not give any below it.
    """
    trees, (ids, s, leaves) = forest.value, members.value
    longest = float(np.linalg.norm(s, axis=1).max(initial=0))
    for b in batches:
        if not len(b):
            continue
        x = _matrix(b["vector"])
        margins = [x @ t["normals"].T - t["offsets"] for t in trees]
        opened, lows = [], []
        for i, query in enumerate(b["vec_id"].to_pylist()):
            own = walk(trees, counts.value, total, [m[i] for m in margins], wanted, k + 1)
            seen = np.logical_or.reduce([np.isin(leaves[t], o) for t, o in enumerate(own)]) & (ids != query)
            score = s[seen] @ x[i]
            lows.append(float(np.partition(score, -k)[-k] - ROUNDING * longest * np.linalg.norm(x[i])) if len(score) >= k else -np.inf)
            opened.append([{"tree": t, "leaf": leaf} for t, o in enumerate(own) for leaf in o])
        kind = pa.list_(pa.struct([("tree", pa.int32()), ("leaf", pa.int32())]))
        yield pa.RecordBatch.from_arrays([b["vec_id"], b["vector"], pa.array(lows), pa.array(opened, kind)], ["query_id", "vector", "low", "opened"])


def _best(qs: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """Of one piece of a leaf, the k best rows for each of these queries, none below the query's `low`."""
    query, vec, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if len(rows) and len(qs):
        ids, queries, x, q = rows["vec_id"].to_numpy(), qs["query_id"].to_numpy(), _matrix(rows["vector"]), _matrix(qs["vector"])
        scores = q @ x.T
        low = qs["low"].to_numpy()
        if len(ids) > k:
            slack = ROUNDING * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
            low = np.maximum(low, np.partition(scores, -k - 1, axis=1)[:, -k - 1] - slack)
        i, j = np.nonzero((scores >= low[:, None]) & (queries[:, None] != ids))
        query, vec, score = queries[i], ids[j], (x[j] * q[i]).sum(1)
    return pa.table({"query_id": query, "vec_id": vec, "score": score})


def search(vectors: DataFrame, is_query, k: int = 20, n_trees: int = 16, leaf: int = 40, wanted: float | None = None, sample: int = SAMPLE, seed: int = 1) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by inner product, best first, ties to the smaller vec_id.

    `vectors` has vec_id and embedding; `is_query` is a Column over it. Vectors that are null, empty, zero or hold a
    null or non-finite component take no part, nor do rows of null vec_id; a vector meets those of its length only. A
    query gets k rows, or all candidates if there are fewer. Of equal vectors only the k + 1 smallest vec_ids can ever
    be among a query's k nearest, so the others need no place in the index; all of them may be queries. `wanted` fixes
    the share of the vectors that a query opens; without it calibrate() sets it. Of rows that
    repeat a vec_id the least vector counts. Other columns are not read.
    """
    v = F.transform("embedding", lambda c: c.cast("double"))
    ok = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))) & F.exists(v, lambda c: c != 0)
    # Vectors keep their own type, which may be half as wide.
    clean = vectors.where(F.col("vec_id").isNotNull() & ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), is_query.alias("is_query"))
    clean = durable(clean.groupBy("vec_id").agg(F.min("vector").alias("vector"), F.max("is_query").alias("is_query")))
    lengths = [r[0] for r in clean.select(F.size("vector")).distinct().orderBy(F.size("vector")).collect()]
    found = [_search(clean.where(F.size("vector") == d), k, n_trees, leaf, wanted, sample, seed) for d in lengths]
    return reduce(DataFrame.union, found) if found else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _search(clean: DataFrame, k: int, n_trees: int, leaf: int, wanted: float | None, sample: int, seed: int) -> DataFrame:
    spark = clean.sparkSession
    kind = dict(clean.dtypes)["vector"]
    first = F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))
    distinct = clean.select("vec_id", "vector").withColumn("copy", first).where(f"copy <= {k + 1}")
    picked = distinct.where("copy = 1").orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).select("vec_id", "vector").orderBy("vec_id").toPandas()
    ids, s, rng = picked["vec_id"].to_numpy(), np.array(picked["vector"].tolist(), float), np.random.default_rng(seed)
    leaf = max(2, min(leaf, len(s) // 64))
    trees = [build_tree(s, leaf, rng) for _ in range(n_trees)]
    known = (ids, s, [leaf_of(t, s) for t in trees])
    wanted = calibrate(trees, known, k, seed)[0] if wanted is None else wanted
    forest, members = spark.sparkContext.broadcast(trees), spark.sparkContext.broadcast(known)
    index = durable(distinct.select("vec_id", "vector").mapInArrow(partial(_index_batches, forest=forest), f"vec_id long, vector {kind}, leaves array<int>"))
    placed = index.select("vec_id", "vector", F.posexplode("leaves").alias("tree", "leaf"))
    counts = [np.zeros(t["leaves"], np.int64) for t in trees]
    for r in placed.groupBy("tree", "leaf").count().collect():  # trees x leaves rows
        counts[r["tree"]][r["leaf"]] = r["count"]
    total = int(counts[0].sum())
    # Queries are few bytes and long walks, so they are dealt out before.
    asked = clean.where("is_query").select("vec_id", "vector").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "vec_id")
    route = partial(_route_batches, forest=forest, members=members, counts=spark.sparkContext.broadcast(counts), total=total, k=k, wanted=wanted)
    routed = durable(asked.mapInArrow(route, f"query_id long, vector {kind}, low double, opened array<struct<tree: int, leaf: int>>"))
    opened = routed.select("query_id", "vector", "low", F.explode("opened").alias("at")).select("query_id", "vector", "low", "at.tree", "at.leaf")
    # Large leaves, and leaves that many queries opened, are dealt in pieces; one row for each tree and leaf.
    pieces = [
        (r["tree"], r["leaf"], -(-int(counts[r["tree"]][r["leaf"]]) // SHARD), -(-r["count"] // QUERIES))
        for r in opened.groupBy("tree", "leaf").count().collect()
    ]
    pieces = F.broadcast(spark.createDataFrame(pieces, "tree int, leaf int, n_rows int, n_queries int"))
    mine = lambda c, n: F.pmod(F.xxhash64(c, F.lit(3)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["tree", "leaf", "p", "q"]
    left = opened.join(pieces, ["tree", "leaf"]).where("n_rows > 0").select("query_id", "vector", "low", "tree", "leaf", every("n_rows").alias("p"), mine("query_id", "n_queries").alias("q"))
    right = placed.join(pieces, ["tree", "leaf"]).select("vec_id", "vector", "tree", "leaf", mine("vec_id", "n_rows").alias("p"), every("n_queries").alias("q"))
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(partial(_best, k=k), "query_id long, vec_id long, score double")
    # A vector may come from several trees.
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score of every twentieth vec_id; see search() for nulls, zeros, ties and small tables."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)

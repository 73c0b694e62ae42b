"""Merkle manifest of a dataset: a 16-ary tree for each source over its documents, and one over the sources' roots.

Nodes are kept in aligned subtrees of LEVELS levels of hashing, a row each, whose digests lie in van Emde Boas order: a
tree is its top half, then each of the trees below, every part laid out by the same rule. One address function serves
construction and the retrieval of siblings. The roots of a level's subtrees are the leaves of the next level, so a tree
of any height takes its logarithm in rounds, and no task holds more than a subtree. Proofs go the other way: a subtree's
row meets the siblings above its root and hands them down.
"""

from __future__ import annotations

import hashlib
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm.common import crc32_sql, stored, table

#: Children of a node, as a power of two; levels of hashing in a stored subtree, so it has 256 leaves.
BITS, LEVELS = 4, 2
DIGEST = 32


def tree_size(levels: int) -> int:
    """Nodes of a complete tree with so many levels of nodes."""
    return ((1 << BITS * levels) - 1) // ((1 << BITS) - 1)


def address(levels: int, depth: int, index):
    """Place of the nodes `index` (an int or an array) of a level, the root's being 0, in a complete tree of `levels` levels of nodes, in van Emde Boas order."""
    if levels == 1:
        return index * 0
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    low, shift = levels - top, BITS * (depth - top)
    return tree_size(top) + (index >> shift) * tree_size(low) + address(low, depth - top, index & ((1 << shift) - 1))


def counts_of(leaves: int, height: int) -> list[int]:
    """Nodes at each depth, root first."""
    return [-(-leaves // (1 << BITS * (height - d))) for d in range(height + 1)]


def build_subtree(digests: list[bytes], height: int) -> bytes:
    """All digests in van Emde Boas order; places without a node are zero."""
    nodes = bytearray(tree_size(height + 1) * DIGEST)
    level = [d.hex() for d in digests]
    for depth in range(height, -1, -1):
        for at, h in zip(address(height + 1, depth, np.arange(len(level))).tolist(), level):
            nodes[at * DIGEST : (at + 1) * DIGEST] = bytes.fromhex(h)
        level = [hashlib.sha256("".join(level[i : i + (1 << BITS)]).encode()).hexdigest() for i in range(0, len(level), 1 << BITS)]
    return bytes(nodes)


def runs_above(nodes: bytes, leaves: int, height: int) -> list[list[bytes]]:
    """For each level of a stored subtree, leaves first and without the root, the runs of siblings as hex text."""
    out, counts = [], counts_of(leaves, height)
    for depth in range(height, 0, -1):
        at = address(height + 1, depth, np.arange(counts[depth])).tolist()
        hexed = [nodes[a * DIGEST : (a + 1) * DIGEST].hex().encode() for a in at]
        out.append([b"".join(hexed[i : i + (1 << BITS)]) for i in range(0, len(hexed), 1 << BITS)])
    return out


def siblings(runs: list[list[bytes]], place: int) -> list[tuple[bytes, bytes]]:
    """For each level the hex digests before and after the node on the way from a leaf's place to the root."""
    out = []
    for level in runs:
        run, i = level[place >> BITS], (place & ((1 << BITS) - 1)) * 2 * DIGEST
        out.append((run[:i], run[i + 2 * DIGEST :]))
        place >>= BITS
    return out


def fold(digest: str, path: list[tuple[bytes, bytes]]) -> str:
    for before, after in path:
        digest = hashlib.sha256(before + digest.encode() + after).hexdigest()
    return digest


def _build(block: pa.Table) -> pa.Table:
    rows = sorted(zip(block["place"].to_pylist(), block["digest"].to_pylist()))
    height = block["height"][0].as_py()
    nodes = build_subtree([d for _, d in rows], height)
    return pa.table({"tree": block["tree"][:1], "block": block["block"][:1], "n": block["n"][:1], "height": block["height"][:1], "leaves": pa.array([len(rows)], pa.int32()), "nodes": pa.array([nodes], pa.binary()), "root": pa.array([nodes[:DIGEST]], pa.binary())})


_PATH = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))


def _pairs(path) -> list[tuple[bytes, bytes]]:
    return [(p["before"], p["after"]) for p in path]


def _hand_down(batches):
    """A row for each leaf of a stored subtree: the siblings up to its root, then those above it."""
    for b in batches:
        out = {"tree": [], "idx": [], "path": []}
        for tree, block, height, leaves, nodes, path in zip(*(b[c].to_pylist() for c in ("tree", "block", "height", "leaves", "nodes", "path"))):
            runs = runs_above(nodes, leaves, height)
            for place in range(leaves):
                out["tree"].append(tree)
                out["idx"].append((block << BITS * height) + place)
                out["path"].append([{"before": x, "after": y} for x, y in siblings(runs, place)] + path)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("path", _PATH)]))


_PROVEN = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())])


def _prove(rows: pa.Table, block: pa.Table) -> pa.Table:
    """The documents of one stored subtree: digest of their siblings, and the root from their present content and these."""
    out = {c: [] for c in _PROVEN.names}
    if len(rows):
        path = _pairs(block["path"][0].as_py())
        above, subroot = b"".join(x + y for x, y in path), block["subroot"][0].as_py().hex()
        runs = runs_above(block["nodes"][0].as_py(), block["leaves"][0].as_py(), block["height"][0].as_py())
        for doc, place, leaf, now in zip(*(rows[c].to_pylist() for c in ("doc_id", "place", "digest", "now"))):
            own = siblings(runs, place)
            out["doc_id"].append(doc)
            out["leaf"].append(leaf.hex())
            out["subroot"].append(subroot)
            out["proof_sha256"].append(hashlib.sha256(b"".join(x + y for x, y in own) + above).hexdigest())
            out["folded_root"].append(fold((leaf if now is None else now).hex(), own + path))
    return pa.table(out, schema=_PROVEN)


def in_order(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """Adds idx, the place among the rows of the same tree, and n, their number; both by range partitions' counts. Written once, so that places don't change."""
    # Equal rows are told apart, so that a range can end among them.
    named = rows.withColumn("copy", F.monotonically_increasing_id())
    ranged = named.repartitionByRange(F.col(tree), *[F.col(c).asc_nulls_first() for c in order], F.col("copy"))
    sorted_ = ranged.sortWithinPartitions(F.col(tree), *[F.col(c).asc_nulls_first() for c in order], "copy")
    # The id counts a partition's rows from its number's start.
    at = stored(sorted_.drop("copy").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftrightunsigned("at", 33)), "merkle-ordered")
    parts = at.groupBy(tree, "part").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    whole = W.partitionBy(tree)
    fronts = parts.select(
        F.col(tree), "part", "first", F.coalesce(F.sum("held").over(whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("front"), F.sum("held").over(whole).alias("n"))
    return at.join(fronts, [tree, "part"]).withColumn("idx", F.col("front") + F.col("at") - F.col("first")).drop("at", "part", "first", "front")


def _height(n) -> F.Column:
    out = F.lit(LEVELS)
    for h in reversed(range(LEVELS)):
        out = F.when(n <= 1 << BITS * h, h).otherwise(out)
    return out.cast("int")


def _placed(nodes: DataFrame) -> DataFrame:
    """Adds height, block and place to (tree, idx, n)."""
    shift = F.col("height") * BITS
    wide = nodes.withColumn("height", _height(F.col("n")))
    return wide.withColumns({"block": F.call_function("shiftright", F.col("idx"), shift), "place": F.col("idx") - F.call_function("shiftleft", F.call_function("shiftright", F.col("idx"), shift), shift)})


class Tree(NamedTuple):
    """levels: stored subtrees (tree, block, n, height, leaves, nodes, root), lowest first; roots: (tree, root)."""

    levels: list[DataFrame]
    roots: DataFrame


def grow(leaves: DataFrame) -> Tree:
    """Trees over rows (tree, idx, n, digest). A tree of one leaf has that leaf as its root."""
    levels, roots, nodes = [], None, leaves.select("tree", "idx", "n", "digest")
    schema = "tree string, block long, n long, height int, leaves int, nodes binary, root binary"
    while True:
        level = stored(_placed(nodes).groupBy("tree", "block").applyInArrow(_build, schema), "merkle-level")
        levels.append(level)
        span = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("height") * BITS)
        above = level.select("tree", F.col("block").alias("idx"), F.expr("1").alias("one"), F.call_function("div", F.col("n") + span - 1, span).alias("n"), F.col("root").alias("digest")).drop("one")
        done = above.where("n = 1").select("tree", F.col("digest").alias("root"))
        roots = done if roots is None else roots.union(done)
        nodes = above.where("n > 1")
        if nodes.isEmpty():
            return Tree(levels, roots)


def paths(tree: Tree, tops: DataFrame) -> DataFrame:
    """The lowest subtrees with `path`, the siblings from their root up; tops: (tree, path) above the trees' own roots."""
    path = None
    for k, level in reversed(list(enumerate(tree.levels))):
        last = F.col("n") <= F.call_function("shiftleft", F.lit(1).cast("long"), F.col("height") * BITS)
        ended = level.where(last).join(tops, "tree")
        met = ended if path is None else ended.unionByName(level.where(~last).join(path.withColumnRenamed("idx", "block"), ["tree", "block"]), allowMissingColumns=True)
        if not k:
            return met
        path = met.mapInArrow(_hand_down, "tree string, idx long, path array<struct<before: binary, after: binary>>")


def field(c) -> F.Column:
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def leaf_digest(text) -> F.Column:
    return F.unhex(F.sha2(F.concat(*[field(F.col(c).cast("string")) for c in ("doc_id", "source", "lang", "n_chars")], field(text)).cast("binary"), 256))


class Manifest(NamedTuple):
    """leaves: (tree, doc_id, digest, idx, n, ...); documents: the trees of the sources; sources: the tree over their roots; root: hex."""

    leaves: DataFrame
    documents: Tree
    sources: Tree
    subroots: DataFrame
    root: str


def manifest(docs: DataFrame, **extra) -> Manifest | None:
    """The manifest of (doc_id, text, lang, source, n_chars), its subtrees stored as Parquet; None for an empty table. `extra` columns stay with the leaves."""
    # A null source comes before the empty one.
    tree = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source")))
    rows = docs.select(tree.alias("tree"), "doc_id", leaf_digest(F.col("text")).alias("digest"), *[c.alias(n) for n, c in extra.items()])
    leaves = in_order(rows, "tree", "doc_id", "digest")
    documents = grow(leaves)
    subroots = in_order(documents.roots.select(F.lit("").alias("tree"), F.col("tree").alias("source_tree"), F.col("root").alias("digest")), "tree", "source_tree")
    sources = grow(subroots)
    root = sources.roots.first()  # one row
    return Manifest(leaves, documents, sources, subroots, root["root"].hex()) if root else None


def prove(m: Manifest, now: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each leaf; the column `now` holds its present digest where that differs."""
    none = F.array().cast("array<struct<before: binary, after: binary>>")
    top = m.sources.levels[0].sparkSession.range(1).select(F.lit("").alias("tree"), none.alias("path"))
    handed = paths(m.sources, top).mapInArrow(_hand_down, "tree string, idx long, path array<struct<before: binary, after: binary>>")
    tops = m.subroots.select("idx", "source_tree", "digest").join(handed.select("idx", "path"), "idx").select(F.col("source_tree").alias("tree"), "path", F.col("digest").alias("subroot"))
    subroot = tops.select("tree", "subroot")
    blocks = paths(m.documents, tops.drop("subroot")).join(subroot, "tree").select("tree", "block", "height", "leaves", "nodes", "path", "subroot")
    rows = _placed(m.leaves).select("tree", "block", "place", "doc_id", "digest", F.col(now).alias("now"))
    out = rows.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(_prove, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    return out.select("doc_id", "leaf", "subroot", F.lit(m.root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == m.root).alias("verified"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A null doc_id comes first, is `-` in its leaf and isn't tampered with; rows of one doc_id are leaves of their own, in
    order of their digests; an empty table has no root and gives no rows. Other columns don't count.
    """
    upper = "".join(map(chr, range(65, 91)))
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    m = manifest(table(spark, sf_dir, "documents"), now=F.when(tampered, leaf_digest(F.translate("text", upper, upper.lower()))))
    if m is None:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return prove(m, "now")


def _levels_sql(name: str, count: int) -> str:
    """Levels of trees (s, i, h, n) named name0 ...: those above, and for each node the siblings before and after it."""
    out = []
    for k in range(count):
        out.append(
            f"{name}p{k} as (select s, i, coalesce(string_agg(h, '') over (w rows between unbounded preceding and 1 preceding), '') a, coalesce(string_agg(h, '') over (w rows between 1 following and unbounded following), '') b"
            f" from {name}{k} where n > 1 window w as (partition by s, i // 16 order by i)),\n"
            f"{name}{k + 1} as (select s, i // 16 i, sha256(string_agg(h, '' order by i)) h, (any_value(n) + 15) // 16 n from {name}{k} where n > 1 group by s, i // 16)"
        )
    return ",\n".join(out)


def _folds_sql(name: str, count: int, start: str) -> str:
    """Chain of tables that fold f and gather the proof q over the levels."""
    out, last = [], start
    for k in range(count):
        out.append(
            f"{name}f{k} as (select x.* exclude (f, q), case when p.s is null then f else sha256(a || f || b) end f, q || coalesce(a || b, '') q"
            f" from {last} x left join {name}p{k} p on p.s = x.s and p.i = x.i // {16**k})"
        )
        last = f"{name}f{k}"
    return ",\n".join(out)


def _op12_sql(levels: int = 6) -> str:
    part = lambda c: f"case when {c} is null then '-' else strlen({c}::varchar)::varchar || ':' || {c} end"
    rest = " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars"))
    upper = "".join(map(chr, range(65, 91)))
    low = f"translate(text, '{upper}', '{upper.lower()}')"
    last = " union all ".join(f"select s, h from d{k} where n = 1" for k in range(levels + 1))
    top = " union all ".join(f"select h from t{k} where n = 1" for k in range(levels + 1))
    return f"""
with leaves as (select doc_id, case when source is null then '0' else '1' || source end s, sha256({rest} || {part("text")}) h,
  case when {crc32_sql("doc_id::varchar")} % 5 = 0 then sha256({rest} || {part(low)}) end m from documents),
d as (select *, row_number() over (partition by s order by doc_id nulls first, h) - 1 i, count(*) over (partition by s) n from leaves),
d0 as (select s, i, h, n from d),
{_levels_sql("d", levels)},
subs as ({last}),
t0 as (select 0 s, row_number() over (order by s) - 1 i, h, count(*) over () n, s name from subs),
{_levels_sql("t", levels)},
tops as ({top}),
start as (select doc_id, s, i, h leaf, coalesce(m, h) f, '' q from d),
{_folds_sql("d", levels, "start")},
mid as (select x.doc_id, x.leaf, x.f, x.q, 0 s, t0.i, t0.h subroot from df{levels - 1} x join t0 on t0.name = x.s),
{_folds_sql("t", levels, "mid")}
select doc_id, leaf, subroot, tops.h root, sha256(q) proof_sha256, f folded_root, f = tops.h verified from tf{levels - 1}, tops
"""


OP12_SQL = _op12_sql()

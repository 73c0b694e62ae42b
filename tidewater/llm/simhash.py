"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into max_bits // 2 + 1 segments. Of two fingerprints at most max_bits apart, one segment
then differs by one bit at most, so both share one of the signatures "this segment with this bit left out". The
signatures are equality-grouped and candidates verified on the whole fingerprint.

Buckets hold distinct fingerprints (or texts), so groups of copies add nothing. A bucket of more than `block` rows
is dealt as pairs of blocks; a group then emits the edges of a spanning forest of its true links, never all pairs.
A link counts in exactly one of the buckets that both share, the first.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewater.llm.common import components, durable, fresh, join_hot, table, worker_cache
from tidewater.llm.shingles import shingle_hashes

#: Rows of a bucket that are compared in one piece.
BLOCK = 1024
#: Bands of min-hashes and min-hashes in each: at Jaccard similarity 0.8 a pair shares no band in 1 of 38,000 cases.
BANDS, BAND_ROWS = 20, 4
#: Most large buckets, or wanted texts, whose keys are broadcast; more are joined by a shuffle.
BROADCAST = 100_000


def majority_bits(h: np.ndarray) -> int:
    """The signed 64-bit number whose bits are set in more than half of h; 0 for none."""
    if not len(h):
        return 0
    b = h.view(np.uint8).reshape(-1, 8)
    if len(h) < 2000:
        votes = np.unpackbits(b, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        table = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
        votes = np.concatenate([np.bincount(b[:, j], minlength=256) @ table for j in range(8)])
    return int(np.packbits(2 * votes > len(h), bitorder="little").view(np.int64)[0])


def _fingerprint_batches(batches, width: int, distinct: bool):
    for batch in batches:
        texts = batch.column(1).to_pylist()
        hashes = (shingle_hashes(t, width) for t in texts)
        fps = [majority_bits(np.unique(h) if distinct else h) for h in hashes]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, width: int = 4, distinct: bool = False) -> DataFrame:
    """(doc_id, fp) of whole texts; fp is 0 for a null text or one without words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(partial(_fingerprint_batches, width=width, distinct=distinct), "doc_id long, fp long")


def segments_of(max_bits: int) -> list[tuple[int, int]]:
    """(offset, width) of each segment."""
    n = max(2, max_bits // 2 + 1)
    cuts = [round(i * 64 / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


class Links:
    """Decides which pairs of a group are links, given the variant of the group's signature."""

    def __init__(self, max_bits: int):
        self.max_bits = max_bits
        self.masks, seg, bit, first = [], [], [], []
        for s, (off, width) in enumerate(segments_of(max_bits)):
            self.masks.append(np.uint64(((1 << width) - 1) << off))
            for p in range(width):
                seg.append(s)
                bit.append(1 << (off + p))
                first.append(p == 0)
        self.seg, self.bit, self.first = np.array(seg), np.array(bit, np.uint64), np.array(first)

    def near(self, a, b, variant):
        """True where a and b are within max_bits and `variant` is the first signature they share."""
        x = a ^ b
        ok = np.bitwise_count(x) <= self.max_bits
        at = np.flatnonzero(ok)
        if len(at):
            x, variant = x[at], variant[at]
            seg = self.seg[variant]
            own = x & np.array(self.masks)[seg]
            good = (own == self.bit[variant]) | ((own == 0) & self.first[variant])
            for s, mask in enumerate(self.masks[:-1]):
                good &= (np.bitwise_count(x & mask) >= 2) | (seg <= s)
            ok[at] = good
        return ok


def _similar(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is `least` or more."""
    low, high = sorted((len(x), len(y)))
    if low < least * high:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (low + high - both) - 1e-9


def _forest(pairs, sets=None, least: float = 0.0):
    """A spanning forest of the given pairs, or of those whose sets are similar."""
    parent: dict[int, int] = {}

    def find(i):
        while (up := parent.setdefault(i, i)) != i:
            parent[i] = i = parent[up]
        return i

    edges = []
    for i, j in pairs.tolist():
        a, b = find(i), find(j)
        if a != b and (sets is None or _similar(sets[i], sets[j], least)):
            parent[b] = a
            edges.append((i, j))
    return np.array(edges, np.int64).reshape(-1, 2)


def _group_batches(batches, max_bits: int, least: float | None, incidence: bool):
    """Rows (key, bi, bj, fp, id[, shingles]) sorted by group: edges (a, b), or the rows that have a link."""
    links, held = Links(max_bits), None

    def work(t):
        key, bi, bj = (t[c].to_numpy() for c in ("key", "bi", "bj"))
        fp, variant = t["fp"].to_numpy().view(np.uint64), key >> 32
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])])
        size = np.diff(np.r_[new, len(key)])
        after = np.repeat(new + size, size)  # the first row beyond each row's group
        i, d, found = np.arange(len(key)), 1, []
        while len(i := i[i + d < after[i]]):
            hit = i[links.near(fp[i], fp[i + d], variant[i])]
            if len(hit):
                found.append(np.stack([hit, hit + d], 1))
            d += 1
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        if incidence:
            return t.take(pa.array(np.unique(pairs))).select(["key", "bi", "bj", "fp", "id"])
        sets = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()] if least is not None else None
        edges, ids = _forest(pairs, sets, least or 0.0), t["id"].to_numpy()
        return pa.table({"a": ids[edges[:, 0]], "b": ids[edges[:, 1]]})

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
        if not len(t):
            continue
        last = [t[c][-1] for c in ("key", "bi", "bj")]
        same = np.logical_and.reduce([t[c].to_numpy() == x.as_py() for c, x in zip(("key", "bi", "bj"), last)])
        cut = int(np.argmax(same))
        held = t.slice(cut)
        if cut:
            yield from work(t.slice(0, cut)).to_batches()
    if held is not None:
        yield from work(held).to_batches()


def signatures(nodes: DataFrame, max_bits: int) -> DataFrame:
    """(key, fp, id) for each deletion variant of each fingerprint."""
    keys, v = [], 0
    for off, width in segments_of(max_bits):
        part = F.shiftrightunsigned("fp", off).bitwiseAND(F.lit((1 << width) - 1))
        for p in range(width):
            keys.append(part.bitwiseAND(F.lit(~(1 << p))) + F.lit(v << 32))
            v += 1
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "fp", "id")


def near_edges(nodes: DataFrame, max_bits: int = 4, sets: Callable[[DataFrame], DataFrame] | None = None, least: float | None = None, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) whose components are those of all links between nodes (id, fp).

    With `sets`, which gives (id, shingles: sorted uint64 as binary) for ids, a link also needs a Jaccard similarity
    of `least`.
    """
    spark = nodes.sparkSession
    # Nodes are few bytes and each becomes 64 rows, so they are dealt out before.
    keys = signatures(nodes.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), max_bits)
    hot = durable(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block))
    n_hot = hot.count()
    dealt = keys.withColumns({"bi": F.lit(0), "bj": F.lit(0)})
    if n_hot:
        parts = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
        mine = F.pmod(F.xxhash64("id", F.lit(7)), parts).cast("int")
        dealt = (
            keys.join(F.broadcast(hot) if n_hot <= BROADCAST else hot, "key", "left")
            .select("key", "fp", "id", mine.alias("mine"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
            .select("key", F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"), "fp", "id")
        )
    order = ["key", "bi", "bj"]
    run = lambda df, out, **kw: df.mapInArrow(partial(_group_batches, max_bits=max_bits, **kw), out)
    grouped = dealt.repartition(*order).sortWithinPartitions(*order, "id")
    if sets is None:
        return run(grouped, "a long, b long", least=None, incidence=False).distinct()
    linked = durable(run(grouped, "key long, bi int, bj int, fp long, id long", least=None, incidence=True))
    with_sets = linked.join(sets(linked.select("id").distinct()), "id").select(*order, "fp", "id", "shingles")
    return run(with_sets.repartition(*order).sortWithinPartitions(*order, "id"), "a long, b long", least=least, incidence=False).distinct()


def near_components(docs: DataFrame, width: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint zero and link like any other; repeated rows come back repeated; a null
    doc_id is a member but never names a component unless all members are null. Only doc_id and text are read.
    """
    fps = durable(fingerprints(docs, width))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    roots = components(near_edges(nodes.select(F.col("fp").alias("id"), "fp"), max_bits))
    rooted = durable(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")))
    heads = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    named = durable(join_hot(rooted.withColumnRenamed("n", "copies"), heads, "root", ["fp"]))
    return join_hot(fps, named.select("fp", "component_id", F.col("copies").alias("n")), "fp", ["doc_id"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _normal_id(text: bytes | None) -> int:
    """Signed XXH64 of the words of a text, lower-cased in A-Z and joined by one space; that of b"" without words."""
    digest = xxhash.xxh64_intdigest(b" ".join(text.lower().split()) if text else b"", 42)
    return digest - (1 << 64) if digest >> 63 else digest


def _odd(n: int) -> np.ndarray:
    """n fixed odd multipliers."""
    return np.random.default_rng(1).integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1)


def band_keys(h: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """A key for each band of min-hashes of a set of hashes; none of an empty set.

    Two sets share a band with probability J ** rows at Jaccard similarity J, wherever they differ.
    """
    if not len(h):
        return np.zeros(0, np.int64)
    by = _odd(bands * rows)
    h = h ^ (h >> np.uint64(29))
    low = np.minimum.reduce([(h[i : i + 4096, None] * by).min(0) for i in range(0, len(h), 4096)])
    key = np.arange(bands, dtype=np.uint64)
    for column in low.reshape(bands, rows).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _node_batches(batches, width: int):
    """Identity, fingerprint over distinct words and band keys over shingles; texts stay where they are read."""
    worker_cache("simhash")  # what other stages have left in the worker goes
    for batch in batches:
        texts = batch.column(1).to_pylist()
        distinct = (set(t.lower().split()) if t else () for t in texts)
        fps = [majority_bits(np.unique(np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64))) for words in distinct]
        bands = [band_keys(np.unique(shingle_hashes(t, width))).tolist() for t in texts]
        columns = [batch.column(0), pa.array(map(_normal_id, texts), pa.int64()), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "id", "fp", "bands"])


def _identity_batches(batches, name: str):
    """Rows of documents with the identity of their text added."""
    worker_cache("simhash")  # what other stages have left in the worker goes
    for batch in batches:
        ids = pa.array(map(_normal_id, batch.column("text").cast(pa.binary()).to_pylist()), pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, name])


def _similar_batches(batches, least: float):
    """Rows (key, bi, bj, id, shingles) sorted by group: edges of a spanning forest of each group's similar pairs."""
    held = None

    def work(t):
        key, bi, bj = (t[c].to_numpy() for c in ("key", "bi", "bj"))
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])])
        ids, raw, edges = t["id"].to_numpy(), t["shingles"].to_pylist(), []
        for start, end in zip(new.tolist(), [*new[1:].tolist(), len(key)]):
            sets = [np.frombuffer(x, np.uint64) for x in raw[start:end]]
            size, label, d = np.array([len(x) for x in sets]), np.arange(end - start), 1
            while d < len(sets) and (label != label[0]).any():
                fits = np.minimum(size[:-d], size[d:]) >= least * np.maximum(size[:-d], size[d:]) - 1e-9
                for i in np.flatnonzero(fits & (label[:-d] != label[d:])).tolist():
                    if label[i] != label[i + d] and _similar(sets[i], sets[i + d], least):
                        label[label == label[i + d]] = label[i]
                        edges.append((ids[start + i], ids[start + i + d]))
                d += 1
        edges = np.array(edges, np.int64).reshape(-1, 2)
        return pa.table({"a": edges[:, 0], "b": edges[:, 1]})

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
        if not len(t):
            continue
        last = [t[c][-1] for c in ("key", "bi", "bj")]
        same = np.logical_and.reduce([t[c].to_numpy() == x.as_py() for c, x in zip(("key", "bi", "bj"), last)])
        cut = int(np.argmax(same))
        held = t.slice(cut)
        if cut:
            yield from work(t.slice(0, cut)).to_batches()
    if held is not None:
        yield from work(held).to_batches()


def band_edges(nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], least: float, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of nodes (id, bands) that share a band and are similar.

    Bands with the same members are compared once, since near copies share most of their bands.
    """
    rows = nodes.select(F.explode("bands").alias("key"), "id")
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("mark"), F.min("id").alias("low"), F.max("id").alias("high")).where("n > 1")
    picked = durable(groups.groupBy("n", "mark", "low", "high").agg(F.min("key").alias("key")).select("key", "n"))
    parts = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("id", F.lit(7)), parts).cast("int")
    order = ["key", "bi", "bj"]
    dealt = durable(
        rows.join(F.broadcast(picked) if picked.count() <= BROADCAST else picked, "key")
        .select("key", "id", mine.alias("mine"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
        .select("key", F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"), "id")
    )
    with_sets = dealt.join(sets(dealt.select("id").distinct()), "id").select(*order, "id", "shingles")
    return with_sets.repartition(*order).sortWithinPartitions(*order, "id").mapInArrow(partial(_similar_batches, least=least), "a long, b long").distinct()


def _set_batches(batches, width: int):
    """Shingle sets of the texts that have the wanted identity."""
    for batch in batches:
        own = [(i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if _normal_id(t) == i]
        sets = [np.unique(shingle_hashes(t, width)).tobytes() for _, t in own]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int64()), pa.array(sets, pa.binary())], ["id", "shingles"])


def near_dedup(docs: DataFrame, width: int = 5, similarity: float = 0.8, max_bits: int = 8) -> DataFrame:
    """The documents, one of each group of near copies: the one of smallest doc_id.

    Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of 0.8 or more; groups
    are connected components of that. Candidates come from two kinds of signatures: bands of min-hashes over the
    shingles, which depend on the similarity alone, so that scattered, appended, cut and block edits are found alike,
    and fingerprints over the distinct words, at most max_bits apart. Texts equal after lower-casing A-Z and joining
    words count as one. Texts without words and null texts are copies of each other. Of repeated rows one stays; rows
    that share a doc_id but not a text are documents of their own. All columns come back.

    Shingle sets, which are as large as the texts, are made only for texts that some candidate pair holds.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    ids = durable(texts.mapInArrow(partial(_node_batches, width=width), "doc_id long, id long, fp long, bands array<long>"))
    first = ids.groupBy("id").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp"))
    banded = durable(ids.select("id", "bands").dropDuplicates(["id"]))

    def shingle_sets(wanted: DataFrame) -> DataFrame:
        """(id, shingles), from the smallest document of each id."""
        named = durable(first.join(wanted, "id").select("id", "first"))
        named = F.broadcast(named) if named.count() <= BROADCAST else named
        own = texts.join(named, F.col("doc_id").eqNullSafe(F.col("first"))).select("id", "text")
        return own.mapInArrow(partial(_set_batches, width=width), "id long, shingles binary").dropDuplicates(["id"])

    edges = durable(band_edges(banded, shingle_sets, similarity))
    roots = components(edges.union(near_edges(first.select("id", "fp"), max_bits, shingle_sets, similarity)))
    group = first.join(roots, F.col("id") == F.col("node"), "left").groupBy(F.coalesce("root", "id").alias("root"))
    kept_id, kept_of, own = (fresh(n, docs.columns) for n in ("near_keep", "near_of", "near_id"))
    keep = group.agg(F.min(F.struct(F.col("first").isNull(), "first", "id")).alias("m")).select(F.col("m.first").alias(kept_id), F.col("m.id").alias(kept_of))
    rows = ids.agg(F.count("*").alias("n"), F.count_distinct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).first()
    if rows[0] == rows[1]:
        return docs.join(keep.select(kept_id), F.col("doc_id").eqNullSafe(F.col(kept_id)), "left_semi")
    marked = docs.mapInArrow(partial(_identity_batches, name=own), StructType([*docs.schema.fields, StructField(own, LongType())]))
    kept = marked.join(keep, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_of)), "left_semi")
    return kept.dropDuplicates(["doc_id", own]).drop(own)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document, at 4 bits or fewer; see near_components() for nulls, empty texts and repeats."""
    return near_components(table(spark, sf_dir, "documents"), width=4, max_bits=4)

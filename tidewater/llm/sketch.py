"""Threshold-scaled document fingerprints.

Every five-word shingle hash below 1 / scale of the hash range is retained, whatever the text's length; so sketches
of unequal texts are subsets of one sample, union is merge, and shared hashes estimate containment.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import table
from tidewater.llm.shingles import shingle_hashes

#: One of so many shingle hashes is retained.
SCALE = 8


def shingle_set(text: str, width: int = 5) -> np.ndarray:
    """All distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(text.encode("utf-8", "replace"), width))


def retained(h: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Of a sorted set, the hashes under the threshold, or the smallest if none is."""
    kept = h[: np.searchsorted(h, np.uint64(2**64 // scale))]
    return kept if len(kept) else h[:1]


def sketch(text: str, width: int = 5, scale: int = SCALE) -> np.ndarray:
    """The distinct shingle hashes under the threshold, sorted.

    A text with shingles but none under the threshold keeps its smallest hash, so that it has a fingerprint; a merge
    drops such a hash once another is under the threshold. A text without words has an empty sketch.
    """
    return retained(shingle_set(text, width), scale)


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of two texts' shingles together."""
    return retained(np.union1d(a, b), scale)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the smaller text's shingles that the other has; two empty sketches give 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def likeness(x: np.ndarray, y: np.ndarray, scale: int = SCALE) -> tuple[float, str]:
    """Containment of two shingle sets, and what it was taken from: `sketch`, as their sketches give it, or `shingles`.

    A set without a hash under the threshold has no sample that compares with another's, so such a pair is compared on
    the whole sets.
    """
    limit = np.uint64(2**64 // scale)
    if any(len(h) and h[0] >= limit for h in (x, y)):
        return containment(x, y), "shingles"
    return containment(retained(x, scale), retained(y, scale)), "sketch"


def as_text(h: np.ndarray) -> str:
    """Lowercase hex, 16 digits for each hash."""
    return h.astype(">u8").tobytes().hex()


def _compare_batches(batches, width: int, scale: int):
    """Rows (bucket, copied, doc_id, text) in order: each original against the row after it in its bucket."""
    out: list[tuple] = []
    held = None
    for batch in batches:
        for bucket, copied, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            own = shingle_set(text, width)
            if held is not None and held[0] == bucket and not held[1]:
                _, _, before, prior, mine = held
                n = len(prior) // 2
                edited = prior[: len(prior) - n] + text[:n]
                changed = shingle_set(edited, width)
                digest = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
                out.append((before, len(prior), digest, as_text(retained(mine, scale)), as_text(retained(changed, scale)), *likeness(mine, changed, scale), *likeness(mine, own, scale)))
            held = (bucket, copied, doc_id, text, own)
            if len(out) >= 256:
                yield _rows(out)
                out = []
    if out:
        yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.float64(), pa.string())
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "edited_basis", "near_next", "next_basis"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def compare_with_next(docs: DataFrame, width: int = 5, scale: int = SCALE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, edited_basis, near_next, next_basis for each document.

    A basis is `sketch` where the likeness follows from the two fingerprints, `shingles` where one of the texts has no
    hash under the threshold and whole shingle sets are compared.

    The edited text's last floor(n_chars / 2) code points are replaced by the first as many of the next document in
    order of doc_id (null first, equal doc_ids by text hash), the first following the last; a table of one document
    is its own next. Null text is empty. The documents are dealt by ranges of doc_id and sorted there; each range's
    first document goes to the range before too, so the texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] if n > 1 else [0.5], 10 * n + 100)).first()[0] or []
    cuts = sorted(set(cuts))
    bucket = F.lit(0)
    if cuts:
        # Every wide-th cut leads to the cuts that are looked through, so a row is compared with about twice their square root.
        wide = max(1, int(len(cuts) ** 0.5))
        low = lambda values: F.aggregate(values, F.lit(0), lambda k, c: k + (c <= F.col("doc_id")).cast("int"))
        lists = F.array(*[F.array(*[F.lit(c) for c in cuts[i : i + wide]]) for i in range(0, len(cuts), wide)])
        at = F.greatest(low(F.array(*[F.lit(c) for c in cuts[::wide]])) - 1, F.lit(0))
        bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(at * wide + low(F.get(lists, at)))
    dealt = rows.withColumns({"bucket": bucket, "mark": F.xxhash64("text")})
    firsts = ids.select(bucket.alias("bucket"), "doc_id").groupBy("bucket").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("has_null")).orderBy("bucket").collect()
    if not firsts:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, edited_basis string, near_next double, next_basis string")
    # (the range's first doc_id, the range before); there are at most as many as shuffle partitions.
    to = [(None if r["has_null"] else r["first"], firsts[k - 1]["bucket"]) for k, r in enumerate(firsts)]
    heads = spark.createDataFrame(to, "head long, before int")
    extra = dealt.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")))
    both = dealt.select("bucket", F.lit(0).alias("copied"), "doc_id", "text", "mark").union(extra.select(F.col("before").alias("bucket"), F.lit(1).alias("copied"), "doc_id", "text", "mark"))
    ordered = both.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "copied", F.col("doc_id").asc_nulls_first(), "mark")
    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, edited_basis string, near_next double, next_basis string"
    return ordered.select("bucket", "copied", "doc_id", "text").mapInArrow(partial(_compare_batches, width=width, scale=scale), out)


def op10_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of compare_with_next() for all documents; see there for nulls, empty texts and repeated doc_ids."""
    return compare_with_next(table(spark, sf_dir, "documents"))

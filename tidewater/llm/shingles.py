"""Word shingles of one text, hashed. Small helpers that run inside Spark tasks."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def by_bytes(batch: pa.RecordBatch, column: int, most: int):
    """Slices of a batch in order, whose values of a text or binary column hold about `most` bytes; longer ones are alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), len(ends)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield batch.slice(a, b - a)


def shingle_hashes(text: bytes | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of `width` words, in order, repeats included (uint64).

    Words are split at ASCII white space after lower-casing A-Z. A text of fewer words gives the hash of its
    whole sequence; a null text or one without words gives none.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64)


def rolled_hashes(text: bytes | None, width: int) -> np.ndarray:
    """Like shingle_hashes(), but rolled from one XXH64 for each word; a text of fewer words gives none."""
    h, _, count = rolled_texts([text], width)
    return h[: int(count[0])]


def rolled_texts(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h, start, count): text k has count[k] shingles, hashed in h[start[k] : start[k] + count[k]]; h has a place for each word."""
    words = [t.lower().split() if t else [] for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    w = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), np.uint64, int(lengths.sum()))
    h, n = w.copy(), max(0, len(w) - width + 1)
    for k in range(1, width):
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h[:n] += w[k : k + n]
    return h ^ (h >> np.uint64(32)), np.cumsum(lengths) - lengths, np.maximum(lengths - width + 1, 0)

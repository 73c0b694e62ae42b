"""Packing by shortest-pack-first over the length histogram (Krell et al., 2021, efficient sequence packing).

Documents are tokenised once and cut into full pieces and a rest. The histogram of piece lengths, at most `size`
numbers, is packed on the driver: lengths go longest first into the patterns with most room, and only pattern counts
are updated. Pieces then find their place in a pattern by their rank among the pieces of their length.
"""

from __future__ import annotations

import heapq
import re
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm.common import stored, table, worker_cache

#: Bound of a worker's cache of encoded words, and bytes of text that are encoded in one piece.
CACHE, CHUNK = 400_000, 4 << 20
#: Bins in which pieces of one length are ranked; no length lands in one task.
BINS = 1024
#: Words of ASCII letters, with ASCII marks other than ' after them.
PLAIN = re.compile(rb"([a-z]+)([!-&(-/:-@\[-`{-~]*)")


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts by a tokenizer that lower-cases and never joins over ASCII white space.

    Each distinct word is encoded once; its ids lie in one array, `pool[start : start + length]`, so the ids of many
    texts are one gather.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: A word that is one id, which no other word has; words that hold its character are encoded alone.
        self.mark = self.tokenizer.encode("~", add_special_tokens=False).ids
        #: Whether the model alone gives the ids of letters and marks, as where both are pieces of their own.
        self.direct = [x.id for w in ("tokenizers", "?!") for x in self.tokenizer.model.tokenize(w)] == self.tokenizer.encode("tokenizers?!", add_special_tokens=False).ids
        self._clear()

    def _clear(self):
        self.place: dict[bytes, int] = {}
        #: Place 0 is the end of a text.
        self.start, self.length, self.pool = np.zeros(1, np.int32), np.ones(1, np.int32), np.zeros(1, np.uint32)

    def _add(self, words: list[bytes], lengths: np.ndarray, ids: np.ndarray):
        self.place.update(zip(words, range(len(self.start), len(self.start) + len(words))))
        self.start = np.r_[self.start, (len(self.pool) + np.cumsum(lengths) - lengths).astype(np.int32)]
        self.length, self.pool = np.r_[self.length, lengths.astype(np.int32)], np.r_[self.pool, ids]

    def _learn(self, words: list[bytes]):
        """Encodes new words. A text of many words costs less than as many texts."""
        several, alone, done, lengths, found, model = [], [], [], [], [], self.tokenizer.model
        own, sizes, ids, tails = [], [], [], {b"": []}
        for w in words:
            if self.direct and (m := PLAIN.fullmatch(w)):
                stem, tail = m.groups()
                if tail not in tails:
                    tails[tail] = [x.id for x in model.tokenize(tail.decode())]
                before = len(ids)
                ids += [x.id for x in model.tokenize(stem.decode())]
                ids += tails[tail]
                own.append(w)
                sizes.append(len(ids) - before)
            else:
                (alone if b"~" in w or len(self.mark) != 1 else several).append(w)
        self._add(own, np.array(sizes, np.int64), np.array(ids, np.uint32))
        for i in range(0, len(several), 512):
            own = several[i : i + 512]
            text = " ~ ".join([w.decode("utf-8", "replace") for w in own]) + " ~"
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(ids == self.mark[0])
            if len(ends) == len(own):
                done += own
                lengths.append(np.diff(ends, prepend=-1) - 1)
                found.append(np.delete(ids, ends))
            else:
                alone += own
        for i in range(0, len(alone), 4096):
            own = alone[i : i + 4096]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in own], add_special_tokens=False)]
            done += own
            lengths.append(np.array([len(x) for x in ids]))
            found.append(np.array([y for x in ids for y in x], np.uint32))
        if done:
            self._add(done, np.concatenate(lengths), np.concatenate(found))

    def _places(self, words: list[bytes]) -> np.ndarray:
        if len(self.place) > CACHE:
            self._clear()
        if new := [w for w in words if w not in self.place]:
            self._learn(new)
        return np.fromiter(map(self.place.__getitem__, words), np.int32, len(words))

    def ids(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each with the end id, and where each text's begin and the last's end."""
        texts = pc.fill_null(texts, "")
        # Lower-casing first saves entries, as the tokenizer does so itself; but special tokens have a case.
        special = pc.match_substring(texts, "<|")
        lower = pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(pc.if_else(special, texts, lower) if pc.any(special).as_py() else lower)
        words, ends = split.values.dictionary_encode(), split.offsets.to_numpy()[1:]
        place = self._places(words.dictionary.cast(pa.binary()).to_pylist())[words.indices.to_numpy()]
        place = np.insert(place, ends, 0)
        length = self.length[place]
        to = np.cumsum(length, dtype=np.int64)
        source = np.repeat((self.start[place] - to + length).astype(np.int32), length)
        source += np.arange(len(source), dtype=np.int32)
        self.pool[0] = end
        return self.pool[source].astype("<u4", copy=False), np.r_[0, to[ends + np.arange(len(ends))]]


def _piece_batches(batches, path: str, size: int, end: int):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    kept = worker_cache("packing")
    if path not in kept:
        kept[path] = Encoder(path)
    encoder = kept[path]
    for whole in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.r_[0, np.flatnonzero(np.diff(ends // CHUNK)) + 1, len(ends)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a == b:
                continue
            batch = whole.slice(a, b - a)
            ids, bounds = encoder.ids(batch.column(1), end)
            tokens = np.diff(bounds)
            number = -(-tokens // size)
            of = np.repeat(np.arange(len(batch)), number)
            start = (np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)) * size
            length = np.minimum(size, tokens[of] - start)
            crc = [zlib.crc32(ids[i:j]) for i, j in zip((bounds[of] + start).tolist(), (bounds[of] + start + length).tolist())]
            columns = [batch.column(0).take(pa.array(of)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(tokens[of])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


def pieces(docs: DataFrame, tokenizer: str, size: int = 4096, end: int = 2) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full pieces of `size` ids and the rest of each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_piece_batches, path=tokenizer, size=size, end=end), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """Patterns as (count, lengths), longest length first, that hold every piece of the histogram once."""
    room: dict[int, list] = {}
    heap: list[int] = []

    def put(free, count, lengths):
        if free not in room:
            room[free] = []
            heapq.heappush(heap, -free)
        room[free].append((count, lengths))

    for length in sorted(histogram, reverse=True):
        left, later = histogram[length], []
        while left and heap and -heap[0] >= length:
            free = -heap[0]
            count, lengths = room[free].pop()
            if not room[free]:
                del room[free]
                heapq.heappop(heap)
            if count > left:
                later.append((free, count - left, lengths))
            used = min(count, left)
            left -= used
            put(free - length, used, [*lengths, length])
        while left:
            # A new pattern takes as many of this length as fit evenly over the fewest packs.
            each = max(1, min(left, size // length))
            packs = left // each
            later.append((size - each * length, packs, [length] * each))
            left -= packs * each
        for x in later:
            put(*x)
    return [(count, lengths) for free in sorted(room) for count, lengths in room[free]]


def slots(patterns: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """For each length, runs of ranks: key (length << 40 | first rank), the first sequence and the offset; sorted by key."""
    ranks: dict[int, int] = {}
    rows, base = [], 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            rank = ranks.get(length, 0)
            rows.append((length << 40 | rank, base, offset))
            ranks[length] = rank + count
            offset += length
        base += count
    rows.sort()
    key, sequence, offset = np.array(rows, np.int64).reshape(-1, 3).T
    return {"key": key, "sequence": sequence, "offset": offset}


def _place_batches(batches, table):
    t = table.value
    for b in batches:
        length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
        key = (length << 40) | rank
        i = np.searchsorted(t["key"], key, "right") - 1
        columns = [*[b[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")], pa.array(t["sequence"][i] + key - t["key"][i]), pa.array(t["offset"][i])]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = 4096, end: int = 2) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one end id; repeated rows and null doc_ids are documents of their own; an empty table
    gives no rows. What the driver holds and broadcasts is bounded by the lengths 1..size.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer or public_tokenizer(), size, end), "pieces").withColumn("bin", F.pmod(F.xxhash64("doc_id", "start"), F.lit(BINS)))
    counts = cut.groupBy("length", "bin").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if not histogram:
        return cut.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = spark.sparkContext.broadcast(slots(shortest_pack_first(histogram, size)))
    before = F.sum("n").over(W.partitionBy("length").orderBy("bin").rowsBetween(W.unboundedPreceding, -1))
    fronts = counts.select("length", "bin", F.coalesce(before, F.lit(0)).alias("front"))
    inside = F.row_number().over(W.partitionBy("length", "bin").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = cut.withColumn("inside", inside).join(fronts, ["length", "bin"]).withColumn("rank", (F.col("front") + F.col("inside")).cast("long"))
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(partial(_place_batches, table=placed), out)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of pack() of all documents, in sequences of 4096 tokens; see there for nulls, empty texts and repeats."""
    return pack(table(spark, sf_dir, "documents"))

"""Class-based bigram language model (Brown et al., 1992) with classes from the exchange algorithm.

P(w | w') = P(class w | class w') * P(w | class w), add-half smoothed. Word counts and class transitions are taken from
all training tokens. The most frequent words are exchanged from class to class one by one; rarer and unseen words move
with the words of the same ending. A sweep of the exchange is one pass over the corpus, which counts for each word the
classes before and after it; the driver then moves words by these counts (as in distributed exchange, Uszkoreit and
Brants, 2008), and the next pass counts under the new classes.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import join_hot, stored, table
from tidewater.llm.shingles import by_bytes

#: Words with a place of their own in the exchange, endings (by hash of three bytes) that stand for all others, classes, sweeps.
WORDS, ENDINGS, CLASSES, SWEEPS = 16_384, 1024, 64, 5
#: Bytes of text in a block, which has one list of words.
BLOCK_BYTES = 24_000_000
#: Tokens whose neighbours a task counts at once, a text at the least.
TOKENS = 1 << 19
#: The end of a text as a word; no word has a space.
END = b" "
_BLOCK = "block long, doc_id long, held_out boolean, ids binary, idx int, h long, ending int, count long"
_DOCS = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, log_counts double, units binary"


def ending_of(word: bytes) -> int:
    """-1 for END."""
    return -1 if word == END else xxhash.xxh64_intdigest(word[-3:], 1) % ENDINGS


def _block(number: int, docs: list[tuple]):
    """A block's documents as ids into its own list of words, and the words with their training counts."""
    index: dict[bytes, int] = {END: 0}
    ids = []
    for _, text, _ in docs:
        words = text.lower().split() if text else []
        own = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32, len(words))
        ids.append(np.append(own, np.int32(0)))
    trained = [x for x, d in zip(ids, docs) if not d[2]]
    count = np.bincount(np.concatenate([np.zeros(0, np.int32), *trained]), minlength=len(index))
    h = np.array([xxhash.xxh64_intdigest(w) for w in index], np.uint64).view(np.int64)
    yield _rows(number, len(docs), doc_id=[x[0] for x in docs], held_out=[x[2] for x in docs], ids=[x.tobytes() for x in ids])
    yield _rows(number, len(index), idx=np.arange(len(index)), h=h, ending=[ending_of(w) for w in index], count=count)


def _rows(number: int, size: int, **columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "int": pa.int32()}
    names = [x.split() for x in _BLOCK.split(", ")]
    columns["block"] = np.full(size, number)
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[k]) if c in columns else pa.nulls(size, kinds[k]) for c, k in names], [c for c, _ in names])


def _block_batches(batches, size: int):
    from pyspark import TaskContext

    number, docs, held = TaskContext.get().partitionId() << 28, [], 0
    for batch in batches:
        for doc in zip(*(c.to_pylist() for c in batch.columns)):
            docs.append(doc)
            held += len(doc[1] or b"")
            if held >= size:
                yield from _block(number, docs)
                number, docs, held = number + 1, [], 0
    if docs:
        yield from _block(number, docs)


def _encode(docs: pa.Table, words: pa.Table, tokens: int, types: int) -> pa.Table:
    """One block's documents in units, with what their words' counts over the whole training text say."""
    c, unit = np.zeros(len(words)), np.zeros(len(words), "<u2")
    at = words["idx"].to_numpy()
    c[at], unit[at] = words["c"].to_numpy(), words["unit"].to_numpy()
    base, log_c = np.log10((c + 0.5) / (tokens + 0.5 * (types + 1))), np.log10(c + 0.5)
    ids = [np.frombuffer(x, np.int32) for x in docs["ids"].to_pylist()]
    return pa.table({
        "doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
        "n_known": pa.array([int((c[x] > 0).sum()) for x in ids], pa.int64()), "base_score": pa.array([float(base[x].sum()) for x in ids], pa.float64()),
        "log_counts": pa.array([float(log_c[x[:-1]].sum()) for x in ids], pa.float64()), "units": pa.array([unit[x].tobytes() for x in ids], pa.binary()),
    })


def _neighbour_batches(batches, classes):
    """For each unit of this task's texts, how often each class comes after and before it, and the unit itself after it."""
    cls = classes.value
    n, wide = len(cls), int(cls.max()) + 1
    after, before, own = np.zeros(n * wide, np.int64), np.zeros(n * wide, np.int64), np.zeros(n, np.int64)
    for part in (part for batch in batches for part in by_bytes(batch, batch.schema.get_field_index("units"), 2 * TOKENS)):
        # Every text ends in END, the last unit, which is also what comes before its first word.
        u = np.concatenate([np.array([n - 1]), *(np.frombuffer(x, "<u2") for x in part["units"].to_pylist())]).astype(np.int64)
        k = cls[u]
        after += np.bincount(u[:-1] * wide + k[1:], minlength=n * wide)
        before += np.bincount(u[1:] * wide + k[:-1], minlength=n * wide)
        own += np.bincount(u[:-1][u[:-1] == u[1:]], minlength=n)
    after, before = after.reshape(n, wide), before.reshape(n, wide)
    some = np.flatnonzero(after.any(1) | before.any(1))
    for i in range(0, len(some), 2048):
        part = some[i : i + 2048]
        rows = np.concatenate([after[part], before[part], own[part, None]], axis=1).astype("<i8")
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([x.tobytes() for x in rows], pa.binary())], ["unit", "counts"])


def _sum_batches(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for u, counts in zip(batch["unit"].to_pylist(), batch["counts"].to_pylist()):
            total[u] = total.get(u, 0) + np.frombuffer(counts, "<i8")
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["unit", "counts"])


def neighbours(docs: DataFrame, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(after, before, own) over all training texts: units x classes, units x classes, units. One row a unit comes to the driver."""
    spark = docs.sparkSession
    n, wide = len(cls), int(cls.max()) + 1
    # A task's counts are as wide as all units, so there are no more tasks than cores.
    few = docs.where("not held_out").select("units").coalesce(spark.sparkContext.defaultParallelism)
    parts = few.mapInArrow(partial(_neighbour_batches, classes=spark.sparkContext.broadcast(cls)), "unit int, counts binary")
    total = np.zeros((n, 2 * wide + 1), np.int64)
    for r in parts.repartition("unit").mapInArrow(_sum_batches, "unit int, counts binary").collect():
        total[r["unit"]] = np.frombuffer(r["counts"], "<i8")
    return total[:, :wide], total[:, wide : 2 * wide], total[:, -1]


def _f(x):
    return x * np.log(np.maximum(x, 1))


def likelihood(n: np.ndarray) -> float:
    """The part of the class bigram log likelihood that depends on the classes."""
    return float(_f(n).sum() - _f(n.sum(1)).sum() - _f(n.sum(0)).sum())


def transitions(after: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Class bigram counts."""
    n = np.zeros((after.shape[1],) * 2)
    np.add.at(n, cls, after)
    return n


def moved(after: np.ndarray, before: np.ndarray, own: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Classes after each unit, the most frequent first, went where the class bigram likelihood gains most; END stays alone in the last class.

    Class counts follow each move; a unit's neighbours are those counted before the first.
    """
    cls, n = cls.copy(), transitions(after, cls)
    classes, fn = after.shape[1] - 1, _f(n)
    d = np.arange(classes)

    def shift(k, out, into, self_, sign):
        n[k] += sign * out
        n[:, k] += sign * into
        n[k, k] += sign * self_
        fn[k], fn[:, k] = _f(n[k]), _f(n[:, k])

    for u in np.argsort(-after[:-1].sum(1), kind="stable"):
        out, into, self_ = after[u].astype(float), before[u].astype(float), float(own[u])
        if not out.sum() + into.sum():
            break
        a = cls[u]
        out[a] -= self_
        into[a] -= self_
        shift(a, out, into, self_, -1)
        rows, cols = n.sum(1)[:classes], n.sum(0)[:classes]
        # Only classes that the unit meets change.
        x, y = np.flatnonzero(out), np.flatnonzero(into)
        gain = (_f(n[:classes, x] + out[x]) - fn[:classes, x]).sum(1) + (_f(n[y, :classes] + into[y, None]) - fn[y, :classes]).sum(0)
        corner = n[d, d]
        gain += _f(corner + out[d] + into[d] + self_) - _f(corner + out[d]) - _f(corner + into[d]) + fn[d, d]
        gain -= _f(rows + out.sum() + self_) - _f(rows) + _f(cols + into.sum() + self_) - _f(cols)
        b = int(np.argmax(gain))
        b = a if gain[b] <= gain[a] + 1e-9 else b
        shift(b, out, into, self_, 1)
        cls[u] = b
    return cls


def exchange(docs: DataFrame, tokens: np.ndarray, classes: int, sweeps: int) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, class bigram counts): at most `sweeps` sweeps; units start dealt out by their token counts, END, the last, is alone in the last class.

    A sweep's moves are weighed one by one against the counts at its start. Where together they don't raise the
    likelihood, half of them are taken back, and half of the rest, until what is left does.
    """
    cls = np.empty(len(tokens), np.int64)
    cls[np.argsort(-tokens[:-1], kind="stable")] = np.arange(len(tokens) - 1) % classes
    cls[-1] = classes
    best = None
    for sweep in range(sweeps + 1):
        after, before, own = neighbours(docs, cls)
        n = transitions(after, cls)
        if best is not None and likelihood(n) <= best[0]:
            apart = np.flatnonzero(cls != best[1])
            cls[apart[1::2]] = best[1][apart[1::2]]
            if len(apart) < 2:
                break
            continue
        best = likelihood(n), cls.copy(), n
        if sweep < sweeps:
            cls = moved(after, before, own, cls).copy()
            if (cls == best[1]).all():
                break
    return best[1], best[2]


def _score_batches(batches, model):
    p = model.value
    cls, step, emit = p["classes"], p["transitions"], p["emit"]
    for b in batches:
        scores = []
        for units, log_counts in zip(b["units"].to_pylist(), b["log_counts"].to_pylist()):
            k = cls[np.frombuffer(units, "<u2")]
            scores.append(float(log_counts + step[np.r_[len(step) - 1, k[:-1]], k].sum() - emit[k].sum()))
        tokens = pa.array(np.full(len(b), p["tokens"]), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b["doc_id"], b["held_out"], b["n_tokens"], b["n_known"], tokens, b["base_score"], pa.array(scores, pa.float64())],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score(docs: DataFrame, held_out, classes: int = CLASSES, sweeps: int = SWEEPS, words: int = WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for each document.

    `held_out` is a Column; the other documents train. Null text is empty and scores its end alone; repeated rows
    count and come back repeated; without training text every count is 0. Documents are cut into blocks of about
    `block_bytes`, each with its own list of words; only these lists, not tokens, meet the corpus counts. `words`
    bounds what the driver holds of the exchange, words + ENDINGS rows of two counts a class; counts are of all words.
    """
    spark, end = docs.sparkSession, words + ENDINGS
    if end >= 1 << 16:
        raise ValueError("words and endings must be fewer than 65,536")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    blocks = stored(rows.mapInArrow(partial(_block_batches, size=block_bytes), _BLOCK), "lm-blocks")
    coded = blocks.where("ids is not null").select("block", "doc_id", "held_out", "ids")
    listed = blocks.where("idx is not null").select("block", "idx", "h", "ending", "count")
    counts = stored(listed.groupBy("h").agg(F.sum("count").alias("c"), F.count("*").alias("n"), F.min("ending").alias("ending")), "lm-counts")
    frequent = counts.where("c > 0 and ending >= 0").orderBy(F.desc("c"), "h").select("h").limit(words).collect()
    own = F.broadcast(spark.createDataFrame([(r["h"], i) for i, r in enumerate(frequent)], "h long, own int"))
    unit = F.when(F.col("ending") < 0, end).otherwise(F.coalesce("own", F.col("ending") + words))
    counts = counts.join(own, "h", "left").select("h", "c", "n", unit.alias("unit"))
    tokens, types = np.zeros(end + 1, np.int64), np.zeros(end + 1, np.int64)
    for r in counts.where("c > 0").groupBy("unit").agg(F.sum("c").alias("tokens"), F.count("*").alias("types")).collect():  # one row a unit
        tokens[r["unit"]], types[r["unit"]] = r["tokens"], r["types"]
    met = join_hot(listed.select(F.col("block").alias("of"), "idx", "h"), counts, "h", ["of"]).select("of", "idx", "c", "unit")
    encode = partial(_encode, tokens=int(tokens.sum()), types=int(types.sum()))
    encoded = stored(coded.groupBy("block").cogroup(met.groupBy("of")).applyInArrow(encode, _DOCS), "lm-docs")
    cls, n = exchange(encoded, tokens, classes, sweeps)
    class_tokens, class_types = (np.bincount(cls, x, classes + 1) for x in (tokens, types))
    emit = np.log10(class_tokens + 0.5 * (class_types + 1))
    emit[-1] = 0.0  # the class of END holds nothing else
    model = spark.sparkContext.broadcast({"classes": cls, "tokens": int(tokens.sum()), "emit": emit, "transitions": np.log10((n + 0.5) / (n.sum(1, keepdims=True) + 0.5 * (classes + 1)))})
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return encoded.mapInArrow(partial(_score_batches, model=model), out).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op5_classlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of score() for every document; see there for nulls, empty texts and repeats. A null doc_id trains."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)

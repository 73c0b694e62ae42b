"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary. A word's probability is the sum over all
ways to cut it into pieces, by the forward algorithm; a text's is the product over its words. Piece probabilities are
trained by expectation-maximisation (forward-backward) on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import durable, table, worker_cache

#: Documents of each language that train it, and rounds of expectation-maximisation.
PER_LANGUAGE, ROUNDS = 500, 3
#: Bound of a worker's cache; pieces' pseudo-count; an unknown letter.
CACHE, PSEUDO, UNKNOWN = 200_000, 0.01, 1e-9
#: Letters of a run that are summed in one step; the sums are carried from step to step. Letters in one lattice.
STEP, CELLS = 1024, 20_000
#: Letters after which sums are scaled, so that they never underflow.
SCALED = 8
#: Languages, or sampled documents, that are broadcast; more are joined by a shuffle.
BROADCAST = 100_000
LETTERS = regex.compile(r"\p{L}+")


def public_vocabulary(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Trie:
    """All beginnings of a vocabulary's pieces as nodes; a step is the key `node * letters + letter`, found by bisection."""

    def __init__(self, pieces: dict[str, int]):
        beginnings = sorted({p[:i] for p in pieces for i in range(1, len(p) + 1)})
        node = {"": 0} | {p: k for k, p in enumerate(beginnings, 1)}
        alphabet = sorted({p[-1] for p in beginnings})
        letter = {c: k for k, c in enumerate(alphabet, 1)}
        self.letters, self.pieces = len(alphabet) + 1, max(pieces.values(), default=0) + 1
        #: Letter by code point; 0 for one in no piece.
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in alphabet]] = list(letter.values())
        keys = np.array([node[p[:-1]] * self.letters + letter[p[-1]] for p in beginnings] or [-1], np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.arange(1, len(keys) + 1)[order]
        #: A node's piece, -1 for none.
        self.piece = np.array([-1] + [pieces.get(p, -1) for p in beginnings], np.int64)
        self.longest = max(map(len, beginnings), default=1)

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The node after each node's letter, -1 for none."""
        key = node * self.letters + letter
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.next[at], -1)


def vocabulary(path: str) -> Trie:
    """The trie of a public vocabulary's pieces, without control and byte pieces."""
    kept = worker_cache("langid")
    if path not in kept:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        kept[path] = Trie({sp.id_to_piece(i): i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))})
    return kept[path]


class Lattice:
    """All pieces in many words: arrays of word, start, end and piece; piece -1 is a letter that is no piece.

    The pieces of each length lie together, in order of their start. Pieces that end in the first `seen` letters are
    left out, as the sums over these are known.
    """

    def __init__(self, words: list[str], trie: Trie, seen: int = 0):
        self.words, self.ends, self.seen, self.reach = len(words), np.array([len(w) for w in words], np.int64), seen, trie.longest
        longest = int(self.ends.max(initial=0))
        inside = np.arange(longest)[:, None] < self.ends
        start, word = np.nonzero(inside)
        letters = np.zeros((self.words, longest), np.int32)
        letters[inside.T] = trie.letter[np.frombuffer("".join(words).encode("utf-32-le", "replace"), "<u4")]
        node, size, kept = np.zeros(len(word), np.int64), 0, []
        self.cuts, edges = [], 0
        while len(word):
            node = trie.step(node, letters[word, start + size])
            size += 1
            # Single letters are always there.
            own = np.where(node >= 0, trie.piece[node], -1)
            e = np.flatnonzero(((own >= 0) | (size == 1)) & (start + size > seen))
            kept.append((word[e], start[e], start[e] + size, own[e]))
            self.cuts.append((edges + np.searchsorted(start[e], np.arange(longest + 1))).tolist())
            edges += len(e)
            on = np.flatnonzero((node >= 0) & (start + size < self.ends[word]))
            word, start, node = word[on], start[on], node[on]
        self.word, self.start, self.end, self.piece = (np.concatenate(x) for x in zip(*kept)) if kept else np.zeros((4, 0), np.int64)

    def forward(self, p, known: np.ndarray | None = None):
        """(alpha, log scale): alpha[w, j] * exp(scale[w, j]) is the probability of all segmentations of the first j
        letters, for each column of p (one row an edge). `known`: alpha of the first seen + 1 places, if any are seen."""
        total = np.zeros((self.words, int(self.ends.max(initial=0)) + 1, p.shape[1]))
        if known is None:
            total[:, 0] = 1.0
        else:
            total[:, : self.seen + 1] = known
        scale = np.zeros_like(total)
        for i in range(total.shape[1] - 1):
            if i > self.seen and i % SCALED == 0:
                top = total[:, i : i + self.reach].max(1)
                top[top == 0] = 1.0
                total[:, i : i + self.reach] /= top[:, None]
                scale[:, i:] += np.log(top)[:, None]
            for size, cut in enumerate(self.cuts, 1):
                if cut[i] < cut[i + 1]:
                    e = slice(cut[i], cut[i + 1])
                    w = self.word[e]
                    total[w, i + size] += total[w, i] * p[e]
        return total, scale

    def backward(self, p):
        """(beta, log scale) of all segmentations of the letters from j on."""
        total = np.zeros((self.words, int(self.ends.max(initial=0)) + 1, p.shape[1]))
        total[np.arange(self.words), self.ends] = 1.0
        scale = np.zeros_like(total)
        for i in range(total.shape[1] - 2, -1, -1):
            for size, cut in enumerate(self.cuts, 1):
                if cut[i] < cut[i + 1]:
                    e = slice(cut[i], cut[i + 1])
                    w = self.word[e]
                    total[w, i] += total[w, i + size] * p[e]
            if i and i % SCALED == 0:
                top = total[:, i : i + self.reach].max(1)
                top[top == 0] = 1.0
                total[:, i : i + self.reach] /= top[:, None]
                scale[:, i : i + self.reach] += np.log(top)[:, None]
                scale[:, :i] = scale[:, i : i + 1]
        return total, scale


def _of_edges(table: np.ndarray, lattice: Lattice) -> np.ndarray:
    """Probabilities of each edge's piece: a row of table (pieces x languages), UNKNOWN for no piece."""
    return np.where((lattice.piece >= 0)[:, None], table[lattice.piece], UNKNOWN)


def _grouped(lengths: np.ndarray, most: int | None = None):
    """Places of words in groups of like length, whose lattices (of at most `most` letters a word) hold about CELLS letters."""
    order, at = np.argsort(lengths, kind="stable"), 0
    wide = np.minimum(lengths[order], most) if most else lengths[order]
    while at < len(order):
        size = np.arange(1, len(order) - at + 1) * wide[at:]
        to = at + max(1, int(np.searchsorted(size, CELLS, "right")))
        yield order[at:to]
        at = to


def _log_sums(words: list[str], trie: Trie, table: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language, STEP letters at a time; the sums at the last places, as many as a
    piece is long, are carried on."""
    out, lengths = np.zeros((len(words), table.shape[1])), np.array([len(w) for w in words])
    live, at, known = np.arange(len(words)), 0, None
    while len(live):
        seen = min(at, trie.longest)
        lattice = Lattice([words[k][at - seen : at + STEP] for k in live], trie, seen)
        alpha, scale = lattice.forward(_of_edges(table, lattice), known)
        row, end = np.arange(len(live)), lattice.ends
        last = scale[row, end]
        more = lengths[live] > at + STEP
        out[live[~more]] += np.log(alpha[row, end])[~more] + last[~more]
        at += STEP
        if more.any():
            # Those that go on all end at the same place.
            span = slice(seen + STEP - min(at, trie.longest), seen + STEP + 1)
            known = alpha[more, span] * np.exp(scale[more, span] - last[more][:, None])
            top = known.max(1)
            known /= top[:, None]
            out[live[more]] += last[more] + np.log(top)
        live = live[more]
    return out


def word_scores(words: list[str], path: str, table: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language, over all its segmentations, however long it is."""
    trie, out = vocabulary(path), np.zeros((len(words), table.shape[1]))
    for own in _grouped(np.array([len(w) for w in words], np.int64), STEP):
        out[own] = _log_sums([words[k] for k in own], trie, table)
    return out


def _expect_batches(batches, path: str, models):
    """Expected piece counts of (lang, word, n) rows under the languages' current probabilities."""
    tables, total = models.value, {}
    for batch in batches:
        langs, words, counts = (batch[c].to_pylist() for c in ("lang", "word", "n"))
        for lang in set(langs):
            total.setdefault(lang, np.zeros(len(tables[None])))
        for own in _grouped(np.array([len(w) for w in words], np.int64)):
            lattice = Lattice([words[k] for k in own], vocabulary(path))
            of, row = np.array([langs[k] for k in own], object), np.arange(len(own))
            p = np.full((len(lattice.word), 1), UNKNOWN)
            edges = {lang: (of == lang)[lattice.word] & (lattice.piece >= 0) for lang in set(of)}
            for lang, e in edges.items():
                p[e, 0] = tables.get(lang, tables[None])[lattice.piece[e]]
            (alpha, up), (beta, down) = ((x[:, :, 0] for x in both) for both in (lattice.forward(p), lattice.backward(p)))
            whole = np.log(alpha[row, lattice.ends]) + up[row, lattice.ends]
            w, i, j = lattice.word, lattice.start, lattice.end
            share = np.array([counts[k] for k in own])[w] * alpha[w, i] * p[:, 0] * beta[w, j] * np.exp(up[w, i] + down[w, j] - whole[w])
            for lang, e in edges.items():
                total[lang] += np.bincount(lattice.piece[e], share[e], len(total[lang]))
    rows = [(lang, int(k), float(x[k])) for lang, x in total.items() for k in np.flatnonzero(x)]
    columns = list(zip(*rows)) or [[], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.float64())], ["lang", "piece", "x"])


def _count_batches(batches):
    """Counts of the words, each after a mark of its start, in (lang, text) rows."""
    for batch in batches:
        count: Counter = Counter()
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            count.update((lang, "▁" + w) for w in LETTERS.findall(text.lower()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in count], pa.string()), pa.array([k[1] for k in count], pa.string()), pa.array(count.values(), pa.float64())], ["lang", "word", "n"])


def sample(labelled: DataFrame, per_language: int) -> DataFrame:
    """(lang, text) of about `per_language` documents of each language, those of least hash; rows of the same text and doc_id count once.

    Languages are counted first; then only hashes below a threshold that lets through four times as many documents as
    wanted are ranked, and texts are read for those that are picked.
    """
    rows = labelled.where("text is not null and lang is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("mark"))
    marks = durable(rows.select("lang", "mark").distinct())
    share = F.shiftrightunsigned("mark", 1) / float(1 << 63)
    counts = durable(marks.groupBy("lang").agg((4.0 * per_language / F.count("*")).alias("share")))
    near = marks.join(F.broadcast(counts) if counts.count() <= BROADCAST else counts, "lang").where(share <= F.col("share"))
    order = F.row_number().over(W.partitionBy("lang").orderBy(share, "mark"))
    picked = durable(near.withColumn("order", order).where(F.col("order") <= per_language).select("lang", "mark"))
    small = F.broadcast(picked) if picked.count() <= BROADCAST else picked
    return rows.join(small, ["lang", "mark"]).dropDuplicates(["lang", "mark"]).select("lang", "text")


def train(labelled: DataFrame, path: str, per_language: int = PER_LANGUAGE, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Piece probabilities of each language from (doc_id, text, lang) rows; those without a text or language don't count.

    The driver holds one number for each language and piece of the vocabulary.
    """
    spark = labelled.sparkSession
    words = sample(labelled, per_language).mapInArrow(_count_batches, "lang string, word string, n double")
    # Few bytes but long work for each, so the words are dealt out evenly.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = durable(words.groupBy("lang", "word").agg(F.sum("n").alias("n")).repartition(parts))
    size = vocabulary(path).pieces
    models: dict = {None: np.full(size, 1.0 / size)}
    for _ in range(rounds):
        step = counts.mapInArrow(partial(_expect_batches, path=path, models=spark.sparkContext.broadcast(models)), "lang string, piece int, x double")
        found = step.groupBy("lang", "piece").agg(F.sum("x").alias("x")).toPandas()
        for lang, own in found.groupby("lang"):
            p = np.full(size, PSEUDO)
            p[own["piece"]] += own["x"]
            models[lang] = p / p.sum()
    return {k: v for k, v in sorted((k, v) for k, v in models.items() if k is not None)}


class _Known:
    """Scores of words that a worker has met, by their place in one array; runs of other characters than white space are words."""

    def __init__(self, languages: int):
        self.place: dict[str, int] = {}
        self.score = np.zeros((CACHE + 100_000, languages))
        self.letters = np.zeros(len(self.score), bool)

    def add(self, words: list[str], path: str, table: np.ndarray):
        parts = [(k, "▁" + letters) for k, w in enumerate(words) for letters in ([w] if w.isalpha() else LETTERS.findall(w))]
        at = len(self.place)
        if at + len(words) > len(self.score):
            self.score = np.vstack([self.score, np.zeros((len(words), table.shape[1]))])
            self.letters = np.r_[self.letters, np.zeros(len(words), bool)]
        self.score[at : at + len(words)], self.letters[at : at + len(words)] = 0, False
        if parts:
            of = np.array([k for k, _ in parts])
            np.add.at(self.score, at + of, word_scores([r for _, r in parts], path, table))
            self.letters[at + of] = True
        self.place.update(zip(words, range(at, at + len(words))))


def _predict_batches(batches, path: str, models, name: str, text: int):
    """Rows whose field `text` is the text, which is carried once; adds lang_pred and score."""
    langs = list(models.value)
    table = np.array(list(models.value.values())).T if langs else np.zeros((1, 0))
    kept = worker_cache("langid")
    if kept.get("model") != name:
        kept |= {"model": name, "known": _Known(len(langs))}
    for whole in batches:
        for at in range(0, len(whole), 256):
            batch, known = whole.slice(at, 256), kept["known"]
            if len(known.place) > CACHE:
                known = kept["known"] = _Known(len(langs))
            counts = [Counter(t.lower().split()) if t and langs else Counter() for t in batch.column(0).field(text).to_pylist()]
            known.add(list({w for c in counts for w in c}.difference(known.place)), path, table)
            picked, score = [], []
            for c in counts:
                place = np.fromiter(map(known.place.__getitem__, c), np.int64, len(c))
                if not known.letters[place].any():
                    picked.append("und")
                    score.append(0.0)
                    continue
                total = np.fromiter(c.values(), float, len(c)) @ known.score[place]
                best = int(np.argmax(total))
                picked.append(langs[best])
                score.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(picked, pa.string()), pa.array(score, pa.float64())], ["row", "lang_pred", "score"])


def predict(docs: DataFrame, models: dict[str, np.ndarray], path: str) -> DataFrame:
    """(row, lang_pred, score): row is the whole input row, so no column name can clash.

    lang_pred is `und` with score 0 for a null text, one without a letter, or if no language was learned; else the most
    probable language, the first by name on a tie, and its posterior probability under equal priors. Only the text is
    read; repeated rows are predicted each.
    """
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = [c.lower() for c in docs.columns].index("text")
    run = partial(_predict_batches, path=path, models=spark.sparkContext.broadcast(models), name=str(id(models)), text=at)
    return docs.select(F.struct("*").alias("row")).mapInArrow(run, schema)


def split(doc_id: Column) -> Column:
    """True where a document is held out of training; a null doc_id never is."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, path: str | None = None) -> DataFrame:
    """predict() of all documents, trained on the labelled ones that aren't held out; a null doc_id isn't.

    Where no document is labelled, all are `und`. An empty table gives no rows.
    """
    path = path or public_vocabulary()
    return predict(docs, train(docs.where(~split(F.col("doc_id"))).select("doc_id", "text", "lang"), path), path)


def keep_identified(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The documents whose text has a language; null texts and texts without a letter go."""
    return identify(docs, path).where("lang_pred <> 'und'").select("row.*")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; see predict() and split() for nulls, empty texts and repeats."""
    out = identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("row.doc_id", split(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")

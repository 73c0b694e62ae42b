"""Prefix trie of conversations, packed as double arrays.

A conversation is the sequence of its turns; equal sequences are counted before they are shuffled as one. Sequences are
dealt to prefix shards: by their first turn, by their first two, four, ... turns where a prefix holds more than a shard,
so a common opening is split and every subtree below a shard's prefix lies in one task. A task gives its turns dense ids,
packs BASE and CHECK arrays level by level and walks all its sequences through them for the nodes. Nodes above the
shards' prefixes occur in many tasks: their counts are merged globally, and their subtree sums are taken by doubling the
distance to the ancestor that a node adds to, so a long shared prefix takes its logarithm in rounds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import crc32_sql, durable, join_hot, stored, table
from tidewater.llm.mixing import n_words

#: Turns of a prefix shard, unless one sequence alone has more; with more turns than SHARD x HOT_SHARDS they grow, so that at most HOT_SHARDS prefixes are ever split.
SHARD, HOT_SHARDS = 8192, 10_000
#: conv_ids of one sequence are joined to text in pieces of this id range.
CHUNK_BITS = 12
NO_ENDS = hashlib.sha256(b"").hexdigest()


class DoubleArray:
    """The child of slot s by label c is base[s] + c, if check[] there is s. Slot 0 is the root; free slots have check -1."""

    def __init__(self, size: int = 1024):
        self.base, self.check, self.top = np.zeros(size, np.int64), np.full(size, -1, np.int64), 1
        self.check[0] = 0

    def _reserve(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base, self.check = np.r_[self.base, np.zeros(more, np.int64)], np.r_[self.check, np.full(more, -1, np.int64)]

    def insert(self, parents: np.ndarray, labels: np.ndarray) -> None:
        """Places the children of slots that have none yet; (parent, label) pairs may repeat."""
        order = np.lexsort((labels, parents))
        parents, labels = parents[order], labels[order]
        new = np.r_[True, (parents[1:] != parents[:-1]) | (labels[1:] != labels[:-1])][: len(parents)]
        parents, labels = parents[new], labels[new]
        first = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]][: len(parents)])
        counts = np.diff(np.r_[first, len(parents)])
        for k in sorted(np.flatnonzero(counts > 1).tolist(), key=lambda k: -counts[k]):
            own = slice(first[k], first[k] + counts[k])
            self._place(int(parents[first[k]]), labels[own])
        # Nodes with one child fit anywhere: they fill the holes first.
        alone = first[counts == 1]
        holes = np.flatnonzero(self.check[: self.top] < 0)[: len(alone)]
        fresh = len(alone) - len(holes)
        self._reserve(self.top + fresh)
        slots = np.r_[holes, np.arange(self.top, self.top + fresh)]
        self.top += fresh
        self.base[parents[alone]] = slots - labels[alone]
        self.check[slots] = parents[alone]

    def _place(self, parent: int, labels: np.ndarray) -> None:
        offsets = labels - labels[0]
        self._reserve(self.top + int(offsets[-1]) + 1)
        fits = np.flatnonzero(self.check[: self.top] < 0)
        fits = fits[fits + offsets[-1] < len(self.check)]
        for o in offsets[1:]:
            if not len(fits):
                break
            fits = fits[self.check[fits + o] < 0]
        at = int(fits[0]) if len(fits) else self.top
        self.base[parent] = at - labels[0]
        self.check[at + offsets] = parent
        self.top = max(self.top, at + int(offsets[-1]) + 1)

    def step(self, slots: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The children by these labels; -1 where there is none."""
        to = self.base[slots] + labels
        held = (to > 0) & (to < self.top)
        return np.where(held & (self.check[np.where(held, to, 0)] == slots), to, -1)


NODES = (
    "upper boolean, hash binary, parent binary, up array<binary>, conv_id long, depth long, parent_conv_id long, n_convs long, words long, "
    "n_children long, n_leaves long, saved long, ends string"
)
_ARROW = pa.schema([
    ("upper", pa.bool_()), ("hash", pa.binary()), ("parent", pa.binary()), ("up", pa.list_(pa.binary())), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
    ("n_convs", pa.int64()), ("words", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string()),
])


def _nodes(shard: pa.Table) -> pa.Table:
    """The nodes of one task's sequences (path, words, n, conv_id, cut, ends).

    A node of depth `cut` or more is complete. A node above has the sums of its complete children alone; `hash` names
    its path, `up` the paths of its ancestors at distances 1, 2, 4, ... `parent` is set where a parent is above the cut.
    """
    rows = sorted(zip(*(shard[c].to_pylist() for c in ("path", "words", "n", "conv_id", "cut", "ends"))), key=lambda r: r[0])
    lengths = np.array([len(r[0]) for r in rows])
    weight, conv, cut = (np.array([r[i] for r in rows], np.int64) for i in (2, 3, 4))
    deepest = int(lengths.max(initial=0))
    # Dense ids by level, so that the children of a node lie close together.
    ids: dict[bytes, int] = {}
    labels, words_of = [], []
    for d in range(deepest):
        row = []
        for path, words, *_ in rows:
            if d < len(path):
                c = ids.setdefault(path[d], len(ids))
                if c == len(words_of):
                    words_of.append(words[d])
                row.append(c)
        labels.append(np.array(row, np.int64))
    digests, words_of = list(ids), np.array(words_of, np.int64)
    trie, at, levels = DoubleArray(), np.zeros(len(rows), np.int64), [np.zeros(1, np.int64)]
    for d in range(deepest):
        live = np.flatnonzero(lengths > d)
        trie.insert(at[live], labels[d])
        at[live] = trie.step(at[live], labels[d])
        levels.append(np.unique(at[live]))
    size = trie.top
    n, least, upper, depth = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, bool), np.zeros(size, np.int64)
    walk = np.zeros(len(rows), np.int64)
    for d in range(deepest + 1):
        live = np.flatnonzero(lengths >= d)
        if d:
            walk[live] = trie.step(walk[live], labels[d - 1])
        np.add.at(n, walk[live], weight[live])
        np.minimum.at(least, walk[live], conv[live])
        upper[walk[live][cut[live] > d]] = True
        depth[levels[d]] = d
    slots, check = np.concatenate(levels), trie.check
    below = slots[1:]
    words = np.zeros(size, np.int64)
    words[below] = words_of[below - trie.base[check[below]]] if len(below) else 0
    whole = ~upper
    kids = np.bincount(check[below[whole[below]]], minlength=size)
    leaves, saved = (whole & (np.bincount(check[below], minlength=size) == 0)).astype(np.int64), np.where(whole, (n - 1) * words, 0)
    for own in reversed(levels[1:]):
        own = own[whole[own]]
        np.add.at(leaves, check[own], leaves[own])
        np.add.at(saved, check[own], saved[own])
    named = {0: b""}
    for s in below[upper[below]].tolist():  # by depth
        up = int(check[s])
        named[s] = hashlib.sha256(named[up] + digests[s - int(trie.base[up])]).digest()
    far = [check[:size]]
    while 2 ** len(far) <= int(depth[upper].max(initial=0)):
        far.append(far[-1][far[-1]])
    ends = {int(s): r[5] for s, r in zip(at.tolist(), rows)}
    out = {c: [] for c in _ARROW.names}
    for s in slots.tolist():
        up, d = int(check[s]), int(depth[s])
        shared = d > 0 and bool(upper[up])
        for c, v in (
            ("upper", bool(upper[s])), ("hash", named.get(s)), ("parent", named[up] if shared else None), ("up", [named[int(f[s])] for k, f in enumerate(far) if 2**k <= d] if upper[s] else None),
            ("conv_id", int(least[s])), ("depth", d), ("parent_conv_id", int(least[up]) if d and not shared else None), ("n_convs", int(n[s])), ("words", int(words[s])),
            ("n_children", int(kids[s])), ("n_leaves", int(leaves[s])), ("saved", int(saved[s])), ("ends", ends.get(s)),
        ):
            out[c].append(v)
    return pa.table(out, schema=_ARROW)


def _digest_runs(batches):
    """SHA-256 of the comma-joined pieces of each seq, whose rows follow one another; one piece is held at a time."""
    seq, state = None, None
    for b in batches:
        done = {"seq": [], "ends": []}
        for s, ids in zip(b["seq"].to_pylist(), b["ids"].to_pylist()):
            if s == seq:
                state.update(b",")
            else:
                if state is not None:
                    done["seq"].append(seq)
                    done["ends"].append(state.hexdigest())
                seq, state = s, hashlib.sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_pydict(done, schema=pa.schema([("seq", pa.binary()), ("ends", pa.string())]))
    if state is not None:
        yield pa.RecordBatch.from_pydict({"seq": [seq], "ends": [state.hexdigest()]}, schema=pa.schema([("seq", pa.binary()), ("ends", pa.string())]))


def ends_digests(members: DataFrame) -> DataFrame:
    """(seq, ends): of each seq's decimal conv_ids, ascending and comma-joined, the SHA-256. Ids are joined in ranges before they meet."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = members.groupBy("seq", F.shiftright("conv_id", CHUNK_BITS).alias("piece")).agg(ids.alias("ids"))
    return pieces.repartition("seq").sortWithinPartitions("seq", "piece").select("seq", "ids").mapInArrow(_digest_runs, "seq binary, ends string")


def turn_lists(turns: DataFrame) -> DataFrame:
    """(conv_id, turns: array of digest and words), ordered by turn, null first; rows that share a turn by role and digest. Null role and text are empty, rows of null conv_id go."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), role.alias("role"), digest.alias("digest"), n_words(text).alias("words"))
    own = turns.where(F.col("conv_id").isNotNull()).groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return own.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def with_shared_heads(own: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of conversation c - c % every; h = crc32(c) % heads."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    first = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, heads - 1).alias("head"))
    both = own.join(first, F.col("conv_id") - F.col("conv_id") % every == F.col("head_id"), "left")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h)
    return both.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def prefix_shards(seqs: DataFrame) -> DataFrame:
    """Adds cut and shard: the length of the prefix that a sequence is dealt by, and its hash. Prefixes double until none but single sequences holds more than a shard."""
    total = seqs.agg(F.sum(F.size("path"))).first()[0] or 0
    most, cut = max(SHARD, total // HOT_SHARDS), 1
    key = F.xxhash64(F.slice("path", F.lit(1), F.col("cut")))
    dealt = seqs.withColumn("cut", F.lit(1)).withColumn("shard", key)
    while True:
        held = dealt.where(F.col("cut") == cut).groupBy("shard").agg(F.count("*").alias("rows"), F.sum(F.size("path")).alias("turns"))
        heavy = durable(held.where((F.col("rows") > 1) & (F.col("turns") > most)).select(F.col("shard").alias("heavy")))  # HOT_SHARDS rows at most
        if heavy.isEmpty():
            return dealt
        split = dealt.join(F.broadcast(heavy), (F.col("cut") == cut) & (F.col("shard") == F.col("heavy")), "left")
        cut *= 2
        dealt = split.withColumn("cut", F.when(F.col("heavy").isNotNull(), cut).otherwise(F.col("cut"))).withColumn("shard", key).drop("heavy")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie over (conv_id, turns): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is named by conv_id and depth. A conversation without turns ends at the root; an empty table gives no nodes.
    A conversation is one row of 40 bytes a turn, so its length is bounded by a row; its number of copies is not.
    """
    path = F.transform("turns", lambda t: t["digest"])
    seq = F.unhex(F.sha2(F.array_join(F.transform(path, F.hex), "").cast("binary"), 256))
    members = stored(conversations.select("conv_id", seq.alias("seq"), path.alias("path"), F.transform("turns", lambda t: t["words"]).alias("words")), "trie-members")
    distinct = members.groupBy("seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("path").alias("path"), F.first("words").alias("words"))
    seqs = stored(distinct.join(ends_digests(members.select("seq", "conv_id")), "seq"), "trie-sequences")
    sharded = prefix_shards(seqs)
    total = seqs.agg(F.sum(F.size("path"))).first()[0] or 0
    groups = max(int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD))
    grouped = sharded.select("path", "words", "n", "conv_id", "cut", "ends", F.pmod("shard", F.lit(groups)).alias("group"))
    nodes = stored(grouped.groupBy("group").applyInArrow(_nodes, NODES), "trie-nodes")
    return _merged(nodes)


def _merged(nodes: DataFrame) -> DataFrame:
    same = lambda *names: [F.any_value(c).alias(c) for c in names]
    added = lambda *names: [F.sum(c).alias(c) for c in names]
    above = nodes.where("upper").groupBy("hash").agg(F.min("conv_id").alias("conv_id"), F.max("ends").alias("ends"), *same("depth", "up", "words"), *added("n_convs", "n_children", "n_leaves", "saved"))
    above = stored(above, "trie-above")
    kids = above.where("depth > 0").groupBy(F.get("up", F.lit(0)).alias("hash")).agg(F.count("*").alias("more"))
    children = F.col("n_children") + F.coalesce("more", F.lit(0))
    above = above.join(kids, "hash", "left").withColumn("n_children", children).drop("more").withColumns({
        "n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("long"), "saved": F.col("saved") + (F.col("n_convs") - 1) * F.col("words")})
    above = stored(above, "trie-above")
    deepest, k = above.agg(F.max("depth")).first()[0] or 0, 0
    while 2**k <= deepest:
        # n_leaves and saved hold the sums of all nodes less than 2^k below.
        part = above.where(F.size("up") > k).groupBy(F.get("up", F.lit(k)).alias("hash")).agg(F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
        more = lambda c, by: F.col(c) + F.coalesce(by, F.lit(0))
        above = stored(above.join(part, "hash", "left").withColumns({"n_leaves": more("n_leaves", "l"), "saved": more("saved", "s")}).drop("l", "s"), "trie-above")
        k += 1
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    hung = nodes.where("not upper and parent is not null").select("parent", *columns).union(above.where("depth > 0").select(F.get("up", F.lit(0)), *columns))
    parents = above.select(F.col("hash").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.lit(0).alias("n"))
    hung = join_hot(hung, parents, "parent", ["conv_id", "depth"], hung.groupBy("parent").agg(F.count("*").alias("n")))
    named = ["conv_id", "depth", "parent_conv_id", *columns[2:]]
    whole = nodes.where("not upper and parent is null").select(named).union(hung.select(named)).union(above.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(named))
    return whole.select(*named[:6], F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node; see turn_lists() and prefix_trie() for nulls, ties and empty tables."""
    return prefix_trie(with_shared_heads(turn_lists(table(spark, sf_dir, "conversations"))))


OP13_SQL = rf"""
with f as (select conv_id c, turn, coalesce(role, '') r, coalesce(text, '') x from conversations where conv_id is not null),
t as (select c, {{'r': r, 'x': x}} m, row_number() over (partition by c order by turn nulls first, r, sha256(strlen(r)::varchar || ':' || r || x)) k from f),
o as (select c, list(m order by k) l from t group by c),
h as (select c, l, {crc32_sql("c::varchar")} % 4 h from o),
re as (select h.c, list_concat(coalesce(o.l, [])[1:h.h], h.l[h.h + 1:]) p from h left join o on o.c = h.c - h.c % 20),
pre as (select c, p, unnest(range(len(p) + 1)) d from re),
nodes as (select p[1:d] p, d, min(c) conv_id, count(*) n, coalesce(string_agg(c::varchar, ',' order by c) filter (len(p) = d), '') e from pre group by 1, 2),
kids as (select p[1:d - 1] p, count(*) k from nodes where d > 0 group by 1),
own as (select nodes.*, coalesce(k, 0) k, case when d = 0 then 0 else (n - 1) * len(regexp_extract_all(p[d].x, '[^\x20\x09-\x0D]+')) end s from nodes left join kids using (p)),
steps as (select p, unnest(range(d + 1)) q, k, s from own),
sums as (select p[1:q] p, count(*) filter (k = 0) leaves, sum(s)::bigint saved from steps group by 1)
select a.conv_id, a.d depth, b.conv_id parent_conv_id, a.n n_convs, a.k n_children, s.leaves n_leaves, s.saved saved_tokens, sha256(a.e) ends_sha256
from own a join sums s on a.p = s.p left join nodes b on a.d > 0 and b.p = a.p[1:a.d - 1]
"""

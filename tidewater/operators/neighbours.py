"""Cosine neighbours of sparse unit rows by an inverted index with prefix bounds, and what follows from them: distances to
the k-th neighbour, and DBSCAN for all eps and min_samples at once.

Items are ranked from rare to frequent. A row's prefix at threshold t is the least number of its first items after which
what is left has length below t: two rows at cosine t or more share an item in both prefixes, so only postings of prefix
items meet, and frequent items mostly stay out. Rows of a period are dealt to blocks and pairs of blocks p <= q, so a row is
copied once a block, not once an item; the postings of two blocks give their pairs' cosines, in turns of bounded size, and
each pair once. Equal rows are compared as one.

For one min_samples a link of two rows counts from the eps on at which it is short enough and both are cores, so clusters
are nested: links are added in order of that eps, and each setting's components start from those before. A piece gives a
forest of its links by that order, which joins at every eps what all its links join.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.operators.graph import components, stored
from tidewater.operators.order import ranked
from tidewater.operators.sparse import Csr, csr_of, unit_sparse

#: Rows and entries of a block; products of a piece; products that a task holds at once.
BLOCK, ENTRIES, PAIRS, HELD = 1 << 18, 1 << 22, 1 << 22, 1 << 21
#: Rounding of a distance.
CLOSE = 1e-12


def by_period(rows: DataFrame) -> DataFrame:
    """The rows with their period; rows of different periods share no item and so are never compared."""
    return rows if "period" in rows.columns else rows.withColumn("period", F.lit(""))


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reps, members) of unit rows ([period,] id, idx, val) that aren't empty: reps (rep, period, first, copies, idx, val), one for each
    different row of a period, numbered in order of their smallest id, `first`; members (period, id, rep)."""
    live = by_period(rows).where(F.size("idx") > 0)
    once = live.groupBy("period", "idx", "val").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    reps = stored(ranked(once, "period", "first").withColumnRenamed("place", "rep"), "neighbour-classes")
    members = live.join(reps.select("period", "idx", "val", "rep"), ["period", "idx", "val"]).select("period", "id", "rep")
    return reps, stored(members, "neighbour-members")


def by_rarity(reps: DataFrame) -> DataFrame:
    """The rows with their items renumbered from the rarest to the most frequent, and in that order."""
    long = reps.select("rep", "period", F.explode(F.arrays_zip("idx", "val")).alias("e")).select("rep", "period", "e.idx", "e.val")
    order = ranked(long.groupBy("period", "idx").agg(F.count("*").alias("n")), "n", "period", "idx").select("period", "idx", F.col("place").cast("int").alias("item"))
    both = long.join(order, ["period", "idx"]).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("item", "val"))).alias("m"))
    return both.join(reps.select("rep", "period", "copies"), "rep").select("rep", "period", "copies", F.col("m.item").alias("idx"), F.col("m.val").alias("val"))


def prefix_length(least: float):
    """Items of a row until the squares left are below least squared; all if least is 0 or less. A hair more, for rounding."""
    if least <= 0:
        return F.size("idx")
    left = F.transform("val", lambda v, i: F.aggregate(F.slice("val", i + 1, F.size("val")), F.lit(0.0), lambda a, x: a + x * x))
    return F.size(F.filter(left, lambda x: x >= least * least * (1 - 1e-9)))


class Met:
    """One piece: the rows of a pair of blocks, of which each two that share a prefix item are compared, in turns."""

    def __init__(self, group):
        side, own = group["side"].to_numpy(), group["p"][0].as_py() == group["q"][0].as_py()
        # The rows of the first block come first.
        order = np.argsort(side, kind="stable")
        self.rows = group if own else group.take(pa.array(order))
        self.front = 0 if own else int((side == 0).sum())
        self.m, self.own = csr_of(self.rows), own
        prefix = self.rows["prefix"].to_numpy()
        row, length = self.m.row, np.diff(self.m.start)
        self.cut = prefix < length
        kept = np.arange(len(self.m.idx)) - self.m.start[:-1][row] < prefix[row]
        self.width = int(self.m.idx.max(initial=0)) + 1
        self.keys = row * self.width + self.m.idx if self.cut.any() else None
        left = np.flatnonzero(kept if own else kept & (row < self.front))
        right = left if own else np.flatnonzero(kept & (row >= self.front))
        # Postings of the second block by item, then row; an entry of the first meets those of its item, in one block those after its row.
        post = right[np.lexsort((row[right], self.m.idx[right]))]
        self.to, self.weight = row[post], self.m.val[post]
        n = len(self.rows) + 1
        at = self.m.idx[post] * n + self.to
        begin = np.searchsorted(at, self.m.idx[left] * n + (row[left] + 1 if own else 0))
        self.begin, self.many = begin, np.searchsorted(at, (self.m.idx[left] + 1) * n) - begin
        self.of, self.val = row[left], self.m.val[left]

    def _looked_up(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Cosines of pairs of rows, by looking the shorter row's items up in the longer."""
        length = np.diff(self.m.start)
        i, j = np.where(length[i] <= length[j], i, j), np.where(length[i] <= length[j], j, i)
        ends, cosine, begin = np.cumsum(length[i]), np.zeros(len(i)), 0
        while begin < len(i):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + HELD, "right")))
            n = length[i[begin:end]]
            of = np.repeat(np.arange(end - begin), n)
            at = self.m.start[i[begin:end]][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            want = j[begin:end][of] * self.width + self.m.idx[at]
            to = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[to] == want)
            cosine[begin:end] = np.bincount(of[hit], self.m.val[at[hit]] * self.m.val[to[hit]], end - begin)
            begin = end
        return cosine

    def turns(self):
        """(i, j, cosine) of the compared pairs, about HELD products at a time; one row's, if those are more."""
        rows, ends = np.unique(self.of, return_index=True)
        ends = np.r_[ends[1:], len(self.of)] if len(rows) else ends
        total, n, a = np.cumsum(self.many)[ends - 1] if len(rows) else ends, len(self.rows), 0
        while a < len(rows):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + HELD, "right")))
            part = slice(ends[a - 1] if a else 0, ends[b - 1])
            many = self.many[part]
            at = np.repeat(self.begin[part] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            key = np.repeat(self.of[part], many) * n + self.to[at]
            product = np.repeat(self.val[part], many) * self.weight[at]
            low, cells = rows[a] * n, (rows[b - 1] - rows[a] + 1) * n
            if cells <= 4 * len(key):
                whole = np.bincount(key - low, product, cells)
                pair = np.flatnonzero(whole)
                cosine, pair = whole[pair], pair + low
            else:
                order = np.argsort(key)
                pair = key[order]
                first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else order
                cosine, pair = np.add.reduceat(product[order], first) if len(pair) else product, pair[first]
            i, j = np.divmod(pair, n)
            if self.keys is not None:
                again = np.flatnonzero(self.cut[i] | self.cut[j])
                cosine[again] = self._looked_up(i[again], j[again])
            yield i, j, cosine
            a = b

    def near(self, eps: float):
        """(i, j, distance) of the pairs within eps."""
        for i, j, cosine in self.turns():
            distance = np.maximum(1 - cosine, 0)
            on = np.flatnonzero(distance <= eps + CLOSE)
            yield i[on], j[on], distance[on]

    def column(self, name: str) -> np.ndarray:
        return self.rows[name].to_numpy()

    def extra(self) -> np.ndarray:
        return np.stack([np.asarray(v) for v in self.rows["extra"].to_numpy(zero_copy_only=False)]) if len(self.rows) else np.zeros((0, 0), int)


def _table(names: str, columns: list[list[np.ndarray]]):
    """Columns of longs, each in parts."""
    return pa.table({n: np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64) for n, c in zip(names.split(), columns)})


def _pairs(group, least):
    """(a, b, cosine), and a row (null, null, comparisons)."""
    m = Met(group)
    rep, compared, out = m.column("rep"), 0, [[], [], [np.zeros(0)]]
    for i, j, cosine in m.turns():
        compared += len(i)
        on = cosine >= least
        a, b = rep[i[on]], rep[j[on]]
        for column, x in zip(out, (np.minimum(a, b), np.maximum(a, b), cosine[on])):
            column.append(x)
    found = _table("a b", out).append_column("cosine", pa.array(np.concatenate(out[2])))
    return pa.concat_tables([found, pa.table({"a": pa.nulls(1, pa.int64()), "b": pa.nulls(1, pa.int64()), "cosine": pa.array([float(compared)])})])


def _nearest(group, k):
    """(rep, distance, copies): for each row of the piece the k nearest that it is compared with here."""
    m = Met(group)
    rep, copies = m.column("rep"), m.column("copies")
    row, other, far, bound = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(len(rep), np.inf)

    def closest():
        order = np.lexsort((far, row))
        begin = np.flatnonzero(np.r_[True, np.diff(row[order]) != 0][: len(order)])
        place = np.arange(len(order)) - np.repeat(begin, np.diff(np.r_[begin, len(order)]))
        last = order[place == k - 1]
        bound[row[last]] = far[last]
        return order[place < k]

    for i, j, cosine in m.turns():
        d = np.maximum(1 - cosine, 0)
        for one, two in ((i, j), (j, i)):
            on = d < bound[one]
            row, other, far = np.r_[row, one[on]], np.r_[other, two[on]], np.r_[far, d[on]]
        if len(row) > 2 * k * len(rep) + HELD:
            best = closest()
            row, other, far = row[best], other[best], far[best]
    best = closest()
    return pa.table({"rep": rep[row[best]], "distance": far[best], "copies": copies[other[best]]})


def _degrees(group, epss):
    """(rep, level, n): copies of the others within each eps, for rows that have some."""
    m = Met(group)
    rep, copies, bounds = m.column("rep"), m.column("copies"), np.array(epss) + CLOSE
    n = np.zeros((len(epss), len(rep)))
    for i, j, d in m.near(epss[-1]):
        level = np.searchsorted(bounds, d) * len(rep)
        n += (np.bincount(level + i, copies[j], n.size) + np.bincount(level + j, copies[i], n.size)).reshape(n.shape)
    n = np.cumsum(n, axis=0)
    level, at = np.nonzero(n)
    return _table("rep level n", [[rep[at]], [level], [n[level, at]]])


def _forest(n: int, i: np.ndarray, j: np.ndarray, level: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (i, j, level) of n rows, fewer than n, that join up to every level what the given ones join."""
    root, out = np.arange(n), [[np.zeros(0, np.int64)] for _ in range(3)]
    for at in range(levels):
        x, y = i[level == at], j[level == at]
        now = root.copy()
        while True:
            low = np.minimum(now[x], now[y])
            new = now.copy()
            np.minimum.at(new, now[x], low)
            np.minimum.at(new, now[y], low)
            new = new[new][root]
            if (new == now).all():
                break
            now = new
        joined = np.flatnonzero((root == np.arange(n)) & (now != root))
        for column, v in zip(out, (joined, now[joined], np.full(len(joined), at))):
            column.append(v)
        root = now
    return tuple(np.concatenate(c) for c in out)


def _forests(group, epss):
    """(setting, a, b, level): for each min_samples, that has its own eps, a forest of the piece's links by the level from which they count. extra: a row's first level as a core."""
    m = Met(group)
    rep, first = m.column("rep"), m.extra()
    held = [[[np.zeros(0, np.int64)] for _ in range(3)] for _ in epss]
    shrunk = lambda s: _forest(len(rep), *map(np.concatenate, held[s]), len(epss[s]))
    for i, j, d in m.near(max((e[-1] for e in epss if e), default=-1.0)):
        for s, own in enumerate(epss):
            at = np.maximum(np.searchsorted(np.array(own) + CLOSE, d), np.maximum(first[i, s], first[j, s]))
            on = at < len(own)
            for column, x in zip(held[s], (i[on], j[on], at[on])):
                column.append(x)
            if sum(map(len, held[s][0])) > 2 * len(rep) + HELD:
                held[s] = [[x] for x in shrunk(s)]
    out: list[list] = [[], [], [], []]
    for s in range(len(epss)):
        a, b, level = shrunk(s)
        for column, x in zip(out, (np.full(len(a), s), rep[a], rep[b], level)):
            column.append(x)
    return _table("setting a b level", out)


def _borders(group, settings):
    """(rep, setting, cluster): the smallest cluster of cores near each row that isn't one. extra: a row's cluster in each setting if it is a core, else -1."""
    m = Met(group)
    rep, own, most = m.column("rep"), m.extra(), np.iinfo(np.int64).max
    best = np.full((len(settings), len(rep)), most)
    for i, j, d in m.near(max(settings)):
        for s, eps in enumerate(settings):
            on = d <= eps + CLOSE
            for one, two in ((i[on], j[on]), (j[on], i[on])):
                asks = np.flatnonzero((own[one, s] < 0) & (own[two, s] >= 0))
                np.minimum.at(best[s], one[asks], own[two[asks], s])
    setting, at = np.nonzero(best < most)
    return _table("rep setting cluster", [[rep[at]], [setting], [best[setting, at]]])


class Index:
    """Rows (rep, period, copies, idx, val) by their prefix items at cosine `least`; each pass compares every pair that may reach it once."""

    def __init__(self, reps: DataFrame, least: float):
        # Without a threshold a prefix is the whole row, in any order.
        rows = by_rarity(reps) if least > 0 else reps.select("rep", "period", "copies", "idx", "val")
        self.rows = stored(rows.withColumn("prefix", prefix_length(least)), "neighbour-rows")
        items = self.rows.select("period", F.explode(F.slice("idx", F.lit(1), F.col("prefix"))).alias("item"))
        self.blocks = stored(items.groupBy("period", "item").agg(F.count("*").alias("n")).where("n > 1"), "neighbour-blocks")
        products = self.blocks.groupBy("period").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("products"))
        sizes = self.rows.groupBy("period").agg(F.count("*").alias("rows"), F.sum(F.size("idx")).alias("entries")).join(products, "period", "left")
        dealt, front = [], 0
        for r in sizes.orderBy("period").collect():  # a row a period
            n = max(-(-r["rows"] // BLOCK), -(-r["entries"] // ENTRIES), 1)
            while (n + 1) * (n + 2) // 2 <= (r["products"] or 0) // PAIRS + 1:
                n += 1
            dealt.append((r["period"], n, front))
            front += n * n
        self.dealt = F.broadcast(self.rows.sparkSession.createDataFrame(dealt, "period string, blocks int, front long"))

    def over(self, f, schema: str, extra: DataFrame | None = None) -> DataFrame:
        """What f makes of every piece; extra: (rep, extra), an array of ints for each row."""
        columns = ["rep", "copies", "idx", "val", "prefix"] + (["extra"] if extra is not None else [])
        rows = (self.rows if extra is None else self.rows.join(extra, "rep")).join(self.dealt, "period")
        b = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
        met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(b, x).alias("p"), F.greatest(b, x).alias("q"), (b > x).cast("int").alias("side")))
        dealt = rows.select("front", "blocks", *columns, F.explode(met).alias("x")).select((F.col("front") + F.col("x.p") * F.col("blocks") + F.col("x.q")).alias("piece"), "x.p", "x.q", "x.side", *columns)
        # Few bytes take long here: partitions of a given number aren't put together.
        spread = dealt.repartition(int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "piece")
        return spread.groupBy("piece").applyInArrow(f, schema)


def cosine_pairs(reps: DataFrame, least: float) -> tuple[DataFrame, int]:
    """(pairs, comparisons): the join itself, a row (a, b, cosine), a < b, for each pair of rows (rep, period, copies, idx, val) at cosine `least` > 0 or more; and how many pairs were compared."""
    found = stored(Index(reps, least).over(partial(_pairs, least=least), "a long, b long, cosine double"), "neighbour-pairs")
    return found.where("a is not null"), int(found.where("a is null").agg(F.sum("cosine")).first()[0] or 0)


def sparse_knn(rows: DataFrame, ks: list[int]) -> DataFrame:
    """(k, id, distance): cosine distance to the k-th other row, for unit rows (id, idx, val); empty rows take no part.
    Rows without a shared item are at distance 1. A row leaves k distances for each of its pieces, never all."""
    reps, members = classes(rows)
    total = members.count()
    near = Index(reps, 0.0).over(partial(_nearest, k=max(ks)), "rep long, distance double, copies long")
    # A row's own copies are at distance 0.
    near = near.union(reps.where("copies > 1").select("rep", F.lit(0.0), F.col("copies") - 1))
    held = F.sum("copies").over(W.partitionBy("rep").orderBy("distance").rowsBetween(W.unboundedPreceding, 0))
    reached = stored(near.withColumn("held", held).groupBy("rep").agg(*[F.min(F.when(F.col("held") >= k, F.col("distance"))).alias(f"d{k}") for k in ks]), "neighbour-distances")
    whole = members.join(reached, "rep", "left").where(F.lit(True))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(f"d{k}", F.lit(1.0)).alias("distance")) for k in ks if total > k] or [F.lit(None).cast("struct<k: int, distance: double>")]))
    return whole.select("id", each.alias("x")).where("x is not null").select("x.k", "id", "x.distance")


def nested_components(links: DataFrame, settings: int, levels: int) -> list[DataFrame]:
    """For each level (node, root) of the links (setting, a, b, level) up to it; a node is a * settings + setting. A level's links
    join the roots of the level before, so what is joined already is not gone through again."""
    node = lambda c: (F.col(c) * settings + F.col("setting")).alias(c)
    out: list[DataFrame] = []
    for level in range(levels):
        edges = links.where(F.col("level") == level).select(node("a"), node("b"))
        if not out:
            out.append(stored(components(edges), "neighbour-level"))
            continue
        for c in ("a", "b"):
            edges = edges.join(out[-1].select(F.col("node").alias(c), "root"), c, "left").select(F.coalesce("root", c).alias(c), "b" if c == "a" else "a")
        further = stored(components(edges), "neighbour-level")
        grown = out[-1].join(further.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        out.append(stored(grown.union(further.join(out[-1], "node", "left_anti").select("node", "root")), "neighbour-level"))
    return out


def dbscan_settings(rows: DataFrame, settings: list[tuple[float, int]]) -> DataFrame:
    """([period,] eps, min_samples, id, cluster) for each setting, for unit rows ([period,] id, idx, val) without negative values; as cluster.dbscan() labels them one at a time.

    A row is its own neighbour; empty rows and noise are -1; clusters are numbered by their smallest core id; a border
    row takes the smallest cluster near it. Three passes serve all settings and periods: degrees, forests of links,
    borders; none emits pairs, so a graph in which almost all rows are near each other is no harder. From eps 1 on all rows are near.
    """
    spark, kept = rows.sparkSession, [c for c in ("period",) if c in rows.columns]
    rows = by_period(rows)
    reps, members = classes(rows)
    epss, samples = sorted({e for e, _ in settings if e < 1}), sorted({m for _, m in settings})
    # The levels of a min_samples are its own eps.
    levels = [sorted({e for e, m in settings if e < 1 and m == sample}) for sample in samples]
    index = Index(reps, 1 - epss[-1] - CLOSE) if epss else None
    counts = reps.select("rep", "copies")
    if index:
        found = index.over(partial(_degrees, epss=epss), "rep long, level long, n long").groupBy("rep").pivot("level", list(range(len(epss)))).agg(F.sum("n"))
        counts = counts.join(found, "rep", "left")
    counts = counts.select("rep", *[(F.col("copies") + F.coalesce(F.col(str(i)), F.lit(0))).alias(f"n{i}") for i in range(len(epss))])
    # For each min_samples the first level at which a row is a core.
    first = F.array(*[F.coalesce(*[F.when(F.col(f"n{epss.index(e)}") >= m, F.lit(i)) for i, e in enumerate(own)], F.lit(len(own))) for m, own in zip(samples, levels)])
    cores = stored(counts.select("rep", first.alias("extra")), "neighbour-cores")
    near = [(e, m) for e, m in settings if e < 1]
    labels = spark.createDataFrame([], "setting long, period string, id long, cluster long")
    if near:
        links = stored(index.over(partial(_forests, epss=levels), "setting long, a long, b long, level long", cores), "neighbour-links")
        joined = nested_components(links, len(samples), max(map(len, levels)))
        own = []
        for i, (e, m) in enumerate(near):
            s, top = samples.index(m), levels[samples.index(m)].index(e)
            core = cores.where(F.col("extra")[s] <= top).select("rep", F.lit(i).cast("long").alias("setting"), (F.col("rep") * len(samples) + s).alias("node"))
            own.append(core.join(joined[top], "node", "left").select("rep", "setting", F.coalesce("root", "node").alias("root")))
        roots = stored(reduce(DataFrame.union, own).join(reps.select("rep", "period"), "rep"), "neighbour-roots")
        # Clusters are numbered from 0 in each period and setting.
        order = ranked(roots.select("period", "setting", "root").distinct(), "period", "setting", "root")
        front = order.groupBy("period", "setting").agg(F.min("place").alias("front"))
        numbers = order.join(F.broadcast(front), ["period", "setting"]).select("setting", "root", (F.col("place") - F.col("front")).alias("cluster"))
        cored = stored(roots.join(numbers, ["setting", "root"]).select("rep", "setting", "cluster"), "neighbour-clusters")
        wide = cored.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("setting", "cluster"))).alias("m"))
        known = reps.select("rep").join(wide, "rep", "left").select("rep", F.array(*[F.coalesce(F.try_element_at("m", F.lit(i).cast("long")), F.lit(-1)) for i in range(len(near))]).alias("extra"))
        border = index.over(partial(_borders, settings=[e for e, _ in near]), "rep long, setting long, cluster long", stored(known, "neighbour-known")).groupBy("rep", "setting").agg(F.min("cluster").alias("cluster"))
        labels = members.join(cored.select("rep", "setting", "cluster").union(border.select("rep", "setting", "cluster")), "rep").select("setting", "period", "id", "cluster")
    for e, m in [x for x in settings if x[0] >= 1]:
        near.append((e, m))
        whole = members.groupBy("period").agg(F.count("*").alias("n")).where(F.col("n") >= m)
        labels = labels.union(members.join(whole, "period").select(F.lit(len(near) - 1).cast("long"), "period", "id", F.lit(0).cast("long")))
    every = F.broadcast(spark.createDataFrame([(i, float(e), m) for i, (e, m) in enumerate(near)], "setting long, eps double, min_samples int"))
    full = rows.select("period", "id").crossJoin(every).join(labels, ["setting", "period", "id"], "left")
    return full.select(*kept, "eps", "min_samples", "id", F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))


def sparse_silhouette(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """([period,] eps, min_samples, silhouette) of labels (..., id, cluster) over unit rows ([period,] id, idx, val): the mean cosine
    silhouette of rows that aren't empty and have a label, null with fewer than two rows or clusters. Linear in the entries."""
    by = [c for c in labels.columns if c not in ("id", "cluster")]
    live = labels.where("cluster >= 0").join(rows.where(F.size("idx") > 0), [c for c in ("period", "id") if c in rows.columns])
    sizes = stored(live.groupBy(*by, "cluster").agg(F.count("*").alias("n")), "cluster-sizes")
    # Where there are fewer than two clusters nothing is to be gone through.
    some = sizes.groupBy(*by).agg(F.count("*").alias("clusters")).where("clusters > 1").drop("clusters")
    live = live.join(F.broadcast(some), by, "left_semi")
    long = live.select(*by, "id", "cluster", F.explode(F.arrays_zip("idx", "val")).alias("e")).select(*by, "id", "cluster", "e.idx", "e.val")
    sums = long.groupBy(*by, "cluster", "idx").agg(F.sum("val").alias("s"))
    dots = long.join(sums.select(*by, F.col("cluster").alias("to"), "idx", "s"), [*by, "idx"]).groupBy(*by, "id", "to").agg(F.sum(F.col("val") * F.col("s")).alias("dot"))
    # Clusters are few; a row shares no item with some of them.
    every = live.select(*by, "id", "cluster").join(sizes.select(*by, F.col("cluster").alias("to"), "n"), by)
    d = every.join(dots, [*by, "id", "to"], "left").withColumn("dot", F.coalesce("dot", F.lit(0.0)))
    own, other = F.col("to") == F.col("cluster"), F.col("to") != F.col("cluster")
    each = d.groupBy(*by, "id").agg(F.max(F.when(own, F.col("n"))).alias("n"), F.max(F.when(own & (F.col("n") > 1), (F.col("n") - F.col("dot")) / (F.col("n") - 1))).alias("a"), F.min(F.when(other, 1 - F.col("dot") / F.col("n"))).alias("b"))
    s = F.when(F.col("n") == 1, 0.0).otherwise((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)))
    mean = each.where("b is not null").groupBy(*by).agg(F.avg(F.coalesce(s, F.lit(0.0))).alias("silhouette"), F.count("*").alias("rows"))
    return labels.select(*by).distinct().join(mean.where("rows >= 2").drop("rows"), by, "left")

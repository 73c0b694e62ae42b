"""The library's queries over the star schema's tables. Each takes (spark, sf_dir)."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.config import STAR
from tidewater.functions import rules as R
from tidewater.operators import classify as L
from tidewater.operators import cluster as K
from tidewater.operators import govern as C
from tidewater.operators import kmeans as KM
from tidewater.operators import neighbours as N
from tidewater.operators import probe as P
from tidewater.operators import profile as FE
from tidewater.operators import reduce as D
from tidewater.operators import results as G
from tidewater.operators import sparse as SP
from tidewater.operators import summaries as S
from tidewater.operators.graph import durable, stored, stored_path
from tidewater.sources.records import detect_bad_decoding, read_ids, read_raw, star_raw, to_typed, write_bucketed, write_profile, write_raw, write_typed

EPS, MIN_SAMPLES = 0.68, 5
#: Buckets of tables by user; on a cluster as many as keep a bucket's rows within a task's memory.
BUCKETS = 64
#: The grids on profiles.
PERIODS, KS, SEEDS, SAMPLES, PERCENTS, DIMS = ("train", "val", "test"), [5, 6, 7, 8], 10, [3, 5], [50, 70, 90], [2, 10, 20, 50]


class Star:
    """The frames that queries share, for one folder of tables. Raw lines, tagged rows and split ratings feed many queries, so each is written once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.fits: dict[str, dict] = {}
        self.recorded: set[str] = set()

    @cached_property
    def raw(self):
        return stored(star_raw(self.spark, self.dir), "raw")

    @cached_property
    def tagged(self):
        return stored(C.tag_all(self.raw, STAR, ids=self.ids), "tagged")

    @cached_property
    def ids(self):
        return C.stored_ids(self.raw)

    @cached_property
    def kept(self):
        return stored(C.kept_lines(self.tagged), "kept")

    def typed(self, kind):
        return to_typed(self.kept.where(F.col("kind") == kind), kind)

    @cached_property
    def split(self):
        return stored(FE.time_split(self.typed("ratings"), STAR), "split")

    @property
    def cells(self):
        return FE.train_cells(self.split)

    @property
    def labels(self):
        """A fixed rule in place of a clustering, so that summaries can be checked."""
        return FE.train_ids(self.split, "user_id").select("user_id", (F.col("user_id") % 5 - 1).cast("int").alias("cluster"))

    @property
    def features(self):
        return L.event_features(self.split, self.typed("users"), self.typed("movies"), STAR)

    @property
    def vectors(self):
        """(id, x) of the embeddings table."""
        e = self.spark.read.parquet(f"{self.dir}/embeddings.parquet")
        return e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))

    @cached_property
    def vocabularies(self):
        return durable(FE.vocabulary(self.split, "user_id")), durable(FE.vocabulary(self.split, "item_id"))

    @cached_property
    def profiles(self):
        """(period, id, idx, val): the user x item rows of each period, over the train vocabulary, of length 1."""
        return stored(N.unit_sparse(SP.sparse_rows(FE.user_item_cells(self.split), *self.vocabularies, by=["period"])), "profiles")

    def profile(self, period):
        return self.profiles.where(F.col("period") == period).select("id", "idx", "val")

    @cached_property
    def profile_values(self):
        """(id, idx, val): the train rows with ratings as they are."""
        return stored(SP.sparse_rows(self.cells, *self.vocabularies), "profile-values")

    @cached_property
    def profile_runs(self):
        """Grid and centres of k-means: every k, seed and period."""
        return KM.fit_runs(self.profiles, self.vocabularies[1].count(), KS, SEEDS)

    def profile_fit(self, algorithm):
        """PCA or SVD of the train rows, as many components as the largest dimension; fitted when first asked for."""
        if algorithm not in self.fits:
            self.fits[algorithm] = D.fit(self.profile_values, max(DIMS), algorithm == "pca", self.vocabularies[1].count())
        return self.fits[algorithm]

    @cached_property
    def dbscan_labels(self):
        """(period, eps, min_samples, id, cluster) for eps at percentiles of the train rows' distance to the min_samples-th neighbour."""
        knn = durable(N.sparse_knn(self.profile("train"), SAMPLES))
        settings = sorted({(r["eps"], m) for m in SAMPLES for r in K.eps_candidates(knn.where(F.col("k") == m), PERCENTS).collect()}, key=lambda x: (x[1], x[0]))
        return settings, stored(N.dbscan_settings(self.profiles, settings), "dbscan-labels")

    @cached_property
    def results_path(self):
        return stored_path(self.spark, "results")

    def results(self, *algorithms):
        """The stored results, those of the named grids among them, or of all. A grid is fitted and recorded once, for the first query that reads it."""
        for name, rows in _fitted(self).items():
            if name not in self.recorded and (not algorithms or name in algorithms):
                G.record(self.results_path, rows())
                self.recorded.add(name)
        return G.read_results(self.spark, self.results_path)

    @property
    def user_rows(self):
        """(id, x): each user's mean rating and share of events by genre, from train cells."""
        items = self.typed("movies")
        names = sorted(STAR.genres)
        # Cells are dealt by user once, with their items' lists of genres; what follows stays there.
        own = self.cells.join(items.select("item_id", "genres"), "item_id").repartition("user_id").groupBy("user_id", "genres").agg(F.sum("value").alias("total"), F.count("*").alias("n"))
        mean = own.select("user_id", F.explode("genres").alias("genre"), "total", "n").groupBy("user_id", "genre").agg((F.sum("total") / F.sum("n")).alias("mean"))
        means = mean.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("genre", "mean"))).alias("means"))
        return means.select(F.col("user_id").alias("id"), F.array(*[F.coalesce(F.try_element_at("means", F.lit(n)), F.lit(0.0)) for n in names]).alias("x"))


def _truth(s: Star) -> DataFrame:
    line = F.col("line")
    f = R.raw_fields(line)
    good = F.when(F.col("kind") == "ratings", R.valid_rating(f, STAR)).when(F.col("kind") == "users", R.valid_user(f, STAR)).otherwise(R.valid_item(f, STAR))
    width = F.when(F.col("kind") == "ratings", 4).when(F.col("kind") == "users", 5).otherwise(3)
    return s.raw.groupBy("kind", R.kind_by_field_count(line).alias("guess")).agg(F.count("*").alias("n"), F.count_if(good).alias("valid"), F.count_if((F.size(f) == width) & R.all_non_empty(f)).alias("filled"), F.count_if(R.leading_id(line).isNotNull()).alias("with_id"), F.count_if(R.normalize_separator(line) != line).alias("separated"))


def _score(s, raw):
    return C.score(raw, s.raw, STAR, s.ids)


def _scores(s: Star) -> DataFrame:
    """Scored train events for metric checks: label and the user's mean."""
    return L.history_features(s.split).select("period", "label", (F.round(F.col("f1"), 6) / 5).alias("score"))


def _grid(s, fits) -> DataFrame:
    """One row a setting: validation and test average precision, and F1."""
    lr = durable(L.feature_vectors(L.standardize(s.features, L.train_moments(s.split)), STAR).select("period", "label", "features"))
    train, later = L.balanced(lr.where("period = 'train'")), lr.where("period <> 'train'")
    rows = []
    for i, (name, fit) in enumerate(fits.items()):
        scores = L.scored(fit(train), later).select("period", "label", "score")
        both = L.average_precision(scores, by=("period",)).join(L.threshold_metrics(scores, by=("period",)), "period")
        own = {r["period"]: r for r in both.collect()}  # two rows
        ap = {p: round(own[p]["average_precision"] or 0.0, 4) if p in own else 0.0 for p in ("val", "test")}
        rows.append((name, i, ap["val"], ap["test"], own["test"]["f1"] if "test" in own else 0.0))
    return s.spark.createDataFrame(rows, "params string, position int, val_ap double, test_ap double, test_f1 double")


def _logreg(s):
    return _grid(s, {f"C={c}": lambda t, c=c: L.train_logreg(t, c) for c in (0.01, 0.1, 1, 10)})


def _trees(s):
    return _grid(s, {f"depth={d} leaf={n}": lambda t, d=d, n=n: L.train_tree(t, d, n) for d in (4, 6, 8, None) for n in (10, 50)})


def _kmeans(s):
    rows = []
    for k, (labelled, cost) in K.kmeans_grid(s.user_rows, [5, 6, 7, 8], n_init=2).items():
        rows.append((k, K.cosine_silhouette(labelled), cost))
    return s.spark.createDataFrame(rows, "k int, silhouette double, sse double")


def _summaries(s):
    """summarize() with its lists as text, place:genre and place:item_id."""
    text = lambda c, field: F.nullif(F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["place"].cast("string"), x[field].cast("string"))), ","), F.lit("")).alias(c)
    x = S.summarize(s.cells, s.labels, s.typed("users"), s.typed("movies"), least=2, good=3.0)
    return x.select("cluster", "size", "avg_rating", text("genres", "genre"), text("items", "item_id"), "male_ratio", "top_age", "top_occupation")


def _eps(rows) -> float:
    """The 90th percentile of the distance to the MIN_SAMPLES-th neighbour."""
    return K.eps_candidates(K.knn_distance(rows, MIN_SAMPLES), [90]).first()["eps"]


def _profile_kmeans(s):
    """k-means on the sparse user x item profiles of each period: the best of all seeds for each k."""
    rows = [(p, k, sse, sil, sizes) for p, k, _, sse, sil, sizes in KM.best_runs(s.profile_runs[0])]
    return s.spark.createDataFrame(rows, "period string, k int, sse double, silhouette double, sizes array<long>")


def _profile_dbscan(s):
    """DBSCAN on the profiles: (period, position, eps, min_samples, clusters, noise, largest, silhouette)."""
    settings, labels = s.dbscan_labels
    places = F.broadcast(s.spark.createDataFrame([(i, float(e), m) for i, (e, m) in enumerate(settings)], "position int, eps double, min_samples int"))
    by = ["period", "eps", "min_samples"]
    live = labels.join(s.profiles.where(F.size("idx") > 0).select("period", "id"), ["period", "id"], "left_semi")
    sizes = live.where("cluster >= 0").groupBy(*by, "cluster").agg(F.count("*").alias("n")).groupBy(*by).agg(F.count("*").alias("clusters"), F.max("n").alias("largest"))
    noise = live.groupBy(*by).agg(F.round(F.avg((F.col("cluster") == -1).cast("double")), 4).alias("noise"))
    row = noise.join(sizes, by, "left").join(N.sparse_silhouette(s.profiles, labels), by, "left").join(places, by[1:])
    return durable(row.select("period", "position", "eps", "min_samples", F.coalesce("clusters", F.lit(0)).alias("clusters"), "noise", F.coalesce("largest", F.lit(0)).alias("largest"), F.round("silhouette", 6).alias("silhouette")))


def _selected(s) -> tuple[int, float, int]:
    """k, eps and min_samples that the val rows of the stored results choose."""
    r = s.results("kmeans", "dbscan")
    of = lambda m: F.try_element_at("metrics", F.lit(m))
    val = r.where(of("period") == PERIODS.index("val"))
    k = K.select_kmeans(val.where("algorithm = 'kmeans'").select(of("k").cast("int").alias("k"), of("silhouette").alias("silhouette"))).first()["k"]
    d = K.select_dbscan(val.where("algorithm = 'dbscan'").select("position", *[of(m).alias(m) for m in ("eps", "min_samples", "clusters", "noise", "silhouette")])).first()
    return k, d["eps"], int(d["min_samples"])


def _fitted(s):
    """How the rows of each grid come about, for the stored table."""
    version = "v1"
    period = F.element_at(F.create_map(*[x for i, p in enumerate(PERIODS) for x in (F.lit(p), F.lit(i))]), F.col("period"))

    def classes(grid, algorithm):
        return G.rows_of(grid(s), "class", algorithm, ["params"], ["val_ap", "test_ap", "test_f1"], version, "position")

    def kmeans():
        rows = _profile_kmeans(s).select(F.col("period").alias("of"), period.alias("period"), "k", "sse", "silhouette")
        return G.rows_of(rows, "cluster", "kmeans", ["of", "k"], ["period", "k", "sse", "silhouette"], version, "k")

    def dbscan():
        db = _profile_dbscan(s)
        return G.rows_of(db.select(F.col("period").alias("of"), period.alias("period"), *db.columns[1:]), "cluster", "dbscan", ["of", "eps", "min_samples"], ["period", "eps", "min_samples", "clusters", "noise", "silhouette"], version, "position")

    def reduced(a):
        return G.rows_of(D.report_of(s.spark, s.profile_fit(a), a, DIMS), "reduce", a, ["dim"], ["dim", "evr", "error"], version, "dim")

    return {"logreg": lambda: classes(_logreg, "logreg"), "tree": lambda: classes(_trees, "tree"), "kmeans": kmeans, "dbscan": dbscan, "pca": lambda: reduced("pca"), "svd": lambda: reduced("svd")}


_METRICS = {("class", "logreg"): "val_ap", ("class", "tree"): "val_ap", ("cluster", "kmeans"): "silhouette", ("cluster", "dbscan"): "silhouette", ("reduce", "pca"): "evr", ("reduce", "svd"): "evr"}


def _results_overview(s):
    r = s.results()
    own = F.coalesce(F.try_element_at("metrics", F.lit("period")), F.lit(PERIODS.index("val"))) == PERIODS.index("val")
    return G.results_overview(r.where(own), _METRICS)


def _results_selected(s):
    k, eps, ms = _selected(s)
    best = L.select_best(s.results("logreg", "tree").where("task = 'class'").select("params", F.try_element_at("metrics", F.lit("val_ap")).alias("val_ap"), F.xxhash64("params").alias("position")), "val_ap", "position").first()
    return s.spark.createDataFrame([(best["params"], best["val_ap"], k, eps, ms)], "classifier string, val_ap double, k int, eps double, min_samples int")


def _results_reduction(s):
    r = s.results("pca", "svd")
    return G.reduction_row(r, "pca", 10).union(G.reduction_row(r, "svd", 50)).union(G.reduction_row(r, "pca", 12))


def _spaces(s) -> dict[str, DataFrame]:
    """The train profile as it is and in reduced coordinates (id, idx, val), of length 1."""
    low = {}
    for a in ("pca", "svd"):
        m = s.profile_fit(a)
        for k in (2, 50):
            coords = D.project(s.profile_values, D.leading(m, k)).withColumnRenamed("coords", "x")
            low[f"{a}-{k}"] = stored(N.unit_sparse(SP.dense_as_sparse(coords)), f"coords-{a}-{k}")
    return {"original": s.profile("train")} | low


def _typed_failures(s):
    """Lines of the raw records that don't cast, by kind and column, counted while the others are written."""
    rows = []
    for kind in ("ratings", "users", "movies"):
        seen = write_typed(s.raw.where(F.col("kind") == kind).select("line"), kind, stored_path(s.spark, "typed"))
        rows += [(kind, name, n) for name, n in seen.items()]
    return s.spark.createDataFrame(rows, "kind string, reason string, n long")


def _profile_export(s):
    """Rows of each table of the profile, as written and read back."""
    out, tables = stored_path(s.spark, "profile"), FE.profile_tables(s.split, s.typed("users"), s.typed("movies"))
    write_profile(tables, out)
    counts = [s.spark.read.parquet(f"{out}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name in tables]
    return reduce(DataFrame.union, counts)


def _raw_files(s):
    """Raw lines, with accents, written to a folder for each kind in a one-byte charset and read back: lines, lines with an accent and characters of each kind."""
    out = stored_path(s.spark, "raw")
    write_raw(s.raw.select("kind", F.translate("line", "ae", "\u00e0\u00e9").alias("line")), out, "ISO-8859-1")
    read = read_raw(s.spark, out, "ISO-8859-1")
    return read.groupBy("kind").agg(F.count("*").alias("lines"), F.count_if(F.col("line").rlike("[\u00e0\u00e9]")).alias("accented"), F.sum(F.length("line")).alias("characters"))


def _user_activity(s):
    """Each train user's cells and mean, from tables in buckets by user: neither the grouping nor the join shuffles them."""
    cells, stats = (write_bucketed(df, name, "user_id", BUCKETS) for df, name in ((s.cells, "cells"), (FE.user_stats(s.split), "user_stats")))
    own = cells.groupBy("user_id").agg(F.count("*").alias("items"), F.sum("value").alias("total"))
    return own.join(stats.hint("merge"), "user_id").select("user_id", "items", "total", "user_mean", "user_count")


def _models(s, *names: str) -> dict:
    """The named models of lr and tree."""
    rows = L.feature_vectors(L.standardize(s.features, L.train_moments(s.split)), STAR)
    train = L.balanced(durable(rows.where("period = 'train'").select("label", "features")))
    fits = {"lr": lambda: L.train_logreg(train, 0.1), "tree": lambda: L.train_tree(train, 6, 50)}
    return {n: fits[n]() for n in names}


def _top_features(s):
    rows = [(m, i + 1, n, w) for m, model in _models(s, "lr", "tree").items() for i, (n, w) in enumerate(L.top_features(model, L.feature_names(STAR)))]
    return s.spark.createDataFrame(rows, "model string, place int, feature string, weight double")


def _settings(s, n: int) -> DataFrame:
    """n settings with figures of the events of every n-th user, in place of a fitted grid."""
    g = s.features.groupBy((F.col("user_id") % n).cast("int").alias("position"))
    return g.agg(F.count("*").alias("n"), F.round(F.avg("label"), 6).alias("share"), F.round(F.avg("rating") - 3, 6).alias("level"))


def _reductions(s) -> DataFrame:
    """Grid rows of two algorithms and four dimensions, from events."""
    pick = lambda i, *v: F.element_at(F.array(*map(F.lit, v)), (i + 1).cast("int"))
    g = s.features.groupBy(pick(F.col("user_id") % 2, "pca", "svd").alias("algorithm"), pick(F.col("item_id") % 4, 2, 10, 20, 50).alias("dim"))
    return g.agg(F.round(F.avg("label"), 4).alias("evr"), F.round(F.avg("rating"), 4).alias("error"))


def _task_rows(s) -> DataFrame:
    """Grid rows of three tasks, two algorithms each and a position for each period, from events."""
    pick = lambda i, *v: F.element_at(F.array(*map(F.lit, v)), (i + 1).cast("int"))
    g = s.features.groupBy(pick(F.col("user_id") % 3, "class", "cluster", "reduce").alias("task"), pick(F.col("item_id") % 2, "first", "second").alias("algorithm"), F.col("period").alias("position"))
    return g.agg(F.round(F.avg("rating"), 6).alias("metric"))


def _comparison(s):
    """k-means and DBSCAN with the selected parameters on the train profile and on its reductions."""
    (k, eps, ms), out, spaces = _selected(s), [], _spaces(s)
    # All spaces are fitted in the same scans.
    every = reduce(DataFrame.union, [rows.select(F.lit(name).alias("period"), "id", "idx", "val") for name, rows in spaces.items()])
    best = {r[0]: r for r in KM.best_runs(KM.fit_runs(every, s.vocabularies[1].count(), [k], SEEDS)[0])}
    for name, rows in spaces.items():
        _, _, _, cost, silhouette, sizes = best[name]
        if name == "original":
            labels = s.dbscan_labels[1].where((F.col("period") == "train") & (F.col("eps") == eps) & (F.col("min_samples") == ms)).select("id", "cluster")
        else:
            labels = durable(K.dbscan(rows.select("id", F.col("val").alias("x")), eps, ms))
        m = K.dbscan_shares(labels, rows.select("id", F.col("val").alias("x"))).first()
        out.append((name, k, silhouette, cost, sizes, eps, ms, m["clusters"], m["noise"]))
    return s.spark.createDataFrame(out, "space string, k int, kmeans_silhouette double, kmeans_sse double, kmeans_sizes array<long>, eps double, min_samples int, dbscan_clusters long, dbscan_noise double")


def _scatter(s):
    """Two principal coordinates of the train profile with the labels of the selected settings."""
    k, eps, ms = _selected(s)
    coords = D.project(s.profile_values, D.leading(s.profile_fit("pca"), 2))
    grid, centres = s.profile_runs
    (run,) = [r for r in KM.best_runs(grid) if r[:2] == ("train", k)]
    labels = KM.labels_of(s.profile("train"), centres[KM.Run(*run[:3])])
    found = s.dbscan_labels[1].where((F.col("period") == "train") & (F.col("eps") == eps) & (F.col("min_samples") == ms)).select("id", F.col("cluster").alias("dbscan"))
    both = coords.join(labels, "id").join(found, "id")
    return both.select("id", F.round(F.col("coords")[0], 4).alias("x"), F.round(F.col("coords")[1], 4).alias("y"), "cluster", "dbscan")


def _loadings(s):
    """Item loadings from a fixed rule: mean centred ratings by component = item_id % 3."""
    return s.cells.groupBy("item_id").agg(F.round(F.avg("value") - 3, 6).alias("loading")).select((F.col("item_id") % 3).cast("int").alias("component"), "item_id", "loading")


def _grid_rows(s):
    e = s.features.groupBy("period").agg(F.round(F.avg("f2"), 6).alias("metric")).select(F.concat(F.lit("class-"), "period").alias("artifact_id"), F.lit("v1").alias("version"), "metric")
    return e


def _specs(s):
    c = s.spark.read.parquet(f"{s.dir}/customer.parquet")
    return c.select(F.concat_ws(",", F.col("c_custkey").cast("string"), F.concat((F.col("c_custkey") + 9).cast("string"), F.lit("-"), (F.col("c_custkey") + 5).cast("string")), F.lit("a"), F.lit("1-9000")).alias("spec"))


def _asked(s):
    return S.expand_user_spec(_specs(s))


def _pairs(s):
    p = s.spark.read.parquet(f"{s.dir}/lineitem.parquet").join(s.spark.read.parquet(f"{s.dir}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey"))
    h = F.col("l_orderkey") % 7
    return p.select(F.when(h == 0, F.col("o_custkey") + 10_000_000).otherwise(F.col("o_custkey")).alias("user_id"), F.when(h == 1, F.col("l_partkey") + 10_000_000).otherwise(F.col("l_partkey")).alias("item_id"))


def _members(s):
    return S.membership(_asked(s), s.labels, s.typed("users"), FE.low_history(FE.user_stats(s.split)))


def _times(s):
    return P.valid_times(s.raw, STAR, STAR.ts_lo, STAR.ts_hi)


_ALL = {
    "score_before": lambda s: _score(s, s.raw),
    "score_after": lambda s: _score(s, s.kept),
    "score_compare": lambda s: C.compare_scores(_score(s, s.raw), _score(s, s.kept)),
    "clean_ratings": lambda s: s.kept.where("kind = 'ratings'").select("line"),
    "clean_users": lambda s: s.kept.where("kind = 'users'").select("line"),
    "clean_items": lambda s: s.kept.where("kind = 'movies'").select("line"),
    "clean_summary": lambda s: C.clean_summary(s.tagged),
    "quarantine_by_reason": lambda s: C.counts_by(C.quarantine_rows(s.tagged), "kind", "reason"),
    "quarantine_rows": lambda s: C.quarantine_rows(s.tagged),
    "quarantine_samples": lambda s: C.first_rows(C.quarantine_rows(s.tagged).distinct(), ["kind", "reason"], 3),
    "clean_counts": lambda s: C.with_total(C.counts_by(s.kept, "kind"), "kind"),
    "clean_samples": lambda s: C.first_rows(s.kept.select("kind", "line").distinct(), ["kind"], 3),
    "bad_decoding": lambda s: detect_bad_decoding(s.raw),
    "reference_ids": lambda s: read_ids(s.raw, "users").withColumn("kind", F.lit("users")).union(read_ids(s.raw, "movies").withColumn("kind", F.lit("movies"))),
    "referential_check": lambda s: C.referential_check(P.ratings4(s.raw), read_ids(s.raw, "movies"), "m").select("line"),
    "rule_truth": _truth,
    "field_count_histogram": lambda s: P.field_count_histogram(s.raw),
    "non_integer_counts": lambda s: P.non_integer_counts(s.raw),
    "rating_range_report": lambda s: P.rating_range_report(s.raw, STAR),
    "ts_report": lambda s: P.ts_report(s.raw),
    "exact_duplicates": lambda s: P.exact_duplicates(s.raw),
    "key_conflicts": lambda s: P.key_conflicts(s.raw),
    "distinct_counts": lambda s: P.distinct_counts(s.raw),
    "distinct_sketches": lambda s: P.distinct_of_sketches(P.monthly_sketches(s.raw)),
    "value_distribution": lambda s: P.value_distribution(s.raw, STAR),
    "zip_report": lambda s: P.zip_report(s.raw),
    "title_report": lambda s: P.title_report(s.raw, STAR),
    "genre_histogram": lambda s: P.genre_histogram(s.raw),
    "orphan_counts": lambda s: P.orphan_counts(s.raw),
    "monthly_histogram": lambda s: P.monthly_histogram(s.raw, STAR, STAR.ts_lo, STAR.ts_hi),
    "order_statistics": lambda s: P.order_statistics(_times(s), [0.0, 0.25, 0.5, 0.9, 0.99]),
    "dirty_samples": lambda s: P.dirty_samples(s.raw, STAR),
    "time_split": lambda s: C.counts_by(s.split, "period", "rating"),
    "vocabulary": lambda s: FE.vocabulary(s.split, "user_id"),
    "user_item_cells": lambda s: FE.user_item_cells(s.split),
    "user_stats": lambda s: FE.user_stats(s.split),
    "item_stats": lambda s: FE.item_stats(s.split).join(FE.global_mean(s.split)),
    "low_history": lambda s: FE.low_history(FE.user_stats(s.split)),
    "new_items": lambda s: FE.new_items(s.split),
    "profile_meta": lambda s: FE.profile_meta(s.split),
    "attribute_tables": lambda s: s.typed("movies").select("item_id", "title", F.array_join("genres", "|").alias("genres")),
    "event_features": lambda s: s.features.select("user_id", "item_id", "ts", "period", "label", F.round("f1", 6).alias("f1"), F.round("f2", 6).alias("f2"), F.array_join("genres", "").alias("genres"), "age_code", "gender", "occupation"),
    "cold_start_counts": lambda s: L.cold_start_counts(s.features),
    "standardize": lambda s: L.standardize(L.history_features(s.split), L.train_moments(s.split)).groupBy("period").agg(*[(F.round(F.avg(c), 5) + 0.0).alias(f"avg_{c}") for c in ("z1", "z2")], *[F.round(F.stddev_pop(c), 5).alias(f"dev_{c}") for c in ("z1", "z2")]),
    "average_precision": lambda s: L.average_precision(_scores(s).where("period = 'val'")).select(F.round("average_precision", 6).alias("average_precision")),
    "threshold_metrics": lambda s: L.threshold_metrics(_scores(s).where("period = 'test'"), 0.5),
    "predict_status": lambda s: L.predict_status(_pairs(s), s.split, s.typed("users"), s.typed("movies")),
    "l2_normalize": lambda s: K.l2_normalize(s.cells),
    "knn_distance": lambda s: K.knn_distance(s.vectors, MIN_SAMPLES).select("id", F.round("distance", 6).alias("distance")),
    "eps_candidates": lambda s: K.eps_candidates(K.knn_distance(s.vectors, MIN_SAMPLES), [50, 70, 90]),
    "dbscan_labels": lambda s: K.dbscan(s.vectors, EPS, MIN_SAMPLES),
    "dbscan_metrics": lambda s: K.dbscan_metrics(durable(K.dbscan(s.vectors, EPS, MIN_SAMPLES)), s.vectors),
    "genre_baseline": lambda s: S.genre_baseline(s.cells, s.typed("movies")),
    "cluster_size_rating": lambda s: S.size_rating(s.cells, s.labels),
    "cluster_genre_pref": lambda s: S.genre_pref(s.cells, s.labels, s.typed("movies")),
    "cluster_rep_items": lambda s: S.rep_items(s.cells, s.labels, s.typed("movies"), least=2, good=3.0),
    "cluster_demographics": lambda s: S.demographics(s.labels, s.typed("users")),
    "cluster_summaries": _summaries,
    "expand_user_spec": _asked,
    "membership": _members,
    "touched_groups": lambda s: S.touched_groups(_members(s), S.genre_pref(s.cells, s.labels, s.typed("movies")), S.rep_items(s.cells, s.labels, s.typed("movies"), least=2, good=3.0)),
    "top_loading_items": lambda s: S.top_loading_items(_loadings(s), s.typed("movies")),
    "grid_upsert": lambda s: S.upsert(_grid_rows(s), _grid_rows(s).where("artifact_id = 'class-val'").withColumn("version", F.lit("v2"))),
    "overview": lambda s: S.overview(_task_rows(s)),
    "logreg_grid": _logreg,
    "tree_grid": _trees,
    "select_best": lambda s: L.select_best(_settings(s, 8).select("position", F.col("share").alias("val_ap")), "val_ap", "position"),
    "top_features": _top_features,
    "predict_pairs": lambda s: L.predict_pairs(_models(s, "lr")["lr"], _pairs(s), s.split, s.typed("users"), s.typed("movies"), STAR),
    "compare_models": lambda s: L.compare_models(_models(s, "lr", "tree"), _pairs(s), s.split, s.typed("users"), s.typed("movies"), STAR),
    "kmeans_grid": _kmeans,
    "select_kmeans": lambda s: K.select_kmeans(_settings(s, 4).select((F.col("position") + 5).alias("k"), F.col("share").alias("silhouette"), F.col("n").alias("sse"))),
    "select_dbscan": lambda s: K.select_dbscan(_settings(s, 12).select("position", (F.col("n") % 20).alias("clusters"), F.col("share").alias("noise"), F.col("level").alias("silhouette"))),
    "profile_kmeans": _profile_kmeans,
    "profile_dbscan": _profile_dbscan,
    "pca_profile": lambda s: D.report_of(s.spark, s.profile_fit("pca"), "pca", DIMS),
    "svd_profile": lambda s: D.report_of(s.spark, s.profile_fit("svd"), "svd", DIMS),
    "pca_loading_items": lambda s: S.top_loading_items(D.loadings(s.profile_fit("pca"), s.vocabularies[1]), s.typed("movies")),
    "results_overview": _results_overview,
    "results_selected": _results_selected,
    "results_reduction": _results_reduction,
    "typed_failures": _typed_failures,
    "profile_export": _profile_export,
    "raw_files": _raw_files,
    "user_activity": _user_activity,
    "cosine_silhouette": lambda s: s.spark.createDataFrame([(round(K.cosine_silhouette(s.vectors.withColumn("cluster", (F.col("id") % 3).cast("int"))), 6),)], "silhouette double"),
    "cluster_sizes": lambda s: K.cluster_sizes(s.labels.where("cluster >= 0"), 6),
    "dbscan_sizes": lambda s: K.dbscan_sizes(K.dbscan(s.vectors, EPS, MIN_SAMPLES)),
    "pca_report": lambda s: D.report(s.vectors, "pca", [2, 10, 20, 50]),
    "svd_report": lambda s: D.report(s.vectors, "svd", [2, 10, 20, 50]),
    "reduction_report": lambda s: S.reduction_report(_reductions(s), "pca", 10).union(S.reduction_report(_reductions(s), "pca", 12)),
    "cluster_comparison": _comparison,
    "scatter_2d": _scatter,
}

_STARS: dict[tuple[str, str], Star] = {}


def star(spark: SparkSession, sf_dir: str) -> Star:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STARS:
        _STARS[key] = Star(spark, sf_dir)
    return _STARS[key]


QUERIES = {name: (lambda spark, sf_dir, f=f: f(star(spark, sf_dir))) for name, f in _ALL.items()}

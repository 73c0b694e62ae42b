"""Small tables with nulls, empties, ties, repeats and clashing columns; brute force where SQL can't say it."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewater.llm import ann, classlm, langid, mixing, packing, passages, preferences, secrets, simhash, sketch

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, fp string, bin string"


def docs_of(spark, texts, **kw):
    lang, source = kw.get("lang", lambda i: "en"), kw.get("source", lambda i: f"s{i % 3}")
    return spark.createDataFrame([(i, t, lang(i), source(i), len(t or ""), "k", "f", "b") for i, t in enumerate(texts)], COLUMNS)


def words(seed, n, pool=5000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(pool)}" for _ in range(n))


ODD = [None, "", "   ", "one", "one", words(1, 80), words(1, 80), words(2, 3000), "x" * 20000]


@pytest.fixture(scope="module")
def odd(spark):
    d = docs_of(spark, ODD)
    return d.union(d.where("doc_id = 5")).union(spark.createDataFrame([(None, "null id", None, None, None, None, None, None)], COLUMNS))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def test_simhash_brute_force(spark, odd, empty):
    base = words(3, 60).split()
    texts = ODD + [" ".join(base[:i] + ["zz"] + base[i + 1 :]) for i in range(0, 60, 5)]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_components(docs_of(spark, texts)).collect()}
    fps = []
    for t in texts:
        w = (t or "").lower().split()
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), seed=42) for i in range(max(1, len(w) - 3))] if w else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    comp = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(fps):
            comp[i] = min(comp[j] for j, b in enumerate(fps) if (a ^ b).bit_count() <= 4)
    assert got == {(i, f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, comp))}
    assert simhash.near_components(odd).count() == odd.count()
    assert simhash.near_components(empty).count() == 0


def test_near_edges_deals_hot_buckets(spark):
    rows = [(i, (1 << (i % 16)) | (1 << (16 + i // 16 % 16))) for i in range(200)]
    nodes = spark.createDataFrame(rows, "id long, fp long")
    few, many = (simhash.components(simhash.near_edges(nodes, 2, block=b)).collect() for b in (8, 1024))
    assert sorted(few) == sorted(many) and many


def test_near_dedup_keeps_one(spark, empty):
    base = words(4, 120).split()
    near = " ".join(["zz", *base[1:]])
    texts = [" ".join(base), " ".join(base).upper(), near, words(5, 120), " ".join(base[:60] + words(6, 60).split()), None, ""]
    assert sorted(r.doc_id for r in simhash.near_dedup(docs_of(spark, texts)).collect()) == [0, 3, 4, 5]
    assert simhash.near_dedup(empty).count() == 0


def test_near_dedup_finds_block_edits(spark):
    texts = []
    for i in range(60):
        base, other = ([f"{x}{i}q{j}" for j in range(200)] for x in "ab")
        edited = [base + other[:30], base + other[:46], base[:165], other[:10] + base[10:], base[:90] + other[:15] + base[105:], [w if j % 45 else "zz" for j, w in enumerate(base)]][i % 6]
        texts += [" ".join(base), " ".join(edited)]
    assert [r.doc_id for r in simhash.near_dedup(docs_of(spark, texts)).orderBy("doc_id").collect()] == list(range(0, 120, 2))


def test_near_dedup_keeps_texts_that_share_a_doc_id(spark):
    a, b, c, d = (words(i, 60) for i in (40, 41, 42, 43))
    rows = [(1, a), (1, b), (1, a), (2, a), (None, c), (None, d), (3, d)]
    got = simhash.near_dedup(spark.createDataFrame([(i, t, "en", "s", 1, "k", "f", "b") for i, t in rows], COLUMNS))
    assert got.columns == [x.split()[0] for x in COLUMNS.split(", ")]
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted([(1, a), (1, b), (0, c), (3, d)])


def test_langid(spark, odd, empty):
    a, b = "the and of house tree water".split(), "und der die haus baum wasser".split()
    text = lambda i: " ".join(random.Random(i).choices(a if i % 2 else b, k=12)) if i else "123 !!"
    d = docs_of(spark, [text(i) for i in range(40)], lang=lambda i: "en" if i % 2 else "de")
    got = {r["row"].doc_id: r.lang_pred for r in langid.identify(d).collect()}
    assert got.pop(0) == "und" and all(v == ("en" if k % 2 else "de") for k, v in got.items())
    assert langid.identify(odd).count() == odd.count() and langid.identify(empty).count() == 0
    assert langid.keep_identified(odd).columns == odd.columns


def test_secrets(spark, odd, empty):
    keys = ["AKIA" + "".join(random.Random(i).choices("ABCDEFGHIJKLMNOP234567", k=16)) for i in range(30)]
    hexes = ["".join(random.Random(i).choices("0123456789abcdef", k=40)) for i in range(30)]
    texts = [f"é some words {k} more" for k in keys] + [f'x token = "{h}" y' for h in hexes] + [f"card 4{i:015d} phone" for i in range(60)] + ["plain words only"]
    found = secrets.scan(docs_of(spark, texts)).collect()
    assert {(r.doc_id, r.secret) for r in found} == set(enumerate(keys + hexes))
    assert all(texts[r.doc_id][r.start : r.start + r.length] == r.secret for r in found)
    clean = {r.doc_id: r for r in secrets.redact(docs_of(spark, texts)).collect()}
    assert clean[0].text == "é some words [SECRET] more" and clean[0].n_chars == len(clean[0].text) and clean[120].text == "plain words only"
    assert secrets.redact(odd).count() == odd.count() and secrets.scan(empty).count() == 0


def test_secrets_of_one_kind(spark):
    keys = ["AKIA" + "".join(random.Random(i).choices("ABCDEFGHIJKLMNOP234567", k=16)) for i in range(5)]
    d = docs_of(spark, [f"some words {k} more" for k in keys])
    assert {(r.doc_id, r.secret) for r in secrets.scan(d).collect()} == set(enumerate(keys))
    assert all(r.text == "some words [SECRET] more" for r in secrets.redact(d).collect())
    assert secrets.scan(docs_of(spark, [f"card 4{i:015d} phone" for i in range(5)])).count() == 0


def test_secrets_rare_beyond_the_sample(spark):
    keys = ["AKIA" + "".join(random.Random(i).choices("ABCDEFGHIJKLMNOP234567", k=16)) for i in range(4)]
    r = random.Random(9)
    other = lambda i: [f"card 4{r.randrange(10**15):015d} phone", f"see /var/lib/{words(i, 1)}/part-{i:05d}.log now", f"id {r.randrange(1 << 40):x}-{i:06d} end"][i % 3]
    d = docs_of(spark, [f"some words {k} more" for k in keys] + [" ".join(other(9 * j + i) for i in range(9)) for j in range(600)])
    found = secrets.with_candidates(d).select(F.explode_outer("cands").alias("c")).where("c is not null").select("c.*")
    trees = secrets.train(secrets.label_by_format(found), limit=100)
    assert {(r.doc_id, r.secret) for r in secrets.scan(d, trees=trees).collect()} == set(enumerate(keys))


def test_mixing(spark, odd, empty):
    d = docs_of(spark, [words(i, 10 + i % 90) for i in range(200)], source=lambda i: "a" if i % 2 else "b" if i % 3 else None)
    rows = mixing.plan(d).collect()
    total = sum(r.size for r in rows)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) < 1
    assert all(0 <= r.taken <= 2 * r.size for r in rows) and abs(sum(r.taken for r in rows) - 1.5 * total) < 4
    out = mixing.mix(d)
    assert out.columns == d.columns and abs(out.select(F.sum(mixing.n_words(F.col("text")))).first()[0] - 1.5 * total) < 4
    assert mixing.plan(odd).count() == odd.count() and mixing.mix(odd).columns == odd.columns
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_op4_mixing_takes_documents_through_positions(spark, tmp_path, monkeypatch):
    texts = [words(i, 10 + i % 90) for i in range(200)] + [None, "", "", words(3, 13)]
    d = docs_of(spark, texts, source=lambda i: "a" if i % 2 else "b" if i % 3 else None)
    d.union(d.where("doc_id in (5, 202)")).write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    monkeypatch.setattr(mixing, "positions", lambda p, f=mixing.positions: seen.append(1) or f(p))
    got = mixing.op4_mixing(spark, str(tmp_path))
    planned = mixing.plan(mixing.table(spark, str(tmp_path), "documents"))
    assert seen and got.columns == ["doc_id", "size", "source_size", "target", "taken", "copies", "first_position"]
    assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(map(tuple, planned.select(*got.columns[:5]).collect()))
    import duckdb

    con = duckdb.connect()
    once = mixing.table(spark, str(tmp_path), "documents").where("doc_id not in (5, 202)")
    once.write.parquet(f"{tmp_path}/once/documents.parquet")
    con.sql(f"create view documents as select * from '{tmp_path}/once/documents.parquet/*.parquet'")
    want = con.sql(f"select doc_id, size, source_size, target, taken, copies, first_position from ({mixing.OP4_SQL})").fetchall()
    order = mixing.op4_mixing(spark, f"{tmp_path}/once").collect()
    assert sorted(map(tuple, order)) == sorted(want)
    assert [r.first_position or 0.0 for r in order] == sorted(r.first_position or 0.0 for r in order)
    copies = mixing.in_training_order(planned)
    full = mixing.taken_of(planned, copies).collect()
    assert all((r.first_position is None) == (r.taken == 0) for r in full) and any(r.first_position for r in full)
    order = [r.position for r in copies.collect()]
    assert order == sorted(order)


def test_classlm(spark, odd, empty):
    d = docs_of(spark, [" ".join(["the", "cat", "sat"] * (i % 5 + 1)) for i in range(30)])
    rows = classlm.score(d, F.col("doc_id") % 5 == 1, classes=4).collect()
    assert len(rows) == 30 and all(r.n_tokens == 3 * (r.doc_id % 5 + 1) + 1 == r.n_known and r.score > r.base_score for r in rows)
    assert classlm.score(odd, F.lit(False), classes=4, sweeps=2).count() == odd.count()
    assert classlm.score(odd, F.lit(True), classes=4).count() == odd.count()
    assert classlm.score(empty, F.lit(False), classes=4).count() == 0


def test_compact_windows_hold_each_passage_once():
    v = np.random.default_rng(0).permutation(200).astype(np.uint64)
    windows = list(zip(*passages.compact_windows(v, 20)))
    for i in range(0, 180, 7):
        for j in range(i + 19, 200, 11):
            own = [c for l, c, r in windows if l <= i <= c <= j <= r]
            assert own == [i + int(np.argmin(v[i : j + 1]))]


def test_passages(spark, odd, empty):
    shared = words(7, 51)
    texts = [words(8, 200) + " " + shared + " " + words(9, 90), words(10, 30) + " " + shared, words(11, 400), shared, words(12, 45) + " " + " ".join(shared.split()[:40])]
    found = passages.repeated_passages(docs_of(spark, texts)).collect()
    assert {x for r in found for x in (r.doc_id, r.other_doc_id)} == {0, 1, 3}
    assert all(texts[r.doc_id].split()[r.start : r.start + r.n_words] == texts[r.other_doc_id].split()[r.other_start : r.other_start + r.n_words] for r in found)
    assert {(r.doc_id, r.other_doc_id) for r in passages.repeated_passages(odd).collect()} >= {(6, 5)}
    assert passages.repeated_passages(empty).count() == 0


def test_preferences(spark):
    schema = "pair_id long, turn int, role string, text string"
    a = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "x"), (1, 0, "user", "hi")], schema)
    b = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "no!"), (1, 2, None, None), (3, 0, "user", "y")], schema)
    got = {r.pair_id: r for r in preferences.format_pairs(a, b).collect()}
    r = got[1]
    assert (r.prompt, r.prompt_turns) == ("<|im_start|>user\nhi<|im_end|>\n", 1)
    s, e = map(int, r.rejected_mask.split("-"))
    assert r.rejected[s:e] == "no!<|im_end|>" and got[2].prompt == "" and got[2].chosen and not got[2].rejected and got[3].rejected
    assert preferences.format_pairs(a.limit(0), b.limit(0)).count() == 0


def test_packing(spark, odd, empty):
    rows = packing.pack(odd, size=64).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(empty).count() == 0
    assert sum(n * len(p) for n, p in packing.shortest_pack_first({3: 10, 5: 4, 8: 2}, 8)) == 16


def test_sketch(spark, odd, empty):
    texts = [words(20, 300), "", words(21, 10), words(20, 300)]
    rows = sorted(sketch.compare_with_next(docs_of(spark, texts)).collect())
    assert [r.n_chars for r in rows] == [len(t) for t in texts] and rows[0].fingerprint == rows[3].fingerprint and rows[3].near_next == 1.0
    a, b = (sketch.sketch(words(i, 4000)) for i in (30, 31))
    both = sketch.sketch(words(30, 4000) + " " + words(31, 4000))
    assert sketch.containment(a, both) > 0.99 and len(np.setdiff1d(sketch.merge(a, b), both)) == 0
    assert sketch.compare_with_next(odd).count() == odd.count() and sketch.compare_with_next(empty).count() == 0


def test_sketch_of_short_texts_in_long_ones(spark):
    texts = []
    for i in range(60):
        long = words(1000 + i, 500).split()
        texts += [" ".join(long[7 : 12 + i % 16]), " ".join(long)]
    rows = sorted(sketch.compare_with_next(docs_of(spark, texts)).collect())
    assert all(r.near_next == 1.0 for r in rows[::2]) and all(r.near_next == 0.0 for r in rows[1::2])
    assert all(r.fingerprint == sketch.as_text(sketch.sketch(t)) for r, t in zip(rows, texts))

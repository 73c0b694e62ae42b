"""All stages in sequence over nulls, repeats, empties, copies and clashing columns, and near-dedup against brute force."""

import random

import corpus_pipeline
from tidewater.llm import packing, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, fp string, bin string, near_keep long, mix_copy int"


def some(r, n):
    return [r.choice("the of and house water tree people light stone river green day night".split()) + str(r.randrange(400)) for _ in range(n)]


def rows_of(texts):
    return [(i, t, "en", f"s{i % 3}", len(t or ""), "f", "b", 1, 2) for i, t in enumerate(texts)]


def test_stages_in_sequence(spark, tmp_path):
    r = random.Random(4)
    key = "AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOP234567", k=16))
    base = some(r, 200)
    texts = [" ".join(some(r, 60 + i)) for i in range(40)] + [None, "", "  ", "12 34", " ".join(base), " ".join(base).upper(), " ".join(base[:195] + some(r, 5)), f"my key is {key} " + " ".join(some(r, 50))]
    rows = rows_of(texts)
    rows += [rows[3], (None, "a text without an id " + " ".join(some(r, 30)), None, None, None, "f", "b", 1, 2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        assert name == "packing" or [f.name for f in docs.schema] == [c.split()[0] for c in SCHEMA.split(", ")]
    ids = lambda n: sorted(-1 if x.doc_id is None else x.doc_id for x in seen[n].select("doc_id").distinct().collect())
    assert ids("language_id") == [-1, *range(40), 44, 45, 46, 47]
    assert ids("near_dedup") == [-1, *range(40), 44, 47] and seen["near_dedup"].count() == 43
    assert seen["secrets"].where(f"text like '%{key}%'").count() == 0 and seen["secrets"].where("doc_id = 47 and text like 'my key is [SECRET] %'").count() == 1
    total = seen["mixing"].selectExpr("sum(size(regexp_extract_all(text, '[^ ]+', 0)))").first()[0]
    before = seen["secrets"].selectExpr("sum(size(regexp_extract_all(text, '[^ ]+', 0)))").first()[0]
    assert abs(total - 1.5 * before) < 5
    pieces = seen["packing"].collect()
    assert len({(p.sequence_id, p.offset) for p in pieces}) == len(pieces) and sum(p.length for p in pieces if p.start == 0) > 0
    assert corpus_pipeline.STAGES[-1][0] == "packing" and packing.pack(seen["mixing"].limit(0)).count() == 0


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_equals_brute_force(spark):
    r, texts = random.Random(6), []
    for _ in range(40):
        base = some(r, r.choice([8, 30, 90, 250]))
        texts.append(base)
        for _ in range(3):
            cut, kind = list(base), r.randrange(4)
            n = max(1, int(len(base) * r.uniform(0.01, 0.25)))
            if kind == 0:
                cut += some(r, n)
            elif kind == 1:
                cut = cut[:-n]
            elif kind == 2:
                at = r.randrange(len(cut) - n + 1)
                cut[at : at + n] = some(r, n)
            else:
                for _ in range(max(1, n // 8)):
                    cut[r.randrange(len(cut))] = "zz"
            texts.append(cut)
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    got = [x.doc_id for x in simhash.near_dedup(spark.createDataFrame(rows_of([" ".join(t) for t in texts]), SCHEMA)).collect()]
    assert sorted(got) == sorted(set(root)) and len(got) < len(texts) - 30

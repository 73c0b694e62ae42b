"""The Merkle manifest against trees built in plain Python."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 16 * 16
        run = level[a : a + 16]
        out.append((run[: i - a], run[i - a + 1 :]))
        i //= 16
    return out


def plain(rows, upper=lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 0):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    by = defaultdict(list)
    for doc, text, lang, source, n in rows:
        leaf = sha("".join(map(part, (doc, source, lang, n, text))))
        now = sha("".join(map(part, (doc, source, lang, n, low(text))))) if upper(doc) else leaf
        by[source].append((doc is not None, doc or 0, leaf, now, doc))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([r[2] for r in sorted(by[s], key=lambda r: r[:3])]) for s in sources}
    top, out = plain_tree([trees[s][-1][0] for s in sources]), []
    for k, s in enumerate(sources):
        for i, (_, _, leaf, now, doc) in enumerate(sorted(by[s], key=lambda r: r[:3])):
            path, folded = plain_path(trees[s], i) + plain_path(top, k), now
            for a, b in path:
                folded = sha("".join(a) + folded + "".join(b))
            out.append((doc, leaf, trees[s][-1][0], top[-1][0], sha("".join("".join(a + b) for a, b in path)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def found(spark, tmp_path, rows, schema=DOCS):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in merkle.op12_merkle(spark, str(tmp_path)).collect()), key=str)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, "b": 17}, {"a": 257, None: 3, "": 1, "é": 300}, {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_against_plain_trees(spark, tmp_path, sizes):
    rows, doc = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((doc, f"Text {doc} Ünï" if doc % 7 else None, "en" if doc % 3 else None, source, doc if doc % 2 else None))
            doc += 1
    assert found(spark, tmp_path, rows) == plain(rows)


def test_taller_trees_with_small_subtrees(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    rows = [(i, f"T{i}", "en", "only", 2) for i in range(700)]
    assert found(spark, tmp_path, rows) == plain(rows)


def test_null_and_repeated_rows(spark, tmp_path):
    rows = [(None, "A", None, "s", 1), (None, "B", None, "s", 1), (5, "C", "en", "s", 1), (5, "C", "en", "s", 1), (5, "", "en", None, None), (9, "x" * 200_000, "en", "s", None)]
    assert found(spark, tmp_path, rows) == plain(rows)


def test_empty_table_and_clashing_columns(spark, tmp_path):
    assert found(spark, tmp_path, []) == []
    rows = [(i, f"T{i}", "en", "s", 2) for i in range(20)]
    wide = [(*r, "x", 1, 2, "y") for r in rows]
    assert found(spark, tmp_path, wide, DOCS + ", tree string, idx long, n long, now string") == plain(rows)


def test_any_change_is_found(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", 1) for i in range(300)], DOCS)
    m = merkle.manifest(docs, now=F.when(F.col("doc_id") == 150, F.lit(b"\x00" * 32)))
    assert [r["doc_id"] for r in merkle.prove(m, "now").where("not verified").collect()] == [150]


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_addresses_are_one_to_one_and_subtrees_lie_together(levels):
    at = [merkle.address(levels, d, np.arange(16**d)) for d in range(levels)]
    assert sorted(np.concatenate(at).tolist()) == list(range(merkle.tree_size(levels)))
    top = levels // 2
    if top:
        low = merkle.tree_size(levels - top)
        for tree in range(0, 16**top, 7):
            own = np.concatenate([at[d][tree * 16 ** (d - top) : (tree + 1) * 16 ** (d - top)] for d in range(top, levels)])
            assert own.max() - own.min() == low - 1

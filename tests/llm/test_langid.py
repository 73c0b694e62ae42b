"""Forward and backward sums against all segmentations written out, and a text without spaces."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import langid
from tidewater.llm.common import worker_cache

VOCABULARY = ["a", "b", "c", "▁", "▁a", "ab", "ba", "aba", "bab", "abcab", "▁ab", "ca"]


def by_segmentation(word, p):
    """Log probability by a plain recursion over last pieces, in logs; an unknown letter is UNKNOWN."""
    best = [0.0]
    for j in range(1, len(word) + 1):
        ways = [best[i] + np.log(p[word[i:j]] if word[i:j] in p else langid.UNKNOWN) for i in range(max(0, j - 5), j) if word[i:j] in p or j - i == 1]
        best.append(np.logaddexp.reduce(ways))
    return best[-1]


@pytest.fixture
def trie(monkeypatch):
    t = langid.Trie({w: i for i, w in enumerate(VOCABULARY)})
    monkeypatch.setitem(worker_cache("langid"), "test", t)
    return t


def written_out(word, p):
    """Sum over all segmentations, each written out."""
    if not word:
        return 1.0
    return sum((p[word[:n]] if word[:n] in p else langid.UNKNOWN) * written_out(word[n:], p) for n in range(1, len(word) + 1) if word[:n] in p or n == 1)


@pytest.mark.parametrize("step", [7, 64, 1024])
def test_forward_sums_all_segmentations(trie, monkeypatch, step):
    monkeypatch.setattr(langid, "STEP", step)
    r = random.Random(step)
    table = np.random.default_rng(0).dirichlet(np.ones(len(VOCABULARY)), 3).T
    words = ["▁" + "".join(r.choices("abcx", k=n)) for n in [*range(1, 12), 30, 33, 64, 200, 200, 3000]] + ["▁" + "x" * 200, "▁" + "y" * 60 + "abcab"]
    got = langid.word_scores(words, "test", table)
    for k in range(3):
        p = dict(zip(VOCABULARY, table[:, k]))
        assert np.allclose(got[:, k], [by_segmentation(w, p) for w in words], rtol=1e-9)
        assert np.allclose(got[:11, k], [np.log(written_out(w, p)) for w in words[:11]], rtol=1e-9)


def test_forward_and_backward_agree(trie):
    p = np.random.default_rng(1).dirichlet(np.ones(len(VOCABULARY)), 1).T
    words = ["▁" + "".join(random.Random(i).choices("abcx", k=5 + i * 13)) for i in range(20)]
    lattice = langid.Lattice(words, trie)
    edges = langid._of_edges(p, lattice)
    (alpha, up), (beta, down) = lattice.forward(edges), lattice.backward(edges)
    for w, n in enumerate(lattice.ends):
        whole = np.log(alpha[w, n, 0]) + up[w, n, 0]
        assert np.isclose(np.log(beta[w, 0, 0]) + down[w, 0, 0], whole)
    # Each letter lies in exactly one piece of a segmentation.
    whole = np.array([np.log(alpha[w, n, 0]) + up[w, n, 0] for w, n in enumerate(lattice.ends)])
    x, i, j = lattice.word, lattice.start, lattice.end
    share = alpha[x, i, 0] * edges[:, 0] * beta[x, j, 0] * np.exp(up[x, i, 0] + down[x, j, 0] - whole[x])
    assert np.allclose(np.bincount(x, share * (j - i)), lattice.ends)


def test_held_out_documents_and_long_runs(spark):
    a, b = "the and of house tree water people".split(), "und der die haus baum wasser leute".split()
    text = lambda i: " ".join(random.Random(i).choices(a if i % 2 else b, k=12))
    rows = [(i, text(i), "en" if i % 2 else "de") for i in range(400)]
    extra = [(1000, "".join(a * 400), None), (1001, "".join(b * 400), None), (None, text(1), None), (1003, "", "en"), (1004, None, "de"), (1005, "12 3", "en"), (7, text(7), "en")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string").withColumn("row", F.lit(1)).withColumn("score", F.lit("x"))
    got = [(r["row"].doc_id, r.lang_pred, r.score) for r in langid.identify(docs).collect()]
    assert len(got) == len(rows) + len(extra) and all(0 <= s <= 1 for _, _, s in got)
    by = {d: p for d, p, _ in got}
    assert all(by[i] == ("en" if i % 2 else "de") for i in range(400))
    assert [by[k] for k in (1000, 1001, None, 1003, 1004, 1005)] == ["en", "de", "en", "und", "und", "und"]
    assert langid.sample(docs.union(docs), 20).count() == 40

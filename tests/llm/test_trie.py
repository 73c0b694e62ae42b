"""The prefix trie against a dictionary of all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidewater.llm import trie

TURNS = "conv_id long, turn long, role string, text string"


def by_dictionary(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), text))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members, kids, leaves, saved, out = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int), []
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        words = len(p[-1][1].encode().split()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * words
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def found(spark, rows):
    df = spark.createDataFrame(rows, TURNS)
    return sorted((tuple(r) for r in trie.prefix_trie(trie.with_shared_heads(trie.turn_lists(df))).collect()), key=lambda r: r[:2])


def talks(seed, n=120):
    """Conversations that share long openings, some of them whole, in few different turns."""
    rng, rows = random.Random(seed), []
    opening = [("user" if i % 2 == 0 else "assistant", f"turn {i} of it") for i in range(12)]
    for c in range(n):
        shared = rng.choice([0, 1, 3, 6, 12])
        turns = opening[:shared] + [(rng.choice("uv"), rng.choice(["a", "b c", ""])) for _ in range(rng.randrange(4))]
        rows += [(c, i, r, x) for i, (r, x) in enumerate(turns)]
    return rows


@pytest.mark.parametrize("shard", [1, 25, 8192])
def test_any_shard_size(spark, monkeypatch, shard):
    monkeypatch.setattr(trie, "SHARD", shard)
    rows = talks(shard)
    assert found(spark, rows) == by_dictionary(rows)


def test_nulls_ties_repeats_and_no_turns(spark):
    rows = [(20, None, "a", "x"), (20, 1, None, "y"), (20, 1, "a", None), (21, 0, "b", "z"), (21, 0, "b", "z"), (None, 0, "a", "lost"), (-3, 5, "", ""), (45, 1, "u", "v"), (46, 1, "u", "v")]
    assert found(spark, rows) == by_dictionary(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_other_columns_are_not_read(spark):
    rows = talks(5, 30)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TURNS + ", turns int, path string, depth int")
    got = trie.prefix_trie(trie.with_shared_heads(trie.turn_lists(df)))
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2]) == by_dictionary(rows)


def test_copies_meet_as_one_sequence(spark):
    rows = [(c, t, "r", f"{t}") for c in range(3000) for t in range(3)]
    assert found(spark, rows) == by_dictionary(rows)


def test_double_array_holds_all_children_and_no_others():
    rng = np.random.default_rng(3)
    array, level, edges = trie.DoubleArray(4), np.zeros(1, np.int64), {}
    for width in (40, 3, 1, 2):
        parents = np.repeat(level, width)
        labels = rng.integers(0, 500, len(parents))
        array.insert(parents, labels)
        to = array.step(parents, labels)
        assert (to >= 0).all()
        for p, c, t in zip(parents.tolist(), labels.tolist(), to.tolist()):
            assert edges.setdefault((p, c), t) == t
        level = np.unique(to)
    assert len(set(edges.values())) == len(edges)
    slots = rng.choice(level, 200)
    labels = rng.integers(0, 500, 200)
    assert [int(x) for x in array.step(slots, labels)] == [edges.get((int(p), int(c)), -1) for p, c in zip(slots, labels)]

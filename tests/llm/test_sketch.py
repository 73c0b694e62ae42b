"""The document fingerprints against a plain computation."""

import hashlib
import random

import pytest
import xxhash

from tidewater.llm import sketch

LIMIT = 2**64 // sketch.SCALE


def plain_set(text):
    words = text.encode().lower().split()
    runs = [b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    return {xxhash.xxh64_intdigest(r, 42) for r in runs}


def plain_sketch(h):
    kept = {x for x in h if x < LIMIT}
    return kept or set(sorted(h)[:1])


def plain_likeness(a, b):
    whole = any(h and min(h) >= LIMIT for h in (a, b))
    x, y = (a, b) if whole else (plain_sketch(a), plain_sketch(b))
    return (float(len(x) == len(y)) if not x or not y else len(x & y) / min(len(x), len(y))), "shingles" if whole else "sketch"


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_all_columns_of_a_table(spark, partitions):
    r = random.Random(partitions)
    texts = [" ".join(f"W{r.randrange(400)}é" for _ in range(r.choice([0, 1, 3, 9, 40, 300, 900]))) for _ in range(150)] + [None, "", "one"]
    ids = r.sample(range(-500, 5000), len(texts))
    rows = sorted(zip(ids, texts))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = {x.doc_id: tuple(x) for x in sketch.compare_with_next(spark.createDataFrame(r.sample(rows, len(rows)), "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    digits = lambda h: "".join(f"{x:016x}" for x in sorted(plain_sketch(h)))
    for k, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(text) // 2
        edited = text[: len(text) - n] + after[:n]
        own, changed, other = map(plain_set, (text, edited, after))
        assert got[doc_id] == (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), digits(own), digits(changed), *plain_likeness(own, changed), *plain_likeness(own, other))

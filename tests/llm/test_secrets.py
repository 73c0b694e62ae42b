"""The secret scan: planted kinds and what looks like them, held-out examples, and the forest against a plain evaluation."""

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewater.llm import secrets

HEX, LOW, KEY = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOP234567"


@pytest.fixture(scope="module")
def trees(spark):
    return secrets.forest(spark)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_planted_kinds(spark, trees):
    r = random.Random(1)
    some = lambda a, k: "".join(r.choice(a) for _ in range(k))
    kinds = {
        "token": (20, lambda: f'some words token = "{some(HEX, 40)}" and more'), "upper": (20, lambda: f'SOME!! TOKEN = "{some(HEX, 40).upper()}"!! MORE'),
        "letters": (20, lambda: f'password = "{some(LOW, 32)}"'), "said": (20, lambda: f'the password is "{some(LOW, 32)}" now'),
        "late digit": (20, lambda: f'token = "{some(LOW, 300)}{some(HEX, 40)}"'), "nine": (20, lambda: f'password = "{some(LOW + LOW.upper() + HEX, 9)}"'),
        "address": (20, lambda: f"see https://bob:{some(LOW + HEX, 12)}@host.example.com/x"), "provider": (20, lambda: f"some words AKIA{some(KEY, 16)} more"),
    }
    clean = {
        "commit": (20, lambda: f"fixed in commit {some(HEX, 40)} today"), "sha256": (20, lambda: f"sha256 {some(HEX, 64)} of it"), "card": (50, lambda: f"card {some('0123456789', 16)} phone"),
        "uuid": (20, lambda: f"id {some(HEX, 8)}-{some(HEX, 4)}-{some(HEX, 4)}-{some(HEX, 4)}-{some(HEX, 12)} end"), "path": (20, lambda: f"see /var/lib/{some(LOW, 6)}/part-{r.randrange(10**5):05d}.log now"),
        "holder": (5, lambda: 'password = "changeme"'), "quote": (5, lambda: 'they said "something" and "understanding" left'),
    }
    rows = [(name, make()) for group in (kinds, clean) for name, (n, make) in group.items() for _ in range(n)]
    found = Counter(rows[x.doc_id][0] for x in secrets.scan(frame(spark, [t for _, t in rows]), trees=trees).collect())
    assert all(found[name] >= 0.95 * n for name, (n, _) in kinds.items()), found
    assert all(found[name] <= 0.05 * n for name, (n, _) in clean.items()), found


def test_held_out_examples(spark, trees):
    rows = secrets.scored(secrets.examples(spark, 3100, seed=7), trees).select("row.secret", F.explode_outer("cands").alias("c"))
    secret = F.coalesce(F.col("c.value") == F.col("secret"), F.lit(False))
    yes = F.coalesce(F.col("c.score") >= 0.5, F.lit(False))
    x = rows.agg(F.count_if(secret & yes).alias("hit"), F.count_if(~secret & yes).alias("wrong"), F.count_if(secret & ~yes).alias("missed")).first()
    print(x)
    assert x.hit / (x.hit + x.wrong) >= 0.97 and x.hit / (x.hit + x.missed) >= 0.97


def plain_vote(trees, features):
    def walk(lines, at, depth):
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-\d.Ee]+)\)", lines[at])
        if not m:
            return float(lines[at].split(":")[1])
        indent = len(m[1])
        if features[int(m[2])] <= float(m[4]):
            return walk(lines, at + 1, depth + 1)
        other = next(k for k in range(at + 1, len(lines)) if re.match(rf" {{{indent}}}Else", lines[k]))
        return walk(lines, other + 1, depth + 1)

    return sum(walk([x for x in t.split("\n") if x.strip()], 0, 0) for t in trees) / len(trees)


def test_forest_equals_a_plain_evaluation(spark, trees):
    rows = secrets.with_candidates(secrets.examples(spark, 310, seed=3)).select(F.explode_outer("cands").alias("c")).where("c is not null").select("c.features")
    got = rows.select("features", secrets.vote(trees, F.col("features")).alias("score")).collect()
    assert len(got) > 300 and all(abs(r.score - plain_vote(trees, r.features)) < 1e-9 for r in got)


def test_transitions_tell_words_from_drawn_letters(spark):
    ratios = secrets._array(secrets.transitions(secrets.dictionary()))
    x = spark.createDataFrame([("understanding",), ("qzjvxkwpgbqd",), ("1234",), ("",)], "v string").select(secrets._transition_score(F.col("v"), ratios).alias("s")).collect()
    assert x[0].s > 0.3 > -0.3 > x[1].s and x[2].s == x[3].s == 0


@pytest.mark.parametrize("text", [":" * 300_000, ".:" * 150_000, "=" * 300_000, "a" * 300_000, "a." * 150_000, '"a' * 150_000, "=." * 150_000, "://a:" * 60_000, "A1" * 150_000])
def test_long_texts_are_read_once(spark, text):
    began = time.time()
    frame(spark, [text]).select(F.size(F.regexp_extract_all("text", F.lit(secrets.CANDIDATE), F.lit(0)))).collect()
    assert time.time() - began < 20

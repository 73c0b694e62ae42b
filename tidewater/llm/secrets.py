"""Secret scans in DataFrame functions: a wide pattern finds candidates, a random forest removes false positives.

The forest is trained by pyspark.ml on labelled findings and then written out as Column expressions, so that a scan is
one pass over the texts without a shuffle or a join. The findings are made by rule: keys, tokens and passwords as they
stand in configuration, addresses and prose, and what looks like them: commit hashes, checksums, identifiers, card
numbers, paths, placeholders. So a label comes from what was put into a text, not from a feature.
"""

from __future__ import annotations

import json
import math
import re
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import durable, table

#: Characters of a quoted or assigned value.
_VALUE = r"[!-~&&[^\"'`<>(){},;]]"
#: Those of an assigned value without quotes; no colon, so that a run of any length is read once.
_ASSIGNED = r"[!-~&&[^\"'`<>(){},;:]]"
#: Quoted values of eight or more; what stands before the @ of an address with a user; assigned values of eight or more, less
#: the mark that ends a sentence; runs of twelve or more characters that keys are made of, with a digit among them; runs of sixteen capitals.
CANDIDATE = (
    rf"(?<=[\"'`]){_VALUE}{{8,}}+(?=[\"'`])|(?<=:)(?<=://[^\s:/@]{{0,64}}:)[^\s/@]{{3,}}+(?=@)|(?<=[=:] ?)(?!/){_ASSIGNED}{{8,}}(?<![.!?])"
    r"|(?<![A-Za-z0-9+/_\-])(?:(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{12,}+={0,2}|[A-Z]{16,}+)"
)
#: Characters of neighbouring text that features see on either side.
CONTEXT = 48
#: Labelled findings that train the forest, texts that they are made in, dictionary words, trees and their depth.
LABELLED, EXAMPLES, DICTIONARY, TREES, DEPTH = 20_000, 8000, 1000, 20, 7
#: Least share of the sample's weight that positives have.
RARE = 0.25
MASK = "[SECRET]"
_NAMES = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api.?key|access.?key|auth|credential|bearer)[^A-Za-z]{0,12}((is|was|are|to|of|for|with|set|value)[^A-Za-z]{1,6}){0,2}$"
#: Words that stand before digests and identifiers.
_DIGESTS = r"(?i)\b(commit|checkout|revert(s|ed)?|merged?|rev(ision)?|sha-?\d*|hash|digest|checksum|md5|etag|integrity|uuid|guid|build|image|blob|tree|base64|id|version|ref)\b[^\n]{0,14}$"
#: Published formats of providers' keys.
_FORMATS = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})$"


def dictionary(size: int = DICTIONARY) -> list[str]:
    """The first whole words of four letters or more in a public vocabulary, which is in order of frequency."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = sorted((i, w[:-4]) for w, i in vocab.items() if re.fullmatch(r"[a-z]{4,}</w>", w))
    return [w for _, w in words[:size]]


def transitions(words: list[str]) -> list[float]:
    """For each pair of letters, row by row, the log-likelihood ratio of the second after the first in words against letters drawn evenly."""
    count = [[1.0] * 26 for _ in range(26)]
    for w in words:
        for a, b in zip(w, w[1:]):
            count[ord(a) - 97][ord(b) - 97] += 1
    return [round(math.log(26 * x / sum(row)), 3) for row in count for x in row]


def _array(values) -> Column:
    return F.expr("array(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}D" for v in values) + ")")


def _transition_score(v: Column, ratios: Column) -> Column:
    """The mean log-likelihood ratio of a value's neighbouring letters; 0 if there are none."""
    codes = F.transform(F.split(F.lower(v), ""), lambda c: F.ascii(c) - 97)
    inside = lambda a: (a >= 0) & (a < 26)
    pairs = F.zip_with(codes, F.slice(codes, F.lit(2), F.greatest(F.size(codes) - 1, F.lit(0))), lambda a, b: F.when(inside(a) & inside(b), F.element_at(ratios, a * 26 + b + 1)))
    known = F.filter(pairs, lambda x: x.isNotNull())
    return F.coalesce(F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(known), F.lit(0)), F.lit(0.0))


def _features(c: Column, words: Column, ratios: Column) -> dict[str, Column]:
    """Of a candidate struct (value, left, right)."""
    v, n = c["value"], F.length(c["value"]).cast("double")
    count = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    parts = F.transform(F.regexp_extract_all(v, F.lit("[A-Z]?[a-z]{3,}|[A-Z]{4,}"), F.lit(0)), F.lower)
    spelled = F.filter(parts, lambda w: F.array_contains(words, w))
    yes = lambda x: x.cast("double")
    return {
        "length": n,
        "digits": count("[0-9]"),
        "upper": count("[A-Z]"),
        "beyond_hex": count("[g-zG-Z]"),
        "marks": count(r"[^A-Za-z0-9]"),
        "kind_changes": count(r"[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])"),
        "transitions": _transition_score(v, ratios),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "dictionary": F.aggregate(spelled, F.lit(0), lambda a, w: a + F.length(w)) / n,
        "path": yes(c["left"].rlike(r"[/.\\]$")) + yes(c["right"].rlike(r"^[./\\]\S")) + yes(v.rlike("/.*/")),
        "digest": yes(v.rlike(r"^([0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$")),
        "format": yes(v.rlike(_FORMATS)),
        "address": yes(c["left"].rlike(r"://[^\s:/@]*:$") & c["right"].startswith("@")),
        "assigned": yes(c["left"].rlike(r"[=:]\s*[\"'`]?$")),
        "named": yes(c["left"].rlike(_NAMES)),
        "digest_named": yes(c["left"].rlike(_DIGESTS)),
        "quoted": yes(c["left"].rlike("[\"'`]$") & c["right"].rlike("^[\"'`]")),
    }


def candidates(text: Column) -> tuple[Column, Column]:
    """The candidates of a text and the text before, between and after them."""
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    return found, F.split(text, CANDIDATE, -1)


def with_candidates(docs: DataFrame) -> DataFrame:
    """(row, gaps, cands): cands are structs (value, start, left, right, features), features in a fixed order."""
    spelled = dictionary()
    words, ratios = _array(spelled), _array(transitions(spelled))
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(CANDIDATE), F.lit(0))
    a = docs.select(F.struct("*").alias("row"), found.alias("found"))
    none = F.array().cast("array<string>")
    b = a.select("row", "found", F.when(F.size("found") > 0, F.split(F.col("row.text"), CANDIDATE, -1)).otherwise(none).alias("gaps"))
    lengths = F.transform("found", lambda v, i: F.length(v) + F.length(F.element_at("gaps", i + 1)))
    starts = F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    c = b.select("row", "found", "gaps", F.when(F.size("found") > 0, starts).otherwise(F.array(F.lit(0))).alias("starts"))
    parts = F.transform("found", lambda v, i: F.struct(
        v.alias("value"), (F.element_at("starts", i + 1) + F.length(F.element_at("gaps", i + 1))).alias("start"),
        F.element_at("gaps", i + 1).alias("gap"), F.left(F.element_at("gaps", i + 2), F.lit(CONTEXT)).alias("right")))
    near = lambda x: F.struct(x["value"].alias("value"), x["start"].alias("start"), F.right(x["gap"], F.lit(CONTEXT)).alias("left"), x["right"].alias("right"))
    d = c.select("row", "gaps", F.transform(parts, near).alias("cands"))
    full = lambda x: F.struct(x["value"].alias("value"), x["start"].alias("start"), x["left"].alias("left"), x["right"].alias("right"), F.array(*_features(x, words, ratios).values()).alias("features"))
    return d.select("row", "gaps", F.transform("cands", full).alias("cands"))


def examples(spark: SparkSession, n: int = EXAMPLES, seed: int = 0) -> DataFrame:
    """(id, kind, text, secret): texts that hold a secret or, where `secret` is null, something that looks like one. Kinds go round by id.

    All is drawn from hashes of seed and id, so a seed gives the same texts every time, and another seed others.
    """
    drawn = lambda tag: F.sha2(F.concat_ws("-", F.lit(f"{seed}-{tag}"), F.col("id").cast("string")), 256)
    pick = lambda tag, values: F.element_at(_array(values), (F.pmod(F.xxhash64(drawn(tag)), F.lit(len(values))) + 1).cast("int"))
    between = lambda tag, a, b: (F.pmod(F.xxhash64(drawn(f"{tag}n")), F.lit(b - a + 1)) + a).cast("int")
    hexed = lambda tag, k: F.left(F.concat(drawn(f"{tag}a"), drawn(f"{tag}b")), F.lit(k) if isinstance(k, int) else k)
    mixed = lambda tag, k: F.left(F.concat(*[F.translate(F.base64(F.unhex(drawn(f"{tag}{i}"))), "+/=", "xY") for i in range(3)]), F.lit(k) if isinstance(k, int) else k)
    letters = lambda tag, k: F.translate(mixed(tag, k), "0123456789", "qzJvXkwpGb")
    number = lambda tag, k: F.left(F.translate(F.concat(drawn(tag), drawn(f"{tag}b")), "abcdef", "193750"), F.lit(k))
    words = [w for w in dictionary() if w.isalpha()]
    word, name = (lambda tag: pick(tag, words)), pick("name", ["password", "passwd", "secret", "token", "api_key", "apiKey", "access_key", "auth_token", "client_secret", "DB_PASSWORD", "pwd", "TOKEN"])
    plain = pick("plain", ["title", "name", "value", "path", "class", "label", "type", "key", "note", "source"])
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    uuid = F.concat_ws("-", hexed("u1", 8), hexed("u2", 4), hexed("u3", 4), hexed("u4", 4), hexed("u5", 12))
    set_, quote = pick("set", [" = ", "=", ": ", " := "]), pick("quote", ["\"", "`"])
    given = lambda of, v: F.when(F.pmod(F.xxhash64(drawn("given")), F.lit(3)) < 2, text(of, set_, quote, v, quote)).otherwise(text(of, set_, v))
    provider = F.element_at(F.array(text("AKIA", F.upper(letters("k1", 16))), text("ghp_", mixed("k2", 36)), text("sk_live_", mixed("k3", 24)), text("AIza", mixed("k4", 35)), text("xoxb-", number("k5", 12), "-", mixed("k6", 24))), between("k", 1, 5))
    mark = pick("mark", list("!@#$%^&*?+"))
    third = F.pmod(F.xxhash64(drawn("third")), F.lit(3))
    short = F.when(third == 0, text(letters("s1", 3), number("s2", 2), mark, mixed("s3", 5))).when(third == 1, F.lower(mixed("s4", between("s4", 8, 15)))).otherwise(mixed("s5", between("s5", 8, 15)))
    mixture, lettered = mixed("m", between("m", 16, 64)), letters("l", between("l", 18, 40))
    shouted = F.upper(hexed("h", 40))
    kinds: list[tuple] = [
        (True, lambda v: text(name, set_, v), provider), (True, lambda v: text("see ", v, " there"), provider), (True, lambda v: given(name, v), hexed("h", 40)),
        (True, lambda v: given(name, v), pick("hl", [32, 64]).cast("int")), (True, lambda v: given(name, v), mixture), (True, lambda v: given(name, v), lettered),
        (True, lambda v: given(name, v), short), (True, lambda v: text("postgres://", word("w1"), ":", v, "@", word("w2"), ".example.com/", word("w3")), F.when(F.pmod(F.xxhash64(drawn("side")), F.lit(3)) < 2, short).otherwise(mixture)),
        (True, lambda v: given(name, v), text(F.repeat(letters("r", 64), F.lit(6)), mixture)), (True, lambda v: text("\"", name, "\": \"", v, "\""), shouted),
        (True, lambda v: text(pick("c", ["the password is ", "secret was ", "with token ", "your password "]), quote, v, quote), F.when(third == 0, lettered).otherwise(mixture)),
        (False, lambda v: text(pick("c", ["fixed in commit ", "git checkout ", "reverts ", "merged as ", "rev ", "commit "]), v, " ", word("w1")), hexed("h", 40)),
        (False, lambda v: text(pick("c", ["sha256:", "sha256 ", "checksum = ", "digest: ", "etag: "]), v), hexed("h", 64)),
        (False, lambda v: text(pick("c", ["md5 ", "hash = \"", "md5: "]), v, "\""), hexed("h", 32)), (False, lambda v: given(pick("c", ["commit", "sha", "revision", "build", "etag", "image"]), v), hexed("h", 40)),
        (False, lambda v: text(pick("c", ["id ", "uuid = \"", "request ", ""]), v, "\" "), uuid), (False, lambda v: text(pick("c", ["card ", "account ", "", "order "]), v), number("d", 16)),
        (False, lambda v: given(plain, v), number("d", 14)), (False, lambda v: text("see ", v, ".log"), F.concat_ws("/", F.lit("/var"), word("w1"), F.when(third == 0, word("w2")).otherwise(F.lower(letters("p", between("p", 4, 12)))), text("part-", number("d", 5)))),
        (False, lambda v: given(plain, v), F.concat_ws("_", word("w1"), word("w2"), word("w3"))), (False, lambda v: given(plain, v), text(word("w1"), F.initcap(word("w2")), F.initcap(word("w3")), number("d", 2))),
        (False, lambda v: given(name, v), F.concat_ws("_", F.lit("your"), word("w1"), F.lit("here"))), (False, lambda v: given(name, v), pick("c", ["changeme", "required", "undefined", "xxxxxxxx", "********", "placeholder"])),
        (False, lambda v: text("data:image/png;base64,", v), text(mixture, mixed("m2", 80))), (False, lambda v: text(v, " ", word("w3")), F.upper(F.concat(word("w1"), word("w2"), word("w4"), word("w5")))),
        (False, lambda v: text("at: ", v), text("20", number("d", 2), "-01-", number("d2", 2), "T10:20:", number("d3", 2))), (False, lambda v: text(word("w4"), " ", v, " ", word("w5")), hexed("h", 40)),
        (False, lambda v: text("he said \"", v, "\" ", word("w2")), pick("c", [w for w in words if len(w) > 7] or ["something"])), (False, lambda v: text("note: ", v), F.concat(word("w1"), word("w2"))),
        (False, lambda v: text("https://", word("w1"), ".example.com:", number("d", 4), "/", v), F.concat_ws("-", word("w2"), word("w3"), number("d2", 4))),
        (False, lambda v: text("the ", v, " of ", word("w2")), F.concat_ws("-", F.lower(letters("p", between("p", 4, 9))), number("d", 4), F.lower(letters("p2", 5)))),
        (False, lambda v: text(pick("c", ["version ", "id ", "build "]), v, " end"), F.concat_ws("-", hexed("h", 10), number("d", 6))),
    ]
    around = lambda body: text(word("a1"), " ", word("a2"), pick("a3", [" ", "\n", ". "]), body, pick("a4", [" ", "\n", ". "]), word("a5"))
    made = []
    for i, (is_secret, write, value) in enumerate(kinds):
        v = hexed("h", value) if i == 3 else value
        made.append(spark.range(i, n, len(kinds), 1).select("id", F.lit(i).alias("kind"), around(write(v)).alias("text"), (v if is_secret else F.lit(None).cast("string")).alias("secret")))
    return durable(reduce(DataFrame.union, made).coalesce(4))


def label_by_content(made: DataFrame) -> DataFrame:
    """The findings (value, left, right, features) in examples(), label 1 for those that are the secret."""
    rows = with_candidates(made).select("row.secret", F.explode_outer("cands").alias("c")).where("c is not null")
    return rows.select("c.*", F.coalesce(F.col("c.value") == F.col("secret"), F.lit(False)).cast("double").alias("label"))


def label_by_format(found: DataFrame) -> DataFrame:
    """Labels a table's own findings (value, left, right): 1 for a provider's published key format, or for
    sixteen or more letters and digits that are assigned to a name like `password`; else 0."""
    v = F.col("value")
    assigned = F.col("left").rlike(_NAMES) & F.col("left").rlike(r"[=:]\s*[\"'`]?$") & (F.length(v) >= 16) & v.rlike("[A-Za-z]")
    return found.withColumn("label", (v.rlike(_FORMATS) | assigned).cast("double"))


def train(found: DataFrame, limit: int = LABELLED, trees: int = TREES, depth: int = DEPTH) -> list[str]:
    """The forest's trees as text, from findings (value, features, label), at most `limit` of them.

    Positives are all taken, or as many as half the limit or as negatives leave room for; negatives fill the rest, each
    in hash order. Where positives are few, they weigh as much together as RARE of the sample. One tree that always says
    the same if the labels are all alike; no without findings.
    """
    none = F.lit("")
    names = list(_features(F.struct(none.alias("value"), none.alias("left"), none.alias("right")), F.array(none), F.array(F.lit(0.0))))
    order = [F.xxhash64("value", "features"), F.col("value")]
    one, other = (durable(found.where(F.col("label") == k).orderBy(*order).limit(limit).select("value", "features", "label")) for k in (1.0, 0.0))
    n_one, n_other = one.count(), other.count()
    if not n_one or not n_other:
        return [f"Predict: {float(n_one > 0)}"]
    n_one = min(n_one, max(limit // 2, limit - n_other))
    n_other = min(n_other, limit - n_one)
    picked = one.orderBy(*order).limit(n_one).union(other.orderBy(*order).limit(n_other)).select("features", "label")
    weight = F.when(F.col("label") == 1, max(1.0, RARE / (1 - RARE) * n_other / n_one)).otherwise(1.0)
    wide = picked.select("label", weight.alias("weight"), *[F.col("features")[i].alias(n) for i, n in enumerate(names)])
    rows = VectorAssembler(inputCols=names, outputCol="vector").transform(wide)
    model = RandomForestClassifier(featuresCol="vector", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=1, featureSubsetStrategy="onethird").fit(rows)
    return [x.split("\n", 1)[1] for x in re.split(r"\n\s*Tree \d+", "\n" + model.toDebugString)[1:]]


_forests: dict[str, list[str]] = {}


def forest(spark: SparkSession) -> list[str]:
    """The trees trained on examples(), once in an application: they depend on no table."""
    key = spark.sparkContext.applicationId
    if key not in _forests:
        _forests[key] = train(label_by_content(examples(spark)))
    return _forests[key]


def _tree(lines: list[str], features: Column) -> Column:
    """One tree of pyspark.ml's toDebugString as a Column; takes its lines off the front."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return F.lit(float(line.split(":")[1]))
    m = re.match(r"If \(feature (\d+) <= ([-\d.Ee]+)\)", line)
    low = _tree(lines, features)
    lines.pop(0)
    return F.when(features[int(m[1])] <= float(m[2]), low).otherwise(_tree(lines, features))


def vote(trees: list[str], features: Column) -> Column:
    """The share of trees that say yes."""
    votes = [_tree([x for x in t.split("\n") if re.match(r"\s*(If|Else|Predict)", x)], features) for t in trees]
    return reduce(lambda a, b: a + b, votes) / len(votes)


def scored(docs: DataFrame, trees: list[str] | None = None) -> DataFrame:
    """(row, gaps, cands) with a score in each candidate; trees are trained on examples() if not given."""
    rows = with_candidates(docs)
    trees = forest(docs.sparkSession) if trees is None else trees
    return rows.withColumn("cands", F.transform("cands", lambda c: F.struct(c["value"].alias("value"), c["start"].alias("start"), vote(trees, c["features"]).alias("score"))))


def scan(docs: DataFrame, least: float = 0.5, trees: list[str] | None = None) -> DataFrame:
    """One row per secret: doc_id, start (code points from 0), length, secret, score (share of trees).

    Null and empty texts have none; repeated rows give their secrets each; other columns are not read.
    """
    rows = scored(docs.select("doc_id", "text"), trees)
    found = rows.select("row.doc_id", F.explode_outer("cands").alias("c")).where(F.col("c.score") >= least)
    return found.select("doc_id", F.col("c.start").alias("start"), F.length("c.value").alias("length"), F.col("c.value").alias("secret"), F.col("c.score").alias("score"))


def redact(docs: DataFrame, least: float = 0.5, trees: list[str] | None = None) -> DataFrame:
    """All documents, all columns; secrets in text are replaced by [SECRET], and n_chars follows where there is one."""
    rows = scored(docs, trees)
    tail = F.transform("cands", lambda c, i: F.concat(F.when(c["score"] >= least, F.lit(MASK)).otherwise(c["value"]), F.element_at("gaps", i + 2)))
    clean = F.concat(F.element_at("gaps", 1), F.array_join(tail, ""))
    text = F.when(F.exists("cands", lambda c: c["score"] >= least), clean).otherwise(F.col("row.text"))
    fixed = rows.select("row", text.alias("text"))
    out = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("text").eqNullSafe(F.col("row.text")), F.col("row.n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return fixed.select(*[x.alias(c) for c, x in out.items()])


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of scan() in all documents; see there for nulls, empty texts and repeats."""
    return scan(table(spark, sf_dir, "documents"))

"""Scanning for secrets, with a random forest that removes false positives. DataFrame functions only.

A candidate is a run of 16 characters of keys or more (letters, digits, ``+ / _ -``) in a word; and, where a naming word with ``=`` or
``:`` stands before it in its word, or is the word before, a value of 6 characters or more of any kind but quotes, brackets, commas
and semicolons. Its features are its length,
the share of transitions between character classes, of digits, of capitals and of distinct characters, the share that a
dictionary covers, whether it stands in a path or an address, and whether the word itself or its neighbours
name a secret or something harmless. The dictionary is a list of words, of which the letter triples count that most of its words are
made of; by default it is the vocabulary of a public tokenizer, read from its file. The forest is trained from labelled findings; trees are then written as nested
conditions, so that candidates are scored inside the row of their document and no text is shuffled.

Labelled findings can be given; without, ``labelled_findings`` makes them from forms of secrets and of harmless runs.

Edge cases: a null or empty text has no findings; all candidates of a very long text are taken; equal secrets are found at
each place; repeated rows have findings each; a null doc_id stays null; an empty table gives an empty result; extra columns
are not read, and are kept by ``redact``.
"""

from __future__ import annotations

import random
import re
import string
import uuid
from collections import Counter
from functools import cache

import public_tokenizers
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import fresh
from .quality import split_words

RUN = "([A-Za-z0-9+/_-]{16,})"
SHORTEST = 16
NAMES = r"(?i)key|token|secret|passw|pwd|credential|auth|bearer|private"
VALUE = r"""[^\x22'`,;()\[\]{}<>]{6,}"""
#: A value behind its name in one word, and a name that says that a value comes.
NAMED = rf"""(?i)(?:key|token|secret|passw(?:or)?d|passwd|pwd|credentials?|auth)[\x22'`]?(?::=|=>|=|:)[\x22'`]?({VALUE})"""
NAMING = r"(?i)(?:key|token|secret|passw(?:or)?d|passwd|pwd|credentials?|auth)[\x22'`]?(?::=|=>|=|:)$"
#: Share of the dictionary's letter triples, the most frequent first, that count.
COMMON = 0.9
HARMLESS = r"(?i)example|sample|dummy|placeholder|changeme|sha-?\d|md5|digest|checksum|commit|revision|uuid|etag|integrity|build"
PATH = r"(?i)://|\.(com|org|net|html?|png|jpe?g|css|js)\b|\w/\w+/\w"
#: Word parts that the labelled findings are made of.
PARTS = (
    "tion ing ent ver sch ich ein ung heit keit lich eau aux que ment elle oire ción aci idad mente ado ero the and her ere "
    "ion ter est ers ati hat ate all eth hes ith ted hou der den gen nde ine und die der das les des une pas con que los las "
    "user name file data test page index image config default value string number system server client home"
).split()
FEATURES = ["length", "transitions", "digits", "capitals", "distinct", "dictionary", "path", "named", "harmless"]
FOUND = "array<struct<word_index:bigint,secret:string,score:double>>"


@cache
def dictionary(path: str = public_tokenizers.path("word_bpe_49k.json")) -> tuple[str, ...]:
    """The words of three letters or more, a to z, of a tokenizer's vocabulary."""
    from tokenizers import Tokenizer

    words = {re.sub("[^a-z]", "", w.lower()) for w in Tokenizer.from_file(path).get_vocab() if re.fullmatch("[^A-Za-z0-9]*[A-Za-z]{3,}[^A-Za-z0-9]*", w)}
    return tuple(sorted(w for w in words if len(w) >= 3))


@cache
def triples(words: tuple[str, ...]) -> str:
    """A 1 for each letter triple, in order of the alphabet, that is among the most frequent ones of the words; else a 0."""
    counts = Counter(w[i : i + 3] for w in words for i in range(len(w) - 2))
    kept, left = set(), COMMON * sum(counts.values())
    for triple, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        if left <= 0:
            break
        kept.add(triple)
        left -= n
    letters = string.ascii_lowercase
    return "".join("1" if a + b + c in kept else "0" for a in letters for b in letters for c in letters)


def covered(run: Column, table: str) -> Column:
    """The share of the run's letter triples (of its places, so digits count against it) that the table has."""
    lower = F.lower(run)
    letter = lambda i: F.ascii(F.substring(lower, i, F.lit(1))) - 97

    def known(i: Column) -> Column:
        a, b, c = letter(i), letter(i + 1), letter(i + 2)
        good = a.between(0, 25) & b.between(0, 25) & c.between(0, 25)
        return F.when(good, F.substring(F.lit(table), a * 676 + b * 26 + c + 1, F.lit(1)) == "1").otherwise(F.lit(False))

    n = F.length(run) - 2
    return F.when(n > 0, F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), known)) / n).otherwise(0.0)


def feature_columns(word: Column, run: Column, before2: Column, before: Column, after: Column) -> dict[str, Column]:
    """The features of a candidate, by name, as doubles."""
    n = F.length(run).cast("double")
    share = lambda pattern: F.length(F.regexp_replace(run, pattern, "")).cast("double") / n
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(run, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "9")
    around = F.concat_ws(" ", before2, before, F.replace(word, run, F.lit(" ")))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {
        "length": n,
        "transitions": F.length(classes).cast("double") / n,
        "digits": share("[^0-9]"),
        "capitals": share("[^A-Z]"),
        "distinct": F.size(F.array_distinct(F.split(run, ""))).cast("double") / n,
        "dictionary": covered(run, triples(dictionary())),
        "path": flag(word.rlike(PATH)),
        "named": flag(around.rlike(NAMES)),
        "harmless": flag(F.concat_ws(" ", around, after).rlike(HARMLESS)),
    }


def labelled_findings(n: int = 3000, seed: int = 10) -> list[tuple[str, str, str, str, str, float]]:
    """Rows of word, run, before2, before, after, label: half are secrets."""
    draw = random.Random(seed)
    hexes, plain = "0123456789abcdef", string.ascii_letters + string.digits
    some = lambda chars, k: "".join(draw.choice(chars) for _ in range(k))
    prose = lambda least: "".join(iter_parts(draw, least))
    talk = lambda: draw.choice(["the", "of", "and", "le", "de", "und", "ist", "per", "to", "", "que", "with", "see"])
    name = lambda: draw.choice(["key", "api_key", "token", "secret", "password", "passwd", "auth", "SECRET_KEY", "access-token", "private_key"])
    rows = []
    for _ in range(n // 2):
        body = draw.choice([
            lambda: some(hexes, draw.choice([20, 24, 32, 40, 48, 64])), lambda: some(plain, draw.randint(20, 48)),
            lambda: some(plain + "+/", draw.choice([40, 44, 64])), lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16),
            lambda: "ghp_" + some(plain, 36), lambda: "sk-" + some(plain, 32), lambda: "xoxb-" + some(string.digits, 12) + "-" + some(plain, 24),
        ])()
        short = draw.random() < 0.25
        if short:  # only where they are named
            body = draw.choice([
                lambda: some(plain, draw.randint(8, 15)), lambda: some(hexes, draw.randint(8, 15)),
                lambda: draw.choice([str.capitalize, str])(prose(4))[:8] + some(string.digits, draw.randint(1, 4)) + draw.choice(["", "!", "#", "$x"]),
                lambda: some(plain + "!@#$%^&*.?", draw.randint(8, 24)),
            ])()
        known = not short and body[:4] in ("AKIA", "ghp_", "xoxb") or not short and body[:3] == "sk-"
        shape = draw.randrange(4 if known else 3)
        if shape == 0:
            rows.append((f"{name()}={body}", body, talk(), talk(), talk(), 1.0))
        elif shape == 1:
            quote = draw.choice(['"', "'", ""])
            rows.append((f"{quote}{body}{quote}", body, name(), draw.choice(["=", ":", ":="]), talk(), 1.0))
        elif shape == 2:
            rows.append((body, body, talk(), f"{name()}:", talk(), 1.0))
        else:
            rows.append((body + draw.choice(["", ".", ","]), body, talk(), talk(), talk(), 1.0))
        word = draw.choice([
            lambda: prose(16), lambda: prose(16).capitalize(), lambda: prose(16).upper(), lambda: f"{prose(5)}-{prose(5)}-{prose(5)}", lambda: f"{prose(6)}_{prose(6)}_{prose(6)}",
            lambda: f"/{prose(4)}/{prose(4)}/{prose(4)}/{some(hexes, 16)}", lambda: f"http://{prose(8)}.com/{prose(5)}/{some(hexes, 20)}",
            lambda: some(draw.choice(["=-", "-", "_", "0", "x", "ab"]), 24), lambda: some(string.digits, 16), lambda: str(uuid.UUID(int=draw.getrandbits(128))), lambda: some(hexes, draw.choice([32, 40, 64])),
        ])()
        if draw.random() < 0.3:  # what is named, but no secret
            value = draw.choice([lambda: prose(5)[:12], lambda: prose(6).capitalize(), lambda: draw.choice(["required", "optional", "changed", "example", "missing", "null-value", "string", "<hidden>"]), lambda: f"{prose(4)}-{prose(4)}", lambda: f"{prose(5)}."])()
            value = re.sub("[<>]", "", value)
            if len(value) >= 6:
                rows.append((f"{name()}{draw.choice('=:')}{value}", value, talk(), talk(), talk(), 0.0) if draw.random() < 0.5 else (value, value, talk(), f"{name()}:", talk(), 0.0))
            continue
        found = re.search(RUN, word)
        if not found:
            continue
        bare = re.fullmatch("[0-9a-f]{32,}", word) or word.count("-") == 4
        before = draw.choice(["commit", "sha256:", "md5:", "uuid", "checksum", "digest", "revision"]) if bare else draw.choice([talk(), talk(), talk(), name()])
        rows.append((word, found[1], talk(), before, talk(), 0.0))
    return rows


def iter_parts(draw: random.Random, least: int) -> list[str]:
    """Word parts of at least so many letters together, with a letter between some."""
    out: list[str] = []
    while sum(map(len, out)) < least:
        out.append(draw.choice([p for p in PARTS if p.isascii()]) if draw.random() < 0.7 else draw.choice(["a", "e", "o", "th", "er", "on", "an", "re", "he", "in", "ed", "st", "ch"]))
    return out


def train(findings: DataFrame, trees: int = 20, depth: int = 6, seed: int = 10) -> RandomForestClassificationModel:
    """findings: word, run, before2, before, after, label."""
    columns = feature_columns(*[F.col(c) for c in ("word", "run", "before2", "before", "after")])
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(findings.select("label", *[c.alias(k) for k, c in columns.items()]))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows.select("features", "label"))


def trees_of(model: RandomForestClassificationModel) -> list[tuple]:
    """Each tree as (feature, threshold, left, right), or a leaf's share of secrets as a float."""

    def walk(node: object) -> tuple | float:
        if node.subtreeDepth() == 0:
            stats = node.impurityStats()
            return float(stats.prob(1.0))
        split = node.split()
        return split.featureIndex(), float(split.threshold()), walk(node.leftChild()), walk(node.rightChild())

    return [walk(t.rootNode()) for t in model._java_obj.trees()]


def forest_score(trees: list[tuple], feature: dict[int, Column] | list[Column]) -> Column:
    """The mean of what the trees say of a candidate."""

    def say(node: tuple | float) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        k, threshold, left, right = node
        return F.when(feature[k] <= threshold, say(left)).otherwise(say(right))

    total = say(trees[0])
    for tree in trees[1:]:
        total = total + say(tree)
    return total / len(trees)


def default_forest(spark: SparkSession) -> list[tuple]:
    rows = spark.createDataFrame(labelled_findings(), "word string, run string, before2 string, before string, after string, label double")
    return trees_of(train(rows.coalesce(1)))


def with_findings(docs: DataFrame, text: str, name: str, trees: list[tuple]) -> DataFrame:
    """Adds the column name: for each candidate its word's place, the run and the score."""
    words, some_runs, some_made = fresh(docs, "__w", "__runs", "__made")
    w = F.col(words)
    word = lambda i: F.coalesce(F.get(w, i.cast("int")), F.lit(""))
    none = F.array().cast("array<string>")
    # few words go on from here: those with a run, and those with a sign that a value comes
    marked = F.filter(
        F.transform(words, lambda x, i: F.struct(i.cast("bigint").alias("i"), x.alias("x"))),
        lambda s: ((F.length(s["x"]) >= SHORTEST) & s["x"].rlike(RUN)) | F.contains(s["x"], F.lit("=")) | F.contains(s["x"], F.lit(":")),
    )

    def own(x: Column) -> Column:
        values, found = F.regexp_extract_all(x, F.lit(NAMED), F.lit(1)), F.regexp_extract_all(x, F.lit(RUN), F.lit(1))
        return F.when(F.size(values) > 0, values).otherwise(found)

    def after(s: Column) -> Column:
        """The value that comes as the next word, where that is not found by itself."""
        x, i = s["x"], s["i"]
        naming = x.rlike("[=:]$") & (x.rlike(NAMING) | (x.rlike("^(?::=|=>|=|:)$") & word(i - 1).rlike(NAMES)))
        return F.when(naming & (F.size(own(word(i + 1))) == 0), F.regexp_extract_all(word(i + 1), F.lit(f"({VALUE})"), F.lit(1))).otherwise(none)

    made_of = lambda found, i, x: F.transform(found, lambda r: F.struct(i.alias("i"), x.alias("x"), r.alias("r")))
    runs = F.flatten(F.transform(marked, lambda s: F.concat(made_of(own(s["x"]), s["i"], s["x"]), made_of(after(s), s["i"] + 1, word(s["i"] + 1)))))
    near = lambda s, k: F.coalesce(F.get(w, s["i"].cast("int") + k), F.lit(""))
    made = F.transform(some_runs, lambda s: F.struct(s["i"].alias("i"), s["r"].alias("r"), F.array(*feature_columns(s["x"], s["r"], near(s, -2), near(s, -1), near(s, 1)).values()).alias("f")))
    scored = F.transform(some_made, lambda s: F.struct(s["i"].alias("word_index"), s["r"].alias("secret"), forest_score(trees, [F.get(s["f"], k) for k in range(len(FEATURES))]).alias("score")))
    return (
        docs.withColumn(words, split_words(F.coalesce(F.col(text), F.lit(""))))
        .withColumn(some_runs, runs).withColumn(some_made, F.when(F.size(some_runs) > 0, made)).drop(some_runs, words)
        .withColumn(name, F.when(F.col(some_made).isNull(), F.array().cast(FOUND)).otherwise(scored.cast(FOUND))).drop(some_made)
    )


def scan(docs: DataFrame, trees: list[tuple], least: float = 0.5) -> DataFrame:
    """A row for each candidate in docs (doc_id, text): doc_id, word_index, secret, score, is_secret."""
    # explode would let Spark ask for the size of the array, and so evaluate the forest once more, in a filter below
    found = with_findings(docs.select("doc_id", "text"), "text", "__found", trees).select("doc_id", F.explode_outer("__found").alias("f"))
    return found.where("f is not null").select("doc_id", "f.*").withColumn("is_secret", F.col("score") >= least)


def redact(docs: DataFrame, trees: list[tuple], least: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret in text replaced; n_chars follows, where docs has it."""
    found, kept = fresh(docs, "__found", "__secrets")
    rows = with_findings(docs, "text", found, trees)
    secrets = F.array_distinct(F.transform(F.filter(found, lambda s: s["score"] >= least), lambda s: s["secret"]))
    longest = F.array_sort(secrets, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0))
    rows = rows.withColumn(kept, longest).drop(found)
    rows = rows.withColumn("text", F.aggregate(kept, F.col("text"), lambda t, s: F.replace(t, s, F.lit(mark))))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size(kept) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)

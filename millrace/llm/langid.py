"""Language identification with a string kernel.

The kernel is the blended spectrum over n-gram presence: for n = 1, 2, 3 the share of n-grams that two texts have in common,
|A and B| / sqrt(|A| |B|), averaged. n-grams are of lower-case letters, where all between two words counts as one space, and
they are hashed into ``DIMS`` places for each n. Landmarks are ``LANDMARKS`` passages of labelled texts; with the kernel among
them, K, a passage x is represented by K(x, landmarks) K^(-1/2) (Nyström), and a kernel ridge regression of each language
against the rest is fitted there. A text is cut into passages, which are scored in batches by two matrix products; their
scores are averaged by length, over the whole text.

The classifier is fitted on a bounded sample: for each language the ``per_lang`` labelled texts that come first by a hash of
doc_id, those of MIN_CHARS to MAX_CHARS characters before shorter and longer ones, and MOST_SAMPLES in all. The model, some MB
whatever the corpus, is broadcast.

A text in none of the languages gets a label too, unless ``reject`` is asked for: then it is ``und`` with score 0. It must be as
much like what was learned as held-out labelled texts of its length are: in its largest kernel value to a landmark, and in
the margin between the first and the second language (if there are two). The bounds are EASE times what all but TAIL of the
held-out texts reach, cut to each of LENGTHS. Passages are judged one by one and averaged, and what fails is judged
again in passages of PIECE letters, so that a text in two learned languages stays. The bounds are low for texts of a line: those
in unlearned languages with the same letters stay there. With fewer than LEAST_HELD held-out texts there are no bounds.

Edge cases: a null text, or one without a letter, is ``und`` with score 0, as is every text if there is nothing to learn
from; rows with null lang are not learned from; repeated rows get a row each; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bound_batches, ship_code
from .common import key_hash
from .memo import own

#: Places for the n-grams of n = 1, 2, 3.
DIMS = (512, 2048, 8192)
STARTS = (0, 512, 2560)
TOTAL = sum(DIMS)
PASSAGE, BATCH = 2048, 64
LANDMARKS, RIDGE = 128, 0.1
MIN_CHARS, MAX_CHARS = 100, 10_000
#: Texts that are learned from, in all languages together (MAX_CHARS characters at most each).
MOST_SAMPLES = 6000
#: Sets that the scan tasks are dealt to where the first texts of a language are looked for.
PARTS = 64
UNKNOWN = "und"
#: For rejection: every HELD-th sample is held out.
HELD, LEAST_HELD, TAIL, EASE, PIECE = 5, 8, 0.01, 0.7, 320
LENGTHS = (10, 20, 40, 80, 160, 320, 640, 1280, 2048)


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def clean(text: str) -> np.ndarray:
    """The code points of the lower-case letters, with one space for all that stands between words."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    points = np.where(letters()[points], points, 32)
    keep = points != 32
    keep[1:] |= points[:-1] != 32
    return points[keep]


def passages(points: np.ndarray, size: int = PASSAGE) -> list[np.ndarray]:
    """Runs of about size points; a last one of under half that length joins the one before."""
    n = max(1, round(len(points) / size))
    return [p for p in np.array_split(points, n) if (p != 32).any()]


def places(points: np.ndarray) -> np.ndarray:
    """Where the presence of a passage's n-grams is noted."""
    a = points.astype(np.uint32)
    one, two, three = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
    h1 = a * one
    h2 = h1[:-1] ^ (a[1:] * two)
    h3 = h2[:-1] ^ (a[2:] * three)

    def spread(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint32(15))) * two
        h = (h ^ (h >> np.uint32(13))) * three
        return h ^ (h >> np.uint32(16))

    return np.concatenate([(spread(h) >> np.uint32(33 - d.bit_length())).astype(np.int32) + s for h, d, s in zip((h1, h2, h3), DIMS, STARTS, strict=True)])


def features(parts: list[np.ndarray]) -> np.ndarray:
    """Rows whose scalar products are the kernel."""
    out = np.zeros((len(parts), TOTAL), np.float32)
    for row, part in zip(out, parts, strict=True):
        row[places(part)] = 1
    for start, d in zip(STARTS, DIMS, strict=True):
        block = out[:, start : start + d]
        block /= np.sqrt(len(DIMS) * np.maximum(1, block.sum(1, keepdims=True)))
    return out


def fit(samples: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """samples: (lang, text). The languages, the landmarks' features, and what their kernel values are multiplied with."""
    of: dict[str, list[np.ndarray]] = {}
    for lang, text in samples:
        of.setdefault(lang, []).extend(passages(clean(text)))
    langs = sorted(k for k, v in of.items() if v)
    if not langs:
        return None
    each = -(-landmarks // len(langs))
    marks = features([p for k in langs for p in of[k][:each]])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    parts = [p for k in langs for p in of[k]]
    y = np.concatenate([np.where(np.arange(len(langs)) == i, 1.0, -1.0)[None].repeat(len(of[k]), 0) for i, k in enumerate(langs)])
    z = np.concatenate([features(parts[i : i + BATCH]) @ marks.T for i in range(0, len(parts), BATCH)]) @ root
    solved = np.linalg.solve(z.T @ z + ridge * np.eye(z.shape[1]), z.T @ y)
    return langs, marks, (root @ solved).astype(np.float32)


Model = tuple[list[str], np.ndarray, np.ndarray]


def score(texts: list[str | None], model: Model | None, least: np.ndarray | None = None) -> list[tuple[str, float]]:
    """The language of each text and its score. least: texts that are not like what was learned are UNKNOWN with score 0."""
    if model is None:
        return [(UNKNOWN, 0.0)] * len(texts)
    langs = model[0]
    sums, sizes = np.zeros((len(texts), len(langs))), np.zeros(len(texts))
    found, wanted = np.zeros((len(texts), 2)), np.zeros((len(texts), 2))
    waiting: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        if waiting:
            owners, parts = list(map(list, zip(*waiting, strict=True)))
            lengths = np.array([len(p) for p in parts], float)
            near, said = judged(parts, model)
            np.add.at(sums, owners, said * lengths[:, None])
            np.add.at(sizes, owners, lengths)
            if least is not None:
                np.add.at(found, owners, evidence(near, said) * lengths[:, None])
                np.add.at(wanted, owners, bound_for(lengths, least) * lengths[:, None])
            waiting.clear()

    for i, text in enumerate(texts):
        for part in passages(clean(text or "")):
            waiting.append((i, part))
            if len(waiting) == BATCH:
                flush()
    flush()
    mean = sums / np.maximum(sizes, 1)[:, None]
    known = (found >= wanted).all(1)
    out = []
    for m, k, n, fits, text in zip(mean, mean.argmax(1), sizes, known, texts, strict=True):
        good = n and (fits or in_pieces(text, model, least))
        out.append((langs[k], float(min(1, max(0, (m[k] + 1) / 2)))) if good else (UNKNOWN, 0.0))
    return out


def judged(parts: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Two matrix products: the passages' kernel values to the landmarks, and what the languages' regressions say."""
    near = features(parts) @ model[1].T
    return near, near @ model[2]


def evidence(near: np.ndarray, said: np.ndarray) -> np.ndarray:
    """For each passage: its largest kernel value to a landmark, and the margin of its language."""
    order = np.sort(said, 1)
    return np.stack([near.max(1), order[:, -1] - order[:, -2] if said.shape[1] > 1 else np.full(len(said), 1e9)], 1)


def bound_for(lengths: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The least evidence that passages of these lengths must give."""
    at, known = np.log(lengths), np.log(least[:, 0])
    return np.stack([np.interp(at, known, np.minimum(least[:, k], 1e9)) for k in (1, 2)], 1)


def in_pieces(text: str, model: Model, least: np.ndarray) -> bool:
    """Whether a text is like what was learned if it is judged in shorter passages."""
    parts = passages(clean(text), PIECE)
    lengths = np.array([len(p) for p in parts], float)
    found = np.concatenate([evidence(*judged(parts[i : i + BATCH], model)) for i in range(0, len(parts), BATCH)])
    return bool((lengths @ found >= lengths @ bound_for(lengths, least)).all())


def bounds(samples: list[tuple[str, str]]) -> np.ndarray | None:
    """Rows of letters, least kernel value, least margin: from a model of the samples that are not held out."""
    held = samples[::HELD]
    model = fit([x for i, x in enumerate(samples) if i % HELD])
    if model is None or len(held) < LEAST_HELD:
        return None
    texts = [(lang, clean(text)) for lang, text in held if lang in model[0]]
    rows = []
    for n in LENGTHS:
        of, parts = zip(*[(model[0].index(k), p[:n]) for k, p in texts if len(p) >= n] or [(0, np.zeros(0, np.uint32))], strict=True)
        if len(parts) >= LEAST_HELD:
            pairs = [judged(list(parts[i : i + BATCH]), model) for i in range(0, len(parts), BATCH)]
            near, said = (np.concatenate(x) for x in zip(*pairs, strict=True))
            right = evidence(near, said)[said.argmax(1) == np.array(of)]
            if len(right) >= LEAST_HELD:
                rows.append((n, *(EASE * np.quantile(right, TAIL, axis=0, method="lower"))))
    return np.array(rows) if rows else None


def sample(docs: DataFrame, per_lang: int) -> list[tuple[str, str]]:
    """docs: doc_id, text, lang. The first texts of each language by hash, those of MIN_CHARS to MAX_CHARS characters before others;
    of a longer one MAX_CHARS characters from its middle. MOST_SAMPLES texts in all: with more languages each gets fewer."""
    letters_in = F.length(F.trim("text")) > 0
    slim = docs.where(F.col("lang").isNotNull() & letters_in).select("lang", "doc_id", key_hash(F.col("doc_id"), seed=8).alias("h"), F.length("text").alias("n"))
    slim = slim.withColumn("odd", ~F.col("n").between(MIN_CHARS, MAX_CHARS))
    langs = slim.select("lang").distinct().limit(MOST_SAMPLES + 1).count()
    if langs > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} languages")
    each = max(1, min(per_lang, MOST_SAMPLES // max(1, langs)))
    # the first of each set of scan tasks, then the first of all: no task gets more than its share of a common language
    ids = slim.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    for by in (["lang", "part"], ["lang"]):
        first = Window.partitionBy(*by).orderBy("odd", "h", "doc_id", "n")
        ids = ids.withColumn("k", F.row_number().over(first)).where(F.col("k") <= each)
    ids = ids.select("lang", "doc_id", "h", "n").distinct()
    start = F.greatest(F.lit(0), F.floor((F.length("text") - MAX_CHARS) / 2).cast("int")) + 1
    rows = docs.select("doc_id", "lang", F.length("text").alias("n"), F.substring("text", start, F.lit(MAX_CHARS)).alias("text"))
    rows = rows.join(F.broadcast(ids), ["doc_id", "lang", "n"])  # MOST_SAMPLES rows at most
    return sorted({(r["h"], r["lang"], r["text"]) for r in rows.collect()})


def identify(docs: DataFrame, train: DataFrame, per_lang: int = 300, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score"), reject: bool = False) -> DataFrame:
    """Adds the language and its score, under these names, to docs (text, and the columns in keep: doc_id unless given).

    train: doc_id, text, lang. reject: a text that is not like what was learned is UNKNOWN with score 0. Raises if a column in keep has the
    name of a result.
    """
    ship_code(docs.sparkSession)
    bound_batches(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    clash = [c for c in keep if c.lower() in {n.lower() for n in names}]
    if clash or names[0].lower() == names[1].lower():
        raise ValueError(f"columns {clash or list(names)} have the names of the results: choose other names")
    sent = keep if "text" in keep else [*keep, "text"]
    at_text = sent.index("text")
    samples = [(lang, text) for _, lang, text in sample(train, per_lang)]
    model = docs.sparkSession.sparkContext.broadcast(fit(samples))
    least = bounds(samples) if reject else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("langid")
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = part.column(at_text).to_pylist()
                found = score(texts, model.value, least)
                added = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *added], names=[*keep, *names])

    fields: Callable[[str], str] = lambda c: f"`{c}` {docs.schema[c].dataType.simpleString()}"
    schema = ", ".join([*map(fields, keep), f"`{names[0]}` string", f"`{names[1]}` double"])
    return docs.select(*sent).mapInArrow(run, schema)

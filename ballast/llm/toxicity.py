"""Toxicity by a counterfactual-regularised classifier over words.

A logistic regression on which words and word beginnings a text holds once, twice or more often; beginnings catch
inflected forms. Its vocabulary is the features that tell the classes of the training rows apart best, and all identity
terms. For each training sentence with an identity term, counterfactuals are made in
which the term is swapped for the others of its group, and the squared difference of the whole text's two scores is
added to the loss, over all features that the swap changes: words, their beginnings and levels of both. What a group's
name adds to a score is held near what the other names of its group add, as neutral mentions look toxic otherwise where
the training rows happen to hold them.

Training reads at most ``max_rows`` labelled rows (those with the smallest hash of their id); the driver gets only the
vocabulary and, for each such row, the places of its words in it. Scoring reads every whole text where it lies.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from ballast.llm.labelled import held_out, training_labels
from ballast.llm.texts import annotate
from ballast.session import written

FOLDS, HELD_OUT = 5, 0
MAX_ROWS = 6000
VOCABULARY = 768
MIN_DOCS = 5
PENALTY = 4.0
# Chosen on folds 1 to 4 of the labelled rows, each left out in turn; the held-out fold took no part.
RIDGE = 5e-5
STEPS = 400
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SENTENCE = re.compile(r"[.!?\n]+")

# Identity terms by group; within a group each may stand for the others.
IDENTITIES = [
    ["men", "women"],
    ["man", "woman"],
    ["male", "female"],
    ["boys", "girls"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "catholic", "atheist"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "catholics", "atheists"],
    ["gay", "straight", "lesbian", "bisexual", "queer"],
    ["transgender", "cisgender"],
    ["black", "white", "asian", "latino", "hispanic", "arab"],
    ["african", "european", "american", "mexican", "chinese", "indian"],
    ["immigrants", "natives", "refugees"],
    ["old", "young"],
    ["deaf", "blind", "disabled"],
]

RESULT = StructType(
    [
        StructField("held_out", BooleanType()),
        StructField("score", DoubleType()),
        StructField("predicted", IntegerType()),
    ]
)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


PREFIXES = (4, 5, 6, 7)
LEVELS = (1, 2, 4)


def forms(word: str) -> list[str]:
    """The word and its beginnings, as names of features."""
    return [word, *[f"{word[:n]}-" for n in PREFIXES if len(word) > n]]


def form_counts(words: list[str]) -> Counter[str]:
    counts: Counter[str] = Counter()
    for word, n in Counter(words).items():
        for form in forms(word):
            counts[form] += n
    return counts


def reached(counts: dict[str, int]) -> list[str]:
    """Names of features: each form, and again for each further level its count reaches."""
    return sorted(f if level == 1 else f"{f}*{level}" for f, n in counts.items() for level in LEVELS if n >= level)


def features_of(text: str) -> list[str]:
    """Names of what a text holds."""
    return reached(form_counts(words_of(text)))


class Scorer:
    """The summed weight of a text's features, looking only at forms that the vocabulary knows."""

    def __init__(self, weights: dict[str, float], intercept: float):
        self.intercept = intercept
        self.of: dict[str, list[tuple[int, float]]] = {}
        for name, w in sorted(weights.items()):
            form, _, level = name.partition("*")
            self.of.setdefault(form, []).append((int(level or 1), w))
        self.seen: dict[str, tuple[str, ...]] = {}

    def _known(self, word: str) -> tuple[str, ...]:
        if len(self.seen) > 200_000:
            self.seen.clear()
        known = self.seen[word] = tuple(f for f in forms(word) if f in self.of)
        return known

    def __call__(self, text: str) -> float:
        counts: dict[str, int] = {}
        seen = self.seen
        for word, n in Counter(words_of(text)).items():
            known = seen.get(word)
            if known is None:
                known = self._known(word)
            for form in known:
                counts[form] = counts.get(form, 0) + n
        return self.intercept + sum(w for f in sorted(counts) for level, w in self.of[f] if counts[f] >= level)


def vocabulary(rows: DataFrame, size: int = VOCABULARY, min_docs: int = MIN_DOCS) -> list[str]:
    """Features of ``rows`` (y, words: distinct) whose shares differ most between the classes, by a chi-square."""
    total = rows.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
    n, p = float(total.n or 0), float(total.p or 0)
    if not n:
        return []
    per = rows.select("y", F.explode("words").alias("word")).groupBy("word")
    per = per.agg(F.count("*").alias("d"), F.sum("y").alias("t")).where(F.col("d") >= min_docs)
    off = F.col("t") - F.col("d") * (p / n)
    per = per.withColumn("gain", off * off / (F.col("d") * (1 - F.col("d") / (n + 1))))
    return [r.word for r in per.orderBy(F.desc("gain"), "word").limit(size).collect()]


def counterfactuals(sentences: list[list[str]]) -> list[tuple[str, str]]:
    """(term, other term) of every swap in these sentences."""
    group = {t: g for g in IDENTITIES for t in g}
    return [(w, o) for s in sentences for w in s if w in group for o in group[w] if o != w]


def changes(text: str) -> list[tuple[list[str], list[str]]]:
    """(features left, features taken) of the text in each of its distinct counterfactuals.

    In one sentence a term is swapped wherever it stands; the rest of the text stays. As counts change for forms of the
    two terms only, so do features.
    """
    sentences = [words_of(s) for s in SENTENCE.split(text)]
    held = None
    out = {}
    for sentence in sentences:
        for term, other in dict.fromkeys(counterfactuals([sentence])):
            held = form_counts(words_of(text)) if held is None else held
            n = sentence.count(term)
            before = {f: held[f] for f in (*forms(term), *forms(other))}
            after = dict(before)
            for f in forms(term):
                after[f] -= n
            for f in forms(other):
                after[f] += n
            had, has = set(reached(before)), set(reached(after))
            out[term, other, *sorted(had - has), "", *sorted(has - had)] = (sorted(had - has), sorted(has - had))
    return list(out.values())


def train(
    rows: list[tuple[list[int], float]], swaps: list[tuple], size: int, penalty: float = PENALTY
) -> tuple[np.ndarray, float]:
    """Weights and intercept. ``rows``: a text's word places and its label; ``swaps``: (row, places left, places taken),
    where a single place may stand for a list of one."""
    x = np.zeros((len(rows), size), dtype=np.float32)
    for i, (places, _) in enumerate(rows):
        x[i, places] = 1.0
    y = np.array([r[1] for r in rows], dtype=np.float64)
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    w, b = np.zeros(size), float(np.log(rate / (1 - rate)))
    if not len(rows):
        return w, b
    row = np.array([s[0] for s in swaps], dtype=np.int64)
    moves = [(i, p, sign) for i, s in enumerate(swaps) for sign, ps in ((-1.0, s[1]), (1.0, s[2])) for p in np.atleast_1d(ps)]
    swap, place, sign = (np.array(c, dtype=t) for c, t in zip(zip(*moves) if moves else ((),) * 3, (np.int64, np.int64, np.float64)))
    n, pairs = len(rows), max(len(row), 1)
    speed_w, speed_b = np.zeros(size), 0.0
    mean_w, mean_b = np.zeros(size), 0.0
    for step in range(1, STEPS + 1):
        z = x @ w.astype(np.float32) + b
        s = 1 / (1 + np.exp(-z.astype(np.float64)))
        off = (s - y) / n
        grad_w, grad_b = x.T @ off.astype(np.float32) + 2 * RIDGE * w, off.sum()
        if len(row):
            moved = np.bincount(swap, weights=sign * w[place], minlength=len(row))
            other = 1 / (1 + np.exp(-(z[row] + moved)))
            gap = 2 * penalty * (s[row] - other) / pairs
            here, there = gap * s[row] * (1 - s[row]), -gap * other * (1 - other)
            both = np.bincount(row, weights=here + there, minlength=n)
            grad_w = grad_w + x.T @ both.astype(np.float32)
            grad_w = grad_w + np.bincount(place, weights=sign * there[swap], minlength=size)
            grad_b += both.sum()
        mean_w, mean_b = 0.9 * mean_w + 0.1 * grad_w, 0.9 * mean_b + 0.1 * grad_b
        speed_w, speed_b = 0.99 * speed_w + 0.01 * grad_w**2, 0.99 * speed_b + 0.01 * grad_b**2
        scale = np.sqrt(1 - 0.99**step) / (1 - 0.9**step) * 0.1
        w = w - scale * mean_w / (np.sqrt(speed_w) + 1e-8)
        b = b - scale * mean_b / (np.sqrt(speed_b) + 1e-8)
    return w, b


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    max_rows: int = MAX_ROWS, penalty: float = PENALTY,
) -> tuple[dict[str, float], float]:
    """A weight for each feature of the vocabulary, and the intercept. Texts that occur twice count once, with their mean label."""
    some = training_labels(labels, doc_id, label, FOLDS, HELD_OUT).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    found = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body")).join(some, "id")
    group = {t for g in IDENTITIES for t in g}

    def rows_of(batches):
        for batch in batches:
            bodies = batch.column("body").to_pylist()
            swaps = [[{"gone": gone, "new": new} for gone, new in changes(b)] for b in bodies]
            names = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("y"),
                    pa.array([features_of(b) for b in bodies], names),
                    pa.array(swaps, pa.list_(pa.struct([("gone", names), ("new", names)]))),
                ],
                names=["id", "y", "words", "swaps"],
            )

    found = found.groupBy("body").agg(F.min("id").alias("id"), F.avg("y").alias("y"))
    swapped = "array<struct<gone: array<string>, new: array<string>>>"
    rows = written(found.mapInArrow(rows_of, f"id {dict(found.dtypes)['id']}, y double, words array<string>, swaps {swapped}"))
    # A row can be longer than the vocabulary, and joins by id can repeat it: the bound holds for what is collected.
    known = list(dict.fromkeys([*vocabulary(rows.select("y", "words")), *sorted(group)]))
    place = {w: i for i, w in enumerate(known)}
    listed = F.array(*[F.lit(w) for w in known])
    # Features outside the vocabulary have no weight, so what a swap changes among them changes no score.
    known_only = lambda s: F.struct(*[F.array_intersect(s[c], listed).alias(c) for c in ("gone", "new")])
    got = rows.select("y", F.array_intersect("words", listed).alias("words"), F.transform("swaps", known_only).alias("swaps"))
    got = got.orderBy(F.xxhash64("words"), "y").limit(max_rows).collect()
    data = [([place[w] for w in r.words], r.y) for r in got]
    swaps = [(i, [place[f] for f in s.gone], [place[f] for f in s.new]) for i, r in enumerate(got) for s in r.swaps]
    w, b = train(data, swaps, len(known), penalty)
    return {k: float(v) for k, v in zip(known, w)}, float(b)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    max_rows: int = MAX_ROWS, penalty: float = PENALTY,
) -> DataFrame:
    """Adds ``held_out``, ``score`` (0 to 1, the higher the likelier toxic) and ``predicted``.

    Labels of the held-out fold are never read; without any label every score is one half. An empty text gets the
    score of a text without known words. A row without an id is not held out and cannot be labelled.
    """
    weights, intercept = fit(docs, labels, doc_id, text, label, max_rows, penalty)
    shared = docs.sparkSession.sparkContext.broadcast((weights, intercept))
    scorer: list[Scorer] = []

    def run(part: pa.RecordBatch) -> list[pa.Array]:
        if not scorer:
            scorer.append(Scorer(*shared.value))
        z = np.array([scorer[0](t) for t in pc.fill_null(part.column(text), "").to_pylist()])
        score = 1 / (1 + np.exp(-z))
        return [part.column("held_out"), pa.array(score, pa.float64()), pa.array(score >= 0.5).cast(pa.int32())]

    marked = docs.withColumn("held_out", held_out(F.col(doc_id), FOLDS, HELD_OUT))
    return annotate(marked, RESULT, text, run)

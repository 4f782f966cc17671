"""Quality by kernel ridge scores over document statistics.

Each text becomes a few statistics. Random Fourier features, cosines of random projections, approximate a Gaussian
kernel over the standardised statistics. Ridge regression on the features needs only the sums of their products with
each other and with the label: every partition sums its own, and the sums of all partitions meet in one aggregate. No
row is sampled. Isotonic regression on out-of-fold scores then turns scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructField, StructType

from ballast.llm.labelled import held_out, training_labels
from ballast.llm.texts import Words, annotate, flat, mix
from ballast.session import written

FOLDS, HELD_OUT = 3, 1
FEATURES = 128
RIDGE = 1e-3
BANDWIDTH = 2.0
SEED = 11
BINS = 2000

STATISTICS = [
    "log_bytes", "log_words", "mean_word", "sd_word", "upper", "digits", "marks", "blanks", "non_ascii", "distinct",
    "repeated_next", "longest_word", "line_length", "marks_per_word", "capital_words", "pipes", "short_words",
]
RESULT = StructType(
    [
        StructField("held_out", BooleanType()),
        StructField("score", DoubleType()),
        StructField("predicted", IntegerType()),
    ]
)


def statistics_of(part: pa.RecordBatch, text: str) -> np.ndarray:
    """A row of ``STATISTICS`` for each text; zeros for a text without characters."""
    data, begins = flat(part.column(text))
    n = part.num_rows
    size = np.diff(np.r_[begins, len(data)]) - 1
    words = Words(data, begins)

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.int64), begins) if n else np.zeros(0, np.int64)

    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    high = data >= 128
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    mark = ~(upper | digit | high | blank | ((data >= 97) & (data <= 122)))
    size1, count1 = np.maximum(size, 1), np.maximum(words.count, 1)
    length = (words.end - words.start).astype(np.float64)
    mean = np.bincount(words.row, weights=length, minlength=n) / count1
    square = np.bincount(words.row, weights=length**2, minlength=n) / count1
    _, firsts = np.unique(mix(words.hash, words.row.astype(np.uint64)), return_index=True)
    distinct = np.bincount(words.row[firsts], minlength=n)
    same = np.r_[False, (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])][: len(words.hash)]
    repeated = np.bincount(words.row[same], minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, words.row, length)
    lines = per_text(data == 10)
    capital = np.bincount(words.row[upper[words.end - 1]], minlength=n) if len(words.end) else np.zeros(n)
    short = np.bincount(words.row[length <= 2], minlength=n)
    marks = per_text(mark)
    out = np.stack(
        [
            np.log1p(size), np.log1p(words.count), mean, np.sqrt(np.maximum(square - mean**2, 0)),
            per_text(upper) / size1, per_text(digit) / size1, marks / size1, (per_text(blank) - 1) / size1,
            per_text(high) / size1, distinct / count1, repeated / count1, np.log1p(longest),
            np.log1p(size / np.maximum(lines, 1)), np.minimum(marks / count1, 20), capital / count1,
            per_text(data == 124) / count1, short / count1,
        ],
        axis=1,
    )
    return np.where((size > 0)[:, None], out, 0.0)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``stats``, an array of ``STATISTICS``."""

    def run(part: pa.RecordBatch) -> list[pa.Array]:
        rows = statistics_of(part, text)
        sizes = pa.array(np.arange(len(rows) + 1) * len(STATISTICS), pa.int32())
        return [pa.ListArray.from_arrays(sizes, pa.array(rows.reshape(-1), pa.float64()))]

    return annotate(docs, StructType([StructField("stats", ArrayType(DoubleType()))]), text, run)


class Features:
    """Random Fourier features of standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, size: int = FEATURES, bandwidth: float = BANDWIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        self.omega = rng.normal(size=(len(mean), size)) / bandwidth
        self.phase = rng.uniform(0, 2 * np.pi, size)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8) / np.sqrt(len(self.mean) / 4)
        z = np.sqrt(2.0 / len(self.phase)) * np.cos(x @ self.omega + self.phase)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)


def _stats(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(STATISTICS))


def normal_equations(rows: DataFrame, features: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each half of ``rows`` (half 0 or 1, y, stats): products of features, their products with y, and counts."""
    size = len(features.phase) + 1
    upper = np.triu_indices(size)
    cells = len(upper[0]) + size + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, cells))
        for batch in batches:
            z, y, half = features(_stats(batch)), batch.column("y").to_numpy(), batch.column("half").to_numpy()
            for h in (0, 1):
                own = half == h
                sums[h] += np.r_[(z[own].T @ z[own])[upper], z[own].T @ y[own], own.sum()]
        for h in (0, 1):
            if sums[h, -1]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(cells, h), pa.int32()), pa.array(np.arange(cells), pa.int32()), pa.array(sums[h])],
                    names=["half", "cell", "value"],
                )

    parts = rows.select("half", "y", "stats").mapInArrow(run, "half int, cell int, value double")
    total = np.zeros((2, cells))
    for r in parts.groupBy("half", "cell").agg(F.sum("value").alias("value")).collect():
        total[r.half, r.cell] = r.value
    gram = np.zeros((2, size, size))
    for h in (0, 1):
        gram[h][upper] = total[h, : len(upper[0])]
        gram[h] = gram[h] + gram[h].T - np.diag(np.diag(gram[h]))
    return gram, total[:, len(upper[0]) : -1], total[:, -1]


def solve(gram: np.ndarray, moment: np.ndarray, count: float, ridge: float = RIDGE) -> np.ndarray:
    size = len(moment)
    penalty = np.eye(size) * ridge * max(count, 1.0)
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(gram + penalty, moment)


def isotonic(weight: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The non-decreasing values closest to ``mean``, by pooling neighbours that are out of order."""
    pools: list[list[float]] = []
    for w, m in zip(weight.tolist(), mean.tolist()):
        pools.append([w, m, 1])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            w2, m2, n2 = pools.pop()
            w1, m1, n1 = pools.pop()
            pools.append([w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), n1 + n2])
    return np.repeat([p[1] for p in pools], [int(p[2]) for p in pools])


def _scored(rows: DataFrame, features: Features, weights: np.ndarray) -> DataFrame:
    """Add ``raw``: the ridge score by the weights of the row's ``model``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = weights[batch.column("model").to_numpy()]
            raw = np.einsum("ij,ij->i", features(_stats(batch)), own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw)], names=[*batch.schema.names, "raw"])

    return rows.mapInArrow(run, StructType([*rows.schema, StructField("raw", DoubleType())]))


def score_quality(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
) -> DataFrame:
    """Adds ``held_out``, ``score`` (0 to 1, the higher the likelier good) and ``predicted``, and drops the text.

    The input's other columns come back whatever they are called, but for those of these three names. Labels of the
    held-out fold are never read; without any label every score is one half. An empty text has
    statistics of zero and is scored like any other. Rows sharing a labelled id are all trained on. A very long
    text is read whole, in a batch of its own.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (text, "held_out", "score", "predicted")])
    fold = held_out(F.col(doc_id), FOLDS, HELD_OUT)
    marked = docs.select(own.alias("own"), fold.alias("held_out"), F.col(doc_id).alias("id"), F.col(text).alias("body"))
    stats = written(with_statistics(marked, "body").drop("body"))
    known = training_labels(labels, doc_id, label, FOLDS, HELD_OUT)
    half = F.pmod(F.xxhash64("id"), F.lit(2)).cast("int")
    train = stats.join(known, "id").select(half.alias("half"), "y", "stats")
    train = written(train)

    at = [F.col("stats")[i] for i in range(len(STATISTICS))]
    moments = train.agg(F.count("*"), *[F.avg(c) for c in at], *[F.stddev_pop(c) for c in at]).first()
    m = len(STATISTICS)
    if not moments[0]:
        return stats.select("own.*", "held_out", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    features = Features(np.array(moments[1 : m + 1], dtype=float), np.array(moments[m + 1 :], dtype=float))
    gram, moment, count = normal_equations(train, features)
    # A half is scored by the other half's weights; where a half is empty, by all.
    whole = solve(gram.sum(axis=0), moment.sum(axis=0), count.sum())
    other = [solve(gram[1 - h], moment[1 - h], count[1 - h]) if count[1 - h] else whole for h in (0, 1)]
    weights = np.stack([*other, whole])
    out_of_fold = _scored(train.withColumn("model", F.col("half")).select("y", "stats", "model"), features, weights)
    step = F.floor(F.least(F.greatest(F.col("raw"), F.lit(-0.5)), F.lit(1.5)) * (BINS / 2))
    bins = out_of_fold.groupBy(step.alias("bin")).agg(F.count("*").alias("n"), F.avg("y").alias("y"), F.avg("raw").alias("raw"))
    bins = bins.orderBy("bin").collect()
    knots = np.array([b.raw for b in bins])
    levels = isotonic(np.array([b.n for b in bins], dtype=float), np.array([b.y for b in bins]))
    shared = docs.sparkSession.sparkContext.broadcast((knots, levels))
    scored = _scored(stats.withColumn("model", F.lit(2)), features, weights).select("own", "held_out", "raw")

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        knots, levels = shared.value
        for batch in batches:
            raw = batch.column("raw").to_numpy()
            score = 0.98 * np.interp(raw, knots, levels) + 0.02 * np.clip(raw, 0, 1)
            kept = [c for c in batch.schema.names if c != "raw"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(score), pa.array(score >= 0.5).cast(pa.int32())],
                names=[*kept, "score", "predicted"],
            )

    schema = StructType([f for f in scored.schema if f.name != "raw"] + list(RESULT)[1:])
    return scored.mapInArrow(calibrate, schema).select("own.*", "held_out", "score", "predicted")

"""Whitening of embeddings from exactly aggregated variances, by polarisation.

The covariance of two dimensions is half of what the variance of their sum exceeds their own variances by. So the
aggregate adds up squares only: for every dimension, and for every sum of two dimensions, of values centred before they
are squared. Values are whole numbers, centred on the whole number nearest their mean; what the mean lies beside that
number is taken out of the sums afterwards, as a whole number of 1 / n. All sums are exact, so the covariance does not
depend on how the rows are partitioned, and its entries are rounded once.

A task gives one row for each sum, dim * (dim + 1) / 2 in all; these meet by their number. The matrix of that size is
decomposed on the driver. Vectors are shuffled once, to find the distinct ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, LongType, StructField, StructType

from ballast.llm.embeddings import SCALE, free_names, matrix, sound, whole
from ballast.llm.texts import with_columns
from ballast.session import written

COMPONENTS = 4
STEP_ROWS = 4096
SAFE = 1 << 23
LEAST_SHARE = 2.0**-44

ADDED = StructType(
    [
        StructField("n", LongType()),
        StructField("deviation", DecimalType(38, 0)),
        StructField("whitened", ArrayType(DoubleType())),
        StructField("explained", ArrayType(DoubleType())),
        StructField("identity_error", DoubleType()),
    ]
)


def _sums(table: DataFrame, dim: int, parts: Callable[[np.ndarray], np.ndarray], exact: bool = True) -> list:
    """Sums over all rows of the vectors that ``parts`` gives for some of them."""
    kind = pa.decimal128(38, 0) if exact else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = matrix(batch.column(0), dim)
            for begin in range(0, len(x), STEP_ROWS):
                own = parts(x[begin : begin + STEP_ROWS])
                own = own.astype(object) if exact else own
                total = own if total is None else total + own
        if total is not None:
            values = [Decimal(int(s)) for s in total] if exact else total
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total))), pa.array(values, kind)], names=["place", "value"]
            )

    rows = table.mapInArrow(run, f"place bigint, value {'decimal(38,0)' if exact else 'double'}")
    got = rows.groupBy("place").agg(F.sum("value").alias("value")).collect()
    return [r.value for r in sorted(got, key=lambda r: r.place)]


def _safe(x: np.ndarray, most: int = SAFE) -> np.ndarray:
    """Whole numbers that stay exact in what follows: 64 bits where they do, Python's own beyond."""
    return x.astype(object) if x.size and max(int(x.max()), -int(x.min())) > most else x


def squares(y: np.ndarray) -> np.ndarray:
    """Sums of squares of each dimension, then of the sum of each pair of dimensions (0, 1), (0, 2), ..., (1, 2), ..."""
    own = [(y * y).sum(axis=0)]
    for i in range(y.shape[1] - 1):
        pair = y[:, i + 1 :] + y[:, i : i + 1]
        own.append((pair * pair).sum(axis=0))
    return np.concatenate(own)


def covariance(n: int, rest: list[int], sums: list[int]) -> np.ndarray:
    """The covariance matrix from sums of squares of centred values; ``rest`` sums the centred values themselves."""
    dim = len(rest)
    # n * n times a variance, as a whole number.
    alone = [n * sums[i] - rest[i] ** 2 for i in range(dim)]
    out = np.diag([a / n**2 for a in alone])
    at = dim
    for i in range(dim):
        for j in range(i + 1, dim):
            both = n * sums[at] - (rest[i] + rest[j]) ** 2
            out[i, j] = out[j, i] = (both - alone[i] - alone[j]) / (2 * n**2)
            at += 1
    return out


def basis(cov: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and unit eigenvectors as columns; those of eigenvalue zero are left out."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = np.flatnonzero(values > LEAST_SHARE * max(np.trace(cov), 0.0))[:components]
    values, vectors = values[some], vectors[:, some]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(some))])
    return values, vectors * sign


class Fit:
    """Where vectors of one length lie and how they spread."""

    def __init__(self, table: DataFrame, n: int, dim: int, components: int):
        sums = [int(s) for s in _sums(table, dim, lambda x: _safe(x, 1 << 50).sum(axis=0))] if dim else []
        self.n, self.dim = n, dim
        self.centre = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
        self.rest = [s - n * int(c) for s, c in zip(sums, self.centre)]
        centre = self.centre
        own = [int(s) for s in _sums(table, dim, lambda x: squares(_safe(x - centre)))] if dim else []
        cov = covariance(n, self.rest, own) if dim else np.zeros((0, 0))
        values, vectors = basis(cov, components) if dim else (np.zeros(0), cov)
        self.axes = vectors / np.sqrt(values)
        self.explained = (values / np.trace(cov)).tolist() if len(values) else []
        self.identity_error = 0.0
        if len(values):
            got = _sums(table, dim, lambda x: (lambda w: (w.T @ w).ravel())(self.whitened(x)), exact=False)
            self.identity_error = float(np.abs(np.array(got).reshape(len(values), -1) / n - np.eye(len(values))).max())

    def whitened(self, x: np.ndarray) -> np.ndarray:
        beside = np.array([r / self.n for r in self.rest])
        return ((x - self.centre).astype(np.float64) - beside) @ self.axes

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - S) ** 2, with the square multiplied out, in whole numbers."""
        y, rest = x - self.centre, np.array(self.rest, dtype=object)
        most = max(int(np.abs(y).max()), 1) if y.size else 1
        small = self.dim * most * max(most, self.n) < 1 << 62
        y, rest = (y, rest.astype(np.int64)) if small else (y.astype(object), rest)
        square, cross = (y * y).sum(axis=1).astype(object), (y * rest).sum(axis=1).astype(object)
        return square * self.n**2 - cross * (2 * self.n) + sum(r * r for r in self.rest)


def whiten(
    rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE
) -> DataFrame:
    """The rows whose vectors count, with ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``.

    Vectors without null or non-finite components count; components are taken times ``scale``, rounded down. The fit is
    over each distinct such vector once, ``n`` of them, so repeated rows weigh nothing and get equal values. Null
    vectors are left out. ``whitened`` holds the centred vector along the first ``components`` unit eigenvectors of the
    covariance, each over the root of its eigenvalue; ``explained`` the eigenvalues' shares of the trace;
    ``identity_error`` how far the covariance of ``whitened`` over the fit is from the identity, added up anew.
    ``deviation`` is the exact sum over dimensions of (n * x - S) ** 2. Eigenvectors of eigenvalue zero are left out,
    so a single distinct vector has no components. Vectors of each length are fitted apart. An empty table gives an
    empty result; columns of the input with the names of these columns are replaced. Equal eigenvalues may come in any
    order. Components of any size are added up exactly; those beyond 64 bits of ``scale`` * component are held at that.
    """
    (v,) = free_names(rows, "whole")
    kept = rows.where(sound(vector)).withColumn(v, whole(vector, scale))
    distinct = written(kept.select(v).distinct())
    schema = with_columns(rows.schema, ADDED)
    rest = [c for c in rows.columns if c not in ADDED.fieldNames()]
    out = None
    for r in distinct.groupBy(F.size(v).alias("dim")).count().orderBy("dim").collect():
        fit = Fit(distinct.where(F.size(v) == r["dim"]), r["count"], r["dim"], components)
        own = _placed(kept.where(F.size(v) == r["dim"]), v, rest, fit, schema)
        out = own if out is None else out.unionByName(own)
    return rows.sparkSession.createDataFrame([], schema) if out is None else out


def _placed(rows: DataFrame, v: str, rest: list[str], fit: Fit, schema: StructType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(v), fit.dim)
            size, number = len(x), len(fit.explained)
            cuts = np.arange(size + 1, dtype=np.int32) * number
            shares = np.tile(np.array(fit.explained, dtype=np.float64), size)
            new = [
                pa.array(np.full(size, fit.n, dtype=np.int64)),
                pa.array([Decimal(int(d)) for d in fit.deviation(x)], pa.decimal128(38, 0)),
                pa.ListArray.from_arrays(cuts, pa.array(fit.whitened(x).ravel())),
                pa.ListArray.from_arrays(cuts, pa.array(shares)),
                pa.array(np.full(size, fit.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + new, names=schema.fieldNames())

    return rows.mapInArrow(run, schema)

"""Centroid clustering by Orchard's search.

Each round sorts, for every centroid, all others by their distance from it. A vector starts at some centroid and walks
down that one's list. A centroid found closer takes over, with its own list from the top; centroids looked at once are
marked and not computed again. Once the next entry is more than twice as far from the current centroid as the vector
is, no later one can be as close, so the walk ends there; an entry at exactly twice the distance could still tie and is
looked at. All distances are whole numbers, so ties are exact and go to the smaller number.

A round reads the vectors once, in any partitioning. A task adds its vectors up by centroid before anything is shuffled,
so what moves is one row for each task and centroid, whatever the share of the largest cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ballast.llm.embeddings import SCALE, free_names, matrix, sound, whole
from ballast.llm.texts import with_columns
from ballast.session import written

CENTROIDS = 40
ROUNDS = 5
DIM = 64
SALT = "2:"
STEP_ROWS = 4096

ADDED = StructType(
    [
        StructField("cluster", IntegerType()),
        StructField("distance", LongType()),
        StructField("cluster_inertia", LongType()),
        StructField("inertia", LongType()),
        StructField("centroid_sha256", StringType()),
    ]
)


class Neighbours:
    """Centroids, and for each of them the others by rising distance."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        k = len(centroids)
        self.order = np.zeros((k, max(k - 1, 0)), dtype=np.int64)
        self.gap = np.zeros_like(self.order)
        for c in range(k):
            gap = ((centroids - centroids[c]) ** 2).sum(axis=1)
            others = np.argsort(gap, kind="stable")
            self.order[c] = others[others != c]
            self.gap[c] = gap[self.order[c]]

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each row and its squared distance."""
        n, k = len(x), len(self.centroids)
        at, place = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        best = ((x - self.centroids[0]) ** 2).sum(axis=1)
        seen = np.zeros((n, k), dtype=bool)
        seen[:, 0] = True
        live = np.arange(n if k > 1 else 0)
        while len(live):
            other = self.order[at[live], place[live]]
            on = self.gap[at[live], place[live]] <= 4 * best[live]
            live, other = live[on], other[on]
            place[live] += 1
            new = ~seen[live, other]
            rows, other = live[new], other[new]
            seen[rows, other] = True
            distance = ((x[rows] - self.centroids[other]) ** 2).sum(axis=1)
            closer = (distance < best[rows]) | ((distance == best[rows]) & (other < at[rows]))
            moved = rows[closer]
            at[moved], best[moved], place[moved] = other[closer], distance[closer], 0
            live = live[place[live] < k - 1]
        return at, best


def _checked(x: np.ndarray) -> np.ndarray:
    """The matrix itself, if no squared distance in it can pass 2 ** 61."""
    if x.size and max(int(x.max()), -int(x.min())) > isqrt((1 << 61) // x.shape[1]) // 2:
        raise ValueError("a component is too large for exact squared distances in 64 bits")
    return x


def _totals(table: DataFrame, shared, dim: int) -> dict[int, tuple[int, int, list[int]]]:
    """Rows, summed distance and summed vectors of each centroid's cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Neighbours(shared.value)
        k = len(index.centroids)
        rows, inertia, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            whole_batch = _checked(matrix(batch.column(0), dim))
            for begin in range(0, len(whole_batch), STEP_ROWS):
                x = whole_batch[begin : begin + STEP_ROWS]
                at, distance = index.search(x)
                by = np.argsort(at, kind="stable")
                starts = np.flatnonzero(np.diff(at[by], prepend=-1))
                own = at[by][starts]
                rows += np.bincount(at, minlength=k)
                inertia[own] += np.add.reduceat(distance[by], starts)
                sums[own] += np.add.reduceat(x[by], starts, axis=0)
        own = np.flatnonzero(rows)
        lists = pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * dim, pa.array(sums[own].ravel()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(own, pa.int32()), pa.array(rows[own]), pa.array(inertia[own]), lists],
            names=["cluster", "rows", "inertia", "sums"],
        )

    parts = table.mapInArrow(run, "cluster int, rows bigint, inertia bigint, sums array<bigint>")
    exact = [F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(dim)]
    totals = parts.groupBy("cluster").agg(F.sum("rows"), F.sum("inertia"), F.array(*exact))
    return {r[0]: (r[1], r[2], [int(s) for s in r[3]]) for r in totals.collect()}


def cluster(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS,
    dim: int = DIM, salt: str = SALT, scale: int = SCALE,
) -> DataFrame:
    """The rows whose vectors count, with ``cluster``, ``distance`` (squared, to the final centroid),
    ``cluster_inertia``, ``inertia`` and ``centroid_sha256``.

    Vectors of ``dim`` components, none null or non-finite, count; components are taken times ``scale``, rounded down.
    Other rows, null vectors among them, are left out. The first centroids are those of the ``centroids`` rows with the
    smallest SHA-256 of ``salt`` and id, rows with equal ids by their vectors; a row without an id belongs to a cluster
    but begins none. Repeated rows count as often as they occur. With fewer rows than ``centroids`` there are fewer
    centroids; without any, and for an empty table, the result is empty. Columns of the input with the names of these
    columns are replaced. Components so large that squared distances could leave 64 bits (2 ** 26 and more at 64
    dimensions) raise an error.
    """
    kept = rows.where(sound(vector) & (F.size(vector) == dim))
    (v,) = free_names(rows, "whole")
    whole_rows = kept.withColumn(v, whole(vector, scale))
    table = written(whole_rows.select(v))
    name = F.sha2(F.concat(F.lit(salt), F.col(vec_id).cast("string")).cast("binary"), 256)
    first = whole_rows.where(F.col(vec_id).isNotNull()).select(name.alias("h"), F.col(v).alias("v"))
    start = [r.v for r in first.orderBy("h", "v").limit(centroids).collect()]
    schema = with_columns(rows.schema, ADDED)
    if not start:
        return rows.sparkSession.createDataFrame([], schema)
    current = _checked(np.array(start, dtype=np.int64).reshape(len(start), dim))
    context = rows.sparkSession.sparkContext
    for _ in range(rounds):
        totals = _totals(table, context.broadcast(current), dim)
        current = current.copy()
        for c, (n, _, sums) in totals.items():
            current[c] = [s // n for s in sums]
    shared = context.broadcast(current)
    inertia = {c: x[1] for c, x in _totals(table, shared, dim).items()}
    by_cluster = np.array([inertia.get(c, 0) for c in range(len(current))], dtype=np.int64)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in current.tolist()]
    rest = [c for c in rows.columns if c not in ADDED.fieldNames()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, names = Neighbours(shared.value), pa.array(digests)
        for batch in batches:
            at, distance = index.search(matrix(batch.column(v), dim))
            own = by_cluster[at]
            new = [at.astype(np.int32), distance, own, np.full(len(at), by_cluster.sum())]
            columns = [batch.column(c) for c in rest] + [pa.array(a) for a in new] + [names.take(pa.array(at))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return whole_rows.mapInArrow(run, schema)

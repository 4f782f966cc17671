"""Exact top-k search by inner product over vector-approximation files.

Vectors are stored in packed blocks, each with its vectors' cells beside the vectors themselves. A cell is one byte for
each component: the interval, among 256 of equal width between the component's least and largest value, that the
component lies in. A query's inner product with a vector is bounded on both sides by the cells' edges.

1. The cells of all blocks are scanned, and the k-th best lower bound of each query is found. Vectors are not read.
2. The cells are scanned again. Vectors whose upper bound reaches that threshold are visited, the highest upper bounds
   first, until a query's k-th exact score lies above every upper bound left. Only visited vectors are computed with.

Queries meet all blocks in batches of a bounded number; a batch is sent to every task and takes one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballast.session import written

K = 5
SCALE = 256
BLOCK_VECTORS = 4096
QUERY_BATCH = 8192
PANEL = 512
CELLS = 256


def quantised(rows: DataFrame, vec_id: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, v, dim): components times ``scale``, rounded down. Vectors with a null or non-finite component go."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    sound = rows.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return sound.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v"), F.size(vector).alias("dim"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def build(vectors: DataFrame, dim: int, low: np.ndarray, width: np.ndarray, block_vectors: int = BLOCK_VECTORS) -> DataFrame:
    """The vector-approximation file of vectors of one dimension: a row for each block of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], 0

        def block() -> pa.RecordBatch:
            x = np.concatenate(rows)
            cells = np.clip((x - low) // width, 0, CELLS - 1).astype(np.uint8)
            values = [[np.concatenate(ids).tobytes()], [cells.tobytes()], [x.astype("<i8").tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, pa.binary()) for v in values], names=["ids", "cells", "exact"])

        for batch in batches:
            x, own = _matrix(batch.column("v"), dim), batch.column("vec_id").to_numpy()
            for at in range(0, len(own), block_vectors):
                ids.append(own[at : at + block_vectors])
                rows.append(x[at : at + block_vectors])
                held += len(ids[-1])
                if held >= block_vectors:
                    yield block()
                    ids, rows, held = [], [], 0
        if held:
            yield block()

    return vectors.select("vec_id", "v").mapInArrow(run, "ids binary, cells binary, exact binary")


def _edges(cells: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest component a cell can stand for, as whole numbers."""
    begin = low + cells.astype(np.float64) * width
    return begin, begin + width - 1


def _bounds(q: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return up @ begin.T + down @ end.T, up @ end.T + down @ begin.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    order = np.lexsort((ids, -scores))[:k]
    return list(zip(scores[order].tolist(), ids[order].tolist()))


def _pass(blocks: DataFrame, shared, dim: int, k: int, low: np.ndarray, width: np.ndarray) -> DataFrame:
    """(query_id, vec_id, score) of each task's ``k`` best for every query, by exact scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q, threshold = shared.value
        q = q.astype(np.float64)
        best: list[list[tuple[int, int]]] = [[] for _ in q_ids]
        for batch in batches:
            for raw_ids, raw_cells, raw_exact in zip(*(batch.column(c) for c in ("ids", "cells", "exact"))):
                ids = np.frombuffer(raw_ids.as_py(), dtype=np.int64)
                exact = np.frombuffer(raw_exact.as_py(), dtype="<i8").reshape(len(ids), dim)
                begin, end = _edges(np.frombuffer(raw_cells.as_py(), np.uint8).reshape(len(ids), dim), low, width)
                for at in range(0, len(q_ids), PANEL):
                    _, upper = _bounds(q[at : at + PANEL], begin, end)
                    for j, own in enumerate(upper, start=at):
                        held = best[j]
                        least = max(threshold[j], held[-1][0]) if len(held) == k else threshold[j]
                        maybe = np.flatnonzero(own >= least)
                        maybe = maybe[ids[maybe] != q_ids[j]]
                        maybe = maybe[np.argsort(-own[maybe], kind="stable")]
                        step = 4 * k
                        for first in range(0, len(maybe), step):
                            some = maybe[first : first + step]
                            if len(held) == k and own[some[0]] < held[-1][0]:
                                break
                            scores = exact[some] @ q[j].astype(np.int64)
                            old = np.array(held, dtype=np.int64).reshape(-1, 2)
                            held = _best(np.r_[old[:, 0], scores], np.r_[old[:, 1], ids[some]], k)
                        best[j] = held
        flat = [(int(i), v, s) for i, own in zip(q_ids, best) for s, v in own]
        columns = [pa.array([r[c] for r in flat], pa.int64()) for c in range(3)]
        yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

    return blocks.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def _thresholds(blocks: DataFrame, shared, dim: int, k: int, low: np.ndarray, width: np.ndarray) -> DataFrame:
    """(place, bound): each task's ``k`` best lower bounds for every query, the query itself left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q, _ = shared.value
        q = q.astype(np.float64)
        best = np.full((len(q_ids), k), -np.inf)
        for batch in batches:
            for raw_ids, raw_cells in zip(batch.column("ids"), batch.column("cells")):
                ids = np.frombuffer(raw_ids.as_py(), dtype=np.int64)
                begin, end = _edges(np.frombuffer(raw_cells.as_py(), np.uint8).reshape(len(ids), dim), low, width)
                own = np.argsort(ids, kind="stable")
                for at in range(0, len(q_ids), PANEL):
                    lower, _ = _bounds(q[at : at + PANEL], begin, end)
                    mine = q_ids[at : at + PANEL]
                    a, b = np.searchsorted(ids[own], mine, "left"), np.searchsorted(ids[own], mine, "right")
                    for j in np.flatnonzero(b > a):
                        lower[j, own[a[j] : b[j]]] = -np.inf
                    top = np.partition(lower, -k, axis=1)[:, -k:] if lower.shape[1] > k else lower
                    both = np.concatenate([best[at : at + PANEL], top], axis=1)
                    best[at : at + PANEL] = np.partition(both, -k, axis=1)[:, -k:]
        place, column = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays(
            [pa.array(place, pa.int64()), pa.array(best[place, column], pa.float64())], names=["place", "bound"]
        )

    return blocks.select("ids", "cells").mapInArrow(run, "place bigint, bound double")


def top_k(
    queries: DataFrame, rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K,
    scale: int = SCALE, query_batch: int = QUERY_BATCH, block_vectors: int = BLOCK_VECTORS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best rows by whole-number inner product.

    Ties go to the smaller id. Rows with the query's id are its own and no candidates. Vectors that are null or hold a
    null or non-finite component take no part, nor do rows without an id; vectors of unequal length have no product. A
    candidate row that occurs twice counts twice. A query that occurs in several rows is asked once for each distinct
    vector, and the best of all count. Inner products must stay below 2 ** 53.
    """
    spark = rows.sparkSession
    small = quantised(rows, vec_id, vector, scale)
    small = written(small)
    asked = quantised(queries, vec_id, vector, scale)
    asked = written(asked.distinct())
    spark_context = spark.sparkContext
    found = None
    for r in asked.groupBy("dim").count().orderBy("dim").collect():
        dim, number = r["dim"], r["count"]
        own = small.where(F.col("dim") == dim)
        if dim:
            edges = own.agg(*[F.min(F.col("v")[i]) for i in range(dim)], *[F.max(F.col("v")[i]) for i in range(dim)]).first()
            if edges[0] is None:
                continue
            low = np.array(edges[:dim], dtype=np.float64)
            width = np.maximum(np.ceil((np.array(edges[dim:], dtype=np.float64) - low + 1) / CELLS), 1)
        else:
            low = width = np.zeros(0)
        blocks = written(build(own, dim, low, width, block_vectors))
        batches = -(-number // query_batch)
        batch_of = F.pmod(F.xxhash64("vec_id", "v"), F.lit(batches))
        for batch in range(batches):
            got = asked.where((F.col("dim") == dim) & (batch_of == batch)).select("vec_id", "v").toLocalIterator()
            pairs = [(x.vec_id, x.v) for x in got]
            if not pairs:
                continue
            ids = np.array([p[0] for p in pairs], dtype=np.int64)
            q = np.array([p[1] for p in pairs], dtype=np.int64).reshape(len(pairs), dim)
            bounds = _thresholds(blocks, spark_context.broadcast((ids, q, None)), dim, k, low, width)
            place = Window.partitionBy("place").orderBy(F.desc("bound"))
            kth = bounds.withColumn("n", F.row_number().over(place)).where(F.col("n") == k).select("place", "bound")
            threshold = np.full(len(ids), -np.inf)
            for x in kth.collect():
                threshold[x.place] = x.bound
            best = _pass(blocks, spark_context.broadcast((ids, q, threshold)), dim, k, low, width)
            found = written(best) if found is None else found.unionByName(written(best))
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

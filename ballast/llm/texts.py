"""Texts in Arrow batches: cutting batches by bytes, and words as numpy arrays over the UTF-8 buffer."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

SLICE_BYTES = 2 << 20
ROWS_PER_BATCH = 256
LANE_WORD_BYTES = 64
SPACE = 32

# Lower-cases A-Z and turns every byte that is no letter, digit or part of a non-ASCII character into a space.
_WORD_BYTES = np.full(256, SPACE, dtype=np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _WORD_BYTES[_b] = _b
for _b in range(0x41, 0x5B):
    _WORD_BYTES[_b] = _b + 32

_MIX = np.uint64(0x9E3779B97F4A7C15)


def cached(key: str, make: Callable[[], object]) -> object:
    """An object that is made once for each Python worker: what functions carry along is new in every task."""
    store = sys.modules.setdefault("_ballast_worker", types.ModuleType("_ballast_worker")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def latest(key: str, token: str, make: Callable[[], object]) -> object:
    """Like ``cached``, but a worker holds only the object of the last ``token`` it was asked for."""
    held = cached(key, dict)
    if token not in held:
        held.clear()
        held[token] = make()
    return held[token]


def small_batches(spark: SparkSession) -> None:
    """Few rows per Arrow batch, so that a batch of long texts stays small; numpy still sees hundreds of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about ``limit`` bytes; a longer text is a part of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield batch.slice(begin, end - begin)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, each text followed by a line feed, and the place where each begins."""
    end, empty = pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())
    filled = pc.binary_join_element_wise(pc.fill_null(column.cast(pa.large_string()), empty), empty, end)
    offsets = np.frombuffer(filled.buffers()[1], dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = np.frombuffer(filled.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[:-1] - offsets[0]


class Words:
    """The lower-cased words of several texts: byte places, a 64-bit hash of each, and the row it belongs to."""

    def __init__(self, data: np.ndarray, begins: np.ndarray):
        self.bytes = _WORD_BYTES[data]
        inside = self.bytes != SPACE
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.row = np.searchsorted(begins, self.start, side="right") - 1
        self.first = np.searchsorted(self.row, np.arange(len(begins)))
        self.count = np.bincount(self.row, minlength=len(begins))
        self.hash = hash_spans(self.bytes, self.start, self.end)

    def texts(self, first: int, last: int) -> list[bytes]:
        """The words from ``first`` to before ``last``."""
        return self.bytes[self.start[first] : self.end[last - 1]].tobytes().split()


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in their order."""
    h = (a ^ (b + _MIX + (a << np.uint64(6)) + (a >> np.uint64(2)))) * _MIX
    return h ^ (h >> np.uint64(29))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans, read eight bytes at a time; long spans are hashed one by one."""
    length = end - start
    out = length.astype(np.uint64) * _MIX
    if not len(start):
        return out
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    lanes = np.ndarray((len(data),), dtype="<u8", buffer=padded, strides=(1,))
    live = np.flatnonzero(length <= LANE_WORD_BYTES)
    for at in range(0, LANE_WORD_BYTES, 8):
        live = live[length[live] > at]
        if not len(live):
            break
        left = np.minimum(length[live] - at, 8).astype(np.uint64)
        lane = lanes[start[live] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
        out[live] = mix(out[live], lane)
    for i in np.flatnonzero(length > LANE_WORD_BYTES):
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes())
    return out


def with_columns(schema: StructType, added: StructType) -> StructType:
    """The input's columns, without those of the operator's names, then the operator's."""
    names = set(added.fieldNames())
    return StructType([StructField(f.name, f.dataType, True) for f in schema if f.name not in names] + list(added))


def annotate(
    df: DataFrame, added: StructType, text: str, function: Callable[[pa.RecordBatch], list[pa.Array]],
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Append the arrays that ``function`` gives for each slice of rows; nothing is shuffled."""
    small_batches(df.sparkSession)
    schema = with_columns(df.schema, added)
    kept = [n for n in df.columns if n not in set(added.fieldNames())]
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, limit):
                new = function(part)
                yield pa.RecordBatch.from_arrays([part.column(n) for n in kept] + new, names=names)

    return df.mapInArrow(run, schema)

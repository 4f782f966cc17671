"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of ``window`` consecutive words of a benchmark item (a shorter item is one window). The
alphabet is words rather than characters: in prose nearly every block of letters occurs in some pattern, while a block
of two words seldom does, so the shift table then skips almost a whole window at a time. Patterns of one length are
searched together. Each search keeps

* a shift table over hashed blocks of two words: how far the window may move before the block could end a match;
* buckets of patterns by the hash of their last block and, as a second key, their first block;
* a direct comparison of words for each position and pattern that meet in a bucket.

Documents stay where they are read: the patterns go to the tasks, in blocks of a bounded size. A benchmark larger than
one block takes one pass over the documents for each block, and each pass adds to the spans that the last has found.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ballast.llm.texts import Words, annotate, flat, latest, mix, slices, small_batches
from ballast.session import written

WINDOW = 10
BLOCK_BYTES = 16 << 20
LANE_WORDS = 256
PART_WORDS = 1 << 17

RESULT = StructType(
    [
        StructField("n_words", LongType()),
        StructField("n_hit", LongType()),
        StructField("hit_spans", ArrayType(LongType())),
        StructField("item_ids", ArrayType(StringType())),
    ]
)


def _in_parts(function, *arrays: np.ndarray) -> np.ndarray:
    """``function`` of arrays of equal length, part by part, so that what it makes on its way stays small."""
    out = None
    for i in range(0, max(len(arrays[0]), 1), PART_WORDS):
        part = function(*[a[i : i + PART_WORDS] for a in arrays])
        if out is None:
            out = np.empty(len(arrays[0]), dtype=part.dtype)
        out[i : i + PART_WORDS] = part
    return out


class ItemWords:
    """Words of many items: their bytes with single spaces between, and for each its place, hash and item number."""

    def __init__(self, bodies: list[str]):
        arena, self.count, parts, at, item = bytearray(), [], [], 0, 0
        for part in slices(pa.RecordBatch.from_arrays([pa.array(bodies, pa.large_string())], names=["body"]), "body"):
            words = Words(*flat(part.column("body")))
            arena += words.bytes.tobytes()
            spans = [(words.start + at).astype(np.int32), (words.end + at).astype(np.int32), (words.row + item).astype(np.int32)]
            parts.append([*spans, words.hash])
            self.count += words.count.tolist()
            at, item = len(arena), item + part.num_rows
        self.arena = bytes(arena)
        empty = [np.zeros(0, dtype=t) for t in (np.int32, np.int32, np.int32, np.uint64)]
        self.start, self.end, self.row, self.hash = map(np.concatenate, zip(empty, *parts))
        self.count = np.array(self.count, dtype=np.int32)
        self.first = (np.cumsum(self.count) - self.count).astype(np.int32)

    def begins(self, window: int) -> dict[int, np.ndarray]:
        """By length of pattern, the words at which one begins."""
        room = self.first[self.row] + self.count[self.row] - window
        found = {window: np.flatnonzero(np.arange(len(self.row), dtype=np.int32) <= room).astype(np.int32)}
        for length in np.unique(self.count[(self.count < window) & (self.count > 0)]).tolist():
            found[length] = self.first[self.count == length]
        return {n: b for n, b in found.items() if len(b)}


class Patterns:
    """All patterns of ``length`` words, ready for search. A pattern is a place in the items' words.

    ``begins`` are the words at which a pattern of this length begins. Equal windows are one pattern with a list of
    items, so a passage that many items share is compared once.
    """

    def __init__(self, length: int, items: ItemWords, begins: np.ndarray):
        self.length, self.arena, self.hash = length, items.arena, items.hash
        self.start, self.end = items.start, items.end
        self.block = min(2, length)
        begins = begins[np.argsort(_in_parts(self._window_hash, begins))]
        same = np.zeros(len(begins), dtype=bool)
        same[1:] = _in_parts(self._equal, begins[1:], begins[:-1])
        for i in np.flatnonzero(same).tolist():
            same[i] = self.bytes_of(begins[i]) == self.bytes_of(begins[i - 1])
        self.place = begins[~same]
        # Pattern and item as one number, so that an item that repeats a window is listed once.
        held = np.cumsum(~same, dtype=np.int64)
        held -= 1
        held <<= 32
        held += items.row[begins]
        held.sort()
        held = held[np.diff(held, prepend=-1) > 0]
        self.item = (held & 0xFFFFFFFF).astype(np.int32)
        self.upto = np.searchsorted(held, np.arange(len(self.place) + 1) << 32).astype(np.int32)
        del begins, same, held

        key = _in_parts(lambda p: mix(self._block_at(self.hash, p + length - 1), self._block_at(self.hash, p + self.block - 1)), self.place)
        self.order = np.argsort(key).astype(np.int32)
        self.key = key[self.order]
        del key
        # Windows that follow each other share all their blocks but one, so there are about as many blocks as windows.
        self.bits = np.uint64(64 - max(12, int(np.ceil(np.log2(len(self.place) * 8)))))
        longest = length - self.block + 1
        self.shift = np.full(1 << (64 - int(self.bits)), longest, dtype=np.min_scalar_type(longest))
        for last in range(self.block - 1, length):
            at = _in_parts(lambda p: self._block_at(self.hash, p + last) >> self.bits, self.place)
            self.shift[at] = length - 1 - last  # falling, so the least stays

    def _window_hash(self, begins: np.ndarray) -> np.ndarray:
        out = self.hash[begins]
        for k in range(1, self.length):
            out = mix(out, self.hash[begins + k])
        return out

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), dtype=bool)
        for k in range(self.length):
            out &= self.hash[a + k] == self.hash[b + k]
        return out

    def _block_at(self, h: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mix(h[last], h[last]) if self.block == 1 else mix(h[last - 1], h[last])

    def bytes_of(self, begin: int) -> bytes:
        """The words of the pattern that begins there, with single spaces between."""
        return self.arena[self.start[begin] : self.end[begin + self.length - 1]]

    def items_of(self, pattern: np.ndarray) -> np.ndarray:
        """Numbers of the items that hold any of these patterns."""
        return np.unique(np.concatenate([self.item[self.upto[p] : self.upto[p + 1]] for p in pattern.tolist()]))

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First words and patterns of all occurrences, none across two texts.

        The words are dealt into lanes of fixed length and all lanes move on at once, each by its own shift.
        """
        h, n = words.hash, len(words.hash)
        begin = np.arange(0, n, LANE_WORDS)
        end = np.minimum(begin + LANE_WORDS + self.length - 1, n)
        at = begin + self.length - 1
        found = []
        while True:
            live = at < end
            at, end = at[live], end[live]
            if not len(at):
                break
            move = self.shift[self._block_at(h, at) >> self.bits].astype(np.int64)
            found.append(at[move == 0])
            at = at + np.maximum(move, 1)
        last = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        last = last[words.row[last] == words.row[last - self.length + 1]]
        key = mix(self._block_at(h, last), self._block_at(h, last - self.length + self.block))
        low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        many = high - low
        first = np.repeat(last, many) - self.length + 1
        bucket = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        pattern = self.order[bucket]
        for k in range(self.length):
            same = h[first + k] == self.hash[self.place[pattern] + k]
            first, pattern = first[same], pattern[same]
        pairs = zip(first.tolist(), self.place[pattern].tolist())
        same = [b" ".join(words.texts(f, f + self.length)) == self.bytes_of(p) for f, p in pairs]
        same = np.array(same, dtype=bool)
        return first[same], pattern[same]


def patterns_of(bodies: list[str], window: int) -> list[Patterns]:
    """Patterns of every length that the items have. ``bodies`` are words with single spaces between."""
    items = ItemWords(bodies)
    return [Patterns(n, items, begins) for n, begins in sorted(items.begins(window).items())]


def item_parts(items: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """(item, body): the words of each row of (item, body), with single spaces between, in parts of bounded length.

    Neighbouring parts overlap by ``window`` - 1 words, so that every window lies in exactly one of them.
    """
    small_batches(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body"):
                words, names, bodies = Words(*flat(part.column("body"))), [], []
                for name, first, count in zip(part.column("item").to_pylist(), words.first.tolist(), words.count.tolist()):
                    for at in range(0, max(count - window + 1, min(count, 1)), part_words):
                        until = first + min(at + part_words + window - 1, count)
                        names.append(name)
                        bodies.append(b" ".join(words.texts(first + at, until)).decode())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.string())], names=["item", "body"])

    return items.mapInArrow(run, "item string, body string")


def _scan(docs: DataFrame, text: str, shared, window: int, again: bool) -> DataFrame:
    token = uuid.uuid4().hex

    def build() -> tuple[list[str], list[Patterns]]:
        return [item for item, _ in shared.value], patterns_of([body for _, body in shared.value], window)

    def search(part: pa.RecordBatch) -> list[pa.Array]:
        names, built = latest("decontamination", token, build)
        words = Words(*flat(part.column(text)))
        cover = np.zeros(len(words.hash) + 1, dtype=np.int64)
        items: list[set[str]] = [set() for _ in range(part.num_rows)]
        if again:
            spans, ids = part.column("hit_spans").to_pylist(), part.column("item_ids").to_pylist()
            for row, (own, named) in enumerate(zip(spans, ids)):
                items[row].update(named)
                np.add.at(cover, words.first[row] + np.array(own[0::2], dtype=np.int64), 1)
                np.add.at(cover, words.first[row] + np.array(own[1::2], dtype=np.int64), -1)
        for patterns in built:
            first, pattern = patterns.find(words)
            np.add.at(cover, first, 1)
            np.add.at(cover, first + patterns.length, -1)
            row = words.row[first]
            for r in np.unique(row).tolist():
                own = patterns.items_of(np.unique(pattern[row == r]))
                items[r].update(names[i] for i in own.tolist())
        hit = np.cumsum(cover)[:-1] > 0
        n_hit = np.bincount(words.row[hit], minlength=part.num_rows)
        spans = [[] for _ in range(part.num_rows)]
        for row in np.flatnonzero(n_hit):
            own = hit[words.first[row] : words.first[row] + words.count[row]]
            edges = np.flatnonzero(np.diff(own.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
            spans[row] = edges.tolist()
        return [
            pa.array(words.count, pa.int64()),
            pa.array(n_hit, pa.int64()),
            pa.array(spans, pa.list_(pa.int64())),
            pa.array([sorted(s) for s in items], pa.list_(pa.string())),
        ]

    return annotate(docs, RESULT, text, search)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Words of each document that lie inside an occurrence of a benchmark window.

    Adds ``n_words``, ``n_hit``, ``hit_spans`` (first word, word after the last, and so on, as a flat list of disjoint
    spans) and ``item_ids`` (strings, sorted). An item without an id is left out, as it could not be named; an item
    without words has no window; rows repeating an item count once. A document without words has no hit.
    ``block_bytes`` bounds, but for the spread of a hash, the item words that are sent to the tasks at once; a longer item
    is cut into parts that overlap by a window less a word. Each Python worker keeps the patterns of one block at a
    time, built once for all its tasks. A very long document is searched whole, in a batch of its own.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col(item_id).isNotNull()).select(
        F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("body")
    )
    items = written(item_parts(items, window))
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = -(-int(total) // block_bytes) or 1
    out = docs
    for block in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == block)
        rows = [(r.item, r.body) for r in own.toLocalIterator()]
        out = _scan(out if block == 0 else written(out), text, spark.sparkContext.broadcast(rows), window, block > 0)
    return out

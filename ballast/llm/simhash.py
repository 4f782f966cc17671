"""SimHash near-duplicates by a Gray-ordered hierarchical index.

Fingerprints are linked when they differ in at most ``max_bits`` bits. Two such fingerprints agree in at least one of
``max_bits + 1`` disjoint blocks of bits, so each distinct fingerprint is dealt once for each block, by the block's
value. Where too many fingerprints share a value, they are dealt again by more and shorter blocks, of which all but
``max_bits`` must agree; as the bits left open get fewer and fingerprints are distinct, no group can stay large. Equal fingerprints are
one row before any of this, so groups of copies cost nothing here.

Several groups make a bucket, which one task searches with an index of its own. Within a group fingerprints are sorted
by Gray rank, so that neighbours differ in few bits. Runs of neighbours are the lowest nodes, runs of nodes the next,
up to one root. A node holds the bits all its fingerprints share and that no node above holds already: a mask and a
value. A search goes down level by level for many fingerprints at once and adds up the differing bits; where the sum
exceeds the limit, the whole group below is left. A bucket returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ballast.llm.components import components
from ballast.llm.texts import annotate
from ballast.session import written

SHINGLE = 3
MAX_BITS = 3
SEED = 42
GROUP_ROWS = 8192
BUCKET_ROWS = 32768
FANOUT = 8
FRONTIER = 1 << 20
BITS = 64


# --- fingerprints -----------------------------------------------------------------------------------------------------


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text; zero without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(b" ".join(g), SEED) for g in grams], dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Add ``fp``, the fingerprint as a signed 64-bit integer."""

    def run(part: pa.RecordBatch) -> list[pa.Array]:
        texts = pc.fill_null(part.column(text), "").to_pylist()
        return [pa.array(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))]

    return annotate(docs, StructType([StructField("fp", LongType())]), text, run)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- the index --------------------------------------------------------------------------------------------------------


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each word in the Gray code's order."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Distinct fingerprints in groups, each group a tree of masked bit patterns. ``fp`` is sorted by group and rank."""

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        order = np.lexsort((gray_rank(fp), group))
        self.source = order
        self.fp = fp[order]
        group = group[order]
        n = len(fp)
        full = np.full(n, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        value, mask, owner = self.fp, full, group
        last = np.arange(n)
        self.levels: list[tuple] = []
        while True:
            first_of = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
            self.levels.append((value, mask, last, None))
            if len(first_of) == len(owner):
                break
            rank = np.arange(len(owner)) - np.repeat(first_of, np.diff(np.r_[first_of, len(owner)]))
            starts = np.flatnonzero(rank % FANOUT == 0)
            ends = np.r_[starts[1:], len(owner)]
            common = np.bitwise_and.reduceat(mask, starts)
            common &= ~(np.bitwise_or.reduceat(value, starts) ^ np.bitwise_and.reduceat(value, starts))
            # Bits that a node shares with all its siblings move up into the parent.
            parent = np.repeat(common, ends - starts)
            self.levels[-1] = (value, mask & ~parent, last, (starts, ends))
            value, mask, owner, last = value[starts], common, owner[starts], last[ends - 1]
        self.root = np.searchsorted(owner, group)
        self.rows = np.bincount(self.root, minlength=len(owner))[self.root] if n else np.zeros(0, np.int64)

    def search(self, begin: int, end: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, later row) within ``limit`` bits, for the queries at ``begin`` to before ``end``."""
        query = np.arange(begin, end)
        node = self.root[begin:end]
        spent = np.zeros(end - begin, dtype=np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            value, mask, last, _ = self.levels[depth]
            spent = spent + np.bitwise_count((self.fp[query] ^ value[node]) & mask[node])
            live = (spent <= limit) & (last[node] > query)
            query, node, spent = query[live], node[live], spent[live]
            if depth:
                starts, ends = self.levels[depth - 1][3]
                low, many = starts[node], ends[node] - starts[node]
                query, spent = np.repeat(query, many), np.repeat(spent, many)
                node = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        return query, node

    def forest(self, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, root) of a spanning forest of all links, as places in the arrays given."""
        n = len(self.fp)
        label = np.arange(n)
        begin = 0
        cost = np.cumsum(self.rows)
        while begin < n:
            base = cost[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(cost, base + FRONTIER, side="right")))
            label = join_labels(label, *self.search(begin, end, limit))
            begin = end
        moved = np.flatnonzero(label != np.arange(n))
        return self.source[moved], self.source[label[moved]]


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest label of each component after linking rows ``a`` and ``b``."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        least = np.minimum(la, lb)
        label = label.copy()
        np.minimum.at(label, la, least)
        np.minimum.at(label, lb, least)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


# --- dealing ----------------------------------------------------------------------------------------------------------


def masks(parts: int, max_bits: int) -> list[int]:
    """Bit masks of which two fingerprints within ``max_bits`` bits agree on at least one: all but ``max_bits`` of
    ``parts`` runs of bits, in every choice."""
    cuts = [round(i * BITS / parts) for i in range(parts + 1)]
    runs = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(kept) for kept in combinations(runs, parts - max_bits)]


def _dealt(rows: DataFrame, parts: int, max_bits: int) -> DataFrame:
    """Each fingerprint once for each mask; ``key`` holds the mask's number and the bits under it."""
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks(parts, max_bits)]
    listed = F.array(*[F.lit(m).cast("bigint") for m in signed])
    dealt = rows.select("fp", F.posexplode(listed).alias("path", "mask"))
    return dealt.select("fp", "path", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def links(distinct: DataFrame, max_bits: int = MAX_BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(u, v) pairs of fingerprints that connect all of column ``fp`` (distinct, no null) within ``max_bits`` bits.

    Groups of more than ``group_rows`` are not searched; their fingerprints are dealt again by more and smaller runs
    of bits. Once the runs left open have 13 bits in all, no group can have over 8192 rows, and all are searched.
    """
    found, rows, parts = None, distinct.select("fp"), max_bits + 1
    while True:
        dealt = written(_dealt(rows, parts, max_bits))
        sizes = written(dealt.groupBy("path", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1))
        last = -(-BITS // parts) * max_bits <= 13
        small = sizes if last else sizes.where(F.col("n") <= group_rows)
        total = small.agg(F.sum("n")).first()[0]
        own = _search(dealt.join(small.select("path", "key"), ["path", "key"]), int(total or 0), max_bits)
        found = own if found is None else found.unionByName(own)
        large = sizes.where(F.col("n") > group_rows).select("path", "key")
        if last or large.isEmpty():
            return found
        rows = dealt.join(large, ["path", "key"]).select("fp").distinct()
        parts += 1


def _search(groups: DataFrame, rows: int, max_bits: int) -> DataFrame:
    buckets = max(1, -(-rows // BUCKET_ROWS)) * 4

    def bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        group = pdf["key"].to_numpy() * np.int64(1021) + pdf["path"].to_numpy()
        fp = pdf["fp"].to_numpy()
        a, b = GrayIndex(group, fp.view(np.uint64)).forest(max_bits)
        return pd.DataFrame({"u": fp[a], "v": fp[b]})

    placed = groups.withColumn("bucket", F.pmod(F.xxhash64("path", "key"), F.lit(buckets)))
    return placed.groupBy("bucket").applyInPandas(bucket, "u bigint, v bigint")


# --- the operator -----------------------------------------------------------------------------------------------------


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One row per document: its id, ``fingerprint`` and ``component_id``, the smallest id that links reach from it.

    All documents without words have fingerprint zero and are linked like any other. Rows with equal ids stay separate
    rows. A null id gets the smallest id of its component, and null where the component has no other.
    """
    own = written(fingerprints(docs.select(F.col(doc_id), F.col(text)), text, shingle).select(doc_id, "fp"))
    distinct = written(own.groupBy("fp").agg(F.min(doc_id).alias("least")))
    linked = components(links(distinct, max_bits, group_rows))
    nodes = linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct())
    nodes = written(nodes.join(distinct, nodes.node == distinct.fp).select("fp", "root", "least"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component"))
    reached = nodes.join(least, "root").select("fp", "component")
    named = distinct.join(reached, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    return own.join(named, "fp").select(doc_id, hex_digits(F.col("fp")).alias("fingerprint"), "component_id")

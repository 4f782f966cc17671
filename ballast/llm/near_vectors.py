"""Near-duplicates of embeddings by collision-counting projections.

Unit vectors are projected on many random lines. On a line, a vector collides with those whose projections lie in a
window centred at its own. The difference of two projections is normal, with the vectors' distance as its deviation, so
pairs at the least similarity collide on a line with a known chance, and the number of lines they collide on is
binomial. The count a pair must reach is the largest that such pairs reach with probability ``recall``; more similar
pairs reach it oftener. Pairs that reach it are verified by their cosine in double precision.

1. Equal vectors of a label are folded to one row with a number of copies.
2. Rows are sorted by label and by which quarter of a line they lie in, line after line, and packed in blocks of rows
   near each other. Each block carries its rows sorted along every line, the ends of its span on each line, and the
   links among its own rows.
3. Blocks of one label meet in pairs. A pair is left out where the spans lie more than a window apart on more lines than
   a pair of rows may miss, as none of its rows could reach the count. Each remaining pair of blocks is one small group:
   windows are looked up in the sorted lines and collisions counted for all rows of both, line after line; pairs of rows
   that can no longer reach the count are dropped on the way.
4. A pair of blocks gives each row's number of links and a spanning forest between the blocks' own components, never the
   pairs themselves. Components of all forests follow by star contraction.

On data without clusters no method of one-dimensional windows prunes more than a share of the pairs, as windows wide
enough for close pairs hold a fixed share of all rows; the work inside a label then grows with its square, in groups of
bounded size that any number of tasks can take.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.llm.components import components
from ballast.llm.embeddings import free_names, matrix, sound
from ballast.llm.simhash import join_labels
from ballast.operators.skew import ROWS_PER_TASK, hot_keys, join_hot, join_spread
from ballast.session import written

COSINE = 0.93
LINES = 32
WINDOW = 2.5
RECALL = 0.999
BLOCK_ROWS = 2048
TILE = 512
SEED = 11
QUARTER_LINES = 12
QUARTERS = (-0.6745, 0.0, 0.6745)
DENSE = 12
SOME_PAIRS = 1 << 15
META_ROWS_PER_TASK = 512
BLOCKS_PER_TASK = 64

BLOCK = "label string, rows int, low array<float>, high array<float>, data array<binary>"
FOUND = "u bigint, u_least bigint, links bigint, v bigint, v_least bigint"


def lines(dim: int, number: int = LINES, seed: int = SEED) -> np.ndarray:
    """Directions of the lines, as columns; a difference of unit vectors projects on them with its length as deviation."""
    return np.random.default_rng([seed, dim]).standard_normal((dim, number))


def window_width(cosine: float, window: float = WINDOW) -> float:
    """Half a window: ``window`` deviations of pairs at the least similarity."""
    return window * sqrt(2 - 2 * cosine)


def least_count(number: int, window: float, recall: float) -> int:
    """The largest count that pairs at the least similarity reach with probability ``recall`` at least."""
    hit = erf(window / sqrt(2))
    reached = 0.0
    for count in range(number, -1, -1):
        reached += comb(number, count) * hit**count * (1 - hit) ** (number - count)
        if reached >= recall:
            return count
    return 0


class Rules:
    """What decides a link."""

    def __init__(self, cosine: float, number: int, window: float, recall: float):
        self.cosine, self.number = cosine, number
        self.width = np.float32(window_width(cosine, window))
        self.misses = number - least_count(number, window, recall)


class Block:
    """Some rows of a label: unit vectors, projections, and both sorted along every line."""

    ARRAYS = {
        "ids": np.int64, "least": np.int64, "named": np.bool_, "copies": np.int64, "root": np.int32, "links": np.int64,
        "unit": np.float64, "place": np.float32, "order": np.int32,
    }

    def __init__(self, ids, least, named, copies, unit, place):
        self.ids, self.least, self.named, self.copies, self.unit, self.place = ids, least, named, copies, unit, place
        self.order = np.argsort(place, axis=0, kind="stable").astype(np.int32)
        self.root = np.arange(len(ids), dtype=np.int32)
        self.links = np.zeros(len(ids), dtype=np.int64)

    def pack(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, a), dtype=t).tobytes() for a, t in self.ARRAYS.items()]

    @classmethod
    def unpack(cls, data: list[bytes]) -> Block:
        out = cls.__new__(cls)
        for (name, kind), raw in zip(cls.ARRAYS.items(), data):
            setattr(out, name, np.frombuffer(raw, dtype=kind))
        n = len(out.ids)
        for name in ("unit", "place", "order"):
            setattr(out, name, getattr(out, name).reshape(n, -1))
        return out


def collisions(a: Block, begin: int, end: int, b: Block, line: int, width: np.float32) -> np.ndarray:
    """Which rows of ``b`` lie in the windows centred at the rows of ``a`` from ``begin`` to before ``end``."""
    order = b.order[:, line]
    along = b.place[order, line]
    own = a.place[begin:end, line]
    first, last = np.searchsorted(along, own - width, "left"), np.searchsorted(along, own + width, "right")
    edge = np.zeros((end - begin, len(along) + 1), dtype=np.int8)
    rows = np.arange(end - begin)
    np.add.at(edge, (rows, first), 1)
    np.add.at(edge, (rows, last), -1)
    out = np.empty((end - begin, len(along)), dtype=np.int8)
    out[:, order] = np.cumsum(edge[:, :-1], axis=1, dtype=np.int8)
    return out


def linked(a: Block, b: Block, rules: Rules) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of ``a``, row of ``b``) that are links, some at a time; of a block with itself each pair once."""
    dense = min(DENSE, rules.number)
    for begin in range(0, len(a.ids), TILE):
        end = min(begin + TILE, len(a.ids))
        count = np.zeros((end - begin, len(b.ids)), dtype=np.int8)
        for line in range(dense):
            count += collisions(a, begin, end, b, line, rules.width)
        if a is b:
            count[np.arange(begin, end)[:, None] >= np.arange(len(b.ids))] = -1
        i, j = np.nonzero(count >= dense - rules.misses) if dense > rules.misses else np.nonzero(count >= 0)
        count = count[i, j]
        for line in range(dense, rules.number):
            count = count + (np.abs(a.place[begin + i, line] - b.place[j, line]) <= rules.width)
            on = count >= line + 1 - rules.misses
            i, j, count = i[on], j[on], count[on]
        for at in range(0, len(i), SOME_PAIRS):
            x, y = begin + i[at : at + SOME_PAIRS], j[at : at + SOME_PAIRS]
            near = np.einsum("ij,ij->i", a.unit[x], b.unit[y]) >= rules.cosine
            if near.any():
                yield x[near], y[near]


def _project(batches: Iterator[pa.RecordBatch], number: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Classes with their unit vectors, projections, and quarters along the first lines as digits of a code."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == dim))
            x = matrix(part.column("v"), dim)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            place = (unit @ lines(dim, number, seed)).astype(np.float32)
            digits = np.searchsorted(QUARTERS, place[:, :QUARTER_LINES])
            code = digits @ (4 ** np.arange(digits.shape[1])[::-1])
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in ("label", "class", "least", "copies")]
                + [pa.array(code.astype(np.int64)), pa.array(place[:, 0])]
                + [pa.array([r.tobytes() for r in m], pa.binary()) for m in (unit, place)],
                names=["label", "class", "least", "copies", "code", "first", "unit", "place"],
            )


def _pack(batches: Iterator[pa.RecordBatch], rules: Rules, block_rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows that follow each other, with the links inside each."""
    held: list[pa.RecordBatch] = []

    def block() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        n = len(table)
        least = table["least"]
        unit, place = (
            np.frombuffer(b"".join(table[c].to_pylist()), dtype=t).reshape(n, -1)
            for c, t in (("unit", np.float64), ("place", np.float32))
        )
        own = Block(
            table["class"].to_numpy(), least.fill_null(0).to_numpy(), least.is_valid().to_numpy(),
            table["copies"].to_numpy(), unit, place,
        )
        root = np.arange(n)
        for i, j in linked(own, own, rules):
            own.links += np.bincount(i, own.copies[j], n).astype(np.int64)
            own.links += np.bincount(j, own.copies[i], n).astype(np.int64)
            root = join_labels(root, i, j)
        own.root = root
        values = [table["label"][0].as_py()], [n], [place.min(axis=0)], [place.max(axis=0)], [own.pack()]
        kinds = pa.string(), pa.int32(), pa.list_(pa.float32()), pa.list_(pa.float32()), pa.list_(pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(values, kinds)], names=["label", "rows", "low", "high", "data"]
        )

    for batch in batches:
        labels = np.array(batch.column("label").to_pylist(), dtype=object)
        cuts = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist(), len(labels)]
        for begin, end in zip(cuts, cuts[1:]):
            while begin < end:
                if held and held[0].column("label")[0].as_py() != labels[begin]:
                    yield block()
                    held = []
                room = min(end - begin, block_rows - sum(h.num_rows for h in held))
                held.append(batch.slice(begin, room))
                begin += room
                if sum(h.num_rows for h in held) == block_rows:
                    yield block()
                    held = []
    if held:
        yield block()


def _found(u: Block, row: np.ndarray, links: np.ndarray) -> list[pa.Array]:
    least = pa.array(u.least[row], mask=~u.named[row])
    return [pa.array(u.ids[row]), least, pa.array(links, pa.int64()), pa.nulls(len(row), pa.int64()), pa.nulls(len(row), pa.int64())]


def _edges(u: Block, i: np.ndarray, v: Block, j: np.ndarray) -> list[pa.Array]:
    least = [pa.array(b.least[row], mask=~b.named[row]) for b, row in ((u, i), (v, j))]
    return [pa.array(u.ids[i]), least[0], pa.nulls(len(i), pa.int64()), pa.array(v.ids[j]), least[1]]


NAMES = ["u", "u_least", "links", "v", "v_least"]


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the blocks already know: their rows' numbers of links, and forests of their own components."""
    for batch in batches:
        for data in batch.column("data").to_pylist():
            own = Block.unpack(data)
            some = np.flatnonzero(own.links)
            yield pa.RecordBatch.from_arrays(_found(own, some, own.links[some]), names=NAMES)
            moved = np.flatnonzero(own.root != np.arange(len(own.root)))
            yield pa.RecordBatch.from_arrays(_edges(own, moved, own, own.root[moved]), names=NAMES)


def _between(table: pa.Table, rules: Rules) -> pa.Table:
    """Links between the two blocks of a pair."""
    a, b = (Block.unpack(d) for _, d in sorted(zip(table["block"].to_pylist(), table["data"].to_pylist())))
    n, m = len(a.ids), len(b.ids)
    of_a, of_b = np.zeros(n), np.zeros(m)
    joined = np.arange(n + m)
    for i, j in linked(a, b, rules):
        of_a += np.bincount(i, b.copies[j], n)
        of_b += np.bincount(j, a.copies[i], m)
        joined = join_labels(joined, a.root[i].astype(np.int64), n + b.root[j].astype(np.int64))
    out = [_found(u, np.flatnonzero(links), links[links > 0].astype(np.int64)) for u, links in ((a, of_a), (b, of_b))]
    moved = np.flatnonzero(joined != np.arange(n + m))
    to = joined[moved]
    for u, row, v, root in ((a, moved < n, a, to < n), (b, moved >= n, a, to < n), (b, moved >= n, b, to >= n)):
        own = row & root
        out.append(_edges(u, moved[own] - (0 if u is a else n), v, to[own] - (0 if v is a else n)))
    return pa.concat_tables([pa.Table.from_arrays(arrays, names=NAMES) for arrays in out])


def _classes(rows: DataFrame) -> DataFrame:
    """Distinct vectors of each label: a number, the copies' count and least id, and the vector."""
    folded = rows.groupBy("label", "dim", "h1", "h2").agg(
        F.first("v").alias("v"), F.count("*").alias("copies"), F.min("id").alias("least")
    )
    return written(folded.withColumn("class", F.monotonically_increasing_id()))


def _block_pairs(blocks: DataFrame, rules: Rules) -> DataFrame:
    """(a, b) of the blocks of one label that are not too far apart on too many lines."""
    meta = blocks.select("label", "block", "low", "high")
    other = meta.select("label", *[F.col(c).alias(f"b_{c}") for c in ("block", "low", "high")])
    met = join_hot(meta, other, ["label"], "inner", rows_per_task=META_ROWS_PER_TASK).where(F.col("block") < F.col("b_block"))
    width = F.lit(float(rules.width)) * (1 + 1e-6)
    spans = F.arrays_zip("low", "high", "b_low", "b_high")
    apart = F.filter(spans, lambda s: (s["b_low"] - s["high"] > width) | (s["low"] - s["b_high"] > width))
    return met.where(F.size(apart) <= rules.misses).select(F.col("block").alias("a"), F.col("b_block").alias("b"))


def near_duplicates(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE,
    number: int = LINES, window: float = WINDOW, recall: float = RECALL, block_rows: int = BLOCK_ROWS, seed: int = SEED,
) -> DataFrame:
    """The input's rows with ``n_links``, the number of other rows linked to each, ``component_id``, the smallest id
    that links reach from it, itself included, and ``kept``, whether that is its own.

    Rows link whose labels are equal and whose vectors have a cosine of ``cosine`` or more; links are found with
    probability ``recall`` or more each, the random lines being drawn once for ``seed``. Rows without a label, and
    vectors that are null, zero, or hold a null or non-finite component link with nothing; vectors of unequal length do
    not link. Repeated rows link with each other. Rows with equal ids are rows of their own; one without an id counts as
    a link, and its component's id is the least there is, null if none. A row without links is its own component. An
    empty table gives an empty result; columns of the input with the names of these columns are replaced.
    """
    added = ["n_links", "component_id", "kept"]
    rest = rows.drop(*added)
    h1, h2, key, dim = free_names(rest, "h1", "h2", "label_key", "dim")
    some = F.exists(F.col(vector), lambda x: x != 0)
    counts = F.coalesce(F.col(label).isNotNull() & sound(vector) & some, F.lit(False))
    keyed = rest.where(counts).withColumns(
        {h1: F.xxhash64(vector), h2: F.xxhash64(F.lit(1), vector), key: F.col(label).cast("string"), dim: F.size(vector)}
    )
    classes = _classes(
        keyed.select(
            F.col(key).alias("label"), F.col(dim).alias("dim"), F.col(h1).alias("h1"), F.col(h2).alias("h2"),
            F.col(vec_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"),
        )
    )
    rules = Rules(cosine, number, window, recall)
    group = F.concat_ws(":", "dim", "label").alias("label")
    projected = classes.select(group, "dim", "class", "least", "copies", "v").mapInArrow(
        lambda batches: _project(batches, number, seed),
        "label string, class bigint, least bigint, copies bigint, code bigint, first float, unit binary, place binary",
    )
    order = ["label", "code", "first", "class"]
    blocks = projected.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        lambda batches: _pack(batches, rules, block_rows), BLOCK
    )
    blocks = written(blocks.withColumn("block", F.monotonically_increasing_id()))
    pairs = written(_block_pairs(blocks, rules))
    sent = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("block"))
    sent = join_hot(sent, blocks.select("block", "data"), ["block"], "inner", rows_per_task=BLOCKS_PER_TASK)
    between = sent.groupBy("a", "b").applyInArrow(lambda table: _between(table, rules), FOUND)
    found = written(blocks.select("data").mapInArrow(_within, FOUND).unionByName(between))

    links = found.where(F.col("links").isNotNull()).groupBy(F.col("u").alias("class")).agg(F.sum("links").alias("links"))

    def node(side: str) -> Column:
        least = F.col(f"{side}_least")
        return F.struct(least.isNull().alias("nameless"), F.coalesce(least, F.lit(0)).alias("id"), F.col(side).alias("class"))

    edges = found.where(F.col("v").isNotNull()).select(node("u").alias("u"), node("v").alias("v"))
    roots = components(edges).select(F.col("node.class").alias("class"), F.col("root").alias("root"))
    answers = classes.drop("v").join(links, "class", "left").join(roots, "class", "left")
    component = F.when(F.col("root").isNull(), F.col("least")).otherwise(F.when(~F.col("root.nameless"), F.col("root.id")))
    answers = written(
        answers.select(
            F.col("label").alias(key), F.col("dim").alias(dim), F.col("h1").alias(h1), F.col("h2").alias(h2), "copies",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), component.alias("component_id"),
        )
    )
    on = [key, dim, h1, h2]
    hot = hot_keys(answers, on, ROWS_PER_TASK, weight=F.col("copies"))
    held = join_spread(keyed, answers.drop("copies"), on, hot, "inner")
    kept = F.col("component_id").eqNullSafe(F.col(vec_id)).alias("kept")
    alone = rest.where(~counts).select("*", F.lit(0).cast("bigint").alias("n_links"), F.col(vec_id).alias("component_id"))
    return held.select(*rest.columns, "n_links", "component_id").unionByName(alone).select("*", kept)

"""Ordered scans over groups of any size.

A window function partitioned by a key sends all rows of that key to one task, so a single key holding a third of
the table would decide the run time of the job. Where a key is that large, the scans here cut the order axis into at
most ``MAX_BLOCKS`` balanced blocks first. Each (key, block) is scanned by an ordinary window; one small row per
(key, block) carries what the rows before (or after) that block contribute. Results equal the plain window's.

Blocks are cut at quantiles of a sample and applied with ``Bucketizer``, a binary search inside the JVM. A table whose
largest key fits a task gets no block column, and the scans fall back to plain windows, which cost one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast.session import written

ROWS_PER_BLOCK = 1 << 21
MAX_BLOCKS = 1 << 18
SAMPLES_PER_BLOCK = 200
BLOCK = "_block"
_POSITION = "_position"


def split_points(
    df: DataFrame,
    keys: Sequence[str],
    order: Column,
    rows_per_block: int = ROWS_PER_BLOCK,
    max_blocks: int = MAX_BLOCKS,
) -> list[float]:
    """Positions along ``order`` that cut the table into balanced blocks; none when no key needs more than one.

    ``keys`` may be coarser than those of the scans to come. Counting keys combines before its shuffle, and only the
    largest count and the sample's quantiles come to the driver.
    """
    total = df.count()
    if total <= rows_per_block:
        return []
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    if sizes.agg(F.max("_rows")).first()[0] <= rows_per_block:
        return []
    wanted = min(max_blocks, -(-total // rows_per_block))
    fractions = [i / wanted for i in range(1, wanted)]
    placed = df.select(order.cast("double").alias(_POSITION))
    share = max(wanted * SAMPLES_PER_BLOCK, 20_000) / total
    sample = placed.sample(share, seed=7) if share < 1 else placed
    return sorted(set(sample.approxQuantile(_POSITION, fractions, 0.25 / wanted)))


def cut(df: DataFrame, order: Column, points: Sequence[float]) -> DataFrame:
    """Add the block number of each row for given split points.

    Equal positions share a block and block numbers never fall as the position grows, which is all the scans need. As
    in a sort, null positions come first, in a block of their own, and NaN comes last.
    """
    if not points:
        return df
    splits = [float("-inf"), *points, float("inf")]
    at = order.cast("double")
    placed = df.withColumn(_POSITION, F.coalesce(F.when(F.isnan(at), F.lit(float("inf"))).otherwise(at), F.lit(0.0)))
    blocked = Bucketizer(splits=splits, inputCol=_POSITION, outputCol=BLOCK).transform(placed)
    return blocked.withColumn(BLOCK, F.when(at.isNull(), -1).otherwise(F.col(BLOCK)).cast("int")).drop(_POSITION)


def with_blocks(df: DataFrame, keys: Sequence[str], order: Column, **blocking: int) -> DataFrame:
    """Add the block number of each row along ``order``, a numeric column that leads the scans' sort order."""
    return df if BLOCK in df.columns else cut(df, order, split_points(df, keys, order, **blocking))


def drop_blocks(df: DataFrame) -> DataFrame:
    return df.drop(BLOCK)


def settled(df: DataFrame) -> DataFrame:
    """Rows ahead of another scan. A table in blocks is read twice by it, so what led here is written down first."""
    return written(df) if BLOCK in df.columns else df


def _carry(df: DataFrame, keys: Sequence[str], per_block: DataFrame, names: Sequence[str]) -> DataFrame:
    """Join one row per (key, block) to the rows; null keys are keys, as they are in a window."""
    on = [*keys, BLOCK]
    edge = per_block.select(*[F.col(k).alias(f"_on_{k}") for k in on], *names)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in on])
    return df.join(edge, same, "left").drop(*[f"_on_{k}" for k in on])


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums of ``sums`` per key, in ``order``."""
    if BLOCK not in df.columns:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: F.sum(value).over(w) for name, value in sums.items()})
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy(*keys, BLOCK).agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in sums.items()])
    blocks = blocks.withColumns({f"_sum_{n}": F.sum(f"_sum_{n}").over(before) for n in sums})
    local = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = _carry(df, keys, blocks, [f"_sum_{n}" for n in sums])
    return joined.withColumns(
        {n: F.sum(v).over(local) + F.coalesce(F.col(f"_sum_{n}"), F.lit(0)) for n, v in sums.items()}
    ).drop(*[f"_sum_{n}" for n in sums])


def floored_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], delta: Column, out: str) -> DataFrame:
    """Running sum of ``delta`` that never falls below zero: a step that would is cut off there.

    With S the plain running sum, the value is ``S - min(0, lowest S so far)``. ``<out>_before`` is the value ahead
    of each row.
    """
    many = BLOCK in df.columns
    w = Window.partitionBy(*keys, *([BLOCK] if many else [])).orderBy(*order)
    local = df.withColumn("_delta", delta)
    local = local.withColumn("_s", F.sum("_delta").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    local = local.withColumns(
        {
            "_low": F.min("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "_low_before": F.min("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    base, floor = F.lit(0), F.lit(0)
    if many:
        before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        blocks = local.groupBy(*keys, BLOCK).agg(F.sum("_delta").alias("_total"), F.min("_s").alias("_lowest"))
        blocks = blocks.withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        blocks = blocks.withColumn("_floor", F.least(F.lit(0), F.min(F.col("_base") + F.col("_lowest")).over(before)))
        local = _carry(local, keys, blocks, ["_base", "_floor"])
        base, floor = F.col("_base"), F.col("_floor")
    now, was = base + F.col("_s"), base + F.col("_s") - F.col("_delta")
    return local.withColumns(
        {
            out: now - F.least(floor, F.lit(0), base + F.col("_low")),
            f"{out}_before": was - F.least(floor, F.lit(0), base + F.col("_low_before")),
        }
    ).drop("_delta", "_s", "_low", "_low_before", "_base", "_floor")


def nearest(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    after: bool = False,
    base: DataFrame | None = None,
) -> DataFrame:
    """The closest non-null value strictly before (or after) each row, per key, for every entry of ``values``.

    Looking forward reverses the sort instead of using a frame that ends at the last row: Spark walks such a frame
    again for each row. ``base`` is the same rows before earlier scans, from which the blocks' edges are cheaper.
    """

    def sort(cols: Sequence[str]) -> list[Column]:
        return [F.col(c).desc() if after else F.col(c).asc() for c in cols]

    if BLOCK not in df.columns:
        w = Window.partitionBy(*keys).orderBy(*sort(order)).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({n: F.last(v, ignorenulls=True).over(w) for n, v in values.items()})
    outer = Window.partitionBy(*keys).orderBy(*sort([BLOCK])).rowsBetween(Window.unboundedPreceding, -1)
    pick = F.min_by if after else F.max_by
    place = F.struct(*order)
    blocks = (df if base is None else base).groupBy(*keys, BLOCK).agg(
        *[pick(v, F.when(v.isNotNull(), place)).alias(f"_edge_{n}") for n, v in values.items()]
    )
    blocks = blocks.withColumns({f"_edge_{n}": F.last(f"_edge_{n}", ignorenulls=True).over(outer) for n in values})
    local = Window.partitionBy(*keys, BLOCK).orderBy(*sort(order)).rowsBetween(Window.unboundedPreceding, -1)
    joined = _carry(df, keys, blocks, [f"_edge_{n}" for n in values])
    return joined.withColumns(
        {n: F.coalesce(F.last(v, ignorenulls=True).over(local), F.col(f"_edge_{n}")) for n, v in values.items()}
    ).drop(*[f"_edge_{n}" for n in values])

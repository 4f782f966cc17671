"""Taking in a backlog in bounded batches along its order, for tables that advance by batches.

A stream over files takes them as old as they are on disk, so a backlog written in any other order than its events' makes
rows late or needs one batch for everything. Here the order column is cut at quantiles into ranges of about equal
numbers of rows, and each range is a batch: the scan's filter leaves out the files and row groups whose statistics lie
outside it. Rows then come in order, whatever file they are in, and no batch exceeds what a cluster should hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_BATCH = 50_000_000
MAX_BATCHES = 10_000


def ranges(
    table: DataFrame, order: str, rows_per_batch: int = ROWS_PER_BATCH, least_batches: int = 1, max_batches: int = MAX_BATCHES
) -> list[Column]:
    """Conditions on ``order``, a number or a time, that split the rows into batches in its order; nulls come first.

    There are ``least_batches`` at least, as far as values differ, and ``max_batches`` at most, which then are larger.
    Equal values share a batch. Only the number of rows and the cuts come to the driver.
    """
    kind = table.schema[order].dataType
    total = table.count()
    wanted = min(max_batches, max(least_batches, -(-total // rows_per_batch)))
    at = F.unix_micros(F.col(order).cast("timestamp")) if kind.typeName().startswith("timestamp") else F.col(order)
    shares = F.array(*[F.lit(i / wanted) for i in range(1, wanted)])
    cuts = table.agg(F.percentile_approx(at, shares, F.lit(20 * wanted))).first()[0] if wanted > 1 else []
    cuts = sorted(set(cuts or []))
    as_value = (lambda v: F.timestamp_micros(F.lit(v)).cast(kind)) if kind.typeName().startswith("timestamp") else (lambda v: F.lit(v).cast(kind))
    out, col = [], F.col(order)
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = F.lit(True) if high is None else col < as_value(high)
        if low is not None:
            part = part & (col >= as_value(low))
        elif high is not None:
            part = part | col.isNull()
        out.append(part)
    return out


def backfill(table: DataFrame, order: str, advance: Callable[[DataFrame, int], None], first_batch: int = 0, **limits: int) -> int:
    """Give ``advance`` a finished table in batches along ``order``, numbered from ``first_batch``; returns how many."""
    parts = ranges(table, order, **limits)
    for number, part in enumerate(parts, start=first_batch):
        advance(table.where(part), number)
    return len(parts)

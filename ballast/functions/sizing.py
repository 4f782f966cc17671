"""Sizes of tensors, allocations and devices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ballast.fixed_values import BUFFER_HEADROOM, DEFAULT_GRANULE, DEFAULT_STAGE_BYTES, ITEM_SIZES
from ballast.functions.literals import lookup
from ballast.functions.naming import is_sharded


def whole_div(a: Column, b: Column | int) -> Column:
    """Integer quotient without a detour over doubles; null for a zero divisor."""
    divisor = F.lit(b).cast("bigint") if isinstance(b, int) else F.nullif(b.cast("bigint"), F.lit(0).cast("bigint"))
    return F.call_function("div", a, divisor)


def itemsize(dtype: Column) -> Column:
    """Bytes per element; null for an unknown dtype."""
    return lookup(ITEM_SIZES, dtype, "int")


def numel(shape: Column) -> Column:
    """Element count of a shape; a scalar's empty shape counts one."""
    return F.aggregate(shape, F.lit(1).cast("bigint"), lambda acc, x: acc * x.cast("bigint"))


def nbytes(dtype: Column, shape: Column) -> Column:
    return numel(shape) * itemsize(dtype)


def align_up(size: Column, granule: Column | None = None) -> Column:
    """Smallest multiple of the granule that holds ``size``; an unknown granule is 2 MiB."""
    g = F.lit(DEFAULT_GRANULE).cast("bigint") if granule is None else F.coalesce(granule, F.lit(DEFAULT_GRANULE))
    over = size % g
    return F.when(over == 0, size).otherwise(size - over + g)


def size_or_default(size: Column) -> Column:
    return F.coalesce(F.nullif(size, F.lit(0).cast("bigint")), F.lit(DEFAULT_STAGE_BYTES).cast("bigint"))


def headroom_bytes(total: Column) -> Column:
    return (total * F.lit(BUFFER_HEADROOM)).cast("bigint")


def gpu_for_shard(shard_index: Column, total_shards: Column, gpu_count: Column) -> Column:
    """Device that holds a shard; unsharded buffers and nodes of unknown device count use device 0."""
    spread = F.when(gpu_count > 0, shard_index % gpu_count)
    return F.when(is_sharded(shard_index, total_shards), F.coalesce(spread, F.lit(0))).otherwise(F.lit(0))

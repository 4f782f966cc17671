"""Tensor catalogs: sizes, offsets in the flat buffer, capacity and array checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.functions import headroom_bytes, nbytes, numel
from ballast.operators.blocks import drop_blocks, running_sum, with_blocks


def with_sizes(tensors: DataFrame) -> DataFrame:
    """Add ``numel`` and ``nbytes`` from dtype and shape."""
    return tensors.withColumns(
        {"numel": numel(F.col("shape")), "nbytes": nbytes(F.col("dtype"), F.col("shape"))}
    )


def model_size(tensors: DataFrame) -> DataFrame:
    """Per buffer: tensor count, elements, bytes and the size of a buffer created for it."""
    total = F.sum("nbytes")
    return tensors.groupBy("buffer_id").agg(
        F.count("*").alias("tensors"),
        F.sum("numel").alias("params"),
        total.alias("total_bytes"),
        headroom_bytes(total).alias("buffer_bytes"),
    )


def pack_offsets(tensors: DataFrame, order: Sequence[str] = ("ordinal",), **blocking: int) -> DataFrame:
    """Add each tensor's ``position`` and byte ``offset``: tensors lie back to back in ``order``, without padding.

    The first order column must be numeric and close to unique within a buffer; it is what large buffers are cut by.
    """
    blocked = with_blocks(tensors, ["buffer_id"], F.col(order[0]), **blocking)
    summed = running_sum(
        blocked, ["buffer_id"], order, {"_through": F.col("nbytes"), "_count": F.lit(1).cast("bigint")}
    )
    return drop_blocks(
        summed.withColumns({"offset": F.col("_through") - F.col("nbytes"), "position": F.col("_count") - 1})
    ).drop("_through", "_count")


def pack_overflow(packed: DataFrame, capacity: Column) -> DataFrame:
    """First tensor of each buffer that would end past ``capacity``, with the offset reached before it."""
    over = packed.where(F.col("offset") + F.col("nbytes") > capacity).withColumn("capacity", capacity)
    first = F.min_by(F.struct("name", "offset", "nbytes", "capacity"), F.struct("offset", "position")).alias("_first")
    return over.groupBy("buffer_id").agg(first).select("buffer_id", "_first.*")


def check_parallel_arrays(update_info: DataFrame) -> DataFrame:
    """Reason an update's parallel arrays disagree in length, null when they agree."""
    names = F.size("names")

    def reason(column: str) -> tuple[Column, Column]:
        text = F.format_string(f"`{column}` should be of the same size as `names`: %d vs %d", F.size(column), names)
        return F.size(column) != names, text

    checks = [reason(c) for c in ("dtype_names", "shapes", "offsets")]
    return update_info.withColumn("reason", F.coalesce(*[F.when(bad, text) for bad, text in checks]))

"""Transfer rates. Rates are GiB per second although logs label them GB/s."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ballast.fixed_values import GIB


def throughput_gbps(size: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, size / F.lit(float(GIB)) / seconds).otherwise(F.lit(0.0))


def pct_of_line_rate(rate: Column, line_rate: Column) -> Column:
    return rate / line_rate * F.lit(100.0)


def received_bytes(mode: Column, size: Column, shard_length: Column) -> Column:
    """Bytes one receiver takes in: its own slice under SCATTER when it has one, else the whole buffer."""
    return F.when((mode == "SCATTER") & (F.coalesce(shard_length, F.lit(0)) > 0), shard_length).otherwise(size)


def logged_bytes(mode: Column, size: Column, lengths: Column | None = None) -> tuple[Column, Column]:
    """Bytes the sender's log counts (always the whole buffer) and bytes it really sends under SCATTER."""
    if lengths is None:
        return size, size
    sent = F.aggregate(lengths, F.lit(0).cast("bigint"), lambda acc, x: acc + x.cast("bigint"))
    return size, F.when((mode == "SCATTER") & (F.size(lengths) > 0), sent).otherwise(size)

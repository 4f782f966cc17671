"""Scalar functions: plain Column in, Column out."""

from ballast.functions.naming import (
    base_buffer_id,
    effective_buffer_id,
    is_sharded,
    shard_file_name,
    shard_from_annotations,
)
from ballast.functions.quantity import parse_quantity
from ballast.functions.rates import logged_bytes, pct_of_line_rate, received_bytes, throughput_gbps
from ballast.functions.sizing import (
    align_up,
    gpu_for_shard,
    headroom_bytes,
    itemsize,
    nbytes,
    numel,
    size_or_default,
    whole_div,
)

__all__ = [
    "align_up",
    "base_buffer_id",
    "effective_buffer_id",
    "gpu_for_shard",
    "headroom_bytes",
    "is_sharded",
    "itemsize",
    "logged_bytes",
    "nbytes",
    "numel",
    "parse_quantity",
    "pct_of_line_rate",
    "received_bytes",
    "shard_file_name",
    "shard_from_annotations",
    "size_or_default",
    "throughput_gbps",
    "whole_div",
]

"""Ids and names of buffers, shards and shard files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ballast.fixed_values import RANK_ANNOTATIONS, SHARD_FILE_FORMAT, SHARD_MARK


def is_sharded(shard_index: Column, total_shards: Column) -> Column:
    """True for a request that names one shard; the wire default (0, 0) is unsharded."""
    return F.coalesce((shard_index >= 0) & (total_shards > 0), F.lit(False))


def effective_buffer_id(buffer_id: Column, shard_index: Column, total_shards: Column) -> Column:
    sharded = F.concat(buffer_id, F.lit(SHARD_MARK), shard_index.cast("string"))
    return F.when(is_sharded(shard_index, total_shards), sharded).otherwise(buffer_id)


def base_buffer_id(buffer_id: Column) -> Column:
    return F.substring_index(buffer_id, SHARD_MARK, 1)


def shard_file_name(base: Column, index: Column, total: Column) -> Column:
    """Path of shard ``index`` of ``total`` under ``base``; an empty base gives the bare name."""
    name = F.format_string(SHARD_FILE_FORMAT, (index + 1).cast("int"), total.cast("int"))
    joined = F.regexp_replace(F.concat(base, F.lit("/"), name), "/+", "/")
    return F.when(F.coalesce(base, F.lit("")) == "", name).otherwise(joined)


def shard_from_annotations(annotations: Column, keys: Sequence[str] = RANK_ANNOTATIONS) -> Column:
    """Shard number from the first annotation whose value starts with an integer; null when there is none."""
    found = [
        F.regexp_extract(F.try_element_at(annotations, F.lit(key)), r"^[ \t]*([+-]?[0-9]+)", 1).try_cast("bigint")
        for key in keys
    ]
    return F.coalesce(*found)

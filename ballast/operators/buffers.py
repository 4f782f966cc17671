"""Auditing declared buffers: shard discovery, its errors and the resulting conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.fixed_values import (
    MSG_BAD_FORMAT,
    MSG_BAD_SUFFIX,
    MSG_EXCLUSIVE,
    MSG_NO_SOURCE,
    MSG_NUM_SHARDS,
    MSG_READY,
    QUANTITY_FORMAT,
)
from ballast.functions import parse_quantity, shard_file_name, whole_div
from ballast.operators.shards import numbers_below

_SHARD = "struct<index:int,path:string,size_bytes:bigint>"


def _quantity_error(capacity: Column) -> Column:
    reason = F.when(capacity.rlike(QUANTITY_FORMAT), F.lit(MSG_BAD_SUFFIX)).otherwise(F.lit(MSG_BAD_FORMAT))
    return F.concat(F.lit('invalid capacity "'), capacity, F.lit('": '), reason)


def _files() -> Column:
    return F.coalesce(F.col("sharding.shard_files"), F.array())


def _has_pattern() -> Column:
    return F.coalesce(F.col("sharding.file_pattern"), F.lit("")) != ""


def discovery_error() -> Column:
    """Why the shards of a buffer cannot be listed; null when they can."""
    n, files = F.col("sharding.num_shards"), _files()
    capacity = F.coalesce(F.col("capacity"), F.lit(""))
    stray = F.filter(files, lambda f: (f["index"] < 0) | (f["index"] >= n))
    from_files = F.when(
        F.size(files) != n,
        F.format_string("shardFiles count (%d) does not match numShards (%d)", F.size(files), n),
    ).when(
        F.size(stray) > 0, F.format_string("shard index %d out of range [0, %d)", F.get(stray, F.lit(0))["index"], n)
    )
    even = F.when(capacity == "", F.lit(MSG_NO_SOURCE)).when(
        parse_quantity(capacity).isNull(), _quantity_error(capacity)
    )
    return F.when(F.size(files) > 0, from_files).when(~_has_pattern(), even)


def _spec_error() -> Column:
    n = F.col("sharding.num_shards")
    return F.when(n <= 0, F.lit(MSG_NUM_SHARDS)).when((F.size(_files()) > 0) & _has_pattern(), F.lit(MSG_EXCLUSIVE))


def validate_buffers(buffers: DataFrame) -> DataFrame:
    """The ShardingConfigured condition of every buffer, and the Ready condition it ends up with.

    ``ready_reason`` of the input, when there, is a Ready condition the buffer already has and keeps.
    """
    sharded = F.col("sharding").isNotNull()
    n, files = F.col("sharding.num_shards"), _files()
    invalid, failed = F.col("_invalid"), F.col("_failed")
    kept = F.col("ready_reason") if "ready_reason" in buffers.columns else F.lit(None).cast("string")
    checked = buffers.withColumns(
        {
            "_invalid": F.when(sharded, _spec_error()),
            "_failed": F.when(sharded, discovery_error()),
            "_distinct": F.size(F.array_distinct(F.transform(files, lambda f: f["index"]))),
            "_kept": kept,
        }
    )
    ok = sharded & invalid.isNull() & failed.isNull()
    return checked.withColumns(
        {
            "status": F.when(sharded, F.when(ok, F.lit("True")).otherwise(F.lit("False"))),
            "reason": F.when(
                sharded,
                F.when(invalid.isNotNull(), F.lit("InvalidSpec"))
                .when(failed.isNotNull(), F.lit("DiscoveryFailed"))
                .otherwise(F.lit("ShardsDiscovered")),
            ),
            "message": F.when(
                sharded, F.coalesce(invalid, failed, F.format_string("Discovered %d shards", n))
            ),
            "total_shards": F.when(ok, n).otherwise(F.lit(0)),
            "dup_index": ok & (F.col("_distinct") < F.size(files)),
            "ready_status": F.lit("True"),
            "ready_reason": F.coalesce("_kept", F.lit("BufferCreated")),
            "ready_message": F.when(F.col("_kept").isNull(), F.lit(MSG_READY)),
        }
    ).drop("_invalid", "_failed", "_distinct", "_kept")


def discovered_shards(validated: DataFrame) -> DataFrame:
    """One row per shard of every buffer that passed ``validate_buffers``.

    Declared files keep their own index: when one index is named twice the last entry wins and the place left empty
    stays a zero entry. A file pattern divides the capacity evenly and drops the rest; without either, the capacity
    is split to the byte and every shard reads the buffer's own path.

    Shard numbers and declared files are unfolded side by side and meet in one aggregate, as no row can then hold a
    list per shard.
    """
    c, n, i = F.col, F.col("total_shards"), F.col("shard_index")
    zero = F.lit(0).cast("bigint")
    shard = ["namespace", "name", "shard_index"]
    passed = validated.where(n > 0)
    of = F.struct(
        "source_path",
        "total_shards",
        (F.size(_files()) > 0).alias("listed"),
        _has_pattern().alias("pattern"),
        parse_quantity(F.coalesce("capacity", F.lit(""))).alias("bytes"),
    )
    numbers = passed.select("namespace", "name", numbers_below(n).cast("array<int>").alias("_numbers"), of.alias("_of"))
    numbers = numbers.select("namespace", "name", "_of", F.explode("_numbers").alias("shard_index"))
    files = passed.select("namespace", "name", F.posexplode(_files().cast(f"array<{_SHARD}>")).alias("_place", "_file"))
    files = files.select("namespace", "name", c("_file.index").alias("shard_index"), "_place", "_file")
    met = numbers.unionByName(files, allowMissingColumns=True).groupBy(*shard)
    met = met.agg(F.max_by("_file", "_place").alias("_own"), F.any_value("_of", True).alias("_of"))
    met = met.where(c("_of").isNotNull())
    placed = met.select(
        *shard,
        "_own",
        "_of.source_path",
        "_of.total_shards",
        c("_of.listed").alias("_listed"),
        c("_of.pattern").alias("_pattern"),
        c("_of.bytes").alias("_bytes"),
    )
    listed, each = c("_listed"), whole_div(c("_bytes"), n)
    extra = F.when(i < c("_bytes") % n, F.lit(1)).otherwise(F.lit(0))
    return placed.select(
        "namespace",
        "name",
        "shard_index",
        F.when(listed, F.coalesce("_own.index", F.lit(0))).otherwise(i).alias("stored_index"),
        F.when(listed, F.coalesce("_own.path", F.lit("")))
        .when(c("_pattern"), shard_file_name(c("source_path"), i, n))
        .otherwise(c("source_path"))
        .alias("path"),
        F.when(listed, F.coalesce("_own.size_bytes", zero))
        .when(c("_pattern"), F.coalesce(each, zero))
        .otherwise(each + extra)
        .alias("size_bytes"),
    )

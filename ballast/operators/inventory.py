"""Device inventories and their published snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.fixed_values import DEVICE_NAME_PREFIX, MIB, SNAPSHOT_SECONDS
from ballast.operators.conditions import latest_by_key
from ballast.operators.shards import numbers_below


def parse_inventory(raw: DataFrame) -> DataFrame:
    """Device count and memory per node from (node, content), where content is a node's memory report.

    The report has a line per device; the first line's value stands for all of them.
    """
    lines = F.split(F.trim(F.regexp_replace("content", r"^\s+|\s+$", "")), "\n")
    token = F.get(F.split(F.trim(F.get(F.col("_lines"), F.lit(0))), r"\s+"), F.lit(0))
    mib = F.col("_token").try_cast("bigint")
    error = F.when(F.col("_token") == "", F.lit("empty report")).when(
        mib.isNull() | ~F.col("_token").rlike("^[0-9]+$"),
        F.concat(F.lit("failed to parse memory value '"), F.col("_token"), F.lit("'")),
    )
    return (
        raw.withColumn("_lines", lines)
        .withColumn("_token", token)
        .select(
            "node",
            F.size("_lines").alias("gpu_count"),
            (mib * F.lit(MIB).cast("bigint")).alias("memory_bytes"),
            error.alias("error"),
        )
    )


def devices(parsed: DataFrame) -> DataFrame:
    """One row per device of every readable node."""
    names = F.transform(
        numbers_below(F.col("gpu_count")), lambda i: F.concat(F.lit(DEVICE_NAME_PREFIX), i.cast("string"))
    )
    return parsed.where(F.col("error").isNull()).select("node", F.explode(names).alias("device"), "memory_bytes")


def inventory_errors(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNotNull()).select("node", "error")


def node_memory(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNull()).select("node", "gpu_count", "memory_bytes")


def device_snapshots(snapshots: DataFrame, seconds: int = SNAPSHOT_SECONDS) -> DataFrame:
    """Latest readable snapshot, by (ts, seq), per node and publication interval; works on tables and on streams with a watermark."""
    interval = F.window("ts", f"{seconds} seconds")
    return (
        snapshots.where(~F.col("failed"))
        .groupBy("node", interval)
        .agg(F.max_by(F.struct("memory_mib", "seq"), F.struct("ts", "seq")).alias("_last"), F.count("*").alias("reads"))
        .select("node", F.col("window.start").alias("interval_start"), "_last.memory_mib", "_last.seq", "reads")
    )


def upsert_slices(current: DataFrame, updates: DataFrame, order: str = "seq") -> DataFrame:
    """One published slice per node; the latest wins and nodes not updated stay."""
    return latest_by_key(current.unionByName(updates), ["node"], order)

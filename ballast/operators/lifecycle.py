"""Allocation ledgers rebuilt from stage and unstage events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.functions import align_up, effective_buffer_id, gpu_for_shard, size_or_default
from ballast.operators.blocks import drop_blocks, floored_sum, nearest, settled, with_blocks

STAGE, UNSTAGE = "stage", "unstage"
_TARGET = ["effective_id", "shard_index", "total_shards"]


def claim_deltas(lifecycle: DataFrame, expire_seconds: int | None = None) -> DataFrame:
    """Turn events into +1 / -1 on the buffer they touch.

    An unstage names only its claim, so it acts on the buffer of that claim's previous event, provided that was a
    stage. A failed stage still records the claim but adds nothing. Events of one node and claim are ordered by
    ``seq``, which is unique. With ``expire_seconds`` an unstage later than that, by column ``at``, acts on nothing.
    """
    c = F.col
    named = lifecycle.withColumn("effective_id", effective_buffer_id(c("buffer_id"), c("shard_index"), c("total_shards")))
    at = ["at"] if expire_seconds is not None else []
    seen = nearest(named, ["node", "claim"], ["seq"], {"_prev": F.struct("op", *_TARGET, *at)})
    up = (c("op") == STAGE) & c("ok")
    down = (c("op") == UNSTAGE) & F.coalesce(c("_prev.op") == STAGE, F.lit(False))
    if expire_seconds is not None:
        down &= F.coalesce(F.unix_micros("at") - F.unix_micros("_prev.at") <= expire_seconds * 1_000_000, F.lit(True))
    target = {t: F.when(down, c(f"_prev.{t}")).otherwise(c(t)) for t in _TARGET}
    return (
        seen.where(up | down)
        .withColumns({**target, "delta": F.when(up, F.lit(1)).otherwise(F.lit(-1))})
        .drop("_prev")
    )


def refcount_history(lifecycle: DataFrame, **blocking: int) -> DataFrame:
    """Every change of a buffer's reference count per node, and whether it freed the buffer.

    Staging a claim again counts again while one unstage counts once, as the ledger being audited does.
    """
    deltas = settled(claim_deltas(with_blocks(lifecycle, ["node"], F.col("seq"), **blocking)))
    counted = floored_sum(deltas, ["node", "effective_id"], ["seq"], F.col("delta"), "ref_count")
    changed = counted.where(F.col("ref_count") != F.col("ref_count_before"))
    return drop_blocks(changed.withColumn("freed", F.col("ref_count") == 0)).drop("ref_count_before")


def live_claims(lifecycle: DataFrame) -> DataFrame:
    """How many claims still hold each buffer: those whose last event is a stage of it."""
    c = F.col
    named = lifecycle.withColumn("effective_id", effective_buffer_id(c("buffer_id"), c("shard_index"), c("total_shards")))
    last = named.groupBy("node", "claim").agg(F.max_by(F.struct("op", "effective_id"), "seq").alias("_last"))
    held = last.where(c("_last.op") == STAGE).select("node", c("_last.effective_id").alias("effective_id"))
    return held.groupBy("node", "effective_id").agg(F.count("*").alias("live_claims"))


def live_allocations(lifecycle: DataFrame, as_of: int | None = None, **blocking: int) -> DataFrame:
    """Buffers held at event ``as_of`` (the end when None) with the size and shard of the stage that allocated them.

    That stage is the last one that took the count from 0 to 1. ``leaked`` is the count no claim will give back.
    """
    seen = lifecycle if as_of is None else lifecycle.where(F.col("seq") <= as_of)
    history = refcount_history(seen, **blocking)
    first = (F.col("delta") == 1) & (F.col("ref_count") == 1)
    born = F.struct("size_bytes", "shard_index", "total_shards", "seq")
    last = history.groupBy("node", "effective_id").agg(
        F.max_by("ref_count", "seq").alias("ref_count"), F.max_by(born, F.when(first, F.col("seq"))).alias("_born")
    )
    held = last.where(F.col("ref_count") > 0).join(live_claims(seen), ["node", "effective_id"], "left")
    return held.select(
        "node",
        "effective_id",
        "ref_count",
        size_or_default(F.col("_born.size_bytes")).alias("size_bytes"),
        F.col("_born.shard_index").alias("shard_index"),
        F.col("_born.total_shards").alias("total_shards"),
        F.col("_born.seq").alias("since_seq"),
        (F.col("ref_count") - F.coalesce("live_claims", F.lit(0))).alias("leaked"),
    )


def bytes_by_gpu(live: DataFrame, gpus: DataFrame, granule: int | None = None) -> DataFrame:
    """Bytes held per node and device after alignment; ``gpus`` is (node, gpu_count)."""
    g = None if granule is None else F.lit(granule).cast("bigint")
    gpu = gpu_for_shard(F.col("shard_index"), F.col("total_shards"), F.col("gpu_count"))
    return (
        live.join(gpus, "node", "left")
        .withColumn("gpu", gpu)
        .groupBy("node", "gpu")
        .agg(F.count("*").alias("buffers"), F.sum(align_up(F.col("size_bytes"), g)).alias("bytes"))
    )


STAGING_KEY = ("node", "claim", "buffer_id", "shard_index")


def dedupe_staging(lifecycle: DataFrame, keys: Sequence[str] = STAGING_KEY) -> DataFrame:
    """First stage request of every (node, claim, buffer, shard), as a combinable aggregate."""
    rest = [c for c in lifecycle.columns if c not in keys]
    stages = lifecycle.where(F.col("op") == STAGE)
    return (
        stages.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), "seq").alias("_first"), F.count("*").alias("requests"))
        .select(*keys, "_first.*", "requests")
    )

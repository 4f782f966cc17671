"""Splitting buffers into shards and finding which bytes fall where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.fixed_values import SHARD_MARK
from ballast.functions import base_buffer_id, shard_file_name, whole_div
from ballast.operators.blocks import nearest, with_blocks

# Numbers unfolded from one array.
PAGE = 4096


def numbers_below(n: Column) -> Column:
    """The array 0 .. n-1; empty for n <= 0, where ``sequence`` would count down."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(
        F.array().cast("array<bigint>")
    )


def unfold(df: DataFrame, first: Column, count: Column, out: str, spread: bool = False) -> DataFrame:
    """One row per number ``first`` .. ``first + count - 1``, in pages, so that no array grows with the count.

    ``spread`` deals the pages to tasks before they are unfolded, for rows whose counts differ widely.
    """
    pages = df.withColumns({"_first": first, "_count": count}).where(F.col("_count") > 0)
    page = F.explode(F.sequence(F.lit(0).cast("bigint"), whole_div(F.col("_count") - 1, PAGE)))
    pages = pages.withColumn("_page", page)
    if spread:
        tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
        pages = pages.repartition(tasks, *[c for c in pages.columns if c != "_count"])
    low = F.col("_page") * PAGE
    high = F.least(F.col("_count"), low + PAGE) - 1
    numbers = F.explode(F.sequence(F.col("_first") + low, F.col("_first") + high))
    return pages.withColumn(out, numbers).drop("_first", "_count", "_page")


def split_shards(buffers: DataFrame) -> DataFrame:
    """One row per shard from ``total_bytes`` and ``num_shards``: the first ``total % n`` shards get a byte more."""
    total, n, i = F.col("total_bytes"), F.col("num_shards").cast("bigint"), F.col("_i")
    quotient = whole_div(total, n)
    rest = total % n
    exploded = buffers.where(n > 0).withColumn("_i", F.explode(numbers_below(n)))
    return exploded.withColumns(
        {
            "shard_index": i.cast("int"),
            "offset_bytes": i * quotient + F.least(i, rest),
            "size_bytes": quotient + F.when(i < rest, F.lit(1)).otherwise(F.lit(0)),
        }
    ).drop("_i")


def shard_files(buffers: DataFrame) -> DataFrame:
    """One row per file of a buffer declared by file pattern; the pattern's own text plays no part in the names."""
    n = F.col("num_shards")
    exploded = buffers.where(n > 0).withColumn("_i", F.explode(numbers_below(n)))
    size = F.coalesce(whole_div(F.col("capacity_bytes"), n), F.lit(0).cast("bigint"))
    return exploded.withColumns(
        {
            "shard_index": F.col("_i").cast("int"),
            "path": shard_file_name(F.col("source_path"), F.col("_i").cast("int"), n),
            "size_bytes": size,
        }
    ).drop("_i")


def tensors_in_shards(tensors: DataFrame, shards: DataFrame, **blocking: int) -> DataFrame:
    """Slices of tensors that fall into each shard: where in the tensor, where in the shard, how long.

    Both are runs of bytes on one line, the buffer, and neither overlaps its like. One ordered sweep over the beginnings
    of both carries the tensor and the shard that are open, and every beginning gives the slice that begins there. So
    the work is linear in tensors, shards and slices, however small either are, and large buffers are swept in blocks.
    """
    c = F.col
    none = {"name": "string", "_ts": "bigint", "_te": "bigint"}, {"shard_index": "int", "_ss": "bigint", "_se": "bigint"}
    t = tensors.where(c("nbytes") > 0).select(
        "buffer_id",
        c("offset").alias("_at"),
        F.lit(0).alias("_kind"),
        F.struct("name", c("offset").alias("_ts"), (c("offset") + c("nbytes")).alias("_te")).alias("_t"),
        F.lit(None).cast(f"struct<{','.join(f'{n}:{k}' for n, k in none[1].items())}>").alias("_s"),
    )
    s = shards.where(c("size_bytes") > 0).select(
        "buffer_id",
        c("offset_bytes").alias("_at"),
        F.lit(1).alias("_kind"),
        F.lit(None).cast(f"struct<{','.join(f'{n}:{k}' for n, k in none[0].items())}>").alias("_t"),
        F.struct("shard_index", c("offset_bytes").alias("_ss"), (c("offset_bytes") + c("size_bytes")).alias("_se")).alias("_s"),
    )
    starts = with_blocks(t.unionByName(s), ["buffer_id"], c("_at"), **blocking)
    swept = nearest(starts, ["buffer_id"], ["_at", "_kind"], {"_open_t": c("_t"), "_open_s": c("_s")})
    swept = swept.select(
        "buffer_id", "_at", F.coalesce("_t", "_open_t").alias("_t"), F.coalesce("_s", "_open_s").alias("_s")
    )
    # Where both begin, the tensor comes first and meets the shard before, which ends there: no slice.
    end = F.least("_t._te", "_s._se")
    return swept.where(c("_t").isNotNull() & c("_s").isNotNull() & (end > c("_at"))).select(
        "buffer_id",
        "_s.shard_index",
        "_t.name",
        (c("_at") - c("_t._ts")).alias("src_start"),
        (c("_at") - c("_s._ss")).alias("dst_start"),
        (end - c("_at")).alias("length"),
    )


def scatter_plan(buffers: DataFrame, targets: Column) -> DataFrame:
    """Assignments of an equal scatter: the i-th target gets shard i, as rank i+1, on device i.

    Lengths are whole quotients, so up to n-1 bytes at a buffer's end are left out; ``split_shards`` covers them.
    """
    n = F.size("_targets")
    out = buffers.withColumn("_targets", targets)
    out = out.withColumn("_each", whole_div(F.col("total_bytes"), n)).where(n > 0)
    out = out.select("*", F.posexplode("_targets").alias("_i", "target_node"))
    return out.select(
        "buffer_id",
        "target_node",
        F.concat(base_buffer_id(F.col("buffer_id")), F.lit(SHARD_MARK), F.col("_i").cast("string")).alias(
            "target_buffer"
        ),
        F.col("_i").alias("shard_index"),
        (F.col("_i") + 1).alias("rank"),
        (F.col("_i") * F.col("_each")).alias("offset_bytes"),
        F.col("_each").alias("length_bytes"),
        F.col("_i").alias("target_gpu"),
    )


def broadcast_ranges(buffers: DataFrame, targets: DataFrame, chunk_bytes: int) -> DataFrame:
    """Every target of a buffer gets every byte of it: one row per target, with the bytes and chunks it gets."""
    chunks = whole_div(F.col("total_bytes") + (chunk_bytes - 1), chunk_bytes)
    sent = buffers.select("buffer_id", "total_bytes").join(targets.select("buffer_id", "target_node"), "buffer_id")
    return sent.withColumns({"chunk_bytes": F.lit(chunk_bytes).cast("bigint"), "chunks": chunks})


def broadcast_plan(buffers: DataFrame, targets: DataFrame, chunk_bytes: int) -> DataFrame:
    """``broadcast_ranges`` with a row for each target and chunk, for the buffers or targets one wants to look at.

    Targets are joined per buffer first and chunks unfolded last, so only the two narrow tables are shuffled.
    """
    size = F.lit(chunk_bytes).cast("bigint")
    start = F.col("chunk_no") * size
    sent = broadcast_ranges(buffers, targets, chunk_bytes)
    return unfold(sent, F.lit(0).cast("bigint"), F.col("chunks"), "chunk_no", spread=True).select(
        "buffer_id",
        "target_node",
        "chunk_no",
        start.alias("byte_start"),
        F.least(size, F.col("total_bytes") - start).alias("length"),
    )

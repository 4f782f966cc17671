"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.functions import whole_div
from ballast.operators.measures import summary_record


def write_shards(pieces: DataFrame, path: str, range_bytes: int = 256 << 20) -> None:
    """Write scattered bytes under each shard's own name, in byte order.

    A shard is spread over tasks by byte range, so a single huge shard does not become a single file.
    """
    spread = pieces.withColumn("_range", whole_div(F.col("byte_start"), range_bytes))
    ordered = spread.repartition("target_buffer", "_range").sortWithinPartitions("target_buffer", "byte_start")
    ordered.drop("_range").write.mode("overwrite").partitionBy("target_buffer").parquet(path)


def write_summary(summary: DataFrame, path: str, models: DataFrame | None = None) -> None:
    """Write a latency summary as JSON, one object per run with a struct per phase (see ``summary_record``)."""
    summary_record(summary, models).write.mode("overwrite").json(path)

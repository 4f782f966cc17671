"""Signal operators as live streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.fixed_values import READY_TIMEOUT_SECONDS
from ballast.functions import whole_div
from ballast.operators.signals import METADATA, PRE_UPDATE, READY, micros, session_totals


def ready_with_metadata(signals: DataFrame, delay: str, timeout: int = READY_TIMEOUT_SECONDS) -> DataFrame:
    """Each READY with the offset table it goes with, whichever came first; unmatched ones once time has passed.

    The join key holds a time bin as wide as the limit besides the buffer. A READY looks into its own bin and the two
    beside it, so a row meets only rows near it in time and a busy buffer is spread over its bins; the aggregate then
    folds the three looks into one row.
    """

    def bin_of(ts: Column) -> Column:
        return whole_div(micros(ts), timeout * 1_000_000)

    around = F.explode(F.array(*[bin_of(F.col("ts")) + d for d in (-1, 0, 1)]))
    ready = signals.where(F.col("signal") == READY).select(
        "buffer_id", "seq", F.col("ts").alias("ready_at"), around.alias("bin")
    )
    meta = signals.where(F.col("signal") == METADATA).select(
        F.col("buffer_id").alias("meta_buffer"), F.col("ts").alias("meta_at"), bin_of(F.col("ts")).alias("meta_bin")
    )
    near = F.expr(
        f"buffer_id = meta_buffer and bin = meta_bin and meta_at >= ready_at - interval {timeout} seconds "
        f"and meta_at <= ready_at + interval {timeout} seconds"
    )
    pairs = ready.withWatermark("ready_at", delay).join(meta.withWatermark("meta_at", delay), near, "left_outer")
    at, ts = F.col("meta_at"), F.col("ready_at")
    picked = F.coalesce(F.max(F.when(at <= ts, at)), F.min(F.when(at > ts, at)))
    return (
        pairs.groupBy("buffer_id", "seq", "ready_at")
        .agg(picked.alias("metadata_at"))
        .withColumns(
            {
                "complete_at": F.when(F.col("metadata_at").isNotNull(), F.greatest("ready_at", "metadata_at")),
                "matched": F.col("metadata_at").isNotNull(),
            }
        )
    )


def update_timeouts_stream(signals: DataFrame, delay: str, timeout: int = READY_TIMEOUT_SECONDS) -> DataFrame:
    """Updates that saw no READY within the time limit, reported when the watermark has passed the limit.

    These are the rows that an outer join of updates with READYs leaves unmatched. The join key holds a time bin as wide
    as the limit besides the buffer; a READY stands in its own bin and the one before, where all updates it can answer
    begin, so an update is looked up once and a busy buffer is spread over its bins. Both sides' state goes with the
    watermark. A READY of an update's own instant answers it if it has the larger number, as in the batch twin.
    """

    def bin_of(ts: Column) -> Column:
        return whole_div(micros(ts), timeout * 1_000_000)

    begun = signals.where(F.col("signal") == PRE_UPDATE).select(
        "buffer_id", "seq", F.col("ts").alias("started_at"), bin_of(F.col("ts")).alias("bin")
    )
    answered = F.explode(F.array(bin_of(F.col("ts")), bin_of(F.col("ts")) - 1))
    ready = signals.where(F.col("signal") == READY).select(
        F.col("buffer_id").alias("ready_buffer"), F.col("seq").alias("ready_seq"), F.col("ts").alias("ready_at"),
        answered.alias("ready_bin"),
    )
    in_time = F.expr(
        f"buffer_id = ready_buffer and bin = ready_bin and ready_at >= started_at "
        f"and ready_at <= started_at + interval {timeout} seconds and (ready_at > started_at or ready_seq > seq)"
    )
    pairs = begun.withWatermark("started_at", delay).join(ready.withWatermark("ready_at", delay), in_time, "left_outer")
    return pairs.where(F.col("ready_buffer").isNull()).select(
        "buffer_id", "seq", "started_at", F.lit("TIMEOUT").alias("outcome")
    )


def step_sessions_stream(signals: DataFrame, gap_seconds: int, delay: str) -> DataFrame:
    """Update steps per buffer as session windows."""
    windowed = signals.withWatermark("ts", delay).groupBy("buffer_id", F.session_window("ts", f"{gap_seconds} seconds"))
    return session_totals(windowed).drop("session_window")

"""Summaries of measured transfers and update iterations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast.fixed_values import GIB, MEAN_WARMUP_ITERATIONS, WARMUP_ITERATIONS
from ballast.functions import logged_bytes, pct_of_line_rate, received_bytes, throughput_gbps
from ballast.operators.blocks import drop_blocks, running_sum, settled, with_blocks
from ballast.operators.order_statistics import distribution_summary

BANDWIDTH = "bandwidth_gbs"


def number_iterations(iterations: DataFrame, **blocking: int) -> DataFrame:
    """0-based number of every row's iteration in its run. An iteration has one row for each of its phases."""
    rows = with_blocks(iterations, ["run", "phase"], F.col("seq"), **blocking)
    rows = running_sum(rows, ["run", "phase"], ["seq"], {"_n": F.lit(1).cast("bigint")})
    return drop_blocks(settled(rows.withColumn("iter", F.col("_n") - 1).drop("_n")))


def drop_warmup(numbered: DataFrame, warmup: int) -> DataFrame:
    return numbered.where(F.col("iter") >= warmup)


def latency_summary(iterations: DataFrame, warmup: int = WARMUP_ITERATIONS, **blocking: int) -> DataFrame:
    """Latency statistics in milliseconds per run and phase after warm-up, and of the rate of its total phase."""
    measured = drop_warmup(number_iterations(iterations, **blocking), warmup)
    rate = (F.col("phase") == "total") & (F.col("seconds") > 0)
    samples = F.array(
        F.struct(F.col("phase").alias("phase"), F.col("seconds").alias("value")),
        F.struct(
            F.lit(BANDWIDTH).alias("phase"),
            F.when(rate, F.col("bytes") / F.lit(float(GIB)) / F.col("seconds")).alias("value"),
        ),
    )
    rows = measured.select("run", F.inline(samples)).where(F.col("value").isNotNull())
    stats = distribution_summary(rows, ["run", "phase"], F.col("value"), rows=2 * iterations.count())
    scale = F.when(F.col("phase") == BANDWIDTH, F.lit(1.0)).otherwise(F.lit(1000.0))
    shown = {c: F.col(c) * scale for c in ("mean", "median", "p95", "min", "max", "stddev")}
    return stats.withColumns(shown).withColumn("p50", F.col("median"))


def summary_record(summary: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """One nested row per run, ready to be written as JSON: ``iters`` and a struct of statistics for every phase.

    Phases measured in milliseconds are named ``pack_ms`` and so on, the rate keeps its name. ``models`` (run, model,
    num_params, total_bytes; a row per run) adds ``model``, ``params`` in millions and ``weight_size_gb``, null for
    a run it lacks.
    """
    stats = F.struct("mean", "median", "p50", "p95", "min", "max", "stddev")
    name = F.when(F.col("phase") == BANDWIDTH, F.col("phase")).otherwise(F.concat("phase", F.lit("_ms")))
    phases = F.map_from_entries(F.array_sort(F.collect_list(F.struct(name.alias("phase"), stats.alias("stats")))))
    iters = F.max(F.when(F.col("phase") != BANDWIDTH, F.col("n")))
    record = summary.groupBy("run").agg(iters.alias("iters"), phases.alias("phases"))
    if models is None:
        return record
    gib = F.col("total_bytes") / F.lit(float(GIB))
    known = models.select(
        "run",
        "model",
        F.format_string("%.1fM", F.col("num_params") / F.lit(1e6)).alias("params"),
        F.format_string("%.3f", gib).alias("weight_size_gb"),
    )
    shown = ["params", "weight_size_gb"]
    joined = record.join(known, "run", "left")
    return joined.select("run", "model", *[F.when(F.col("model").isNotNull(), F.col(c)).alias(c) for c in shown], "iters", "phases")


def mean_transfer(iterations: DataFrame, warmup: int = MEAN_WARMUP_ITERATIONS, **blocking: int) -> DataFrame:
    """Plain mean duration after warm-up, and the rate at that mean."""
    measured = drop_warmup(number_iterations(iterations, **blocking), warmup)
    n, seconds, gib = F.count("*"), F.sum("seconds"), F.sum("bytes") / F.lit(float(GIB))
    return measured.groupBy("run").agg(
        n.alias("n"),
        seconds.alias("wall_seconds"),
        (seconds / n).alias("mean_seconds"),
        F.try_divide(gib, seconds).alias("gbps"),
    )


def concurrent_streams(transfers: DataFrame) -> DataFrame:
    """Latency, spread and throughput of streams that ran side by side in one run."""
    gib = F.sum("bytes") / F.lit(float(GIB))
    n, longest, mean = F.count("*"), F.max("seconds"), F.avg("seconds")
    place = F.struct("seconds", "stream")
    return transfers.groupBy("run").agg(
        n.alias("streams"),
        mean.alias("avg_seconds"),
        longest.alias("max_seconds"),
        gib.alias("total_gib"),
        F.try_divide(gib, longest).alias("aggregate_gbps"),
        F.try_divide(gib / n, mean).alias("per_stream_gbps"),
        (longest - F.min("seconds")).alias("spread_seconds"),
        F.min_by("stream", place).alias("fastest"),
        F.max_by("stream", place).alias("slowest"),
    )


def slowest_streams(transfers: DataFrame, k: int) -> DataFrame:
    """The k slowest streams of each run; the planner limits every group before the shuffle."""
    w = Window.partitionBy("run").orderBy(F.col("seconds").desc(), F.col("stream"))
    return transfers.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def transfer_rates(transfers: DataFrame, line_rate: float) -> DataFrame:
    """Bytes and rate of each transfer as its receiver sees it, as its sender logs it, and as its sender sent it."""
    c = F.col
    lengths: Column | None = c("lengths") if "lengths" in transfers.columns else None
    logged, sent = logged_bytes(c("mode"), c("bytes"), lengths)
    out = transfers.withColumns(
        {
            "received_bytes": received_bytes(c("mode"), c("bytes"), c("shard_length")),
            "logged_bytes": logged,
            "sent_bytes": sent,
        }
    )
    return out.withColumns(
        {
            "received_gbps": throughput_gbps(c("received_bytes"), c("seconds")),
            "logged_gbps": throughput_gbps(c("logged_bytes"), c("seconds")),
            "pct_of_line": pct_of_line_rate(throughput_gbps(c("received_bytes"), c("seconds")), F.lit(line_rate)),
        }
    )

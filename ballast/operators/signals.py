"""Update signals: pairing, matching, delivery and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.fixed_values import READY_TIMEOUT_SECONDS
from ballast.operators.blocks import BLOCK, cut, drop_blocks, nearest, running_sum, settled, split_points, with_blocks
from ballast.operators.skew import hot_keys, join_spread

PRE_UPDATE, READY, METADATA = "PRE_UPDATE", "READY", "METADATA"
CONNECT, DISCONNECT = "CONNECT", "DISCONNECT"


def _block(rows: DataFrame) -> list[str]:
    return [BLOCK] if BLOCK in rows.columns else []


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def seconds_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1e6)


def update_windows(signals: DataFrame, **blocking: int) -> DataFrame:
    """Each PRE_UPDATE with the next READY of its buffer; ``is_open`` when none follows."""
    rows = signals.where(F.col("signal").isin(PRE_UPDATE, READY))
    rows = with_blocks(rows, ["buffer_id"], micros(F.col("ts")), **blocking)
    ready = F.when(F.col("signal") == READY, F.col("ts"))
    paired = nearest(rows, ["buffer_id"], ["ts", "seq"], {"ended_at": ready}, after=True)
    return drop_blocks(
        paired.where(F.col("signal") == PRE_UPDATE).select(
            "buffer_id",
            "seq",
            F.col("ts").alias("started_at"),
            "ended_at",
            seconds_between(F.col("ts"), F.col("ended_at")).alias("seconds"),
            F.col("ended_at").isNull().alias("is_open"),
        )
    )


def update_timeouts(windows: DataFrame, timeout: float = READY_TIMEOUT_SECONDS) -> DataFrame:
    """Updates that saw no READY in time."""
    late = F.col("is_open") | (F.col("seconds") > timeout)
    return windows.where(late).select("buffer_id", "seq", "started_at", F.lit("TIMEOUT").alias("outcome"))


def ready_metadata(signals: DataFrame, timeout: float = READY_TIMEOUT_SECONDS, **blocking: int) -> DataFrame:
    """The offset table each READY goes with: the latest one at most ``timeout`` before it, else the first after it.

    A receive is complete once both have come. Two ordered scans do this without comparing pairs.
    """
    rows = signals.where(F.col("signal").isin(READY, METADATA))
    base = with_blocks(rows, ["buffer_id"], micros(F.col("ts")), **blocking)
    meta = F.when(F.col("signal") == METADATA, F.col("ts"))
    rows = nearest(base, ["buffer_id"], ["ts", "seq"], {"_earlier": meta})
    rows = nearest(rows, ["buffer_id"], ["ts", "seq"], {"_later": meta}, after=True, base=base)
    ts, earlier, later = F.col("ts"), F.col("_earlier"), F.col("_later")
    # An offset table of the same instant is none later, whichever was numbered first.
    picked = F.when(later == ts, later).when(seconds_between(earlier, ts) <= timeout, earlier).when(
        seconds_between(ts, later) <= timeout, later
    )
    return rows.where(F.col("signal") == READY).select(
        "buffer_id",
        "seq",
        ts.alias("ready_at"),
        picked.alias("metadata_at"),
        F.when(picked.isNotNull(), F.greatest(ts, picked)).alias("complete_at"),
        picked.isNotNull().alias("matched"),
    )


def subscriptions(signals: DataFrame, **blocking: int) -> DataFrame:
    """Every CONNECT with the next DISCONNECT of the same subscriber and buffer."""
    rows = signals.where(F.col("signal").isin(CONNECT, DISCONNECT))
    rows = with_blocks(rows, ["buffer_id"], micros(F.col("ts")), **blocking)
    gone = F.when(F.col("signal") == DISCONNECT, F.col("ts"))
    paired = nearest(rows, ["buffer_id", "peer"], ["ts", "seq"], {"broken_at": gone}, after=True)
    return drop_blocks(
        paired.where(F.col("signal") == CONNECT).select(
            "buffer_id", "peer", "seq", F.col("ts").alias("connected_at"), "broken_at"
        )
    )


def deliver_signals(signals: DataFrame, subs: DataFrame, **blocking: int) -> DataFrame:
    """How many live subscriptions each READY reaches: connected by then and not yet broken.

    Counts come from one ordered sweep over connects, breaks and READYs; pairs are never formed.
    """
    points = split_points(signals, ["buffer_id"], micros(F.col("ts")), **blocking)
    ready = signals.where(F.col("signal") == READY)
    zero = F.lit(0)
    steps = (
        ready.select("buffer_id", "ts", "seq", F.lit(1).alias("_kind"), zero.alias("_step"))
        .unionByName(
            subs.select("buffer_id", F.col("connected_at").alias("ts"), "seq", zero.alias("_kind"), F.lit(1).alias("_step"))
        )
        .unionByName(
            subs.where(F.col("broken_at").isNotNull()).select(
                "buffer_id", F.col("broken_at").alias("ts"), "seq", zero.alias("_kind"), F.lit(-1).alias("_step")
            )
        )
    )
    steps = settled(cut(steps, micros(F.col("ts")), points))
    swept = running_sum(steps, ["buffer_id"], ["ts", "_kind", "seq"], {"receivers": F.col("_step")})
    return swept.where(F.col("_kind") == 1).select("buffer_id", "seq", F.col("ts").alias("ready_at"), "receivers")


def subscription_receipts(signals: DataFrame, subs: DataFrame, **blocking: int) -> DataFrame:
    """How many READYs each subscription gets while it lives: the difference of two running counts."""
    points = split_points(signals, ["buffer_id"], micros(F.col("ts")), **blocking)
    zero = F.lit(0)
    # A READY at the very moment of connecting counts, one at the moment of breaking does not.
    ready = signals.where(F.col("signal") == READY).select(
        "buffer_id", "ts", "seq", F.lit(None).cast("string").alias("peer"), F.lit(1).alias("_kind"), F.lit(1).alias("_one")
    )
    opened = subs.select("buffer_id", F.col("connected_at").alias("ts"), "seq", "peer", zero.alias("_kind"), zero.alias("_one"))
    closed = subs.where(F.col("broken_at").isNotNull()).select(
        "buffer_id", F.col("broken_at").alias("ts"), "seq", "peer", F.lit(-1).alias("_kind"), zero.alias("_one")
    )
    steps = settled(cut(ready.unionByName(opened).unionByName(closed), micros(F.col("ts")), points))
    swept = running_sum(steps, ["buffer_id"], ["ts", "_kind", "seq"], {"_seen": F.col("_one")})
    totals = ready.groupBy("buffer_id").agg(F.count("*").alias("_all"))
    per_sub = (
        swept.where(F.col("_kind") < 1)
        .groupBy("buffer_id", "peer", "seq")
        .agg(
            F.max(F.when(F.col("_kind") == 0, F.col("_seen"))).alias("_at_open"),
            F.max(F.when(F.col("_kind") == -1, F.col("_seen"))).alias("_at_close"),
        )
    )
    counted = join_spread(per_sub, totals, ["buffer_id"], hot_keys(signals, ["buffer_id"]))
    through = F.coalesce("_at_close", "_all", F.lit(0))
    return counted.select("buffer_id", "peer", "seq", (through - F.col("_at_open")).alias("delivered"))


def step_sessions(signals: DataFrame, gap_seconds: float, **blocking: int) -> DataFrame:
    """Update steps per buffer: signals no further apart than the gap form one, with its span and counts."""
    rows = with_blocks(signals, ["buffer_id"], micros(F.col("ts")), **blocking)
    rows = nearest(rows, ["buffer_id"], ["ts", "seq"], {"_prev": F.col("ts")})
    fresh = F.col("_prev").isNull() | (seconds_between(F.col("_prev"), F.col("ts")) > gap_seconds)
    rows = settled(rows.select("buffer_id", "ts", "seq", "signal", fresh.cast("int").alias("_fresh"), *_block(rows)))
    rows = running_sum(rows, ["buffer_id"], ["ts", "seq"], {"_step": F.col("_fresh")})
    return session_totals(rows.groupBy("buffer_id", "_step")).drop("_step")


def session_totals(grouped) -> DataFrame:
    """Totals of one step; the same for the batch scan and the streaming session window."""
    return grouped.agg(
        F.min("ts").alias("started_at"),
        F.max("ts").alias("ended_at"),
        F.count("*").alias("signals"),
        F.count(F.when(F.col("signal") == READY, F.lit(1))).alias("updates"),
    ).withColumn("seconds", seconds_between(F.col("started_at"), F.col("ended_at")))

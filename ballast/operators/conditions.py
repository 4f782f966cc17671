"""Condition lists rebuilt from status updates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.operators.blocks import drop_blocks, nearest, with_blocks
from ballast.operators.skew import join_hot

KEYS = ("object_id", "type")
# Types whose stored entry changes only when the status does; all others are rewritten by every update.
STICKY = ("Validated",)


def condition_transitions(updates: DataFrame, **blocking: int) -> DataFrame:
    """Updates whose status differs from the one before, per object and condition type."""
    rows = with_blocks(updates, list(KEYS), F.col("seq"), **blocking)
    rows = nearest(rows, list(KEYS), ["seq"], {"_prev": F.struct("status")})
    first = F.col("_prev").isNull()
    changed = first | ~F.col("status").eqNullSafe(F.col("_prev.status"))
    return drop_blocks(rows.where(changed).withColumn("previous", F.col("_prev.status")).drop("_prev"))


def latest_by_key(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last row per key, as an aggregate that combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*keys, "_last.*")


def condition_changes(updates: DataFrame, sticky: Sequence[str] = STICKY, **blocking: int) -> DataFrame:
    """The updates that decide the stored conditions: the last one, and every change of a sticky type."""
    is_sticky = F.col("type").isin(*sticky)
    refreshed = latest_by_key(updates.where(~is_sticky), KEYS, "seq")
    return refreshed.unionByName(condition_transitions(updates.where(is_sticky), **blocking).drop("previous"))


def condition_latest(updates: DataFrame, sticky: Sequence[str] = STICKY, **blocking: int) -> DataFrame:
    """The stored condition per object and type."""
    return latest_by_key(condition_changes(updates, sticky, **blocking), KEYS, "seq")


def deciding_updates(updates: DataFrame, sticky: Sequence[str] = STICKY, **limits: int) -> DataFrame:
    """The updates that can still decide a stored condition, whatever other updates are yet to come in whatever order.

    Of a type that is not sticky, that is the last update. Of a sticky type it is the last run of equal status, all of
    it, and the update before it: a late update inside the run would make the first one after it decide. What lies
    further back cannot, as the last update of every other status only moves on. So this is a merge: applied to parts
    of the updates, and again to what it left of them, it leaves what it leaves of all. A key has few statuses.
    """
    is_sticky = F.coalesce(F.col("type").isin(*sticky), F.lit(False))
    refreshed = latest_by_key(updates.where(~is_sticky), KEYS, "seq")
    own = updates.where(is_sticky)
    newest = own.groupBy(*KEYS, "status").agg(F.max("seq").alias("_newest"))
    by_age = F.sort_array(F.collect_list("_newest"), asc=False)
    before_run = newest.groupBy(*KEYS).agg(F.get(by_age, F.lit(1)).alias("_before"))
    placed = join_hot(own, before_run, list(KEYS), "left", **limits)
    held = placed.where(F.col("_before").isNull() | (F.col("seq") >= F.col("_before"))).drop("_before")
    return refreshed.unionByName(held)

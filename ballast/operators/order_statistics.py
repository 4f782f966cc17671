"""Exact medians and tail values of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast.functions import whole_div

# Sketch size.
ACCURACY = 20000
# A group is large above this many values. There is one bracket for each, so a millionth of the rows at most.
LARGE_GROUP = 1 << 20


def distribution_summary(
    df: DataFrame, keys: Sequence[str], value: Column, rows: int | None = None, accuracy: int = ACCURACY
) -> DataFrame:
    """n, mean, median, p95, min, max and sample deviation of ``value`` per key.

    p95 is the value at 0-based place ``int(n * 0.95)`` of the sorted values, or the maximum below 20 values; the
    deviation of a single value is 0. Both order statistics are exact, and no large group is ever gathered. A first
    pass brackets the wanted places of large groups with sketches of fixed size. A second one counts what lies outside
    the brackets and keeps only the distinct values inside. The brackets are four times as wide as the sketch's
    guaranteed error. There is a bracket for each large group, and the planner chooses the join. ``rows``, when known, is
    the number of values or a number above it, and saves counting them.
    """
    keys = list(keys)
    c = F.col
    x = df.select(*keys, value.alias("_x")).where(c("_x").isNotNull())
    margin = 4.0 / accuracy
    spots = [p + d for p in (0.5, 0.95) for d in (-margin, margin)]
    stats = x.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg("_x").alias("mean"),
        F.min("_x").alias("min"),
        F.max("_x").alias("max"),
        F.coalesce(F.stddev_samp("_x"), F.lit(0.0)).alias("stddev"),
    )
    brackets = _large_brackets(x, keys, spots, x.count() if rows is None else rows, accuracy)
    if brackets is None:
        counted = x.select(*keys, F.lit(0).alias("_part"), c("_x").alias("_v"))
    else:
        inside = c("_lo1").isNull() | c("_x").between(c("_lo1"), c("_hi1")) | c("_x").between(c("_lo2"), c("_hi2"))
        part = (c("_hi1") < c("_x")).cast("int") + (c("_hi2") < c("_x")).cast("int")
        counted = x.join(brackets, keys, "left").select(
            *keys, F.coalesce(part, F.lit(0)).alias("_part"), F.when(inside, c("_x")).alias("_v")
        )
    counted = counted.groupBy(*keys, "_part", "_v").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys).orderBy(c("_part"), c("_v").asc_nulls_first())
    placed = counted.withColumns(
        {
            "_end": F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "_n": F.sum("_c").over(Window.partitionBy(*keys)),
        }
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((c("_end") - c("_c") <= rank) & (rank < c("_end")), c("_v")))

    n = c("_n")
    tail = F.when(n >= 20, (n * F.lit(0.95)).cast("bigint")).otherwise(n - 1)
    picked = placed.groupBy(*keys).agg(
        at(whole_div(n - 1, 2)).alias("_m1"), at(whole_div(n, 2)).alias("_m2"), at(tail).alias("_p95")
    )
    missed = F.raise_error(F.lit("a place lies outside its bracket")).cast("double")
    return picked.join(stats, keys).select(
        *keys,
        "n",
        "mean",
        F.coalesce((c("_m1") + c("_m2")) / 2, missed).alias("median"),
        F.coalesce("_p95", missed).alias("p95"),
        "min",
        "max",
        "stddev",
    )


def _large_brackets(
    x: DataFrame, keys: list[str], spots: list[float], total: int, accuracy: int
) -> DataFrame | None:
    """Value ranges around the wanted places of every large group; None when no group can be large."""
    if total <= LARGE_GROUP:
        return None
    sketched = x.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_x", spots, accuracy).alias("_s"))
    names = ("_lo1", "_hi1", "_lo2", "_hi2")
    ranges = [F.col("_s")[i].alias(name) for i, name in enumerate(names)]
    return sketched.where(F.col("_n") > LARGE_GROUP).select(*keys, *ranges)

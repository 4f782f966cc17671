"""Joins whose left side may lean on a few keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ballast.session import written

ROWS_PER_TASK = 1 << 20
MOST_HOT_KEYS = 1000


def hot_keys(
    df: DataFrame,
    keys: Sequence[str],
    rows_per_task: int = ROWS_PER_TASK,
    most: int = MOST_HOT_KEYS,
    weight: Column | None = None,
) -> DataFrame | None:
    """Keys holding more rows than one task should take, and how many parts to cut each into; None without any.

    A key is hot above ``rows_per_task`` rows whatever the table's size, and its parts are that large at most. Up to
    ``most`` hot keys come to the driver; where there are more, they stay a table. ``weight`` is how many rows a row
    of ``df`` stands for, where they have been counted before.
    """
    number = F.count("*") if weight is None else F.sum(weight)
    counts = df.groupBy(*keys).agg(number.alias("_rows")).where(F.col("_rows") > rows_per_task)
    hot = counts.select(*keys, F.ceil(F.col("_rows") / rows_per_task).alias("_salts"))
    rows = hot.limit(most + 1).collect()
    if len(rows) > most:
        return written(hot)
    return df.sparkSession.createDataFrame(rows, hot.schema) if rows else None


def join_spread(
    left: DataFrame, right: DataFrame, keys: Sequence[str], hot: DataFrame | None, how: str = "left"
) -> DataFrame:
    """``left.join(right, keys, how)`` for inner and left joins, with the ``hot`` keys of ``left`` spread over tasks.

    ``hot`` comes from ``hot_keys`` over some of the join keys. Rows of a hot key are dealt to its parts by a hash of
    their content and of the partition they come from, so that copies of one row spread as well; a task run again deals
    the same. The right side's rows of that key are repeated for each part. All other keys have one part. Without hot
    keys this is the plain join.
    """
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins can be spread")
    if hot is None:
        return left.join(right, list(keys), how)
    hot_on = [c for c in hot.columns if c != "_salts"]
    parts = F.coalesce("_salts", F.lit(1).cast("bigint"))
    hashable = [f.name for f in left.schema.fields if not isinstance(f.dataType, MapType)]
    row = F.xxhash64(*hashable, F.col("_from"))
    dealt = left.withColumn("_from", F.spark_partition_id()).join(hot, hot_on, "left")
    dealt = dealt.withColumn("_salt", F.pmod(row, parts)).drop("_from")
    repeated = right.join(hot, hot_on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))
    )
    return dealt.drop("_salts").join(repeated.drop("_salts"), [*keys, "_salt"], how).drop("_salt")


def join_hot(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", **limits: int) -> DataFrame:
    """``join_spread`` with the hot keys looked up in ``left`` itself."""
    return join_spread(left, right, keys, hot_keys(left, keys, **limits), how)

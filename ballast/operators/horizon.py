"""Requests without their repeats: of requests of one key, the first, and then each that no kept one is close before.

Which requests are kept depends on those kept before, one after another. The chain is followed without walking it: a
request's successor, were it kept, is the first one beyond its horizon, which an ordered sweep finds for all requests
at once. Requests that follow a longer pause are kept whatever came before. The others that are kept are those reached
from these along successors; successors are doubled in every round, so a chain takes the logarithm of its length in
rounds of joins. A key that holds a large share of all requests is swept in blocks like any other large key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.operators.blocks import drop_blocks, nearest, with_blocks
from ballast.session import written

MAX_ROUNDS = 64


def _swept(rows: DataFrame, keys: Sequence[str], horizon: Column, **blocking: int) -> tuple[DataFrame, DataFrame]:
    """Requests (*keys, _at, seq) that follow a pause, and the successors (_next_at, _next_seq) of all requests."""
    c = F.col
    placed = with_blocks(rows, list(keys), c("_at"), **blocking)
    seen = nearest(placed, list(keys), ["_at", "seq"], {"_before": c("_at")})
    marked = written(drop_blocks(seen.withColumn("_free", c("_before").isNull() | (c("_at") - c("_before") > horizon)).drop("_before")))
    ends = marked.select(*keys, (c("_at") + horizon).alias("_at"), "seq", F.lit(1).alias("_kind"), c("_at").alias("_of"), F.lit(None).cast("boolean").alias("_free"))
    starts = marked.select(*keys, "_at", "seq", F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("_of"), "_free")
    both = with_blocks(starts.unionByName(ends), list(keys), c("_at"), **blocking)
    after = F.when(c("_kind") == 0, F.struct("_at", "seq", "_free"))
    found = drop_blocks(nearest(both, list(keys), ["_at", "_kind", "seq"], {"_next": after}, after=True))
    # A request after a pause is kept anyway, so chains need not lead to it.
    led = found.where((c("_kind") == 1) & c("_next").isNotNull() & ~c("_next._free"))
    jumps = led.select(*keys, c("_of").alias("_at"), "seq", c("_next._at").alias("_next_at"), c("_next.seq").alias("_next_seq"))
    return marked.where("_free").select(*keys, "_at", "seq"), jumps


def first_in_horizon(requests: DataFrame, keys: Sequence[str], at: Column, horizon_us: int, **blocking: int) -> DataFrame:
    """The requests that no kept request of the same key lies up to ``horizon_us`` microseconds before.

    Requests are ordered by ``at`` (microseconds) and ``seq``, which together are unique within a key; of several at
    one instant the one with the smallest ``seq`` is looked at first, and the others are its repeats. All columns stay.
    Requests without a time or with a null in their key are left out.
    """
    c = F.col
    known = requests.withColumn("_at", at.cast("bigint")).dropna(subset=["_at", "seq", *keys])
    kept, jumps = _swept(known.select(*keys, "_at", "seq"), keys, F.lit(horizon_us).cast("bigint"), **blocking)
    row, following = [*keys, "_at", "seq"], [*keys, c("_next_at").alias("_at"), c("_next_seq").alias("seq")]
    kept, jumps = written(kept), written(jumps)
    for _ in range(MAX_ROUNDS):
        if jumps.isEmpty():
            return known.join(kept, row, "left_semi").select(*requests.columns)
        kept = written(kept.unionByName(kept.join(jumps, row).select(*following)).distinct())
        onward = jumps.select(*keys, c("_at").alias("_next_at"), c("seq").alias("_next_seq"), c("_next_at").alias("_to"), c("_next_seq").alias("_to_seq"))
        jumps = written(
            jumps.join(onward, [*keys, "_next_at", "_next_seq"]).select(
                *keys, "_at", "seq", c("_to").alias("_next_at"), c("_to_seq").alias("_next_seq")
            )
        )
    raise RuntimeError(f"a chain of more than 2 ** {MAX_ROUNDS} requests")

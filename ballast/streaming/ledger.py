"""Live tables: the allocation ledger, staging requests without repeats, and the latest row per key.

The ledger advances by micro-batches through ``foreachBatch``, with the scans of its batch twin. Its state is a keyed
table (``LevelledTable``): of every (node, claim) its last event, of every (node, buffer) its last event's number and
its count. For a batch, the state of the keys in it enters the scans as one earlier row a key. A claim or buffer that
holds a large share of a batch is scanned in blocks like any other large key, and no rows reach a Python worker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.functions import effective_buffer_id
from ballast.operators.blocks import drop_blocks, floored_sum, settled, with_blocks
from ballast.operators.conditions import latest_by_key
from ballast.operators.lifecycle import STAGE, STAGING_KEY, claim_deltas
from ballast.operators.skew import join_hot
from ballast.session import shared_dir, written
from ballast.streaming.levels import FANOUT, LevelledTable
from ballast.streaming.run import run_batches

EVENT = ["node", "claim", "buffer_id", "shard_index", "total_shards", "op", "ok", "seq", "size_bytes"]
LEDGER = (
    "node string, effective_id string, claim string, seq bigint, op string, delta int, size_bytes bigint, late boolean, "
    "ref_count bigint, freed boolean"
)
COUNTED = f"{LEDGER}, changed boolean"
STATE = (
    "kind string, node string, key string, seq bigint, at timestamp, op string, buffer_id string, shard_index int, "
    "total_shards int, ref_count bigint"
)
CLAIM, BUFFER, CLOCK = "claim", "buffer", "clock"


class Ledger:
    """The allocation ledger in a folder.

    Events of a claim or a buffer that are numbered at or before what an earlier batch counted for it come late: they
    are passed on with ``late`` set and change nothing. Repeats of one (node, claim, seq) inside a batch count once.

    With ``expire_seconds``, an unstage acts only on a stage at most that long before it, by column ``ts``, and claims
    are forgotten once events have come that are later by twice that time. Without, claims are remembered for ever.
    """

    def __init__(self, spark: SparkSession, folder: str, expire_seconds: int | None = None, fanout: int = FANOUT, **blocking: int):
        self.spark, self.folder, self.expire, self.blocking = spark, folder, expire_seconds, blocking
        schema = spark.createDataFrame([], STATE).schema
        self.state = LevelledTable(spark, f"{folder}/ledger", schema, self._fold, fanout)

    def _fold(self, rows: DataFrame) -> DataFrame:
        """The last state of each key, without claims that have expired."""
        last = latest_by_key(rows, ["kind", "node", "key"], "seq")
        if self.expire is None:
            return last
        now = rows.where(F.col("kind") == CLOCK).agg(F.max(F.unix_micros("at"))).first()[0]
        if now is None:
            return last
        old = (F.col("kind") == CLAIM) & (F.unix_micros("at") < now - 2 * self.expire * 1_000_000)
        return last.where(~F.coalesce(old, F.lit(False)))

    def _known(self, batch_id: int, kind: str, keys: DataFrame) -> DataFrame | None:
        """The state before a batch of the keys (node, key) in it."""
        state = self.state.after(batch_id)
        if state is None:
            return None
        own = state.where(F.col("kind") == kind).join(keys.distinct(), ["node", "key"], "left_semi")
        return written(latest_by_key(own, ["node", "key"], "seq"), f"{self.folder}/work/{kind}")

    def advance(self, batch: DataFrame, batch_id: int) -> None:
        """Count a micro-batch. A batch that is run again writes the same rows to the same places."""
        c = F.col
        at = c("ts") if "ts" in batch.columns else F.lit(None).cast("timestamp")
        events = batch.select(*EVENT, at.alias("at")).dropDuplicates(["node", "claim", "seq"])
        events = written(events, f"{self.folder}/work/events")
        claims = self._known(batch_id, CLAIM, events.select("node", c("claim").alias("key")))
        timely, late = events, None
        if claims is not None:
            seen = claims.select("node", c("key").alias("claim"), c("seq").alias("_seen"))
            met = join_hot(events, seen, ["node", "claim"])
            is_late = F.coalesce(c("seq") <= c("_seen"), F.lit(False))
            late, timely = met.where(is_late).select(*EVENT, "at"), met.where(~is_late).select(*EVENT, "at")
            before = claims.select(
                "node", c("key").alias("claim"), "buffer_id", "shard_index", "total_shards", "op", F.lit(False).alias("ok"),
                "seq", F.lit(None).cast("bigint").alias("size_bytes"), "at",
            )
            timely = timely.unionByName(before)
        deltas = claim_deltas(with_blocks(timely, ["node"], c("seq"), **self.blocking), self.expire)
        counted = self._counted(batch_id, settled(deltas))
        if late is not None:
            target = effective_buffer_id(c("buffer_id"), c("shard_index"), c("total_shards"))
            none = {"late": F.lit(True), "delta": F.lit(0), "ref_count": F.lit(None).cast("bigint")}
            passed_on = late.withColumn("effective_id", target).withColumns({**none, "changed": F.lit(True), "freed": F.lit(False)})
            counted = counted.unionByName(passed_on.select(*counted.columns))
        place = f"{self.folder}/changes/batch={batch_id}"
        counted.write.mode("overwrite").parquet(place)
        self.state.add(batch_id, self._advanced(self.spark.read.schema(COUNTED).parquet(place), timely, batch_id))

    def _counted(self, batch_id: int, deltas: DataFrame) -> DataFrame:
        """Deltas with the counts they lead to, ``changed`` telling those that made a difference."""
        c = F.col
        rows = deltas.withColumns({"late": F.lit(False), "_before": F.lit(False)})
        known = self._known(batch_id, BUFFER, deltas.select("node", c("effective_id").alias("key")))
        if known is not None:
            seen = known.select("node", c("key").alias("effective_id"), c("seq").alias("_seen"))
            rows = join_hot(rows, seen, ["node", "effective_id"])
            is_late = F.coalesce(c("seq") <= c("_seen"), F.lit(False))
            rows = rows.withColumns({"late": is_late, "delta": F.when(is_late, 0).otherwise(c("delta"))}).drop("_seen")
            start = known.select(
                "node", c("key").alias("effective_id"), "seq", c("ref_count").cast("int").alias("delta"),
                F.lit(False).alias("late"), F.lit(True).alias("_before"),
            )
            # Blocks follow the number, so the earlier row takes the block of its own.
            rows = settled(with_blocks(drop_blocks(rows).unionByName(start, allowMissingColumns=True), ["node"], c("seq"), **self.blocking))
        counted = drop_blocks(floored_sum(rows, ["node", "effective_id"], ["seq"], c("delta"), "ref_count"))
        counted = counted.where(~c("_before")).withColumns(
            {
                "changed": c("late") | (c("ref_count") != c("ref_count_before")),
                "freed": (c("ref_count") == 0) & ~c("late"),
                "ref_count": F.when(~c("late"), c("ref_count")).cast("bigint"),
                "delta": c("delta").cast("int"),
            }
        )
        return counted.select(*[f.split()[0] for f in COUNTED.split(", ")])

    def _advanced(self, counted: DataFrame, timely: DataFrame, batch_id: int) -> DataFrame:
        """The state of the keys in a batch, after it."""
        c = F.col
        nothing = F.lit(None)
        last = latest_by_key(timely.drop("ok", "size_bytes"), ["node", "claim"], "seq")
        claims = last.select(
            F.lit(CLAIM).alias("kind"), "node", c("claim").alias("key"), "seq", "at", "op", "buffer_id", "shard_index",
            "total_shards", nothing.cast("bigint").alias("ref_count"),
        )
        ends = latest_by_key(counted.where(~c("late")).select("node", "effective_id", "seq", "ref_count"), ["node", "effective_id"], "seq")
        empty = {"at": "timestamp", "op": "string", "buffer_id": "string", "shard_index": "int", "total_shards": "int"}
        buffers = ends.select(
            F.lit(BUFFER).alias("kind"), "node", c("effective_id").alias("key"), "seq",
            *[nothing.cast(t).alias(n) for n, t in empty.items()], "ref_count",
        )
        out = claims.unionByName(buffers)
        if self.expire is None:
            return out
        clock = timely.agg(F.max("at").alias("at")).select(
            F.lit(CLOCK).alias("kind"), F.lit("").alias("node"), F.lit("").alias("key"), F.lit(batch_id).cast("bigint").alias("seq"),
            "at", *[nothing.cast(t).alias(n) for n, t in [*empty.items(), ("ref_count", "bigint")] if n != "at"],
        )
        return out.unionByName(clock)

    def changes(self) -> DataFrame:
        """Every change of a count and every free, and the late rows, of all batches so far."""
        try:
            rows = self.spark.read.schema(COUNTED).parquet(f"{self.folder}/changes/batch=*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], COUNTED)
        return rows.where("changed").drop("changed")


def allocation_ledger(lifecycle: DataFrame, folder: str | None = None, **options: int) -> DataFrame:
    """Every reference count change and free of a stream of events; late rows carry ``late`` and change nothing.

    The stream runs over what its source holds. With a ``folder`` a later call goes on where this one ended.
    """
    ledger = Ledger(lifecycle.sparkSession, folder or shared_dir(lifecycle.sparkSession), **options)
    run_batches(lifecycle, ledger.advance, ledger.folder)
    return ledger.changes()


def dedupe_staging_stream(lifecycle: DataFrame, horizon: str) -> DataFrame:
    """Drop stage requests repeated within the horizon, ahead of the ledger."""
    stages = lifecycle.where(F.col("op") == STAGE).withWatermark("ts", horizon)
    return stages.dropDuplicatesWithinWatermark(list(STAGING_KEY))


def upsert_stream(
    updates: DataFrame,
    keys: list[str],
    order: str,
    merge: Callable[[DataFrame], DataFrame] | None = None,
    view: Callable[[DataFrame], DataFrame] | None = None,
    fanout: int = FANOUT,
    folder: str | None = None,
) -> DataFrame:
    """Keep a table of the latest row per key of a stream, in the shared folder, and return its view.

    Micro-batches are merged in a ``LevelledTable``. ``merge`` leaves the rows that can still decide, by default each
    key's latest; ``view`` makes the table out of them. With a ``folder`` a later call goes on where this one ended.
    """
    spark = updates.sparkSession
    place = folder or shared_dir(spark)
    merge = merge or (lambda rows: latest_by_key(rows, keys, order))
    table = LevelledTable(spark, f"{place}/table", updates.schema, merge, fanout)
    run_batches(updates, lambda batch, batch_id: table.add(batch_id, batch), place)
    return (view or (lambda rows: latest_by_key(rows, keys, order)))(table.rows())

"""Staging requests of a stream without their repeats inside a horizon."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ballast.operators.conditions import latest_by_key
from ballast.operators.horizon import first_in_horizon
from ballast.operators.lifecycle import STAGE, STAGING_KEY
from ballast.session import shared_dir, written
from ballast.streaming.run import run_batches


class StagingFilter:
    """Keeps the first staging request of every horizon, in the order of event time, in a folder.

    A request is decided once requests later by ``delay_us`` have come; until then it waits. What is remembered are
    waiting requests and each key's last kept one while its horizon lasts, so the state does not outgrow the horizon and
    the delay. A request older than what has been decided comes late: it is passed on with ``late`` set and repeats
    nothing. State is written to two folders by turns, and each batch's rows to one of its own, so a batch that is run
    again reads and writes the same.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, horizon_us: int, delay_us: int, **blocking: int):
        self.spark, self.folder, self.horizon, self.delay, self.blocking = spark, folder, horizon_us, delay_us, blocking
        self.columns = schema.fieldNames()
        self.out = StructType([*[StructField(f.name, f.dataType) for f in schema], StructField("late", BooleanType())])
        self.held = StructType([*[StructField(f.name, f.dataType) for f in schema], StructField("decided", BooleanType())])

    def _state(self, batch_id: int) -> DataFrame:
        if batch_id == 0:
            return self.spark.createDataFrame([], self.held)
        return self.spark.read.schema(self.held).parquet(f"{self.folder}/held/turn={(batch_id - 1) % 2}")

    def _clock(self, batch_id: int) -> int | None:
        """Up to when requests have been decided before a batch."""
        if batch_id == 0:
            return None
        return self.spark.read.schema("until bigint").parquet(f"{self.folder}/clock/turn={(batch_id - 1) % 2}").first()[0]

    def advance(self, batch: DataFrame, batch_id: int, end: bool = False) -> None:
        """Take in a micro-batch. With ``end`` all requests are decided, as after the last one of a finished stream."""
        c = F.col
        at = F.unix_micros("ts")
        new = batch.where((c("op") == STAGE) & c("ts").isNotNull()).select(*self.columns).withColumn("decided", F.lit(False))
        before, decided = self._clock(batch_id), self._state(batch_id)
        is_late = F.lit(False) if before is None else at <= before
        rows = written(new.withColumn("late", is_late).unionByName(decided.withColumn("late", F.lit(False))), f"{self.folder}/work/rows")
        newest = rows.agg(F.max(at)).first()[0]
        until = before if newest is None else max(newest if end else newest - self.delay, before if before is not None else newest - self.delay)
        ripe = ~c("late") & (F.lit(until is not None) & (at <= F.lit(until)))
        chosen = first_in_horizon(rows.where(ripe), STAGING_KEY, at, self.horizon, **self.blocking)
        kept = written(chosen, f"{self.folder}/work/kept")
        fresh = kept.where(~c("decided")).drop("decided").unionByName(rows.where("late").drop("decided"))
        fresh.write.mode("overwrite").parquet(f"{self.folder}/kept/batch={batch_id}")
        waiting = rows.where(~c("late") & ~ripe).drop("late")
        last = latest_by_key(kept.withColumn("_place", F.struct("ts", "seq")), list(STAGING_KEY), "_place").drop("_place")
        live = last.where(at >= F.lit(until) - self.horizon) if until is not None else last
        held = waiting.unionByName(live.drop("late").withColumn("decided", F.lit(True)))
        held.write.mode("overwrite").parquet(f"{self.folder}/held/turn={batch_id % 2}")
        clock = self.spark.createDataFrame([(until,)], "until bigint")
        clock.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/clock/turn={batch_id % 2}")

    def kept(self) -> DataFrame:
        """The requests kept so far, and the late ones."""
        try:
            return self.spark.read.schema(self.out).parquet(f"{self.folder}/kept/batch=*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.out)


def staging_in_horizon(lifecycle: DataFrame, horizon_us: int, delay_us: int, folder: str | None = None, **blocking: int) -> DataFrame:
    """The requests of a stream that ``StagingFilter`` keeps, once the stream has run over what its source holds.

    Requests within ``delay_us`` of the newest wait for more to come; a closing row far later decides them.
    """
    spark = lifecycle.sparkSession
    requests = StagingFilter(spark, folder or shared_dir(spark), lifecycle.schema, horizon_us, delay_us, **blocking)
    run_batches(lifecycle, requests.advance, requests.folder)
    return requests.kept()

"""Running a stream over what its source holds, and sources for it."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.session import STATE_STORE, conf, shared_dir

# Far later than any event, yet within the nanosecond range of the pandas tasks.
CLOSING_TIME = "2199-01-01 00:00:00"
EVENT_TYPES = ("signup", "purchase", "view", "click", "error")


def read_events_stream(
    spark: SparkSession, path: str, schema: str, file_format: str = "parquet", files_per_batch: int | None = None
) -> DataFrame:
    """Event files under ``path`` as an unbounded source. A plain path is made a glob, so it may be a single file.

    Without ``files_per_batch`` a micro-batch takes all new files. That is the safe choice for a backlog whose files
    are not in time order: with a limit, rows older than the watermark of an earlier batch count as late.
    """
    if not set("{[*?") & set(path):
        parent, name = path.rstrip("/").rsplit("/", 1)
        path = f"{parent}/{{{name}}}"
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(file_format).load(path)


def closing_rows(table: DataFrame) -> DataFrame:
    """A row of every event type in the far future, with negative ids: each filtered stream's watermark then passes
    its data."""
    number = F.col("id")
    known = {
        "event_id": -1 - number,
        "ts": F.lit(CLOSING_TIME),
        "user_id": F.lit(0),
        "event_type": F.element_at(F.array(*[F.lit(t) for t in EVENT_TYPES]), (number + 1).cast("int")),
    }
    columns = [known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema.fields]
    return table.sparkSession.range(len(EVENT_TYPES)).select(*columns)


def finite_events_stream(spark: SparkSession, events_path: str, schema: str) -> DataFrame:
    """A stream of a finished events table followed by closing rows, so nothing waits in state at the end.

    The table is read in place: one glob names it and the closing rows' folder, and the file source goes by age.
    Only when the two lie on different file systems is the table copied next to the closing rows.
    """
    folder = shared_dir(spark)
    table = spark.read.schema(schema).parquet(events_path)
    closing = f"{folder}/closing"
    data, end = urlsplit(events_path), urlsplit(closing)
    if (data.scheme or "file", data.netloc) != (end.scheme or "file", end.netloc):
        table.write.parquet(f"{folder}/events")
        path = f"{folder}/*"
    else:
        root = f"{data.scheme}://{data.netloc}" if data.scheme else ""
        path = f"{root}/{{{data.path.lstrip('/')},{end.path.lstrip('/')}}}"
    closing_rows(table).coalesce(1).write.parquet(closing)
    return read_events_stream(spark, path, schema)


def run_available(stream: DataFrame, output_mode: str = "append") -> DataFrame:
    """Run a stream over all data its source holds, into a table in the shared folder, and return that table."""
    spark = stream.sparkSession
    folder = shared_dir(spark)
    with stream_conf(spark):
        query = (
            stream.writeStream.format("parquet")
            .outputMode(output_mode)
            .option("path", f"{folder}/out")
            .option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_batches(stream: DataFrame, advance: Callable[[DataFrame, int], None], folder: str) -> None:
    """Run a stream over all data its source holds, a function taking each micro-batch and its number. Progress is kept
    in ``folder``, so a later run goes on where this one ended."""
    with stream_conf(stream.sparkSession):
        query = (
            stream.writeStream.foreachBatch(advance)
            .option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()


def stream_conf(spark: SparkSession):
    """RocksDB state, with a state partition per core of the application."""
    return conf(
        spark,
        spark__sql__streaming__stateStore__providerClass=STATE_STORE,
        spark__sql__shuffle__partitions=str(spark.sparkContext.defaultParallelism),
    )

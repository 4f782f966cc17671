"""Session settings and the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_workspace: ContextVar[str | None] = ContextVar("workspace", default=None)

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ballast")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A new folder every executor can reach: in the open ``workspace``, or else under ``spark.checkpoint.dir``.

    Only a local session may leave that setting out; it gets a folder in /tmp.
    """
    return f"{_workspace.get() or _root(spark)}/ballast-{uuid.uuid4().hex}"


def _root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        app = spark.sparkContext.applicationId
        root = _local_dirs.get(app) or _local_dirs.setdefault(app, tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return root.rstrip("/")


@contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """A folder that holds what operators called in this block write for themselves; it is removed at the block's end.

    Operators return rows that read such tables, so results have to be written, or otherwise used, inside the block, and
    to a place outside the folder. It is removed as well when the block fails. Blocks may be nested.
    """
    folder = shared_dir(spark)
    token = _workspace.set(folder)
    try:
        yield folder
    finally:
        _workspace.reset(token)
        # Hadoop's own file systems remove whatever Spark was able to write, whichever scheme it has.
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: computed once, and not again when an executor is lost.

    A ``path`` is overwritten, so that a job that runs again and again, as a stream's batches do, leaves one table.
    """
    path = path or f"{shared_dir(df.sparkSession)}/rows"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def conf(spark: SparkSession, **values: str) -> Iterator[None]:
    """Set SQL settings (``__`` for dots) for the duration of a block."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)

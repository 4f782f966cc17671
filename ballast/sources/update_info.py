"""The update message of a buffer, parallel arrays of its tensors, to and from tensor rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.functions import whole_div
from ballast.schemas import UPDATE_INFO

# Tensors per message; a larger buffer takes several, so no row gathers a whole catalog.
TENSORS_PER_MESSAGE = 4096


def tensors_to_update_info(packed: DataFrame, per_message: int = TENSORS_PER_MESSAGE) -> DataFrame:
    """Messages (buffer_id, part, names, dtype_names, shapes, offsets, total_bytes) from packed tensors.

    ``total_bytes`` is where the last tensor of the part ends.
    """
    part = whole_div(F.col("position"), per_message)
    row = F.struct("position", "name", "dtype", "shape", "offset", (F.col("offset") + F.col("nbytes")).alias("until"))
    gathered = packed.groupBy("buffer_id", part.alias("part")).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    return gathered.select(
        "buffer_id",
        "part",
        F.col("_rows.name").alias("names"),
        F.col("_rows.dtype").alias("dtype_names"),
        F.col("_rows.shape").alias("shapes"),
        F.col("_rows.offset").alias("offsets"),
        F.array_max("_rows.until").alias("total_bytes"),
    )


def to_json(info: DataFrame) -> DataFrame:
    arrays = F.struct("names", "dtype_names", "shapes", "offsets", "total_bytes")
    return info.select("buffer_id", "part", F.to_json(arrays).alias("json"))


def from_json(messages: DataFrame) -> DataFrame:
    parsed = F.from_json("json", UPDATE_INFO, {"mode": "FAILFAST"})
    return messages.select("buffer_id", "part", parsed.alias("_i")).select("buffer_id", "part", "_i.*")


def update_info_to_tensors(info: DataFrame) -> DataFrame:
    """One row per tensor of every message."""
    zipped = F.arrays_zip("names", "dtype_names", "shapes", "offsets")
    rows = info.select("buffer_id", "part", "total_bytes", F.posexplode(zipped).alias("index", "_t"))
    return rows.select(
        "buffer_id",
        "part",
        "index",
        F.col("_t.names").alias("name"),
        F.col("_t.dtype_names").alias("dtype"),
        F.col("_t.shapes").alias("shape"),
        F.col("_t.offsets").alias("offset"),
        "total_bytes",
    )

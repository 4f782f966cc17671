"""Per-node device memory reports, one small text file per node."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.operators.inventory import parse_inventory


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^([A-Za-z0-9+.-]+):/+", "$1:/")


def read_gpu_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Device count and memory per node from report files in a folder or below it.

    The node is the file's name without its ending. An empty file is an error, as is a report that cannot be read. No
    reader gives a row for a file without a byte, so those are the ones of the reader's own file list without a row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    listed = spark.createDataFrame([(unquote(f),) for f in files.inputFiles()], "listed string")
    read = files.select(_plain(F.col("path")).alias("_place"), F.decode("content", "UTF-8").alias("_text"))
    all_files = listed.select(_plain(F.col("listed")).alias("_place")).join(read, "_place", "left")
    node = F.regexp_extract(F.element_at(F.split("_place", "/"), -1), r"^(.*?)(?:\.[^.]*)?$", 1)
    return parse_inventory(all_files.select(node.alias("node"), F.coalesce("_text", F.lit("")).alias("content")))

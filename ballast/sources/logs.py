"""Transfer lines of node logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed format of the two log lines that report a finished transfer.
TRANSFER_LINE = (
    r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3} - \w+ - "
    r"(?:Target|Source) NCCL (?:BROADCAST|SCATTER) (?:recv )?complete in \d+\.\d+s\. Bandwidth: \d+\.\d+ GB/s\s*$"
)


def parse_transfer_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """(ts, level, role, mode, seconds, gbps) of every transfer line; other lines are dropped.

    The pattern is matched once per line; a line that fits has its fields at fixed words.
    """
    fitting = lines.where(F.col(column).rlike(TRANSFER_LINE))
    fields = fitting.select(F.split(F.rtrim(F.col(column)), " ").alias("_w"))

    def word(at: int) -> Column:
        return F.element_at("_w", at)

    stamp = F.to_timestamp(F.concat(word(1), F.lit(" "), word(2)), "yyyy-MM-dd HH:mm:ss,SSS")
    return fields.select(
        stamp.alias("ts"),
        word(4).alias("level"),
        word(6).alias("role"),
        word(8).alias("mode"),
        F.regexp_replace(word(-4), "s[.]$", "").cast("double").alias("seconds"),
        word(-2).cast("double").alias("gbps"),
    )


def read_transfer_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_transfer_log(spark.read.text(path))

"""The scalar functions under SQL names, and shard splitting as a SQL table function.

Each one is a SQL expression that the optimizer inlines, so a query using them stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ballast.fixed_values import (
    DEFAULT_GRANULE,
    DEFAULT_STAGE_BYTES,
    GIB,
    ITEM_SIZES,
    RANK_ANNOTATIONS,
    SHARD_FILE_FORMAT,
    SHARD_MARK,
)
from ballast.functions.quantity import quantity_sql


def _annotation_sql() -> str:
    keys = [
        f"try_cast(regexp_extract(try_element_at(a, '{k}'), r'^[ \\t]*([+-]?[0-9]+)', 1) as bigint)"
        for k in RANK_ANNOTATIONS
    ]
    return f"coalesce({', '.join(keys)})"


def _lookup_sql(name: str) -> str:
    entries = " ".join(f"when '{k}' then {v}" for k, v in ITEM_SIZES.items())
    return f"case {name} {entries} end"


def definitions() -> dict[str, str]:
    sharded = "coalesce(i >= 0 and t > 0, false)"
    return {
        "parse_quantity(s STRING) RETURNS BIGINT": quantity_sql("s"),
        "align_up(n BIGINT, g BIGINT) RETURNS BIGINT": (
            f"case when n % coalesce(g, {DEFAULT_GRANULE}) = 0 then n "
            f"else (n div coalesce(g, {DEFAULT_GRANULE}) + 1) * coalesce(g, {DEFAULT_GRANULE}) end"
        ),
        "is_sharded(i INT, t INT) RETURNS BOOLEAN": sharded,
        "effective_buffer_id(b STRING, i INT, t INT) RETURNS STRING": (
            f"case when {sharded} then concat(b, '{SHARD_MARK}', cast(i as string)) else b end"
        ),
        "base_buffer_id(b STRING) RETURNS STRING": f"substring_index(b, '{SHARD_MARK}', 1)",
        "shard_file_name(b STRING, i INT, n INT) RETURNS STRING": (
            f"case when coalesce(b, '') = '' then format_string('{SHARD_FILE_FORMAT}', i + 1, n) "
            f"else regexp_replace(concat(b, '/', format_string('{SHARD_FILE_FORMAT}', i + 1, n)), '/+', '/') end"
        ),
        "shard_from_annotations(a MAP<STRING, STRING>) RETURNS BIGINT": _annotation_sql(),
        "throughput_gbps(b BIGINT, s DOUBLE) RETURNS DOUBLE": (
            f"case when s > 0 then b / cast({GIB} as double) / s else 0D end"
        ),
        "pct_of_line_rate(r DOUBLE, m DOUBLE) RETURNS DOUBLE": "r / m * 100D",
        "received_bytes(m STRING, n BIGINT, l BIGINT) RETURNS BIGINT": (
            "case when m = 'SCATTER' and coalesce(l, 0) > 0 then l else n end"
        ),
        "itemsize(d STRING) RETURNS INT": _lookup_sql("d"),
        "numel(s ARRAY<BIGINT>) RETURNS BIGINT": "aggregate(s, 1L, (a, x) -> a * x)",
        "nbytes(d STRING, s ARRAY<BIGINT>) RETURNS BIGINT": f"aggregate(s, 1L, (a, x) -> a * x) * {_lookup_sql('d')}",
        "logged_bytes(m STRING, n BIGINT) RETURNS BIGINT": "n",
        "sent_bytes(m STRING, n BIGINT, l ARRAY<BIGINT>) RETURNS BIGINT": (
            "case when m = 'SCATTER' and size(l) > 0 then aggregate(l, 0L, (a, x) -> a + x) else n end"
        ),
        "size_or_default(n BIGINT) RETURNS BIGINT": f"coalesce(nullif(n, 0), {DEFAULT_STAGE_BYTES})",
        "gpu_for_shard(i INT, t INT, g INT) RETURNS INT": (
            f"case when {sharded} then coalesce(case when g > 0 then i % g end, 0) else 0 end"
        ),
        "split_shards(total BIGINT, n INT) RETURNS TABLE(shard_index INT, offset_bytes BIGINT, size_bytes BIGINT)": (
            "select i, i * (total div nullif(n, 0)) + least(cast(i as bigint), total % nullif(n, 0)), "
            "total div nullif(n, 0) + if(i < total % nullif(n, 0), 1, 0) "
            "from explode(case when n > 0 then sequence(0, n - 1) end) as t(i)"
        ),
    }


def register(spark: SparkSession) -> None:
    """Make every function usable from ``spark.sql``."""
    for signature, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")

"""Lookup tables as map literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def map_sql(table: dict[str, object], sql_type: str) -> str:
    return "map(" + ", ".join(f"'{k}', cast('{v}' as {sql_type})" for k, v in table.items()) + ")"


def lookup(table: dict[str, object], key: Column, sql_type: str) -> Column:
    """The entry for ``key``, null without one. The table is one folded literal in the plan."""
    return F.try_element_at(F.expr(map_sql(table, sql_type)), key)

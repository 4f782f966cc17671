"""Rows with labels, held-out folds, and hashed words of texts for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def held_out(doc_id: Column, folds: int, out: int) -> Column:
    return F.coalesce(fold(doc_id, folds) == out, F.lit(False))


def training_labels(labels: DataFrame, doc_id: str, label: str, folds: int, out: int) -> DataFrame:
    """(id, y) of labelled ids outside the held-out fold; an id with several labels gets their mean."""
    rows = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & (fold(F.col(doc_id), folds) != out))
    return rows.groupBy(F.col(doc_id).alias("id")).agg(F.avg(F.col(label).cast("double")).alias("y"))

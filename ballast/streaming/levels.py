"""A table that grows by micro-batches and stays a logarithm of their number in folders.

Each batch gives rows that are merged by a fold: a function of rows that may be applied to any parts of them first, in
any order, and to rows it has seen before. Batches count up like a number written in base ``fanout``. A level holds up
to ``fanout - 1`` slots, each a folder; a batch that finds the levels below some level full folds them and itself into
the next slot of that level. So a row is rewritten once a level, and nothing has to be deleted: a slot whose rows have
moved up stays readable, as the fold makes nothing of rows it knows, until its turn to be overwritten comes.

The slot follows from the batch's number, and no batch overwrites what it reads. A batch that is run again therefore
writes the same rows to the same place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FANOUT = 4

Fold = Callable[[DataFrame], DataFrame]


def slot_of(batch_id: int, fanout: int = FANOUT) -> tuple[int, int]:
    """(level, slot) a batch is written to; the levels below are folded into it."""
    level = 0
    while batch_id % fanout == fanout - 1:
        batch_id //= fanout
        level += 1
    return level, batch_id % fanout


class LevelledTable:
    def __init__(self, spark: SparkSession, folder: str, schema: StructType, fold: Fold, fanout: int = FANOUT):
        if fanout < 2:
            raise ValueError("fanout must be 2 at least")
        self.spark, self.folder, self.schema, self.fold, self.fanout = spark, folder, schema, fold, fanout

    def _slots(self, batches: int, below: int | None = None) -> list[str]:
        """Folders holding the rows of the first ``batches`` batches, those of levels from ``below`` on left out."""
        out, level = [], 0
        while batches and (below is None or level < below):
            out += [f"{self.folder}/level={level}/slot={s}" for s in range(batches % self.fanout)]
            batches //= self.fanout
            level += 1
        return out

    def add(self, batch_id: int, rows: DataFrame) -> None:
        """Store a batch's rows. Batches come in order of their numbers, from 0; the last one may come again."""
        level, slot = slot_of(batch_id, self.fanout)
        lower = self._slots(batch_id, level)
        if lower:
            rows = self.spark.read.schema(self.schema).parquet(*lower).unionByName(rows)
        self.fold(rows).write.mode("overwrite").parquet(f"{self.folder}/level={level}/slot={slot}")

    def after(self, batches: int) -> DataFrame | None:
        """The folded rows of the first ``batches`` batches, before a last fold over all slots; None for no batches."""
        live = self._slots(batches)
        return self.spark.read.schema(self.schema).parquet(*live) if live else None

    def rows(self) -> DataFrame:
        """All rows there are, read without knowing how many batches there were, folded."""
        try:
            found = self.spark.read.schema(self.schema).parquet(f"{self.folder}/level=*/slot=*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found = self.spark.createDataFrame([], self.schema)
        return self.fold(found)

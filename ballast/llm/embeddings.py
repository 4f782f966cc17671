"""What the operators on embeddings share: which vectors count, whole-number components, and names that cannot clash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem in taken:
            stem = f"_{stem}"
        taken.add(stem)
        out.append(stem)
    return out


def sound(vector: str) -> Column:
    """Whether a vector is there and none of its components is null or non-finite."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))


def whole(vector: str, scale: int = SCALE) -> Column:
    """The components times ``scale``, rounded down to whole numbers."""
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)

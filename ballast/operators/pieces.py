"""Tensor bytes in pieces, from the file to the numbers: no row holds more than a chunk, however large a tensor is.

A buffer's flat address space is cut in chunks of one size. The part of a tensor inside a chunk is a fragment, and the
fragments are the same whether they are cut from the tensor's own bytes, from rows of a file read in chunks, or out of
packed chunks. So a tensor's digest, a tree over the hashes of its fragments, is the same on all these sides, and is
found without bringing its bytes together: hashes are made where the fragments are cut, and only they are moved.

Numbers are decoded fragment by fragment as well. Of each fragment the whole elements are summed up in Arrow batches of
a few small parts, and what comes back is their count, sum and first values. Of elements that two fragments share, the
few bytes at the fragments' ends meet by the element's number and are decoded in turn.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, LongType, StructField, StructType

from ballast.fixed_values import ITEM_SIZES, KIB
from ballast.functions import itemsize, whole_div
from ballast.operators.payload import (
    CHUNK_BYTES,
    DIGEST_FAN_IN,
    chunk_size,
    cut_chunks,
    decoded,
    digest_tree,
    joined,
    with_touched_chunks,
)

HEAD = 10
# What a Python worker holds at a time: rows of an Arrow batch, and bytes of a row. Parts are whole elements of any type.
BATCH_ROWS = 256
PART_BYTES = 64 * KIB
FLOATS = ("F16", "BF16", "F32", "F64", "float16", "bfloat16", "float32", "float64")


def fragments(placed: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Fragments (buffer_id, ordinal, chunk_no, piece, at, bytes) of payloads with their offsets.

    ``piece`` counts a tensor's fragments from 0 and ``at`` its bytes before this one. An empty tensor is one empty
    fragment.
    """
    size = chunk_size(chunk_bytes)
    c = F.col
    base = c("chunk_no") * size
    start = F.greatest(c("offset"), base)
    end = F.least(c("offset") + c("nbytes"), base + size)
    cut = with_touched_chunks(placed, c("offset"), c("nbytes"), chunk_bytes).select(
        "buffer_id",
        "ordinal",
        "chunk_no",
        (c("chunk_no") - whole_div(c("offset"), chunk_bytes)).alias("piece"),
        (start - c("offset")).alias("at"),
        F.substring("payload", (start - c("offset") + 1).cast("int"), (end - start).cast("int")).alias("bytes"),
    )
    return cut.unionByName(_empty(placed, chunk_bytes))


def _empty(tensors: DataFrame, chunk_bytes: int) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return tensors.where(F.col("nbytes") == 0).select(
        "buffer_id", "ordinal", whole_div(F.col("offset"), chunk_bytes).alias("chunk_no"), zero.alias("piece"),
        zero.alias("at"), F.lit(b"").alias("bytes"),
    )


def file_chunks(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks (buffer_id, chunk_no, byte_start, bytes) of checkpoint files: their data rows (path, byte_start, bytes)
    read with ``chunkBytes`` of the same size are chunks already, so nothing is moved."""
    aligned = F.assert_true(
        (F.col("byte_start") % chunk_size(chunk_bytes) == 0) & (F.octet_length("bytes") <= chunk_bytes),
        F.lit("rows are not cut at multiples of the chunk size"),
    )
    checked = rows.where(aligned.isNull())
    return checked.select(
        F.col("path").alias("buffer_id"), whole_div(F.col("byte_start"), chunk_bytes).alias("chunk_no"), "byte_start", "bytes"
    )


def unpack_pieces(chunks: DataFrame, tensors: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The fragments of every tensor (buffer_id, ordinal, offset, nbytes), cut back out of the chunks.

    Bytes stay where their chunks are: requests, a row for each tensor and chunk, come to them, and each gives a row of
    at most a chunk. Columns as in ``fragments``.
    """
    c = F.col
    ranges = tensors.select(
        "buffer_id", "ordinal", c("offset").alias("_tensor"), c("offset").alias("_from"), c("nbytes").alias("_length")
    )
    cut = cut_chunks(chunks, ranges, ["ordinal", "_tensor"], chunk_bytes)
    chunk_no = whole_div(c("_start"), chunk_bytes)
    found = cut.select(
        "buffer_id", "ordinal", chunk_no.alias("chunk_no"), (chunk_no - whole_div(c("_tensor"), chunk_bytes)).alias("piece"),
        (c("_start") - c("_tensor")).alias("at"), c("_piece").alias("bytes"),
    )
    return found.unionByName(_empty(tensors, chunk_bytes))


def tensor_digests(
    pieces: DataFrame, keys: Sequence[str] = ("buffer_id", "ordinal"), levels: int = 2, fan_in: int = DIGEST_FAN_IN
) -> DataFrame:
    """One digest per tensor from its fragments, with their number and bytes: a tree of fixed fan-in over their SHA-256.

    Only hashes are moved. Two levels of 4096 reach 1.6e7 fragments of a tensor.
    """
    hashed = pieces.select(
        *keys, F.col("piece").alias("_pos"), F.sha2("bytes", 256).alias("_hex"), F.octet_length("bytes").alias("_n")
    )
    totals = hashed.groupBy(*keys).agg(F.count("*").alias("pieces"), F.sum("_n").alias("nbytes"))
    return totals.join(digest_tree(hashed.drop("_n"), keys, levels, fan_in), list(keys))


def whole_payloads(pieces: DataFrame, keys: Sequence[str] = ("buffer_id", "ordinal")) -> DataFrame:
    """Pieces put together: a row for each tensor, which must fit one."""
    return pieces.groupBy(*keys).agg(joined("bytes", "at").alias("payload"))


# --- numbers ----------------------------------------------------------------------------------------------------------

PROFILE = StructType(
    [
        StructField("elements", LongType()),
        StructField("finite", LongType()),
        StructField("total", DoubleType()),
        StructField("head", ArrayType(FloatType())),
    ]
)


def profile_of(raw: bytes, at: int, dtype: str) -> tuple:
    """What a fragment tells about a tensor: its whole elements summed up."""
    width = ITEM_SIZES[dtype]
    skip = min(-at % width, len(raw))
    rest = (len(raw) - skip) % width
    values = decoded(raw[skip : len(raw) - rest], dtype)
    finite = values[np.isfinite(values)]
    first = max(0, HEAD - (at + skip) // width)
    return len(values), len(finite), float(finite.sum(dtype=np.float64)), values[:first].tolist()


@F.pandas_udf(PROFILE)
def _profile(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for raw, at, dtype in batches:
        rows = [profile_of(r, int(a), d) for r, a, d in zip(raw, at, dtype, strict=True)]
        kinds = {"elements": "int64", "finite": "int64", "total": "float64"}
        yield pd.DataFrame(rows, columns=PROFILE.fieldNames(), dtype=object).astype(kinds)


def parts(pieces: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Pieces (at, bytes, ...) cut again at multiples of ``part_bytes`` in their tensor. An empty piece stays one row."""
    c = F.col
    n = F.octet_length("bytes")
    size = chunk_size(part_bytes)
    last = whole_div(c("at") + F.greatest(n, F.lit(1)) - 1, part_bytes)
    cut = pieces.withColumn("_part", F.explode(F.sequence(whole_div(c("at"), part_bytes), last)))
    start = F.greatest(c("at"), c("_part") * size)
    end = F.least(c("at") + n, (c("_part") + 1) * size)
    piece = F.substring("bytes", (start - c("at") + 1).cast("int"), (end - start).cast("int"))
    return cut.withColumns({"at": start, "bytes": piece}).drop("_part")


def number_profile(pieces: DataFrame, keys: Sequence[str] = ("buffer_id", "ordinal")) -> DataFrame:
    """Per tensor: ``error``, ``elements``, ``finite``, their double ``total`` and the ``first`` ten values.

    ``pieces`` are (*keys, dtype, at, bytes), cut anywhere. A tensor has an error, and nothing else, if its type is none
    of floats or its bytes are no whole number of elements. A tensor with a null among its pieces has no numbers. No values
    leave the Python workers but the first ten, and each element is decoded once, in batches of at most ``BATCH_ROWS``
    times ``PART_BYTES``: the session is set to small Arrow batches.
    """
    pieces.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    c = F.col
    known = F.coalesce(c("dtype").isin(*FLOATS), F.lit(False))
    full = c("bytes").isNotNull() & c("at").isNotNull()
    sizes = pieces.groupBy(*keys).agg(
        F.max("dtype").alias("dtype"), F.sum(F.octet_length("bytes").cast("bigint")).alias("_nbytes"),
        F.every(full).alias("_full"),
    )
    width = itemsize(c("dtype"))
    error = F.when(~known, F.lit("not a float dtype")).when(
        c("_nbytes") % width != 0, F.format_string("%d bytes is not a multiple of %d", c("_nbytes"), width)
    )
    read = pieces.where(known & full).select(*keys, "dtype", "at", "bytes")
    whole = parts(read).select(*keys, "dtype", "at", _profile("bytes", "at", "dtype").alias("_p")).select(*keys, "dtype", "at", "_p.*")
    # Bytes of elements that fragments share, by the number of the element and their place in it.
    n = F.octet_length("bytes")
    skip = F.least(F.pmod(-c("at"), width), n)
    rest = (n - skip) % width
    lead = F.struct(c("at").alias("_at"), F.substring("bytes", F.lit(1), skip.cast("int")).alias("bytes"))
    tail = F.struct((c("at") + n - rest).alias("_at"), F.substring("bytes", (n - rest + 1).cast("int"), rest.cast("int")).alias("bytes"))
    split = read.where((skip > 0) | (rest > 0)).select(*keys, "dtype", F.explode(F.array(lead, tail)).alias("_end"))
    split = split.select(*keys, "dtype", "_end.*").where(n > 0)
    element = whole_div(c("_at"), width)
    glued = split.groupBy(*keys, "dtype", element.alias("_element")).agg(joined("bytes", "_at").alias("bytes"))
    glued = glued.where(F.octet_length("bytes") == width).select(*keys, "dtype", (c("_element") * width).alias("at"), "bytes")
    shared = glued.select(*keys, "dtype", "at", _profile("bytes", "at", "dtype").alias("_p")).select(*keys, "dtype", "at", "_p.*")
    both = whole.unionByName(shared)
    heads = F.sort_array(F.collect_list(F.when(F.size("head") > 0, F.struct("at", "head"))))
    sums = both.groupBy(*keys).agg(
        F.sum("elements").alias("elements"), F.sum("finite").alias("finite"), F.sum("total").alias("total"),
        F.flatten(F.transform(heads, lambda h: h["head"])).alias("first"),
    )
    sound = c("error").isNull() & c("_full")
    out = sizes.withColumn("error", error).join(sums, list(keys), "left")
    return out.select(
        *keys, "dtype", "error",
        *[F.when(sound, c(n)).alias(n) for n in ("elements", "finite")],
        F.when(sound & (c("finite") > 0), c("total")).alias("total"),
        F.when(sound, c("first")).alias("first"),
    )

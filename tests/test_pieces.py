"""Tensors larger than a chunk, from the file to the numbers, against plain numpy, hashlib and zlib."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_payload import random_payloads
from test_sources import write_safetensors

from ballast.operators import payload, pieces
from ballast.session import conf
from ballast.sources import safetensors

NUMPY = {"F16": "<f2", "F32": "<f4", "F64": "<f8"}


def brute_digest(offset, raw, chunk, fan_in=4096):
    cuts = [max(0, c * chunk - offset) for c in range(offset // chunk, (offset + max(len(raw), 1) - 1) // chunk + 1)]
    parts = [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)])]
    level = [hashlib.sha256(p).hexdigest() for p in parts]
    for _ in range(2):
        level = [hashlib.sha256("".join(level[i : i + fan_in]).encode()).hexdigest() for i in range(0, len(level), fan_in)]
    return len(parts), level[0]


@pytest.mark.parametrize("chunk", [7, 64, 1 << 20])
def test_pieces_of_both_sides_are_the_same(spark, chunk):
    rows, df = random_payloads(spark)
    placed = payload.with_payload_offsets(df, rows_per_block=30)
    cut = pieces.fragments(placed, chunk)
    back = pieces.unpack_pieces(payload.pack_chunks(placed, chunk), placed.drop("payload"), chunk)
    columns = ["buffer_id", "ordinal", "chunk_no", "piece", "at", "bytes"]
    got = [sorted(map(tuple, d.select(columns).collect())) for d in (cut, back)]
    assert got[0] == got[1] and max(len(r[-1]) for r in got[0]) <= chunk
    whole = pieces.whole_payloads(back).collect()
    assert sorted((r.buffer_id, r.ordinal, bytes(r.payload)) for r in whole) == sorted(rows)
    fan_in = 5
    digests = {(r.buffer_id, r.ordinal): (r.pieces, r.digest, r.nbytes) for r in pieces.tensor_digests(back, fan_in=fan_in, levels=2).collect()} if chunk > 7 else None
    if digests:
        at = {}
        for b, o, raw in sorted(rows):
            assert digests[b, o] == (*brute_digest(at.get(b, 0), raw, chunk, fan_in), len(raw))
            at[b] = at.get(b, 0) + len(raw)


def test_unpacking_does_not_move_the_chunks_again(spark):
    _, df = random_payloads(spark)
    chunks = payload.pack_chunks(payload.with_payload_offsets(df), 64)
    with conf(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        back = pieces.unpack_pieces(chunks, payload.payload_offsets(df), 64)
        plan = back._jdf.queryExecution().executedPlan().toString()
    join = plan.index("SortMergeJoin")
    between = plan[join : plan.index("ObjectHashAggregate", join)]
    assert "Exchange" not in between and "chunk_no" in between


def test_from_a_file_to_numbers(spark, tmp_path):
    rng = np.random.default_rng(4)
    big = rng.standard_normal(700).astype("<f8")
    big[[3, 300]] = np.nan, np.inf
    half = rng.standard_normal(333).astype("<f2")
    brain = (rng.standard_normal(50).astype("<f4").view("<u4") >> 16).astype("<u2")
    tensors = [
        ("odd", "U8", [5], rng.bytes(5)), ("big", "F64", [700], big.tobytes()), ("none", "F32", [0], b""),
        ("half", "F16", [333], half.tobytes()), ("brain", "BF16", [50], brain.tobytes()),
    ]
    write_safetensors(tmp_path / "m.safetensors", tensors)
    safetensors.register(spark)
    reader = spark.read.format("safetensors")
    heads = reader.load(str(tmp_path)).select(
        F.col("path").alias("buffer_id"), "ordinal", "dtype", F.col("begin").alias("offset"), "nbytes"
    )
    for chunk in (3, 100, 1 << 20):
        rows = reader.option("payload", "true").option("chunkBytes", str(chunk)).option("taskBytes", "1000").load(str(tmp_path))
        cut = pieces.unpack_pieces(pieces.file_chunks(rows, chunk), heads, chunk)
        assert cut.agg(F.max(F.octet_length("bytes"))).first()[0] <= chunk
        offset, digests = 0, {r.ordinal: r for r in pieces.tensor_digests(cut).collect()}
        for i, (_, _, _, raw) in enumerate(tensors):
            assert (digests[i].pieces, digests[i].digest) == brute_digest(offset, raw, chunk)
            offset += len(raw)
        typed = cut.join(heads.select("buffer_id", "ordinal", "dtype"), ["buffer_id", "ordinal"])
        got = {r.ordinal: r for r in pieces.number_profile(typed).collect()}
        assert got[0].error == "not a float dtype" and got[0].elements is None
        assert (got[2].elements, got[2].total, got[2]["first"], got[2].error) == (0, None, [], None)
        values = {1: big.astype("<f4"), 3: half.astype("<f4"), 4: (brain.astype("<u4") << 16).view("<f4")}
        for i, v in values.items():
            finite = v[np.isfinite(v)]
            assert (got[i].elements, got[i].finite) == (len(v), len(finite))
            assert got[i].total == pytest.approx(finite.astype(float).sum(), rel=1e-9)
            assert np.array_equal(np.array(got[i]["first"], dtype="<f4"), v[:10], equal_nan=True)


def test_bytes_that_are_no_whole_number_of_elements(spark):
    rows = [("t", 1, "F32", 0, b"abc"), ("t", 1, "F32", 3, b"defg"), ("t", 2, None, 0, b"ab"), ("t", 3, "F16", 0, b"")]
    df = spark.createDataFrame(rows, "buffer_id string, ordinal bigint, dtype string, at bigint, bytes binary")
    got = {r.ordinal: (r.error, r.elements) for r in pieces.number_profile(df).collect()}
    assert got == {1: ("7 bytes is not a multiple of 4", None), 2: ("not a float dtype", None), 3: (None, 0)}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_python_sees_small_batches_of_small_parts_once(spark):
    schema = "buffer_id string, ordinal bigint, dtype string, at bigint, bytes binary"
    rows = [("t", 1, "F16", 0, b"abcd"), ("t", 1, "F16", 4, b"efg"), ("t", 2, "F16", 0, b"")]
    with conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch="10000"):
        profile = pieces.number_profile(spark.createDataFrame(rows, schema))
        # The pieces and the elements that pieces share; the pieces were decoded three times, twice of it in one task.
        assert plan_of(profile).count("ArrowEvalPython") == 2
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == pieces.BATCH_ROWS


def test_parts_of_pieces(spark):
    r = random.Random(3)
    raw, cuts = r.randbytes(1000), [0, 1, 130, 131, 640, 1000]
    rows = [(a, raw[a:b]) for a, b in zip(cuts, cuts[1:])] + [(1000, b"")]
    got = sorted(pieces.parts(spark.createDataFrame(rows, "at bigint, bytes binary"), 64).collect())
    want = sorted({*cuts, *range(0, 1000, 64)})
    assert [(x["at"], bytes(x["bytes"])) for x in got] == [(a, raw[a:b]) for a, b in zip(want, [*want[1:], 1000])]


@pytest.mark.parametrize("dtype", ["F16", "BF16", "F32", "F64"])
def test_numbers_of_pieces_beyond_a_part(spark, dtype):
    rng = np.random.default_rng(5)
    kind = NUMPY.get(dtype, "<f4")
    values = rng.standard_normal(2 * pieces.PART_BYTES // np.dtype(kind).itemsize + 77).astype(kind)
    values[[5, -1]] = np.nan, np.inf
    raw = values.tobytes()
    if dtype == "BF16":
        raw = (values.view("<u4") >> 16).astype("<u2").tobytes()
        values = (np.frombuffer(raw, "<u2").astype("<u4") << 16).view("<f4")
    cuts = [0, 7, pieces.PART_BYTES + 3, len(raw) - 1, len(raw)]
    rows = [("t", 0, dtype, 0, raw)] + [("t", 1, dtype, a, raw[a:b]) for a, b in zip(cuts, cuts[1:])]
    rows += [("t", 2, dtype, 0, raw[:8]), ("t", 2, dtype, 8, None), (None, 3, dtype, 0, raw[:8])]
    rows += [("t", 4, dtype, 0, raw[:8]), ("t", 4, dtype, None, raw[8:16])]
    df = spark.createDataFrame(rows, "buffer_id string, ordinal bigint, dtype string, at bigint, bytes binary")
    got = {r.ordinal: r for r in pieces.number_profile(df).collect()}
    finite = values[np.isfinite(values)].astype("<f4").astype(float)
    for i in (0, 1):
        assert (got[i].error, got[i].elements, got[i].finite) == (None, len(values), len(finite))
        assert got[i].total == pytest.approx(finite.sum(), rel=1e-9)
        assert np.array_equal(np.array(got[i]["first"], dtype="<f4"), values[:10].astype("<f4"), equal_nan=True)
    for i in (2, 3, 4):  # no bytes or no place in a piece; a key that joins with nothing
        assert (got[i].error, got[i].elements, got[i].finite, got[i].total) == (None, None, None, None)


def test_file_rows_must_be_chunks(spark):
    rows = spark.createDataFrame([("f", 5, b"abc")], "path string, byte_start bigint, bytes binary")
    with pytest.raises(Exception, match="multiples of the chunk size"):
        pieces.file_chunks(rows, 4).collect()


def test_checksums(spark):
    r = random.Random(1)
    rows = [("b", i, r.randbytes(r.randrange(300))) for i in range(50)]
    df = spark.createDataFrame(rows, "buffer_id string, ordinal bigint, payload binary")
    got = {x.ordinal: (x.sha256, x.crc32) for x in payload.checksums(df).collect()}
    assert got == {i: (hashlib.sha256(b).hexdigest(), zlib.crc32(b)) for _, i, b in rows}

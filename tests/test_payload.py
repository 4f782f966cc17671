"""Packing, cutting, checking and decoding bytes; shard plans; published figures."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballast.operators import buffers, catalog, claims, measures, payload, shards

GIB = 1 << 30


def random_payloads(spark, seed=3, n=120):
    r = random.Random(seed)
    rows = [(f"b{0 if i % 3 == 0 else r.randrange(3)}", i, r.randbytes(r.choice([0, 1, 5, 64, 200, 333]))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "buffer_id string, ordinal bigint, payload binary")


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 20])
def test_pack_then_unpack(spark, chunk):
    rows, df = random_payloads(spark, n=40 if chunk == 1 else 120)
    packed = payload.with_payload_offsets(df, rows_per_block=30)
    chunks = payload.pack_chunks(packed, chunk)
    flat = {}
    for b, _, p in rows:
        flat[b] = flat.get(b, b"") + p
    for r in chunks.collect():
        assert bytes(r.bytes) == flat[r.buffer_id][r.byte_start : r.byte_start + chunk]
    back = payload.unpack(chunks, packed.drop("payload"), chunk).collect()
    assert sorted((r.buffer_id, r.ordinal, bytes(r.payload)) for r in back) == sorted(rows)


def test_chunk_size_is_checked(spark):
    with pytest.raises(ValueError, match="chunk_bytes"):
        payload.pack_chunks(random_payloads(spark)[1], 1 << 31)


def test_slices_tile_tensors_and_shards(spark):
    r = random.Random(8)
    tensors = spark.createDataFrame(
        [(f"b{i % 2}", i, f"t{i}", r.choice([0, 3, 50, 700])) for i in range(200)],
        "buffer_id string, ordinal bigint, name string, nbytes bigint",
    )
    packed = catalog.pack_offsets(tensors)
    totals = tensors.groupBy("buffer_id").agg(F.sum("nbytes").alias("total_bytes")).withColumn("num_shards", F.lit(7))
    cut = shards.split_shards(totals)
    results = [sorted(map(tuple, shards.tensors_in_shards(packed, cut, rows_per_block=n).collect())) for n in (20, 150, 1 << 20)]
    assert results[0] == results[1] == results[2]
    by_shard, by_tensor = {}, {}
    for b, s, name, src, dst, length in results[0]:
        by_shard.setdefault((b, s), []).append((dst, length))
        by_tensor.setdefault(name, []).append((src, length))
    sizes = {(x.buffer_id, x.shard_index): x.size_bytes for x in cut.collect()}
    lengths = {x.name: x.nbytes for x in tensors.collect() if x.nbytes}
    for found, want in ((by_shard, sizes), (by_tensor, lengths)):
        assert set(found) == set(want)
        for key, parts in found.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            assert at == want[key]


def test_small_tensors_meet_small_shards_in_linear_work(spark):
    """A million tensors and a hundred thousand shards inside 64 MiB."""
    n, m, total = 1_000_000, 100_000, 64_000_000
    t = spark.range(n).select(F.lit("b").alias("buffer_id"), F.col("id").cast("string").alias("name"), (F.col("id") * 64).alias("offset"), F.lit(64).cast("bigint").alias("nbytes"))
    s = spark.range(m).select(F.lit("b").alias("buffer_id"), F.col("id").cast("int").alias("shard_index"), (F.col("id") * 640 + 17).alias("offset_bytes"), F.lit(640).cast("bigint").alias("size_bytes"))
    begin = time.time()
    out = shards.tensors_in_shards(t, s, rows_per_block=200_000).agg(F.sum("length"), F.count("*"), F.max("length")).first()
    assert tuple(out) == (total - 17, 11 * m - 1, 64)
    assert time.time() - begin < 90


def test_gaps_give_no_slices(spark):
    t = spark.createDataFrame([("b", "x", 0, 10), ("b", "y", 20, 10), ("c", "z", 0, 5)], "buffer_id string, name string, offset bigint, nbytes bigint")
    s = spark.createDataFrame([("b", 0, 5, 3), ("b", 1, 12, 10), ("d", 0, 0, 9)], "buffer_id string, shard_index int, offset_bytes bigint, size_bytes bigint")
    assert sorted(map(tuple, shards.tensors_in_shards(t, s).collect())) == [("b", 0, "x", 5, 0, 3), ("b", 1, "y", 0, 8, 2)]


def test_split_values(spark):
    rows = [("a", 10, 4), ("b", 3, 4), ("c", 600 * GIB, 8), ("d", 5, 0), ("e", 5, -1)]
    df = spark.createDataFrame(rows, "buffer_id string, total_bytes bigint, num_shards int")
    got = {}
    for r in shards.split_shards(df).orderBy("buffer_id", "shard_index").collect():
        got.setdefault(r.buffer_id, []).append((r.offset_bytes, r.size_bytes))
    assert got["a"] == [(0, 3), (3, 3), (6, 2), (8, 2)]
    assert [s for _, s in got["b"]] == [1, 1, 1, 0]
    assert got["c"] == [(i * 80530636800, 80530636800) for i in range(8)]
    assert set(got) == {"a", "b", "c"}


def test_scatter_plan_values(spark):
    df = spark.createDataFrame([("big__shard_0", 10 * GIB)], "buffer_id string, total_bytes bigint")
    plan = shards.scatter_plan(df, F.array(F.lit("n1"), F.lit("n2"))).orderBy("shard_index").collect()
    assert [(r.target_node, r.target_buffer, r.rank, r.offset_bytes, r.length_bytes, r.target_gpu) for r in plan] == [
        ("n1", "big__shard_0", 1, 0, 5368709120, 0),
        ("n2", "big__shard_1", 2, 5368709120, 5368709120, 1),
    ]


def test_model_shapes(spark):
    shapes = [[1024, 1024], [1024], [512, 1024], [512]]
    df = spark.createDataFrame([("m", i, f"p{i}", "BF16", s) for i, s in enumerate(shapes)], "buffer_id string, ordinal bigint, name string, dtype string, shape array<bigint>")
    row = catalog.model_size(catalog.with_sizes(df)).first()
    n = 1024 * 1024 + 1024 + 512 * 1024 + 512
    assert (row.tensors, row.params, row.total_bytes, row.buffer_bytes) == (4, n, 2 * n, int(2 * n * 1.05))
    packed = catalog.pack_offsets(catalog.with_sizes(df))
    first = catalog.pack_overflow(packed, F.lit(2 * 1024 * 1024 + 2048)).collect()
    assert [(r.name, r.offset) for r in first] == [("p2", 2 * 1024 * 1024 + 2048)]


def test_typed_views(spark):
    half = np.array([7.0] * 5, "<f2")
    wide = np.array([1.5, -2.0, 3e38], "<f4")
    brain = (wide.view("<u4") >> 16).astype("<u2")
    rows = [
        ("t", 0, "F16", half.tobytes()),
        ("t", 1, "F32", wide.tobytes()),
        ("t", 2, "BF16", brain.tobytes()),
        ("t", 3, "F16", b"abc"),
        ("t", 4, "I32", b"abcd"),
        ("t", 5, "F16", b""),
    ]
    df = spark.createDataFrame(rows, "buffer_id string, ordinal bigint, dtype string, payload binary")
    got = {r.ordinal: r for r in payload.typed_view(df).collect()}
    assert got[0]["values"] == [7.0] * 5
    assert got[1]["values"] == wide.tolist()
    assert got[2]["values"][:2] == [1.5, -2.0]
    assert (got[3]["values"], got[3].error) == (None, "3 bytes is not a multiple of 2")
    assert got[4].error == "not a float dtype" and got[5]["values"] == []
    stats = payload.tensor_stats(payload.typed_view(df.where("ordinal in (0, 1)")), ["buffer_id"], "ordinal").first()
    assert (stats.elements, stats.first) == (8, [7.0] * 5)


def test_replicas(spark):
    schema = "buffer_id string, name string, payload binary"
    left = [("b", "x", b"1"), ("b", "y", b"2"), ("b", "z", b"")] + [("b", "many", b"5")] * 50 + [("b", "mixed", b"6")]
    right = [("b", "x", b"1"), ("b", "y", b"3"), ("b", "w", b"4")] + [("b", "many", b"5")] * 70
    right += [("b", "mixed", b"6"), ("b", "mixed", b"7")]
    checked = payload.verify_replicas(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema))
    got = {r.name: r.verdict for r in checked.collect()}
    assert got == {"x": "MATCH", "y": "DIFF", "z": "MISSING_RIGHT", "w": "MISSING_LEFT", "many": "MATCH", "mixed": "DIFF"}
    assert checked.count() == 6


def test_numbers_are_unfolded_in_pages(spark):
    df = spark.createDataFrame([("a", 5, 10000), ("b", 0, 0), ("c", 7, 1), ("d", 0, -3)], "k string, f bigint, n bigint")
    for spread in (False, True):
        out = shards.unfold(df, F.col("f"), F.col("n"), "i", spread)
        got = {r.k: (r.lo, r.hi, r.c, r.d) for r in out.groupBy("k").agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.count("*").alias("c"), F.countDistinct("i").alias("d")).collect()}
        assert got == {"a": (5, 10004, 10000, 10000), "c": (7, 7, 1, 1)}


def test_digest_tree_sees_order_and_depth(spark):
    rows = [("b", i, f"h{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "buffer_id string, position bigint, sha256 string")
    one = payload.buffer_digests(df, levels=4, fan_in=3).first().digest
    swapped = df.withColumn("sha256", F.when(F.col("position") == 4, "h5").when(F.col("position") == 5, "h4").otherwise(F.col("sha256")))
    assert payload.buffer_digests(swapped, levels=4, fan_in=3).first().digest != one
    with pytest.raises(Exception, match="more levels"):
        payload.buffer_digests(df, levels=2, fan_in=3).collect()


PUBLISHED_SECONDS = [2.2654, 2.2887, 2.2536, 2.3122, 2.3310, 2.3901, 2.3543, 2.3034]


def test_published_streams(spark):
    rows = [("best", i, s, 75 * GIB) for i, s in enumerate(PUBLISHED_SECONDS)]
    df = spark.createDataFrame(rows, "run string, stream int, seconds double, bytes bigint")
    r = measures.concurrent_streams(df).first()
    assert (round(r.avg_seconds, 4), r.max_seconds, r.total_gib) == (2.3123, 2.3901, 600.0)
    assert (round(r.aggregate_gbps, 1), round(r.per_stream_gbps, 2), round(r.spread_seconds, 4)) == (251.0, 32.43, 0.1365)
    assert (r.fastest, r.slowest) == (2, 5)
    assert [x.stream for x in measures.slowest_streams(df, 3).orderBy("place").collect()] == [5, 6, 4]


FILES = "array<struct<index:int,path:string,size_bytes:bigint>>"
BUFFERS = (
    "namespace string, name string, capacity string, source_path string, "
    f"sharding struct<strategy:string,num_shards:int,shard_files:{FILES},file_pattern:string>"
)


def test_buffer_and_claim_conditions(spark):
    def spec(n, files=(), pattern=""):
        return ("TensorParallel", n, [(i, p, s) for i, p, s in files], pattern)

    declared = [
        ("none", "1Gi", None),
        ("zero", "1Gi", spec(0)),
        ("both", "1Gi", spec(1, [(0, "a", 1)], "p*")),
        ("count", "1Gi", spec(2, [(0, "a", 1)])),
        ("range", "1Gi", spec(2, [(0, "a", 1), (2, "b", 1)])),
        ("dup", "1Gi", spec(2, [(1, "a", 1), (1, "b", 2)])),
        ("nocap", "", spec(2)),
        ("badcap", "10GiB", spec(2)),
        ("pattern", "10GiB", spec(2, (), "m-*")),
        ("even", "10", spec(4)),
    ]
    df = spark.createDataFrame([("d", n, c, "/m/", s) for n, c, s in declared], BUFFERS)
    checked = buffers.validate_buffers(df)
    got = {r.name: (r.status, r.reason, r.message, r.dup_index) for r in checked.collect()}
    bad = "quantities must match the regular expression '^([+-]?[0-9.]+)([eEinumkKMGTP]*[-+]?[0-9]*)$'"
    assert got == {
        "none": (None, None, None, False),
        "zero": ("False", "InvalidSpec", "numShards must be > 0", False),
        "both": ("False", "InvalidSpec", "shardFiles and filePattern are mutually exclusive", False),
        "count": ("False", "DiscoveryFailed", "shardFiles count (1) does not match numShards (2)", False),
        "range": ("False", "DiscoveryFailed", "shard index 2 out of range [0, 2)", False),
        "dup": ("True", "ShardsDiscovered", "Discovered 2 shards", True),
        "nocap": ("False", "DiscoveryFailed", "sharding requires either shardFiles, filePattern, or capacity to compute splits", False),
        "badcap": ("False", "DiscoveryFailed", f'invalid capacity "10GiB": {bad}', False),
        "pattern": ("True", "ShardsDiscovered", "Discovered 2 shards", False),
        "even": ("True", "ShardsDiscovered", "Discovered 4 shards", False),
    }
    found = buffers.discovered_shards(checked)
    listed = sorted((r.name, r.shard_index, r.stored_index, r.path, r.size_bytes) for r in found.collect())
    assert listed == [
        ("dup", 0, 0, "", 0),
        ("dup", 1, 1, "b", 2),
        ("even", 0, 0, "/m/", 3),
        ("even", 1, 1, "/m/", 3),
        ("even", 2, 2, "/m/", 2),
        ("even", 3, 3, "/m/", 2),
        ("pattern", 0, 0, "/m/model-00001-of-00002.safetensors", 0),
        ("pattern", 1, 1, "/m/model-00002-of-00002.safetensors", 0),
    ]
    asked = [
        ("c1", "even", 3, None),
        ("c2", "even", 4, None),
        ("c3", "even", None, {"ray.io/rank": "2 of 4"}),
        ("c4", "even", None, {"ray.io/rank": "x"}),
        ("c5", "none", None, None),
        ("c6", "gone", 0, None),
        ("c7", "zero", 0, None),
        ("c8", "dup", 0, None),
    ]
    schema = "namespace string, name string, buffer_name string, shard_index int, annotations map<string,string>"
    claim_rows = spark.createDataFrame([("d", *a) for a in asked], schema)
    out = {r.name: (r.status, r.reason, r.message) for r in claims.resolve_shards(claim_rows, checked, found).collect()}
    no_rank = (
        'shardIndex not specified and no rank annotation found on claim "c4"; '
        "set spec.shardIndex or add annotation wpi.io/shard-index"
    )
    assert out == {
        "c1": ("True", "BufferFound", "Validated. Assigned shard 3 of 4 (path: /m/, size: 2 bytes)"),
        "c2": ("False", "ShardValidationFailed", "shardIndex 4 out of range [0, 4)"),
        "c3": ("True", "BufferFound", "Validated. Assigned shard 2 of 4 (path: /m/, size: 2 bytes)"),
        "c4": ("False", "ShardValidationFailed", no_rank),
        "c5": ("True", "BufferFound", "Referenced WeightBuffer was found"),
        "c6": ("False", "BufferNotFound", "Referenced WeightBuffer was not found"),
        "c7": ("False", "ShardValidationFailed", "WeightBuffer sharding not yet discovered (totalShards=0)"),
        "c8": ("True", "BufferFound", "Validated. Assigned shard 0 of 2 (path: , size: 0 bytes)"),
    }


def test_overlapping_assignments(spark):
    """Many targets that ask for the same bytes each get them, a piece per row."""
    body = bytes(range(250)) * 4
    rows = spark.createDataFrame([("b", 0, body)], "buffer_id string, ordinal bigint, payload binary")
    chunks = payload.pack_chunks(payload.with_payload_offsets(rows), 64)
    asked = spark.createDataFrame(
        [("b", f"t{i}", i, 10 * (i % 7), 300) for i in range(200)],
        "buffer_id string, target_buffer string, shard_index int, offset_bytes bigint, length_bytes bigint",
    )
    got = {}
    for r in payload.scatter(chunks, asked, 64).orderBy("byte_start").collect():
        assert len(r.bytes) <= 64
        got[r.target_buffer] = got.get(r.target_buffer, b"") + bytes(r.bytes)
    assert got == {f"t{i}": body[10 * (i % 7) :][:300] for i in range(200)}


def test_many_declared_shards(spark):
    n = 20_000
    files = [(i ^ 1, f"/f{i}", i) for i in range(n)]
    files[5] = (0, "/again", 99)
    schema = (
        "namespace string, name string, source_path string, capacity string, total_shards int, "
        "sharding struct<num_shards:int, shard_files:array<struct<index:int,path:string,size_bytes:bigint>>, file_pattern:string>"
    )
    rows = spark.createDataFrame([("d", "b", "/m", "10", n, (n, files, "")), ("d", "off", "/m", "10", 0, (0, [], ""))], schema)
    got = {r.shard_index: (r.stored_index, r.path, r.size_bytes) for r in buffers.discovered_shards(rows).collect()}
    assert len(got) == n
    assert got[0] == (0, "/again", 99) and got[4] == (0, "", 0) and got[7] == (7, "/f6", 6)


def test_broadcast_ranges(spark):
    sizes = spark.createDataFrame([("a", 10), ("e", 0)], "buffer_id string, total_bytes bigint")
    targets = spark.createDataFrame([("a", "n1"), ("a", "n2"), ("e", "n1")], "buffer_id string, target_node string")
    got = {(r.buffer_id, r.target_node): (r.total_bytes, r.chunks) for r in shards.broadcast_ranges(sizes, targets, 4).collect()}
    assert got == {("a", "n1"): (10, 3), ("a", "n2"): (10, 3), ("e", "n1"): (0, 0)}

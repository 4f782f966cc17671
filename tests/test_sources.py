"""Readers and writers on small files."""

import json
import random
import struct
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballast.operators import buffers, catalog, claims, inventory, measures, payload, shards
from ballast.session import conf
from ballast.sources import inventory as inventory_source
from ballast.sources import logs, objects, safetensors, sinks, update_info

GIB = 1 << 30


def write_safetensors(path, tensors):
    header, data = {"__metadata__": {"format": "pt"}}, b""
    for name, dtype, shape, raw in tensors:
        header[name] = {"dtype": dtype, "shape": shape, "data_offsets": [len(data), len(data) + len(raw)]}
        data += raw
    text = json.dumps(header).encode()
    path.write_bytes(struct.pack("<Q", len(text)) + text + data)
    return data


@pytest.fixture
def checkpoint(tmp_path):
    rng = np.random.default_rng(1)
    first = [("weight", "F16", [16, 8], rng.bytes(256)), ("b.bias", "BF16", [8], rng.bytes(16)), ("empty", "F32", [0], b"")]
    second = [("a", "F32", [], rng.bytes(4)), ("big", "U8", [5000], rng.bytes(5000))]
    folder = tmp_path / "ckpt"
    (folder / "deep").mkdir(parents=True)
    data = {
        "one": write_safetensors(folder / "one.safetensors", first),
        "two": write_safetensors(folder / "deep" / "two.safetensors", second),
    }
    (folder / "config.json").write_text("{}")
    return str(folder), data


def test_safetensors_headers(spark, checkpoint):
    safetensors.register(spark)
    rows = spark.read.format("safetensors").option("filesPerTask", "1").load(checkpoint[0])
    got = [tuple(r)[1:] for r in rows.orderBy(F.col("path").desc(), "ordinal").collect()]
    assert got == [
        (0, "weight", "F16", [16, 8], 0, 256, 256),
        (1, "b.bias", "BF16", [8], 256, 272, 16),
        (2, "empty", "F32", [0], 272, 272, 0),
        (0, "a", "F32", [], 0, 4, 4),
        (1, "big", "U8", [5000], 4, 5004, 5000),
    ]
    assert rows.rdd.getNumPartitions() == 2
    sized = catalog.with_sizes(rows.drop("nbytes")).join(rows.select("path", "name", F.col("nbytes").alias("said")), ["path", "name"])
    assert sized.where("nbytes <> said").count() == 0


def test_safetensors_payload_is_cut(spark, checkpoint):
    safetensors.register(spark)
    reader = spark.read.format("safetensors").option("payload", "true").option("chunkBytes", "100").option("taskBytes", "1000")
    rows = reader.load(checkpoint[0]).collect()
    for name, data in checkpoint[1].items():
        pieces = sorted((r.byte_start, bytes(r.bytes)) for r in rows if r.path.endswith(f"{name}.safetensors"))
        assert b"".join(b for _, b in pieces) == data
        assert all(len(b) <= 100 for _, b in pieces)


def test_object_lists(spark, tmp_path):
    buffer_items = [
        {
            "metadata": {"namespace": "d", "name": "wb"},
            "spec": {"capacity": "10", "sourcePath": "/m", "sharding": {"strategy": "Custom", "numShards": 4}},
            "status": {"conditions": [{"type": "Ready", "status": "True", "reason": "Earlier", "message": "m"}]},
        },
        {"metadata": {"namespace": "d", "name": "plain"}, "spec": {"capacity": "10Gi"}},
    ]
    claim_items = [
        {"metadata": {"namespace": "d", "name": "c0", "annotations": {"ray.io/rank": "1"}}, "spec": {"weightBufferName": "wb"}},
        {"metadata": {"namespace": "d", "name": "c1"}, "spec": {"weightBufferName": "wb", "shardIndex": 0}},
        {"metadata": {"namespace": "e", "name": "c2"}, "spec": {"weightBufferName": "wb", "shardIndex": 0}},
    ]
    rc_items = [
        {"metadata": {"namespace": "d", "name": "c1", "uid": "u1"}, "spec": {"devices": {"requests": [{"name": "r", "exactly": {"deviceClassName": "wpi-device-class"}}]}}},
        {"metadata": {"namespace": "d", "name": "x", "uid": "u2"}, "spec": {"devices": {"requests": [{"name": "r"}]}}},
    ]
    for kind, items in {"WeightBuffer": buffer_items, "WeightClaim": claim_items, "ResourceClaim": rc_items}.items():
        (tmp_path / f"{kind}.json").write_text(json.dumps({"kind": "List", "items": items}, indent=1))

    def read(kind):
        return objects.read_object_list(spark, str(tmp_path / f"{kind}.json"), kind)

    checked = buffers.validate_buffers(objects.buffers(read("WeightBuffer")))
    by_name = {r.name: r for r in checked.collect()}
    assert (by_name["wb"].reason, by_name["wb"].message, by_name["wb"].ready_reason) == ("ShardsDiscovered", "Discovered 4 shards", "Earlier")
    assert (by_name["plain"].reason, by_name["plain"].ready_reason) == (None, "BufferCreated")
    resolved = claims.resolve_shards(objects.claims(read("WeightClaim")), checked, buffers.discovered_shards(checked))
    got = {r.name: (r.reason, r.assigned_index, r.shard_path, r.shard_bytes) for r in resolved.collect()}
    assert got == {"c0": ("BufferFound", 1, "/m", 3), "c1": ("BufferFound", 0, "/m", 3), "c2": ("BufferNotFound", None, None, None)}
    rcs = objects.resource_claims(read("ResourceClaim"))
    assert [r.name for r in claims.filter_unallocated(claims.filter_device_class(rcs)).collect()] == ["c1"]
    drift = {(r.name, r.action) for r in claims.reconcile_diff(resolved, rcs).collect()}
    assert drift == {("c0", "CREATE"), ("x", "DELETE")}


def test_malformed_list_fails(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"items": [{"metadata": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        objects.read_object_list(spark, str(tmp_path / "bad.json"), "WeightClaim").collect()


def test_transfer_log(spark, tmp_path):
    (tmp_path / "node.log").write_text(
        "2024-05-01 10:00:00,123 - INFO - Target NCCL SCATTER recv complete in 2.2654s. Bandwidth: 33.11 GB/s\n"
        "2024-05-01 10:00:01,000 - INFO - Source NCCL BROADCAST complete in 0.5000s. Bandwidth: 20.00 GB/s \n"
        "2024-05-01 10:00:02,000 - INFO - Target NCCL SCATTER recv started\n"
        "junk\n\n"
    )
    got = [tuple(r) for r in logs.read_transfer_log(spark, str(tmp_path)).orderBy("ts").collect()]
    assert got == [
        (datetime(2024, 5, 1, 10, 0, 0, 123000), "INFO", "Target", "SCATTER", 2.2654, 33.11),
        (datetime(2024, 5, 1, 10, 0, 1), "INFO", "Source", "BROADCAST", 0.5, 20.0),
    ]


def fleet(n, seed):
    r = random.Random(seed)
    items = []
    for i in range(n):
        text = r.choice(["plain", 'with "quotes" and \\ back', "brackets ]}[{ , inside", "line\nbreak", "\u00e9 \u2028", ""])
        spec = {"capacity": f"{i}Gi", "sourcePath": text}
        if i % 3 == 0:
            files = [{"index": k, "path": f"/m/{k}", "sizeBytes": k * 10} for k in range(r.randrange(4))]
            spec["sharding"] = {"strategy": "Custom", "numShards": 4, "shardFiles": files}
        items.append({"metadata": {"namespace": "d", "name": f"wb{i}", "annotations": {}}, "spec": spec})
    return items


@pytest.mark.parametrize("indent, rows_per_block", [(4, 1 << 20), (1, 50), (None, 1 << 20)])
def test_large_object_lists_are_read_in_parts(spark, tmp_path, indent, rows_per_block):
    lists = {
        "a": {"apiVersion": "v1", "items": fleet(60, 1), "kind": "List", "metadata": {"items": {"x": {"y": [{"items": 1}]}}}},
        "b": {"kind": "List", "metadata": {"resourceVersion": "items"}, "items": fleet(40, 2)},
        "empty": {"items": [], "kind": "List"},
        "none": {"kind": "List", "items": None},
    }
    for name, content in lists.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(content, indent=indent, ensure_ascii=False))
    want = sorted(map(str, objects.read_object_list(spark, str(tmp_path), "WeightBuffer").collect()))
    with conf(spark, spark__sql__files__maxPartitionBytes="3000", spark__sql__files__openCostInBytes="0"):
        assert indent is None or spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = objects.read_large_object_list(spark, str(tmp_path), "WeightBuffer", rows_per_block=rows_per_block)
        found = sorted(map(str, got.collect()))
    assert found == want and len(found) == 100


def test_odd_layouts_are_read_whole(spark, tmp_path):
    item = '{"metadata": {"name": "%s"}, "spec": {"capacity": "1"}}'
    texts = {
        "one": '{"items": [' + item % "a" + ",\n" + item % "b" + "]\n}",
        "two": '{\n"items": [\n' + item % "c" + ",\n" + item % "d" + "\n]\n}",
        "three": '{\n"items": [{\n"metadata": {"name": "e"}\n}, {\n"metadata": {"name": "f"}\n}]}',
        "four": '{\n"items": [\n{\n"metadata": {"name": "g"}}, {"metadata": {"name": "h"}\n}\n]\n}',
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = objects.read_large_object_list(spark, str(tmp_path), "WeightBuffer").collect()
    assert sorted(r.metadata.name for r in got) == list("abcdefgh")


def test_gpu_inventory(spark, tmp_path):
    for node, text in {"n1": "81559 MiB\n1 MiB\n", "n2": "", "n3": "oops MiB\n", "n4": "100 MiB"}.items():
        (tmp_path / f"{node}.csv").write_text(text)
    (tmp_path / "rack").mkdir()
    (tmp_path / "rack" / "n5").write_text("7 MiB\n")
    parsed = inventory_source.read_gpu_inventory(spark, str(tmp_path))
    devices = sorted(tuple(r) for r in inventory.devices(parsed).collect())
    assert devices == [
        ("n1", "wpi-device-0", 81559 << 20),
        ("n1", "wpi-device-1", 81559 << 20),
        ("n4", "wpi-device-0", 100 << 20),
        ("n5", "wpi-device-0", 7 << 20),
    ]
    errors = {r.node: r.error for r in inventory.inventory_errors(parsed).collect()}
    assert errors["n3"] == "failed to parse memory value 'oops'" and set(errors) == {"n2", "n3"}


def test_update_info(spark):
    tensors = spark.createDataFrame(
        [("b", 0, "w", "BF16", [768, 768]), ("b", 1, "v", "BF16", [768])],
        "buffer_id string, ordinal bigint, name string, dtype string, shape array<bigint>",
    )
    info = update_info.tensors_to_update_info(catalog.pack_offsets(catalog.with_sizes(tensors)))
    row = info.first()
    assert (row.offsets, row.total_bytes, row.shapes) == ([0, 1179648], 1181184, [[768, 768], [768]])
    assert update_info.from_json(update_info.to_json(info)).collect() == info.collect()
    checked = catalog.check_parallel_arrays(info.withColumn("dtype_names", F.array(F.lit("BF16"))))
    assert checked.first().reason == "`dtype_names` should be of the same size as `names`: 1 vs 2"


def test_shard_sink(spark, tmp_path):
    docs = spark.createDataFrame([("b", i, bytes([i]) * (i * 7)) for i in range(40)], "buffer_id string, ordinal bigint, payload binary")
    whole = b"".join(bytes([i]) * (i * 7) for i in range(40))
    packed = payload.with_payload_offsets(docs)
    total = spark.createDataFrame([("b", len(whole), 3)], "buffer_id string, total_bytes bigint, num_shards int")
    cut = shards.split_shards(total).select(
        "buffer_id", F.concat(F.lit("b__shard_"), "shard_index").alias("target_buffer"), "shard_index", "offset_bytes",
        F.col("size_bytes").alias("length_bytes"),
    )
    pieces = payload.scatter(payload.pack_chunks(packed, 64), cut, 64)
    sinks.write_shards(pieces, str(tmp_path / "out"), range_bytes=500)
    back = spark.read.parquet(str(tmp_path / "out")).orderBy("byte_start").collect()
    assert b"".join(bytes(r.bytes) for r in back) == whole
    assert {r.target_buffer for r in back} == {"b__shard_0", "b__shard_1", "b__shard_2"}
    for r in cut.collect():
        own = b"".join(bytes(x.bytes) for x in back if x.target_buffer == r.target_buffer)
        assert own == whole[r.offset_bytes : r.offset_bytes + r.length_bytes]


def test_summary_sink(spark, tmp_path):
    rows = [("r", i, p, 1.0 + i, GIB) for i in range(30) for p in ("pack", "total")]
    df = spark.createDataFrame([(a, 2 * b + (c == "total"), c, d, e) for a, b, c, d, e in rows], "run string, seq bigint, phase string, seconds double, bytes bigint")
    models = spark.createDataFrame([("r", "tiny", 124_400_000, GIB // 4)], "run string, model string, num_params bigint, total_bytes bigint")
    sinks.write_summary(measures.latency_summary(df), str(tmp_path / "s"), models)
    record = json.loads(next((tmp_path / "s").glob("part-*.json")).read_text())
    assert record["run"] == "r" and set(record["phases"]) == {"pack_ms", "total_ms", "bandwidth_gbs"}
    assert set(record["phases"]["pack_ms"]) == {"mean", "median", "p50", "p95", "min", "max", "stddev"}
    assert record["phases"]["total_ms"]["max"] == 30_000.0 and record["phases"]["bandwidth_gbs"]["min"] == 1 / 30
    assert (record["model"], record["params"], record["weight_size_gb"], record["iters"]) == ("tiny", "124.4M", "0.250", 27)


def test_summary_without_models(spark):
    df = spark.createDataFrame([("r", i, "total", 1.0, GIB) for i in range(5)], "run string, seq bigint, phase string, seconds double, bytes bigint")
    summary = measures.latency_summary(df, warmup=1)
    record = measures.summary_record(summary).first()
    assert record.iters == 4 and set(record.phases) == {"total_ms", "bandwidth_gbs"}
    unknown = spark.createDataFrame([], "run string, model string, num_params bigint, total_bytes bigint")
    record = measures.summary_record(summary, unknown).first()
    assert (record.model, record.params, record.weight_size_gb) == (None, None, None)


def test_stored_status(spark, tmp_path):
    """A count stored earlier outlives a spec that became invalid, and a stored assignment reaches staging."""
    buffer_items = [
        {
            "metadata": {"namespace": "d", "name": "wb"},
            "spec": {"capacity": "10", "sourcePath": "/m", "sharding": {"strategy": "Custom", "numShards": 0}},
            "status": {
                "totalShards": 2,
                "discoveredShards": [{"index": 0, "path": "/a", "sizeBytes": 6}, {"index": 1, "path": "/b"}],
            },
        }
    ]
    claim_items = [
        {"metadata": {"namespace": "d", "name": "c"}, "spec": {"weightBufferName": "wb", "shardIndex": 1}, "status": {"assignedShardIndex": 1}},
        {"metadata": {"namespace": "d", "name": "auto"}, "spec": {"weightBufferName": "wb"}, "status": {"assignedShardIndex": 0}},
    ]
    for kind, items in {"WeightBuffer": buffer_items, "WeightClaim": claim_items}.items():
        (tmp_path / f"{kind}.json").write_text(json.dumps({"items": items}))
    found = objects.read_object_list(spark, str(tmp_path / "WeightBuffer.json"), "WeightBuffer")
    owned = objects.claims(objects.read_object_list(spark, str(tmp_path / "WeightClaim.json"), "WeightClaim"))

    assert buffers.validate_buffers(objects.buffers(found)).first().total_shards == 0
    resolved = claims.resolve_shards(owned, objects.stored_buffers(found), objects.stored_shards(found))
    got = {r.name: (r.status, r.shard_path, r.shard_bytes) for r in resolved.collect()}
    assert got == {"c": ("True", "/b", 0), "auto": ("False", None, None)}

    requests = spark.createDataFrame([("d", "u", "auto")], "namespace string, uid string, name string")
    held = spark.createDataFrame([], "namespace string, uid string, name string")
    for use, index in ((False, -1), (True, 0)):
        staged = claims.staging_requests(requests, held, owned, objects.buffers(found), use_assigned=use).first()
        assert (staged.buffer, staged.shard_index) == ("wb", index)

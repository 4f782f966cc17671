"""One query per operator, over the relations of ``relations``. Each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from ballast import functions as fn
from ballast.fixed_values import KIB
from ballast.functions import sql as sql_names
from ballast.operators import (
    buffers as buf,
    catalog,
    claims as clm,
    conditions,
    inventory as inv,
    lifecycle as life,
    measures,
    payload,
    pieces,
    shards,
    signals as sig,
)
from ballast.operators.horizon import first_in_horizon
from ballast.operators.skew import hot_keys
from ballast.plans import relations as rel
from ballast.schemas import EVENTS
from ballast.sources import logs, update_info
from ballast.session import shared_dir
from ballast.streaming import ledger, run, staging
from ballast.streaming import signals as stream_sig
from ballast.streaming.backfill import backfill

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Parameters of the registered queries, the same in their SQL counterparts.
BUCKET_BYTES = 128 * KIB
CHUNK_BYTES = 64 * KIB
PLAN_CHUNK_BYTES = 16 * KIB
PIECE_BYTES = KIB + 1
SESSION_GAP_SECONDS = 3600
LINE_RATE = 50.0
TOP_STREAMS = 3
STREAM_DELAY = "10 minutes"
STAGING_HORIZON_US = 2 * 86400 * 1_000_000
STAGING_DELAY_US = 600 * 1_000_000
BACKLOG_BATCHES = 3


def query(function: Query) -> Query:
    """Register under the function's name; timestamps leave as microseconds, in UTC."""

    @wraps(function)
    def run_query(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        out = function(spark, sf_dir)
        stamps = [f.name for f in out.schema.fields if isinstance(f.dataType, TimestampType)]
        return out.withColumns({c: F.unix_micros(c) for c in stamps}) if stamps else out

    REGISTRY[function.__name__] = run_query
    return run_query


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.table(spark, sf_dir, "events")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.finite_events_stream(spark, f"{sf_dir}/events.parquet", EVENTS)


def _six_places(value: Column) -> Column:
    """Six decimals, shifted off exact halves so that the order of a sum cannot decide the last digit."""
    return F.round(value + 1e-9, 6)


def _shape_text(df: DataFrame) -> DataFrame:
    return df.withColumn("shape", F.array_join(F.col("shape").cast("array<string>"), "x"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.pack_offsets(rel.tensors(spark, sf_dir), rel.TENSOR_ORDER)


# --- tensor catalog -------------------------------------------------------------------------------------------------


@query
def model_size(spark, sf_dir):
    return catalog.model_size(rel.tensors(spark, sf_dir))


@query
def pack_offsets(spark, sf_dir):
    packed = _packed(spark, sf_dir)
    return packed.select("buffer_id", "name", "position", F.col("offset").alias("byte_offset"), "nbytes")


@query
def pack_overflow(spark, sf_dir):
    over = catalog.pack_overflow(_packed(spark, sf_dir), F.lit(BUCKET_BYTES).cast("bigint"))
    return over.withColumnRenamed("offset", "byte_offset")


@query
def split_shards(spark, sf_dir):
    return shards.split_shards(rel.buffer_totals(spark, sf_dir)).orderBy("buffer_id", "shard_index")


@query
def tensors_in_shards(spark, sf_dir):
    cut = shards.split_shards(rel.buffer_totals(spark, sf_dir))
    return shards.tensors_in_shards(_packed(spark, sf_dir), cut)


@query
def update_info_roundtrip(spark, sf_dir):
    info = update_info.tensors_to_update_info(_packed(spark, sf_dir), 256)
    back = update_info.update_info_to_tensors(update_info.from_json(update_info.to_json(info)))
    return _shape_text(back).withColumnRenamed("offset", "byte_offset")


@query
def update_info_check(spark, sf_dir):
    info = update_info.tensors_to_update_info(_packed(spark, sf_dir), 256)
    kind = F.substring_index("buffer_id", "-", -1).cast("bigint") % 5

    def damaged(column: str, when: int):
        return F.when(kind == when, F.slice(column, 1, F.size(column) - 1)).otherwise(F.col(column))

    faulty = {c: damaged(c, i + 1) for i, c in enumerate(("dtype_names", "shapes", "offsets"))}
    checked = catalog.check_parallel_arrays(info.withColumns(faulty))
    return checked.select("buffer_id", "part", F.size("names").alias("tensors"), "reason")


@query
def scatter_plan(spark, sf_dir):
    number = F.substring_index("buffer_id", "-", -1).cast("bigint")
    few, many = (F.array(*[F.lit(f"10.0.{n}.{i}") for i in range(n)]) for n in (4, 8))
    return shards.scatter_plan(rel.buffer_totals(spark, sf_dir), F.when(number % 2 == 0, few).otherwise(many))


def _sent(spark, sf_dir):
    group = F.substring_index("buffer_id", "-", -1).cast("bigint") % 5
    buffers = rel.buffer_totals(spark, sf_dir).withColumn("_group", group)
    nodes = rel.table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("target_node"), (F.col("n_nationkey") % 5).cast("bigint").alias("_group")
    )
    targets = buffers.select("buffer_id", "_group").join(nodes, "_group").select("buffer_id", "target_node")
    return buffers, targets


@query
def broadcast_plan(spark, sf_dir):
    return shards.broadcast_plan(*_sent(spark, sf_dir), PLAN_CHUNK_BYTES)


@query
def broadcast_ranges(spark, sf_dir):
    return shards.broadcast_ranges(*_sent(spark, sf_dir), PLAN_CHUNK_BYTES)


# --- payload --------------------------------------------------------------------------------------------------------


def _payload_offsets(spark, sf_dir):
    return payload.with_payload_offsets(rel.documents(spark, sf_dir))


@query
def pack_chunks(spark, sf_dir):
    chunks = payload.pack_chunks(_payload_offsets(spark, sf_dir), CHUNK_BYTES)
    return chunks.select(
        "buffer_id",
        "chunk_no",
        "byte_start",
        F.octet_length("bytes").alias("length"),
        F.sha2("bytes", 256).alias("sha256"),
    )


@query
def unpack_roundtrip(spark, sf_dir):
    packed = _payload_offsets(spark, sf_dir)
    chunks = payload.pack_chunks(packed, CHUNK_BYTES)
    back = payload.unpack(chunks, payload.payload_offsets(rel.documents(spark, sf_dir)), CHUNK_BYTES)
    return payload.checksums(back).drop("crc32")


@query
def scatter_bytes(spark, sf_dir):
    packed = _payload_offsets(spark, sf_dir)
    chunks = payload.pack_chunks(packed, CHUNK_BYTES)
    sizes = rel.documents(spark, sf_dir).groupBy("buffer_id").agg(
        F.sum(F.octet_length("payload").cast("bigint")).alias("total_bytes")
    )
    plan = shards.scatter_plan(sizes, F.array(*[F.lit(f"10.0.4.{i}") for i in range(4)]))
    pieces = payload.scatter(chunks, plan, CHUNK_BYTES)
    return pieces.select(
        "target_buffer",
        "shard_index",
        "byte_start",
        F.octet_length("bytes").alias("length"),
        F.sha2("bytes", 256).alias("sha256"),
    )


@query
def verify_replicas(spark, sf_dir):
    named = rel.documents(spark, sf_dir).withColumn("name", F.concat(F.lit("t."), F.col("ordinal").cast("string")))
    d = F.col("ordinal")
    hurt = F.when(d % 97 == 0, F.concat("payload", F.lit(b"!"))).otherwise(F.col("payload"))
    left = named.where(d % 83 != 0)
    right = named.where(d % 89 != 0).withColumn("payload", hurt)
    return payload.verify_replicas(left, right).select("buffer_id", "name", "verdict")


@query
def payload_checksums(spark, sf_dir):
    return payload.checksums(rel.documents(spark, sf_dir)).drop("crc32")


@query
def payload_crc32(spark, sf_dir):
    return payload.checksums(rel.documents(spark, sf_dir)).drop("sha256")


def _unpacked(spark, sf_dir):
    """Documents packed and cut out again; most of them lie over several chunks, which begin at odd bytes."""
    chunks = payload.pack_chunks(_payload_offsets(spark, sf_dir), PIECE_BYTES)
    return pieces.unpack_pieces(chunks, payload.payload_offsets(rel.documents(spark, sf_dir)), PIECE_BYTES)


@query
def piece_digests(spark, sf_dir):
    return pieces.tensor_digests(_unpacked(spark, sf_dir))


@query
def buffer_digests(spark, sf_dir):
    placed = _payload_offsets(spark, sf_dir).select("buffer_id", "position", F.sha2("payload", 256).alias("sha256"))
    return payload.buffer_digests(placed)


def _stats_text(stats: DataFrame) -> DataFrame:
    return stats.withColumns(
        {
            "mean": _six_places(F.col("mean")),
            "first": F.array_join(F.transform("first", lambda x: F.round(x.cast("double") * 1000).cast("bigint").cast("string")), ","),
        }
    )


@query
def tensor_stats(spark, sf_dir):
    return _stats_text(payload.tensor_stats(rel.embeddings(spark, sf_dir), ["buffer_id", "ordinal"], "ordinal"))


@query
def typed_view_stats(spark, sf_dir):
    """Document bytes read as half floats, an error where their number is odd."""
    whole = rel.documents(spark, sf_dir).select(
        "buffer_id", "ordinal", F.lit("F16").alias("dtype"), F.lit(0).cast("bigint").alias("at"), F.col("payload").alias("bytes")
    )
    return _profile_columns(pieces.number_profile(whole))


def _profile_columns(profile: DataFrame) -> DataFrame:
    mean = _six_places(F.try_divide(F.col("total"), F.col("finite")))
    counts = [F.col(n).cast("int").alias(n) for n in ("elements", "finite")]
    return profile.select("buffer_id", "ordinal", "error", *counts, mean.alias("mean"))


@query
def typed_view_pieces(spark, sf_dir):
    """The same over the pieces of unpacked documents, whose cuts fall inside elements too."""
    return _profile_columns(pieces.number_profile(_unpacked(spark, sf_dir).withColumn("dtype", F.lit("F16"))))


# --- buffers --------------------------------------------------------------------------------------------------------


@query
def validate_buffers(spark, sf_dir):
    return buf.validate_buffers(rel.buffers(spark, sf_dir)).drop("sharding")


@query
def discovered_shards(spark, sf_dir):
    shown = buf.discovered_shards(buf.validate_buffers(rel.buffers(spark, sf_dir)))
    return shown.orderBy("namespace", "name", "shard_index")


@query
def parse_quantity(spark, sf_dir):
    both = rel.quantities(spark, sf_dir).unionByName(
        rel.buffers(spark, sf_dir).select(
            F.substring_index("name", "-", -1).cast("bigint").alias("id"), F.col("capacity").alias("quantity")
        )
    )
    return both.withColumn("bytes", fn.parse_quantity(F.col("quantity")))


@query
def align_up(spark, sf_dir):
    b = rel.buffers(spark, sf_dir).select(
        "name", fn.parse_quantity(F.col("capacity")).alias("bytes"), F.col("sharding.num_shards").alias("n")
    )
    staged = fn.size_or_default(F.col("bytes"))
    granule = F.when(F.col("n") > 0, F.col("n").cast("bigint") * 4096)
    return b.select(
        "name",
        staged.alias("staged"),
        fn.align_up(staged).alias("aligned"),
        fn.align_up(staged, granule).alias("aligned_own"),
    )


@query
def shard_files(spark, sf_dir):
    b = rel.buffers(spark, sf_dir)
    declared = b.where(F.col("sharding").isNotNull()).select(
        "name",
        F.when(F.substring("name", -1, 1) == "4", F.lit("")).otherwise(F.concat("source_path", F.lit("/"))).alias("source_path"),
        F.col("sharding.num_shards").alias("num_shards"),
        fn.parse_quantity(F.col("capacity")).alias("capacity_bytes"),
    )
    return shards.shard_files(declared).select("name", "shard_index", "path", "size_bytes")


# --- claims ---------------------------------------------------------------------------------------------------------


def _validated(spark, sf_dir):
    return buf.validate_buffers(rel.buffers(spark, sf_dir))


def _resolved(spark, sf_dir):
    validated = _validated(spark, sf_dir)
    return clm.resolve_shards(rel.claims(spark, sf_dir), validated, buf.discovered_shards(validated))


def _staging(spark, sf_dir):
    claims = rel.claims(spark, sf_dir)
    requests = rel.staging(spark, sf_dir, claims)
    return clm.staging_requests(requests, rel.resource_claims(claims), claims, rel.buffers(spark, sf_dir))


@query
def resolve_claims(spark, sf_dir):
    out = clm.resolve_claims(rel.claims(spark, sf_dir), rel.buffers(spark, sf_dir))
    return out.select("namespace", "name", "buffer_name", "found", "reason", "message")


@query
def resolve_shards(spark, sf_dir):
    return _resolved(spark, sf_dir).select(
        "namespace", "name", "status", "reason", "message", "assigned_index", "shard_path", "shard_bytes"
    )


@query
def shard_from_annotations(spark, sf_dir):
    c = rel.claims(spark, sf_dir)
    return c.select("id", "name", fn.shard_from_annotations(F.col("annotations")).alias("shard"))


@query
def staging_requests(spark, sf_dir):
    return _staging(spark, sf_dir)


@query
def over_capacity(spark, sf_dir):
    nodes = inv.node_memory(inv.parse_inventory(rel.inventory_reports(spark, sf_dir)))
    hot = hot_keys(rel.staging(spark, sf_dir, rel.claims(spark, sf_dir)), ["node"])
    return clm.over_capacity(_staging(spark, sf_dir), nodes, hot).select(
        "namespace", "claim", "node", "size_bytes", "memory_bytes", "verdict"
    )


@query
def device_class_any(spark, sf_dir):
    rcs = rel.resource_claims(rel.claims(spark, sf_dir))
    return clm.filter_unallocated(clm.filter_device_class(rcs)).select("namespace", "name", "uid")


@query
def reconcile_diff(spark, sf_dir):
    rcs = rel.resource_claims(rel.claims(spark, sf_dir))
    return clm.reconcile_diff(_resolved(spark, sf_dir), rcs)


@query
def effective_ids(spark, sf_dir):
    staged = _staging(spark, sf_dir)
    effective = fn.effective_buffer_id(F.col("buffer"), F.col("shard_index"), F.col("total_shards"))
    return staged.select(
        "claim",
        "buffer",
        "shard_index",
        "total_shards",
        fn.is_sharded(F.col("shard_index"), F.col("total_shards")).alias("sharded"),
        effective.alias("effective_id"),
        fn.base_buffer_id(effective).alias("base_id"),
    )


# --- lifecycle ------------------------------------------------------------------------------------------------------

LEDGER_COLUMNS = ["node", "effective_id", "claim", "seq", "op", "delta", "ref_count", "freed"]


@query
def refcount_history(spark, sf_dir):
    return life.refcount_history(rel.lifecycle(_events(spark, sf_dir))).select(*LEDGER_COLUMNS)


@query
def live_allocations(spark, sf_dir):
    return life.live_allocations(rel.lifecycle(_events(spark, sf_dir)))


@query
def bytes_by_gpu(spark, sf_dir):
    live = life.live_allocations(rel.lifecycle(_events(spark, sf_dir)))
    return life.bytes_by_gpu(live, rel.node_gpus(spark, sf_dir))


@query
def dedupe_staging(spark, sf_dir):
    first = life.dedupe_staging(rel.lifecycle(_events(spark, sf_dir)))
    return first.select(*life.STAGING_KEY, "seq", "requests")


@query
def stream_ledger(spark, sf_dir):
    lifecycle = rel.lifecycle(run.read_events_stream(spark, f"{sf_dir}/events.parquet", EVENTS))
    return ledger.allocation_ledger(lifecycle).where(~F.col("late")).select(*LEDGER_COLUMNS)


@query
def stream_dedupe_staging(spark, sf_dir):
    deduped = ledger.dedupe_staging_stream(rel.lifecycle(_event_stream(spark, sf_dir)), "3650 days")
    return run.run_available(deduped).where(F.col("seq") >= 0).select(*life.STAGING_KEY)


@query
def backfill_ledger(spark, sf_dir):
    """The live ledger over a backlog, taken in in several batches."""
    live = ledger.Ledger(spark, shared_dir(spark))
    backfill(rel.lifecycle(_events(spark, sf_dir)), "seq", live.advance, least_batches=BACKLOG_BATCHES)
    return live.changes().where(~F.col("late")).select(*LEDGER_COLUMNS)


STAGING_COLUMNS = [*life.STAGING_KEY, "seq", "total_shards", "ok", "size_bytes", "ts"]


@query
def staging_in_horizon(spark, sf_dir):
    stages = rel.lifecycle(_events(spark, sf_dir)).where(F.col("op") == life.STAGE)
    return first_in_horizon(stages, life.STAGING_KEY, F.unix_micros("ts"), STAGING_HORIZON_US).select(*STAGING_COLUMNS)


@query
def backfill_staging(spark, sf_dir):
    """The live filter of staging requests over a backlog, the last batch deciding all that waits."""
    lifecycle = rel.lifecycle(_events(spark, sf_dir))
    live = staging.StagingFilter(spark, shared_dir(spark), lifecycle.schema, STAGING_HORIZON_US, STAGING_DELAY_US)
    batches = backfill(lifecycle, "ts", live.advance, least_batches=BACKLOG_BATCHES)
    live.advance(lifecycle.limit(0), batches, end=True)
    return live.kept().where(~F.col("late")).select(*STAGING_COLUMNS)


# --- signals --------------------------------------------------------------------------------------------------------


@query
def update_windows(spark, sf_dir):
    return sig.update_windows(rel.signals(_events(spark, sf_dir)))


@query
def update_timeouts(spark, sf_dir):
    return sig.update_timeouts(sig.update_windows(rel.signals(_events(spark, sf_dir))))


@query
def ready_metadata(spark, sf_dir):
    return sig.ready_metadata(rel.signals(_events(spark, sf_dir)))


@query
def deliver_signals(spark, sf_dir):
    signals = rel.signals(_events(spark, sf_dir))
    return sig.deliver_signals(signals, sig.subscriptions(signals))


@query
def subscription_receipts(spark, sf_dir):
    signals = rel.signals(_events(spark, sf_dir))
    return sig.subscription_receipts(signals, sig.subscriptions(signals))


@query
def step_sessions(spark, sf_dir):
    return sig.step_sessions(rel.signals(_events(spark, sf_dir)), SESSION_GAP_SECONDS)


@query
def stream_ready_metadata(spark, sf_dir):
    matched = stream_sig.ready_with_metadata(rel.signals(_event_stream(spark, sf_dir)), STREAM_DELAY)
    return run.run_available(matched).where(F.col("seq") >= 0)


@query
def stream_update_timeouts(spark, sf_dir):
    late = stream_sig.update_timeouts_stream(rel.signals(_event_stream(spark, sf_dir)), STREAM_DELAY)
    return run.run_available(late).where(F.col("seq") >= 0)


@query
def stream_step_sessions(spark, sf_dir):
    signals = rel.signals(_event_stream(spark, sf_dir))
    return run.run_available(stream_sig.step_sessions_stream(signals, SESSION_GAP_SECONDS, STREAM_DELAY)).where(
        F.col("ended_at") < F.lit(run.CLOSING_TIME).cast("timestamp")
    )


# --- measurements ---------------------------------------------------------------------------------------------------


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: _six_places(F.col(c)) for c in columns})


@query
def latency_summary(spark, sf_dir):
    out = measures.latency_summary(rel.transfers(_events(spark, sf_dir)))
    return _rounded(out, "mean", "median", "p50", "p95", "min", "max", "stddev")


@query
def mean_transfer(spark, sf_dir):
    out = measures.mean_transfer(rel.transfers(_events(spark, sf_dir)))
    return _rounded(out, "wall_seconds", "mean_seconds", "gbps")


@query
def concurrent_streams(spark, sf_dir):
    out = measures.concurrent_streams(rel.transfers(_events(spark, sf_dir)))
    rates = ["avg_seconds", "max_seconds", "total_gib", "aggregate_gbps", "per_stream_gbps", "spread_seconds"]
    return _rounded(out, *rates)


@query
def slowest_streams(spark, sf_dir):
    top = measures.slowest_streams(rel.transfers(_events(spark, sf_dir)), TOP_STREAMS)
    return top.select("run", "stream", "seconds", "place")


@query
def transfer_rates(spark, sf_dir):
    out = measures.transfer_rates(rel.transfers(_events(spark, sf_dir)), LINE_RATE)
    shown = out.select(
        "seq", "mode", "received_bytes", "logged_bytes", "sent_bytes", "received_gbps", "logged_gbps", "pct_of_line"
    )
    return _rounded(shown, "received_gbps", "logged_gbps", "pct_of_line")


@query
def sql_transfer_rates(spark, sf_dir):
    """``transfer_rates`` as SQL over the functions' names."""
    sql_names.register(spark)
    out = spark.sql(
        """SELECT seq, mode, received_bytes(mode, bytes, shard_length) AS received_bytes,
             logged_bytes(mode, bytes) AS logged_bytes, sent_bytes(mode, bytes, lengths) AS sent_bytes,
             throughput_gbps(received_bytes(mode, bytes, shard_length), seconds) AS received_gbps,
             throughput_gbps(logged_bytes(mode, bytes), seconds) AS logged_gbps,
             pct_of_line_rate(throughput_gbps(received_bytes(mode, bytes, shard_length), seconds), :line) AS pct_of_line
           FROM {transfers}""",
        args={"line": LINE_RATE},
        transfers=rel.transfers(_events(spark, sf_dir)),
    )
    return _rounded(out, "received_gbps", "logged_gbps", "pct_of_line")


@query
def sql_tensor_sizes(spark, sf_dir):
    """Sizes of tensors by the functions' SQL names."""
    sql_names.register(spark)
    return spark.sql(
        """SELECT buffer_id, name, itemsize(dtype) AS itemsize, numel(shape) AS numel, nbytes(dtype, shape) AS nbytes,
             align_up(nbytes(dtype, shape), 256L) AS aligned FROM {tensors}""",
        tensors=rel.tensors(spark, sf_dir),
    )


@query
def log_parse(spark, sf_dir):
    return logs.parse_transfer_log(rel.log_lines(_events(spark, sf_dir)))


# --- inventory ------------------------------------------------------------------------------------------------------


@query
def gpu_inventory(spark, sf_dir):
    return inv.devices(inv.parse_inventory(rel.inventory_reports(spark, sf_dir)))


@query
def inventory_errors(spark, sf_dir):
    return inv.inventory_errors(inv.parse_inventory(rel.inventory_reports(spark, sf_dir)))


@query
def device_snapshots(spark, sf_dir):
    return inv.device_snapshots(rel.snapshots(_events(spark, sf_dir)))


@query
def upsert_slices(spark, sf_dir):
    readable = rel.snapshots(_events(spark, sf_dir)).where(~F.col("failed"))
    current = readable.where(F.col("seq") % 3 == 0)
    updates = readable.where((F.col("seq") % 3 != 0) & (F.col("node") != "node-7"))
    return inv.upsert_slices(current, updates).select("node", "seq", "memory_mib", "ts")


@query
def stream_device_snapshots(spark, sf_dir):
    snaps = rel.snapshots(_event_stream(spark, sf_dir)).withWatermark("ts", STREAM_DELAY)
    return run.run_available(inv.device_snapshots(snaps)).where(F.col("seq") >= 0)


# --- conditions -----------------------------------------------------------------------------------------------------


@query
def condition_latest(spark, sf_dir):
    return conditions.condition_latest(rel.condition_updates(_events(spark, sf_dir)))


@query
def condition_transitions(spark, sf_dir):
    return conditions.condition_transitions(rel.condition_updates(_events(spark, sf_dir)))


@query
def stream_conditions(spark, sf_dir):
    updates = rel.condition_updates(run.read_events_stream(spark, f"{sf_dir}/events.parquet", EVENTS))
    return ledger.upsert_stream(
        updates, list(conditions.KEYS), "seq", conditions.deciding_updates, conditions.condition_latest
    )

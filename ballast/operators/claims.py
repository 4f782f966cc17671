"""Claims against buffers: resolution, staging requests, admission and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.fixed_values import DEVICE_CLASS, MSG_FOUND, MSG_NO_RANK, MSG_NOT_DISCOVERED, MSG_NOT_FOUND
from ballast.functions import parse_quantity, shard_from_annotations, whole_div
from ballast.operators.skew import ROWS_PER_TASK, hot_keys, join_spread
from ballast.session import written

# Joins here carry no broadcast hints, since buffers and claims both grow with the fleet: the planner compares the
# measured size of a side with its own limit. Rows that lean on one buffer or node are spread over tasks.

BUFFER_KEY = ("namespace", "buffer_name")


def _found(claims: DataFrame, buffers: DataFrame, hot: DataFrame | None) -> DataFrame:
    side = buffers.withColumnsRenamed({c: f"_b_{c}" for c in buffers.columns if c != "namespace"})
    side = side.withColumnRenamed("_b_name", "buffer_name").withColumn("_hit", F.lit(True))
    return join_spread(claims, side, BUFFER_KEY, hot).withColumn(
        "found", F.coalesce(F.col("_hit"), F.lit(False))
    )


def resolve_claims(claims: DataFrame, buffers: DataFrame) -> DataFrame:
    """Does each claim's buffer exist in the claim's own namespace?"""
    out = _found(claims, buffers.select("namespace", "name"), hot_keys(claims, BUFFER_KEY))
    return out.withColumns(
        {
            "reason": F.when(F.col("found"), F.lit("BufferFound")).otherwise(F.lit("BufferNotFound")),
            "message": F.when(F.col("found"), F.lit(MSG_FOUND)).otherwise(F.lit(MSG_NOT_FOUND)),
        }
    ).drop("_hit")


def resolve_shards(claims: DataFrame, validated: DataFrame, shards: DataFrame) -> DataFrame:
    """The Validated condition of every claim and the shard it is given.

    The index is the claim's own, else the first one its annotations carry. A shard without a row falls back to the
    buffer's path and size 0.
    """
    buffers = validated.select("namespace", "name", "source_path", "total_shards", F.col("sharding").isNotNull().alias("sharded"))
    c = F.col
    index = F.coalesce(c("shard_index").cast("bigint"), shard_from_annotations(c("annotations")))
    sharded = c("found") & F.coalesce(c("_b_sharded"), F.lit(False))
    hot = hot_keys(claims, BUFFER_KEY)
    claimed = _found(claims, buffers, hot).withColumn("_index", F.when(sharded, index))
    error = (
        F.when(~sharded, F.lit(None).cast("string"))
        .when(c("_b_total_shards") <= 0, F.lit(MSG_NOT_DISCOVERED))
        .when(c("_index").isNull(), F.format_string(MSG_NO_RANK, c("name")))
        .when(
            (c("_index") < 0) | (c("_index") >= c("_b_total_shards")),
            F.format_string("shardIndex %d out of range [0, %d)", c("_index"), c("_b_total_shards")),
        )
    )
    claimed = claimed.withColumn("_error", error)
    usable = sharded & c("_error").isNull()
    claimed = claimed.withColumn("assigned_index", F.when(usable, c("_index").cast("int")))
    rows = shards.select(
        "namespace",
        F.col("name").alias("buffer_name"),
        F.col("shard_index").alias("assigned_index"),
        F.col("path").alias("_path"),
        F.col("size_bytes").alias("_size"),
    )
    joined = join_spread(claimed, rows, [*BUFFER_KEY, "assigned_index"], hot)
    path = F.when(usable, F.coalesce("_path", "_b_source_path"))
    size = F.when(usable, F.coalesce("_size", F.lit(0).cast("bigint")))
    assigned = F.format_string(
        "Validated. Assigned shard %d of %d (path: %s, size: %d bytes)",
        c("assigned_index"),
        c("_b_total_shards"),
        c("shard_path"),
        c("shard_bytes"),
    )
    return joined.withColumns({"shard_path": path, "shard_bytes": size}).withColumns(
        {
            "status": F.when(c("found") & c("_error").isNull(), F.lit("True")).otherwise(F.lit("False")),
            "reason": F.when(~c("found"), F.lit("BufferNotFound"))
            .when(c("_error").isNotNull(), F.lit("ShardValidationFailed"))
            .otherwise(F.lit("BufferFound")),
            "message": F.when(~c("found"), F.lit(MSG_NOT_FOUND))
            .when(c("_error").isNotNull(), c("_error"))
            .when(usable, assigned)
            .otherwise(F.lit(MSG_FOUND)),
        }
    ).drop("_hit", "_index", "_error", "_path", "_size", "_b_source_path", "_b_total_shards", "_b_sharded")


def staging_requests(
    requests: DataFrame,
    resource_claims: DataFrame,
    claims: DataFrame,
    buffers: DataFrame,
    use_assigned: bool = False,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """What a node is asked to stage for each request: claim, buffer, path, bytes, shard and shard count.

    The claim is the resource claim with the request's uid, or the request's own name. Only an index written in the
    claim counts, so a claim that was given its shard automatically is staged whole while its size is divided;
    ``use_assigned`` reads ``assigned_index`` as well. Sizes are whole quotients, 0 when the capacity is unreadable.
    """
    by_uid = resource_claims.select("namespace", "uid", F.col("name").alias("_rc_name"))
    # No key of a table is hot that has no more rows than a hot key has.
    few = requests.limit(rows_per_task + 1).count() <= rows_per_task
    hot_uids = None if few else hot_keys(requests, ["namespace", "uid"], rows_per_task)
    named = join_spread(requests, by_uid, ["namespace", "uid"], hot_uids).withColumn("claim", F.coalesce("_rc_name", "name"))
    index = F.coalesce("shard_index", "assigned_index") if use_assigned else F.col("shard_index")
    by_name = claims.select(
        "namespace",
        F.col("name").alias("claim"),
        F.coalesce("buffer_name", F.lit("")).alias("buffer"),
        index.alias("_index"),
    )
    sized = buffers.select(
        "namespace",
        F.col("name").alias("buffer"),
        "source_path",
        parse_quantity(F.col("capacity")).alias("_bytes"),
        F.coalesce(F.col("sharding.num_shards"), F.lit(0)).alias("_total"),
    )
    hot_claims = hot_buffers = None
    if not few:
        # Requests are counted once, by claim; how many of them lean on a buffer follows from these counts.
        asked = written(named.groupBy("namespace", "claim").agg(F.count("*").alias("_asked")))
        hot_claims = hot_keys(asked, ["namespace", "claim"], rows_per_task, weight=F.col("_asked"))
        leaning = asked.join(by_name.drop("_index"), ["namespace", "claim"])
        hot_buffers = hot_keys(leaning, ["namespace", "buffer"], rows_per_task, weight=F.col("_asked"))
    claimed = join_spread(named, by_name, ["namespace", "claim"], hot_claims)
    joined = join_spread(claimed, sized, ["namespace", "buffer"], hot_buffers)
    joined = joined.withColumn("total_shards", F.coalesce("_total", F.lit(0)))
    total, size = F.col("total_shards"), F.col("_bytes")
    share = F.when(total > 0, whole_div(size, total)).otherwise(size)
    return joined.withColumns(
        {
            "buffer": F.coalesce("buffer", F.lit("")),
            "source_path": F.coalesce("source_path", F.lit("")),
            "size_bytes": F.coalesce(share, F.lit(0).cast("bigint")),
            "shard_index": F.coalesce("_index", F.lit(-1)),
        }
    ).drop("_rc_name", "_index", "_bytes", "_total", "name")


def over_capacity(staging: DataFrame, nodes: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Admission of each staging request: rejected when one device of its node is known to be too small.

    ``hot``, from ``hot_keys`` over the requests' nodes, spreads nodes that get a large share of all requests.
    """
    joined = join_spread(staging, nodes.select("node", "memory_bytes"), ["node"], hot)
    too_big = F.col("memory_bytes").isNotNull() & (F.col("size_bytes") > F.col("memory_bytes"))
    return joined.withColumn("verdict", F.when(too_big, F.lit("REJECT")).otherwise(F.lit("ADMIT")))


def filter_device_class(resource_claims: DataFrame, device_class: str = DEVICE_CLASS) -> DataFrame:
    """Keep claims with any exact request for the class; an alternative without ``exactly`` never matches."""
    hit = F.exists("requests", lambda r: F.coalesce(r["exactly"]["device_class"] == device_class, F.lit(False)))
    return resource_claims.where(hit)


def filter_unallocated(resource_claims: DataFrame) -> DataFrame:
    results: Column = F.coalesce(F.size(F.col("results")), F.lit(0))
    return resource_claims.where(results <= 0)


def reconcile_diff(validated_claims: DataFrame, resource_claims: DataFrame) -> DataFrame:
    """Resource claims missing for valid claims (CREATE), and ones whose claim no longer exists (DELETE).

    ``validated_claims`` holds every claim that exists. One that fails validation keeps the resource claim it has. Both
    tables are read once and meet in one aggregate.
    """
    keys = ["namespace", "name"]
    claim = validated_claims.select(
        *keys, F.coalesce(F.col("status") == "True", F.lit(False)).alias("valid"), F.lit(True).alias("exists"), F.lit(False).alias("held")
    )
    held = resource_claims.select(*keys, F.lit(False).alias("valid"), F.lit(False).alias("exists"), F.lit(True).alias("held"))
    met = claim.unionByName(held).groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("valid", "exists", "held")])
    action = F.when(F.col("valid") & ~F.col("held"), "CREATE").when(F.col("held") & ~F.col("exists"), "DELETE")
    return met.select(*keys, action.alias("action")).where(F.col("action").isNotNull())

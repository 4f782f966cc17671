"""Object lists exported from a cluster's API as JSON (``items[]``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.operators.blocks import BLOCK, drop_blocks, nearest, running_sum, settled, with_blocks
from ballast.schemas import KINDS
from ballast.session import written


def read_object_list(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One row per object of every list file under ``path``: metadata, spec and status. Malformed files fail."""
    reader = spark.read.schema(f"items array<{KINDS[kind]}>").option("multiLine", True).option("mode", "FAILFAST")
    return reader.json(path).select(F.explode("items").alias("o")).select("o.*")


def buffers(objects: DataFrame) -> DataFrame:
    """Buffer objects in the shape ``validate_buffers`` takes, and the shards their status holds."""
    files, found = (
        F.transform(
            F.coalesce(column, F.array()),
            lambda f: F.struct(
                f["index"].alias("index"),
                f["path"].alias("path"),
                F.coalesce(f["sizeBytes"], F.lit(0).cast("bigint")).alias("size_bytes"),
            ),
        )
        for column in ("spec.sharding.shardFiles", "status.discoveredShards")
    )
    sharding = F.struct(
        F.col("spec.sharding.strategy").alias("strategy"),
        F.coalesce("spec.sharding.numShards", F.lit(0)).alias("num_shards"),
        files.alias("shard_files"),
        F.coalesce("spec.sharding.filePattern", F.lit("")).alias("file_pattern"),
    )
    ready = F.filter(F.coalesce("status.conditions", F.array()), lambda c: c["type"] == "Ready")
    return objects.select(
        F.col("metadata.namespace").alias("namespace"),
        F.col("metadata.name").alias("name"),
        F.col("spec.capacity").alias("capacity"),
        F.coalesce("spec.sourcePath", F.lit("")).alias("source_path"),
        F.when(F.col("spec.sharding").isNotNull(), sharding).alias("sharding"),
        F.get(ready, F.lit(0))["reason"].alias("ready_reason"),
        F.coalesce("status.totalShards", F.lit(0)).alias("stored_total_shards"),
        found.alias("stored_shards"),
    )


def stored_buffers(objects: DataFrame) -> DataFrame:
    """Buffers with the shard count their status holds as ``total_shards``, to resolve claims against what was stored.

    The stored count stays when a later spec becomes invalid; ``validate_buffers`` gives what the spec says now.
    """
    return buffers(objects).withColumnRenamed("stored_total_shards", "total_shards")


def stored_shards(objects: DataFrame) -> DataFrame:
    """One row per discovered shard in the buffers' status, in the shape ``resolve_shards`` takes; place is the index."""
    listed = buffers(objects).select("namespace", "name", F.posexplode("stored_shards").alias("shard_index", "_shard"))
    return listed.select("namespace", "name", "shard_index", "_shard.path", "_shard.size_bytes")


def claims(objects: DataFrame) -> DataFrame:
    """Claim objects in the shape the claim operators take."""
    return objects.select(
        F.col("metadata.namespace").alias("namespace"),
        F.col("metadata.name").alias("name"),
        F.col("metadata.annotations").alias("annotations"),
        F.col("spec.weightBufferName").alias("buffer_name"),
        F.col("spec.shardIndex").alias("shard_index"),
        F.col("status.assignedShardIndex").alias("assigned_index"),
    )


def resource_claims(objects: DataFrame) -> DataFrame:
    requests = F.transform(
        F.coalesce("spec.devices.requests", F.array()),
        lambda r: F.struct(
            r["name"].alias("name"),
            F.when(
                r["exactly"].isNotNull(), F.struct(r["exactly"]["deviceClassName"].alias("device_class"))
            ).alias("exactly"),
        ),
    )
    return objects.select(
        F.col("metadata.namespace").alias("namespace"),
        F.col("metadata.name").alias("name"),
        F.col("metadata.uid").alias("uid"),
        requests.alias("requests"),
        F.transform(F.col("status.allocation.devices.results"), lambda r: r["device"]).alias("results"),
    )


# --- lists too large for one task -------------------------------------------------------------------------------------

def _block(rows: DataFrame) -> list[str]:
    return [BLOCK] if BLOCK in rows.columns else []


_STRING = r'"(?:[^"\\]|\\.)*"'


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of list files (file, place, line), ``place`` rising along each file.

    Spark's text reader cuts files where it likes and gives each cut's lines in order. A line is at least a byte long,
    so a cut's first byte and the number of lines before it in the cut place a line among all of its file.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"),
    )
    rows = written(rows)
    first = rows.groupBy("file", "_block").agg(F.min("_id").alias("_first"))
    return rows.join(first, ["file", "_block"]).select("file", (F.col("_block") + F.col("_id") - F.col("_first")).alias("place"), "line")


def read_large_object_list(spark: SparkSession, path: str, kind: str, **blocking: int) -> DataFrame:
    """``read_object_list`` for list files of any size, written with line breaks as API clients do.

    A JSON string holds no line break, so every line can be weighed by itself: how many brackets it opens and closes
    outside strings. A running sum over a file's lines, in blocks where a file has many, gives the depth each line
    begins at, and with it which lines belong to which object of ``items``. Lines then meet by object, and only an
    object is ever held whole. Files in which objects do not begin and end on lines of their own, such as those without
    any line breaks, are read whole, as ``read_object_list`` does. Malformed objects fail.
    """
    c = F.col
    bare = F.regexp_replace("line", _STRING, "")
    steps = F.transform(
        F.filter(F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), ""), lambda x: x != ""),
        lambda x: F.when(x.isin("{", "["), F.lit(1)).otherwise(F.lit(-1)),
    )
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low"), F.lit(0).alias("zeros"))

    def step(s: Column, x: Column) -> Column:
        depth = s["depth"] + x
        return F.struct(depth.alias("depth"), F.least(s["low"], depth).alias("low"), (s["zeros"] + (depth == 0).cast("int")).alias("zeros"))

    lines = _lines(spark, path).withColumn("_line", F.aggregate(steps, start, step))
    lines = lines.select(
        "file", "place", "line", F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")).alias("_text"),
        c("_line.depth").alias("_delta"), c("_line.low").alias("_low"), c("_line.zeros").alias("_zeros"),
    )
    placed = with_blocks(lines, ["file"], c("place"), **blocking)
    deep = settled(running_sum(placed, ["file"], ["place"], {"_after": c("_delta")}))
    before = c("_after") - c("_delta")
    key = F.nullif(F.regexp_extract("_text", r'^"((?:[^"\\]|\\.)*)"\s*:', 1), F.lit(""))
    known = nearest(deep.withColumn("_before", before), ["file"], ["place"], {"_under": F.when(before == 1, key)})
    inside = (c("_under") == "items") & (c("_before") >= 2)
    begins = inside & (c("_before") == 2) & c("_text").startswith("{")
    # Lines on which an object or the list begins or ends beside something else.
    least, text = c("_before") + c("_low"), c("_text")
    one_object = text.startswith("{") & (c("_low") == 0) & ((c("_zeros") == 0) | ((c("_zeros") == 1) & text.rlike(r"\},?$")))
    odd = (
        ((c("_before") == 0) & ~text.isin("", "{"))
        | ((least <= 1) & text.contains('"items"') & ~((c("_before") == 1) & text.rlike(r'^"items"\s*:\s*(\[|\[\s*\],?|null,?)$')))
        | (inside & (c("_before") == 2) & ~text.isin("", "]", "],") & ~one_object)
        | (inside & (c("_before") > 2) & (least <= 2) & ~text.isin("}", "},"))
    )
    counted = known.select(
        "file", "place", "line", "_before", inside.alias("_inside"), begins.alias("_begins"),
        F.coalesce(odd, F.lit(False)).alias("_odd"), *_block(known),
    )
    counted = running_sum(settled(counted), ["file"], ["place"], {"_item": F.coalesce(c("_begins").cast("int"), F.lit(0))})
    counted = written(drop_blocks(counted))
    whole = counted.where("_odd").select("file").distinct()
    files = [r.file for r in whole.collect()]
    own = counted.where(c("_inside") & ((c("_before") > 2) | c("_begins")))
    own = own if not files else own.join(whole, "file", "left_anti")
    texts = own.groupBy("file", "_item").agg(F.expr("listagg(line, '\n') within group (order by place)").alias("_json"))
    text = F.regexp_replace("_json", r",\s*$", "")
    parsed = texts.select(F.from_json(text, KINDS[kind], {"mode": "FAILFAST"}).alias("o")).select("o.*")
    for file in files:
        parsed = parsed.unionByName(read_object_list(spark, file, kind))
    return parsed

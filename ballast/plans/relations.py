"""Relations derived from the given tables, one per record kind the operators work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ballast.fixed_values import DEVICE_CLASS, GIB, MIB, RANK_ANNOTATIONS
from ballast.operators.catalog import with_sizes

# Iteration order of a buffer's tensors. Rows equal in all of these are interchangeable.
TENSOR_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "nbytes", "dtype")


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the file once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def _pick(index: Column, *values: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    flag = c("l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select(
        _text("wb-", c("l_suppkey")).alias("buffer_id"),
        _text("layer.", c("l_orderkey"), ".", c("l_linenumber"), ".", c("l_partkey")).alias("name"),
        F.when(flag == "A", F.lit("F16")).when(flag == "R", F.lit("F32")).otherwise(F.lit("BF16")).alias("dtype"),
        F.array(c("l_quantity").cast("bigint"), 1 + c("l_partkey") % 8).alias("shape"),
        *[c(o) for o in TENSOR_ORDER[:4]],
    )
    return with_sizes(rows)


def buffer_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every packed buffer and the number of shards it is split into (1 to 8)."""
    totals = tensors(spark, sf_dir).groupBy("buffer_id").agg(F.sum("nbytes").alias("total_bytes"))
    number = F.substring_index("buffer_id", "-", -1).cast("bigint")
    return totals.withColumn("num_shards", (1 + number % 8).cast("int"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        _text("doc-", F.col("lang")).alias("buffer_id"),
        F.col("doc_id").alias("ordinal"),
        F.encode("text", "utf-8").alias("payload"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        _text("emb-", F.col("label")).alias("buffer_id"),
        F.col("vec_id").alias("ordinal"),
        F.col("embedding").alias("values"),
    )


def buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared buffers, among them every kind of faulty shard declaration."""
    k = F.col("s_suppkey")
    n = (k % 9).cast("int")
    suffix = _pick(k % 7, "Gi", "Mi", "G", "M", "", "Ti", "GiB")
    capacity = F.when(k % 23 == 22, F.lit("")).otherwise(_text((1 + k % 97), suffix))
    count = F.when(k % 25 == 2, n + 1).otherwise(n)
    listed = ((k % 5 == 2) | (k % 35 == 1)) & (count > 0)

    def entry(i: Column) -> Column:
        last = i == count - 1
        index = F.when(last & (k % 25 == 7), n).when(last & (k % 25 == 12), F.lit(0)).otherwise(i)
        return F.struct(
            index.cast("int").alias("index"),
            _text("/models/", k, "/part-", i).alias("path"),
            ((i + 1) * 1000).cast("bigint").alias("size_bytes"),
        )

    files = F.when(listed, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), entry)).otherwise(
        F.array().cast("array<struct<index:int,path:string,size_bytes:bigint>>")
    )
    sharding = F.struct(
        _pick(k % 4, "TensorParallel", "ExpertParallel", "PipelineParallel", "Custom").alias("strategy"),
        n.alias("num_shards"),
        files.alias("shard_files"),
        F.when(k % 5 == 1, F.lit("model-*-of-*.safetensors")).otherwise(F.lit("")).alias("file_pattern"),
    )
    return table(spark, sf_dir, "supplier").select(
        _text("ns-", F.col("s_nationkey") % 5).alias("namespace"),
        _text("wb-", k).alias("name"),
        capacity.alias("capacity"),
        _text("/models/", k).alias("source_path"),
        F.when(k % 11 != 10, sharding).alias("sharding"),
    )


def quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity strings of all spellings, from account balances."""
    k = F.col("s_suppkey")
    cents = F.round(F.abs("s_acctbal") * 100).cast("bigint")
    number = _text(F.floor(cents / 100), ".", F.lpad((cents % 100).cast("string"), 2, "0"))
    sign = F.when(k % 13 == 12, F.lit("-")).when(k % 13 == 11, F.lit("+")).otherwise(F.lit(""))
    suffix = _pick(k % 16, "", "Ki", "Mi", "Gi", "Ti", "Pi", "k", "M", "G", "T", "m", "u", "e3", "E2", "KB", "gi")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), F.concat(sign, number, suffix).alias("quantity"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of buffers, some dangling and some in the wrong namespace."""
    c = F.col("c_custkey")
    supplier = table(spark, sf_dir, "supplier")
    total = supplier.agg(F.count("*")).scalar()
    target = c % (total + 1 + F.floor(total / 10))
    homes = supplier.select(F.col("s_suppkey").alias("_target"), (F.col("s_nationkey") % 5).alias("_home"))
    keys = [F.lit(k) for k in RANK_ANNOTATIONS]
    annotations = (
        F.when(c % 4 == 1, F.create_map(keys[2], _text(c % 10)))
        .when(c % 4 == 2, F.create_map(keys[1], _text(c % 7, "th")))
        .when(c % 4 == 3, F.create_map(keys[0], F.lit("n/a"), keys[2], _text(" ", c % 10)))
    )
    customers = table(spark, sf_dir, "customer").withColumn("_target", target)
    return customers.join(homes, "_target", "left").select(
        c.alias("id"),
        F.when(c % 17 == 0, F.lit("ns-wrong"))
        .otherwise(_text("ns-", F.coalesce("_home", F.lit(0))))
        .alias("namespace"),
        F.col("c_name").alias("name"),
        _text("wb-", F.col("_target")).alias("buffer_name"),
        F.when(c % 3 == 0, (c % 10).cast("int")).alias("shard_index"),
        annotations.alias("annotations"),
    )


def resource_claims(claim_rows: DataFrame) -> DataFrame:
    """Resource claims of four claims in five, plus orphans."""
    i = F.col("id")
    ours, other = F.struct(F.lit(DEVICE_CLASS).alias("device_class")), F.struct(F.lit("gpu-class").alias("device_class"))
    none = F.lit(None).cast("struct<device_class:string>")

    def request(exactly: Column) -> Column:
        return F.struct(F.lit("device").alias("name"), exactly.alias("exactly"))

    requests = (
        F.when(i % 3 == 0, F.array(request(ours)))
        .when(i % 3 == 1, F.array(request(other)))
        .otherwise(F.array(request(none), request(ours)))
    )
    results = (
        F.when(i % 4 == 0, F.array(F.lit("gpu-0"))).when(i % 4 == 1, F.array().cast("array<string>"))
    )
    kept = F.when(i % 5 != 0, F.struct(F.col("name").alias("name"), _text("u-", i).alias("uid")))
    orphan = F.when(i % 50 == 0, F.struct(_text("orphan-", i).alias("name"), _text("uo-", i).alias("uid")))
    rows = claim_rows.select("id", "namespace", F.explode(F.array_compact(F.array(kept, orphan))).alias("_rc"))
    return rows.select("id", "namespace", "_rc.*", requests.alias("requests"), results.alias("results"))


def staging(spark: SparkSession, sf_dir: str, claim_rows: DataFrame) -> DataFrame:
    """A staging request per claim on the node of its customer's nation."""
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("node"))
    homes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    return (
        claim_rows.select("id", "namespace", "name")
        .join(homes, "id")
        .join(nodes, "c_nationkey")
        .select("namespace", "name", _text("u-", F.col("id")).alias("uid"), "node")
    )


def lifecycle(events: DataFrame) -> DataFrame:
    """Stage and unstage events; works on the events table and on its stream."""
    e = F.col("event_id")
    stage = F.col("event_type").isin("signup", "purchase", "view")
    sharded = e % 12 < 6
    return events.select(
        _text("node-", F.col("user_id") % 8).alias("node"),
        _text("c-", F.col("user_id") % 40).alias("claim"),
        _text("wb-", e % 12).alias("buffer_id"),
        F.when(sharded, F.floor(e / 12) % 4).otherwise(F.lit(-1)).cast("int").alias("shard_index"),
        F.when(sharded, F.lit(4)).otherwise(F.lit(0)).alias("total_shards"),
        F.when(stage, F.lit("stage")).otherwise(F.lit("unstage")).alias("op"),
        (e % 53 != 0).alias("ok"),
        e.alias("seq"),
        ((1 + e % 64) * MIB + e % 3).alias("size_bytes"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def node_gpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GPU count of the nodes of ``lifecycle``; the last ones are unknown."""
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").where(key < 7).select(
        _text("node-", key).alias("node"), (1 + key % 4).cast("int").alias("gpu_count")
    )


def signals(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    signal = (
        F.when(kind == "view", F.lit("PRE_UPDATE"))
        .when(kind == "purchase", F.lit("READY"))
        .when(kind == "click", F.lit("METADATA"))
        .when(kind == "signup", F.lit("CONNECT"))
        .otherwise(F.lit("DISCONNECT"))
    )
    return events.select(
        _text("wb-", F.col("user_id") % 20).alias("buffer_id"),
        _text("peer-", F.col("user_id")).alias("peer"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        signal.alias("signal"),
    )


def transfers(events: DataFrame) -> DataFrame:
    """Transfer measurements, one per event; the phase cycles with the event number."""
    e = F.col("event_id")
    size = (1 + e % 75) * GIB
    scatter = e % 2 == 1
    return events.select(
        F.col("user_id").alias("run"),
        e.alias("seq"),
        e.alias("stream"),
        _pick(e % 4, "pack", "propagate", "metadata", "total").alias("phase"),
        (F.col("value") / 100).alias("seconds"),
        size.alias("bytes"),
        F.when(scatter, F.lit("SCATTER")).otherwise(F.lit("BROADCAST")).alias("mode"),
        F.when(scatter & (e % 4 != 3), F.shiftright(size, 3)).otherwise(F.lit(0).cast("bigint")).alias("shard_length"),
        F.when(scatter, F.array_repeat(F.shiftright(size, 3), 7)).otherwise(F.array().cast("array<bigint>")).alias("lengths"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def log_lines(events: DataFrame) -> DataFrame:
    """Node log lines written from ``transfers``, between other lines. Numbers are cut, not rounded, to their digits."""
    e = F.col("event_id")
    ten_thousandths = F.round(F.col("value") * 100).cast("bigint")
    hundredths = F.floor((1 + e % 75) / (ten_thousandths / 10000.0) * 100)

    def fixed(scaled: Column, digits: int) -> Column:
        unit = 10**digits
        return _text(F.floor(scaled / unit), ".", F.lpad((scaled % unit).cast("string"), digits, "0"))

    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS")
    mode = F.when(e % 2 == 1, F.lit("SCATTER")).otherwise(F.lit("BROADCAST"))
    rest = _text(" complete in ", fixed(ten_thousandths, 4), "s. Bandwidth: ", fixed(hundredths, 2), " GB/s")
    role = F.when(e % 3 == 0, _text("Source NCCL ", mode, rest)).otherwise(
        _text("Target NCCL ", mode, " recv", rest)
    )
    line = F.when((F.col("event_type") == "error") | (ten_thousandths <= 0), _text(stamp, " - ERROR - lost ", e)).otherwise(
        _text(stamp, " - INFO - ", role)
    )
    return events.select(line.alias("value"))


def inventory_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's memory report: a line per device, of which only the first one's value counts; some are empty."""
    key = F.col("n_nationkey")
    mib = 40960 + 1024 * key
    lines = F.transform(
        F.sequence(F.lit(0).cast("bigint"), (key % 8).cast("bigint")), lambda i: _text(mib + i, " MiB\n")
    )
    content = F.when(key % 10 == 9, F.lit("\n")).otherwise(F.array_join(lines, ""))
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("node"), content.alias("content"))


def snapshots(events: DataFrame) -> DataFrame:
    return events.select(
        _text("node-", F.col("user_id") % 8).alias("node"),
        F.col("ts").cast("timestamp").alias("ts"),
        (40960 + F.col("event_id") % 1024).alias("memory_mib"),
        F.col("event_id").alias("seq"),
        (F.col("event_id") % 20 == 0).alias("failed"),
    )


def condition_updates(events: DataFrame) -> DataFrame:
    return events.select(
        _text("obj-", F.col("user_id") % 30).alias("object_id"),
        F.when(F.col("event_id") % 2 == 0, F.lit("Ready")).otherwise(F.lit("Validated")).alias("type"),
        F.when(F.col("value") > 100, F.lit("True")).otherwise(F.lit("False")).alias("status"),
        F.col("event_type").alias("reason"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
    )

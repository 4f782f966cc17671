"""Scalar functions: golden values, agreement with a plain-Python reading of the rules, and SQL names."""

import math
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ballast import functions as fn
from ballast.functions import sql as sql_functions

GIB = 1 << 30
MAX = 2**63 - 1

QUANTITIES = {
    "10Gi": 10 * GIB,
    "214748364800": 214748364800,
    "600Gi": 600 * GIB,
    "1.5Gi": 3 * GIB // 2,
    "0.1Ki": 103,
    ".5": 1,
    "5.": 5,
    "5M": 5_000_000,
    "2k": 2000,
    "1E": 10**18,
    "1E3": 1000,
    "12e2": 1200,
    "15e-1": 2,
    "1500m": 2,
    "1u": 1,
    "1n": 1,
    "0n": 0,
    "0": 0,
    "-1.5": -2,
    "+3Ki": 3072,
    "8Ei": MAX,
    "7Ei": 7 * 1024**6,
    "9223372036854775807": MAX,
    "9223372036854775808": MAX,
    "99999999999999999999999999": MAX,
    "1e30": MAX,
    "0e30": 0,
    "1e-30": 1,
    "10GiB": None,
    "": None,
    "Gi": None,
    "1 Gi": None,
    "1K": None,
    ".": None,
    "1.2.3": None,
    "abc": None,
}


def test_quantity_values(spark):
    df = spark.createDataFrame([(q,) for q in QUANTITIES], "q string")
    got = {r.q: r.b for r in df.select("q", fn.parse_quantity(F.col("q")).alias("b")).collect()}
    assert got == QUANTITIES


LONG_QUANTITIES = {
    "0.0000000000000000001": 1,
    "0.0000000000000000001Ei": 1,
    "100000000000000000000n": 10**11,
    "100000000000000000000m": 10**17,
    "0.5e19": 5 * 10**18,
    "0.001e20": 10**17,
    "1e99999999999": MAX,
    "1e-99999999999": 1,
    "0e99999999999": 0,
    "-0.0000000000000000000000000000000000000001": -1,
    "0000000000000000000000000000000000000001.5Ki": 1536,
    "1.5e0000000000000000001": 15,
    "1234567890123456789.9999999999999999999999999999999999999999": 1234567890123456790,
    f"0.{str(5**60).zfill(60)}Ei": 1,
    f"0.{str(5**60).zfill(60)}1Ei": 2,
    "7.9999999999999999999999999999Ei": MAX,
    "9223372036854775807": MAX,
    "9223372036854775806.1": MAX,
    "123456789012345678901234567890Ki": MAX,
}


def test_quantities_of_many_digits(spark):
    df = spark.createDataFrame([(q,) for q in LONG_QUANTITIES], "q string")
    assert {r.q: r.b for r in df.select("q", fn.parse_quantity(F.col("q")).alias("b")).collect()} == LONG_QUANTITIES


@settings(max_examples=5, deadline=None)
@given(
    st.lists(
        st.tuples(
            st.decimals(min_value=0, max_value=10**9, places=3),
            st.sampled_from(["", "Ki", "Mi", "Gi", "k", "M", "G", "m", "u", "e2", "E-1"]),
        ),
        min_size=1,
        max_size=40,
    )
)
def test_quantity_against_decimal(spark, numbers):
    units = {"": 1, "Ki": 1024, "Mi": 1024**2, "Gi": GIB, "k": 1000, "M": 10**6, "G": 10**9}
    units |= {"m": Decimal("0.001"), "u": Decimal("0.000001"), "e2": 100, "E-1": Decimal("0.1")}
    rows = [(f"{n}{s}", min(MAX, math.ceil(n * units[s]))) for n, s in numbers]
    df = spark.createDataFrame(rows, "q string, want bigint")
    bad = df.where(~fn.parse_quantity(F.col("q")).eqNullSafe(F.col("want"))).collect()
    assert bad == []


@pytest.mark.parametrize(
    ("buffer", "index", "total", "want"),
    [
        ("buf-1", -1, 0, "buf-1"),
        ("buf-1", -1, 8, "buf-1"),
        ("buf-1", 0, 0, "buf-1"),
        ("big-model", 0, 8, "big-model__shard_0"),
        ("big-model", 7, 8, "big-model__shard_7"),
        ("buf", 3, 4, "buf__shard_3"),
        ("buf", None, None, "buf"),
    ],
)
def test_effective_id(spark, buffer, index, total, want):
    df = spark.createDataFrame([(buffer, index, total)], "b string, i int, t int")
    effective = fn.effective_buffer_id(F.col("b"), F.col("i"), F.col("t"))
    assert df.select(effective, fn.base_buffer_id(effective)).first()[:] == (want, buffer)


def test_annotations(spark):
    one, two, three = "wpi.io/shard-index", "batch.kubernetes.io/job-completion-index", "ray.io/rank"
    cases = [
        ({one: "3abc", three: "5"}, 3),
        ({one: "x", two: "-2"}, -2),
        ({two: "", three: " +7"}, 7),
        ({one: "99999999999999999999", three: "1"}, 1),
        ({three: "n"}, None),
        ({}, None),
        (None, None),
    ]
    df = spark.createDataFrame(cases, "a map<string,string>, want bigint")
    got = df.select(fn.shard_from_annotations(F.col("a")).alias("g"), "want").collect()
    assert [r.g for r in got] == [r.want for r in got]


def test_sizes(spark):
    df = spark.createDataFrame(
        [("BF16", [768, 768]), ("bfloat16", [768]), ("F32", []), ("F32", [0, 4]), ("??", [1])],
        "dtype string, shape array<bigint>",
    )
    assert [r[0] for r in df.select(fn.nbytes(F.col("dtype"), F.col("shape"))).collect()] == [1179648, 1536, 4, 0, None]
    n = spark.createDataFrame([(0,), (1,), (2097152,), (2097153,), (None,)], "n bigint")
    assert [r[0] for r in n.select(fn.align_up(F.col("n"))).collect()] == [0, 2097152, 2097152, 4194304, None]
    assert [r[0] for r in n.select(fn.size_or_default(F.col("n"))).collect()] == [10 * GIB, 1, 2097152, 2097153, 10 * GIB]


def test_published_rates(spark):
    df = spark.createDataFrame([(75 * GIB, 2.2654), (10 * GIB, 0.0), (75 * GIB, 2.3901)], "b bigint, s double")
    rates = [r[0] for r in df.select(F.round(fn.throughput_gbps(F.col("b"), F.col("s")), 2)).collect()]
    assert rates == [33.11, 0.0, 31.38]
    pct = spark.range(1).select(F.round(fn.pct_of_line_rate(F.lit(36.57), F.lit(50.0)), 2)).first()[0]
    assert pct == 73.14


def test_logged_bytes(spark):
    df = spark.createDataFrame([("SCATTER", 100, [20, 30]), ("SCATTER", 100, []), ("BROADCAST", 100, [])], "m string, n bigint, l array<bigint>")
    logged, sent = fn.logged_bytes(F.col("m"), F.col("n"), F.col("l"))
    assert [tuple(r) for r in df.select(logged, sent).collect()] == [(100, 50), (100, 100), (100, 100)]


def test_sql_names_agree(spark):
    sql_functions.register(spark)
    c = F.col
    df = spark.createDataFrame([(q,) for q in QUANTITIES], "q string")
    df.createOrReplaceTempView("q")
    same = spark.sql("select q, parse_quantity(q) b from q").collect()
    assert {r.q: r.b for r in same} == QUANTITIES
    rows = [("b", 3, 4, 5, 1.5, "SCATTER", 2), ("", -1, 4, 0, 0.0, "BROADCAST", 0), ("a__shard_1", 0, 0, 4194305, 2.0, "SCATTER", 3)]
    t = spark.createDataFrame(rows, "b string, i int, n int, size bigint, s double, m string, g int")
    t.createOrReplaceTempView("t")
    by_sql = spark.sql(
        """select is_sharded(i, n), effective_buffer_id(b, i, n), base_buffer_id(b), shard_file_name(b, i, n),
        align_up(size, cast(g as bigint) + 3), size_or_default(size), throughput_gbps(size, s), pct_of_line_rate(s, 50D),
        received_bytes(m, size, 7L), gpu_for_shard(i, n, g), shard_from_annotations(map('ray.io/rank', '4x')) from t"""
    ).collect()
    granule = c("g").cast("bigint") + 3
    by_column = t.select(
        fn.is_sharded(c("i"), c("n")),
        fn.effective_buffer_id(c("b"), c("i"), c("n")),
        fn.base_buffer_id(c("b")),
        fn.shard_file_name(c("b"), c("i"), c("n")),
        fn.align_up(c("size"), granule),
        fn.size_or_default(c("size")),
        fn.throughput_gbps(c("size"), c("s")),
        fn.pct_of_line_rate(c("s"), F.lit(50.0)),
        fn.received_bytes(c("m"), c("size"), F.lit(7)),
        fn.gpu_for_shard(c("i"), c("n"), c("g")),
        fn.shard_from_annotations(F.create_map(F.lit("ray.io/rank"), F.lit("4x"))),
    ).collect()
    assert [tuple(r) for r in by_sql] == [tuple(r) for r in by_column]
    rows = [("F16", [3, 4], "SCATTER", [5, 6]), ("bfloat16", [], "SCATTER", []), ("what", [0], "BROADCAST", [9])]
    t = spark.createDataFrame(rows, "d string, s array<bigint>, m string, l array<bigint>")
    t.createOrReplaceTempView("t2")
    by_sql = spark.sql("select itemsize(d), numel(s), nbytes(d, s), logged_bytes(m, 99L), sent_bytes(m, 99L, l) from t2").collect()
    n = F.lit(99).cast("bigint")
    by_column = t.select(fn.itemsize(c("d")), fn.numel(c("s")), fn.nbytes(c("d"), c("s")), *fn.logged_bytes(c("m"), n, c("l"))).collect()
    assert [tuple(r) for r in by_sql] == [tuple(r) for r in by_column]
    shards = spark.sql("select * from split_shards(10, 4)").collect()
    assert [tuple(r) for r in shards] == [(0, 0, 3), (1, 3, 3), (2, 6, 2), (3, 8, 2)]
    assert spark.sql("select * from split_shards(10, 0)").collect() == []

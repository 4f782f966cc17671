"""Scans, order statistics and spread joins give the plain result however the rows are cut."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from ballast.operators import blocks, lifecycle, measures, order_statistics, signals, skew
from ballast.operators.conditions import condition_transitions

LIFECYCLE = (
    "node string, claim string, buffer_id string, shard_index int, total_shards int, op string, ok boolean, "
    "seq bigint, size_bytes bigint"
)


def random_lifecycle(n: int, seed: int) -> list[tuple]:
    """A third of all events fall on one claim; some stages fail."""
    r = random.Random(seed)
    rows = []
    for seq in range(n):
        node = f"n{r.randrange(3)}"
        claim = "hot" if r.random() < 0.33 else f"c{r.randrange(6)}"
        op = "stage" if r.random() < 0.55 else "unstage"
        rows.append((node, claim, f"b{r.randrange(4)}", r.randrange(-1, 2), 2, op, r.random() > 0.15, seq, 1 + r.randrange(9)))
    return rows


def fold(rows: list[tuple]) -> tuple[list[tuple], dict, dict]:
    """The ledger as one sequential loop: claims and buffers in two dictionaries."""
    claims, counts, born, out = {}, {}, {}, []
    for node, claim, buffer, index, total, op, ok, seq, size in rows:
        if op == "stage":
            target = f"{buffer}__shard_{index}" if index >= 0 else buffer
            claims[node, claim] = target
            if not ok:
                continue
            counts[node, target] = counts.get((node, target), 0) + 1
            if counts[node, target] == 1:
                born[node, target] = size
            out.append((node, target, seq, 1, counts[node, target]))
        elif (node, claim) in claims:
            target = claims.pop((node, claim))
            if counts.get((node, target), 0) > 0:
                counts[node, target] -= 1
                out.append((node, target, seq, -1, counts[node, target]))
    return out, {k: v for k, v in counts.items() if v > 0}, born


@pytest.mark.parametrize("rows_per_block", [1 << 20, 150, 20])
def test_ledger_equals_fold(spark, rows_per_block):
    rows = random_lifecycle(900, 7)
    events = spark.createDataFrame(rows, LIFECYCLE)
    want, held, born = fold(rows)
    history = lifecycle.refcount_history(events, rows_per_block=rows_per_block)
    got = history.select("node", "effective_id", "seq", "delta", "ref_count").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    live = lifecycle.live_allocations(events, rows_per_block=rows_per_block).collect()
    assert {(r.node, r.effective_id): r.ref_count for r in live} == held
    assert all(r.size_bytes == born[r.node, r.effective_id] for r in live)
    assert all(r.leaked >= 0 for r in live)


def test_live_as_of(spark):
    rows = random_lifecycle(400, 3)
    live = lifecycle.live_allocations(spark.createDataFrame(rows, LIFECYCLE), as_of=200, rows_per_block=30).collect()
    assert {(r.node, r.effective_id): r.ref_count for r in live} == fold(rows[:201])[1]


def sample(spark, n=2000):
    r = random.Random(5)
    rows = [("hot" if r.random() < 0.4 else f"k{r.randrange(5)}", r.randrange(300), i, r.choice([None, 1, 2, 3])) for i in range(n)]
    return spark.createDataFrame(rows, "k string, at bigint, id bigint, v int")


def test_blocks_cut_hot_keys(spark):
    df = blocks.with_blocks(sample(spark), ["k"], F.col("at"), rows_per_block=100)
    sizes = df.groupBy("k", blocks.BLOCK).count().agg(F.max("count")).first()[0]
    assert blocks.BLOCK in df.columns and sizes <= 200
    assert blocks.BLOCK not in blocks.with_blocks(sample(spark), ["k"], F.col("at"), rows_per_block=1500).columns
    assert df.groupBy("at").agg(F.countDistinct(blocks.BLOCK).alias("n")).where("n > 1").count() == 0


@pytest.mark.parametrize("rows_per_block", [700, 60])
def test_scans_equal_windows(spark, rows_per_block):
    plain = sample(spark)
    cut = blocks.with_blocks(plain, ["k"], F.col("at"), rows_per_block=rows_per_block)
    order = ["at", "id"]

    def scans(df):
        df = blocks.running_sum(df, ["k"], order, {"s": F.coalesce("v", F.lit(0)), "n": F.lit(1)})
        df = blocks.nearest(df, ["k"], order, {"before": F.col("v"), "last": F.struct("id", "v")})
        df = blocks.nearest(df, ["k"], order, {"after": F.col("v")}, after=True)
        df = blocks.floored_sum(df, ["k"], order, F.coalesce(F.col("v") - 2, F.lit(-1)), "level")
        return sorted(map(str, blocks.drop_blocks(df).collect()))

    assert scans(cut) == scans(plain)


@pytest.mark.parametrize("rows_per_block", [1 << 20, 90])
def test_transitions(spark, rows_per_block):
    r = random.Random(2)
    rows = [(f"o{r.randrange(3)}", "Validated", r.choice(["True", "False"]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "object_id string, type string, status string, seq bigint")
    want, last = [], {}
    for o, _, s, i in rows:
        if last.get(o) != s:
            want.append(i)
        last[o] = s
    got = condition_transitions(df, rows_per_block=rows_per_block)
    assert sorted(x.seq for x in got.collect()) == want


@pytest.mark.parametrize("limit", [1 << 20, 300])
def test_order_statistics_are_exact(spark, monkeypatch, limit):
    monkeypatch.setattr(order_statistics, "LARGE_GROUP", limit)
    r = random.Random(9)
    data = {
        "hot": [r.lognormvariate(0, 2) for _ in range(6000)],
        "ties": [float(r.randrange(3)) for _ in range(900)],
        "same": [7.0] * 500,
        "nineteen": [float(i) for i in range(19)],
        "twenty": [float(i) for i in range(20)],
        "forty": [float(i) for i in range(40)],
        "one": [3.5],
        "two": [1.0, 2.0],
    }
    rows = [(k, v) for k, vs in data.items() for v in vs]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {x.k: x for x in order_statistics.distribution_summary(df, ["k"], F.col("v"), accuracy=200).collect()}
    for k, vs in data.items():
        s = sorted(vs)
        p95 = s[int(len(s) * 0.95)] if len(s) >= 20 else s[-1]
        assert (got[k].n, got[k].median, got[k].p95, got[k].min, got[k].max) == (len(s), statistics.median(s), p95, s[0], s[-1])
        assert got[k].stddev == pytest.approx(statistics.stdev(s) if len(s) > 1 else 0)
        assert got[k].mean == pytest.approx(statistics.mean(s))


def test_warmup_is_left_out(spark):
    rows = [("r", i, "total", 100.0 if i < 3 else 1.0, 1 << 30) for i in range(23)]
    df = spark.createDataFrame(rows, "run string, seq bigint, phase string, seconds double, bytes bigint")
    got = {r.phase: r for r in measures.latency_summary(df).collect()}
    assert got["total"].n == 20 and got["total"].max == 1000.0
    assert got["bandwidth_gbs"].mean == 1.0


@pytest.mark.parametrize("how", ["left", "inner"])
def test_spread_join_equals_join(spark, how):
    left = spark.createDataFrame(
        [("hot" if i % 3 == 0 else f"k{i % 40}", i, {"a": "b"}) for i in range(900)], "k string, i bigint, m map<string,string>"
    )
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k2", 4)], "k string, w int")
    hot = skew.hot_keys(left, ["k"], rows_per_task=100)
    assert [tuple(r) for r in hot.collect()] == [("hot", 3)]
    got = skew.join_hot(left, right, ["k"], how, rows_per_task=100).select("k", "i", "w")
    want = left.join(right, ["k"], how).select("k", "i", "w")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert skew.hot_keys(left, ["k"], rows_per_task=1000) is None
    counted = left.groupBy("k").agg(F.count("*").alias("rows"))
    again = skew.hot_keys(counted, ["k"], rows_per_task=100, weight=F.col("rows"))
    assert sorted(again.collect()) == sorted(hot.collect())


def test_deliveries_equal_pairs(spark):
    r = random.Random(4)
    kinds = ["READY", "CONNECT", "DISCONNECT"]
    rows = [(f"b{r.randrange(2)}", f"p{r.randrange(5)}", i, 1_700_000_000 + r.randrange(500), r.choice(kinds)) for i in range(600)]
    rows = list({(b, t): (b, p, i, t, k) for b, p, i, t, k in rows}.values())
    df = spark.createDataFrame(rows, "buffer_id string, peer string, seq bigint, t bigint, signal string")
    df = df.withColumn("ts", F.timestamp_seconds("t"))
    subs = [
        (b, p, i, t, min((u for c, q, _, u, k2 in rows if k2 == "DISCONNECT" and (c, q) == (b, p) and u > t), default=None))
        for b, p, i, t, k in rows
        if k == "CONNECT"
    ]
    for size in (1 << 20, 80):
        found = signals.subscriptions(df, rows_per_block=size)
        per_ready = signals.deliver_signals(df, found, rows_per_block=size).collect()
        want = {i: sum(c == b and o <= t and (e is None or t < e) for c, _, _, o, e in subs) for b, _, i, t, k in rows if k == "READY"}
        assert {x.seq: x.receivers for x in per_ready} == want
        per_sub = signals.subscription_receipts(df, found, rows_per_block=size).collect()
        want = {s: sum(k == "READY" and c == b and o <= t and (e is None or t < e) for c, _, _, t, k in rows) for b, _, s, o, e in subs}
        assert {x.seq: x.delivered for x in per_sub} == want


@pytest.mark.parametrize("after", [False, True])
def test_scans_with_null_nan_and_tied_positions(spark, after):
    """Blocks give the window's rows where positions are null, NaN or equal, and where a key is null."""
    r = random.Random(8)
    places = [None, float("nan"), float("-inf"), float("inf"), *[float(i // 3) for i in range(60)]]
    rows = [(r.choice(["a", None]), r.choice(places), i, r.choice([None, i])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, at double, id int, v int")
    results = []
    for rows_per_block in (1 << 20, 25):
        cut = blocks.with_blocks(df, ["k"], F.col("at"), rows_per_block=rows_per_block)
        assert (blocks.BLOCK in cut.columns) == (rows_per_block == 25)
        near = blocks.nearest(cut, ["k"], ["at", "id"], {"near": F.col("v")}, after=after)
        summed = blocks.running_sum(cut, ["k"], ["at", "id"], {"s": F.coalesce("v", F.lit(0)).cast("bigint")})
        floored = blocks.floored_sum(cut, ["k"], ["at", "id"], F.when(F.col("v").isNull(), -2).otherwise(1), "f")
        results.append([
            sorted(map(str, near.select("id", "near").collect())),
            sorted(map(str, summed.select("id", "s").collect())),
            sorted(map(str, floored.select("id", "f", "f_before").collect())),
        ])
    assert results[0] == results[1]


def test_warm_up_counts_iterations_not_rows(spark):
    """23 iterations of four phases, the first three slow: 20 of each phase are measured."""
    phases = ["pack", "propagate", "metadata", "total"]
    rows = [("r", 4 * i + j, p, 100.0 if i < 3 else 1.0, 1 << 30) for i in range(23) for j, p in enumerate(phases)]
    df = spark.createDataFrame(rows, "run string, seq bigint, phase string, seconds double, bytes bigint")
    for rows_per_block in (1 << 20, 5):
        got = measures.latency_summary(df, rows_per_block=rows_per_block).collect()
        assert {r.phase: (r.n, r.max) for r in got if r.phase in phases} == {p: (20, 1000.0) for p in phases}


def test_metadata_of_the_same_instant(spark):
    """An offset table at the READY's own instant wins over an older one, whatever its number."""
    rows = [("b", "METADATA", "x", 0, 1), ("b", "READY", "x", 10, 2), ("b", "METADATA", "x", 10, 3)]
    df = spark.createDataFrame(rows, "buffer_id string, signal string, peer string, at int, seq bigint")
    df = df.withColumn("ts", F.timestamp_seconds("at")).drop("at")
    df = df.replace({"METADATA": signals.METADATA, "READY": signals.READY}, subset=["signal"])
    got = signals.ready_metadata(df).first().asDict()
    stamps = sorted(v for v in got.values() if hasattr(v, "year"))
    assert len(stamps) >= 2 and stamps[0] == stamps[-1]

"""Streams over several micro-batches, with rows out of order."""

import math
import os
import random
import time

import pytest
from pyspark.sql import functions as F
from test_scans import LIFECYCLE, fold, random_lifecycle

from ballast.operators import conditions
from ballast.operators import lifecycle as life
from ballast.operators.horizon import first_in_horizon
from ballast.operators.signals import update_timeouts, update_windows
from ballast.streaming import ledger, levels, run, staging
from ballast.streaming import signals as stream_signals
from ballast.streaming.backfill import backfill


def write_batches(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        newest = max((os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".parquet")), key=os.path.getctime)
        os.utime(newest, (time.time() + i, time.time() + i))


def test_ledger_over_batches(spark, tmp_path):
    rows = random_lifecycle(300, 11)
    late = [rows[5]]
    folder = str(tmp_path / "in")
    write_batches(spark, folder, [rows[:100][::-1], rows[100:200], rows[200:] + late], LIFECYCLE)
    stream = run.read_events_stream(spark, folder, LIFECYCLE, files_per_batch=1)
    out = ledger.allocation_ledger(stream).collect()
    got = sorted((r.node, r.effective_id, r.seq, r.delta, r.ref_count) for r in out if not r.late)
    assert got == sorted(fold(rows)[0])
    assert [r.seq for r in out if r.late] == [5]


def deal(spark, rows, schema, r, most):
    """The rows in batches of random sizes, the rows of each in random order, as DataFrames."""
    out = []
    while rows:
        n = r.randrange(most // 2, most)
        out.append(spark.createDataFrame(r.sample(rows[:n], len(rows[:n])), schema))
        rows = rows[n:]
    return out


@pytest.mark.parametrize("seed, fanout, rows_per_block", [(1, 2, 1 << 20), (2, 3, 40)])
def test_ledger_in_any_cut_and_again(spark, tmp_path, seed, fanout, rows_per_block):
    r = random.Random(seed)
    rows = random_lifecycle(200, seed)
    live = ledger.Ledger(spark, str(tmp_path / "ledger"), fanout=fanout, rows_per_block=rows_per_block)
    batches = deal(spark, rows, LIFECYCLE, r, 80)
    for i, batch in enumerate(batches):
        live.advance(batch, i)
        if i == 2:  # a batch is run again after its end was not recorded
            live.advance(batch, i)
    out = live.changes().collect()
    assert not any(x.late for x in out) and len(batches) > 3
    assert sorted((x.node, x.effective_id, x.seq, x.delta, x.ref_count) for x in out) == sorted(fold(rows)[0])
    assert all(x.freed == (x.ref_count == 0) for x in out)


def test_ledger_goes_on_where_it_ended(spark, tmp_path):
    rows = random_lifecycle(120, 4)
    source, folder = str(tmp_path / "in"), str(tmp_path / "ledger")
    write_batches(spark, source, [rows[:70]], LIFECYCLE)
    assert ledger.allocation_ledger(run.read_events_stream(spark, source, LIFECYCLE), folder).count()
    write_batches(spark, source, [rows[70:]], LIFECYCLE)
    out = ledger.allocation_ledger(run.read_events_stream(spark, source, LIFECYCLE), folder).collect()
    assert sorted((x.node, x.effective_id, x.seq, x.delta, x.ref_count) for x in out) == sorted(fold(rows)[0])


def test_ledger_forgets_claims(spark, tmp_path):
    def event(seq, claim, op, second):
        return ("n", claim, "b", -1, 0, op, True, seq, 1, second)

    schema = LIFECYCLE + ", t bigint"
    live = ledger.Ledger(spark, str(tmp_path / "ledger"), expire_seconds=100, fanout=2)
    batches = [
        [event(0, "a", "stage", 0), event(1, "b", "stage", 0)],
        [event(2, "a", "unstage", 100)],
        [event(3, "b", "unstage", 101)],
        [event(4, "c", "stage", 500)],
        [event(5, "c", "stage", 501)],
    ]
    for i, rows in enumerate(batches):
        live.advance(spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("t")), i)
    assert sorted((x.seq, x.delta, x.ref_count) for x in live.changes().collect()) == [
        (0, 1, 1), (1, 1, 2), (2, -1, 1), (4, 1, 2), (5, 1, 3)
    ]
    held = live.state.after(4).where("kind = 'claim'").select("key").distinct().collect()
    assert [x.key for x in held] == ["c"]


STAGES = LIFECYCLE + ", at bigint"


def random_stages(r, n):
    """A busy key with requests at every distance, ties among them, and some quiet ones."""
    rows = []
    for seq in range(n):
        hot = r.random() < 0.6
        at = r.randrange(400) if hot else r.randrange(4000)
        rows.append(("n", "hot" if hot else f"c{r.randrange(4)}", "b", -1, 0, "stage", True, seq, 1, at))
    return rows


def greedy(rows, horizon):
    last, kept = {}, []
    for row in sorted(rows, key=lambda x: (x[9], x[7])):
        if row[1] not in last or row[9] - last[row[1]] > horizon:
            last[row[1]] = row[9]
            kept.append(row[7])
    return sorted(kept)


@pytest.mark.parametrize("horizon, rows_per_block", [(7, 1 << 20), (60, 25), (100000, 40)])
def test_first_in_horizon_equals_a_walk(spark, horizon, rows_per_block):
    rows = random_stages(random.Random(horizon), 300)
    df = spark.createDataFrame(rows + [("n", None, "b", -1, 0, "stage", True, 999, 1, 5)], STAGES)
    got = first_in_horizon(df, life.STAGING_KEY, F.col("at"), horizon, rows_per_block=rows_per_block)
    assert got.columns == df.columns
    assert sorted(x.seq for x in got.collect()) == greedy(rows, horizon)


def test_staging_filter_waits_for_its_delay(spark, tmp_path):
    r = random.Random(8)
    rows, horizon, delay = random_stages(r, 240), 40, 90
    ordered = sorted(rows, key=lambda x: x[9] + r.randrange(delay))  # out of order by less than the delay
    schema = spark.createDataFrame([], STAGES).withColumn("ts", F.timestamp_micros("at")).schema
    live = staging.StagingFilter(spark, str(tmp_path / "staging"), schema, horizon, delay)
    cuts = [0, 90, 130, 240]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        batch = spark.createDataFrame(ordered[a:b], STAGES).withColumn("ts", F.timestamp_micros("at"))
        live.advance(batch, i)
        if i == 1:
            live.advance(batch, i)
    late = ("n", "hot", "b", -1, 0, "stage", True, 777, 1, 1)
    live.advance(spark.createDataFrame([late], STAGES).withColumn("ts", F.timestamp_micros("at")), 3, end=True)
    out = live.kept().collect()
    assert sorted(x.seq for x in out if not x.late) == greedy(rows, horizon)
    assert [x.seq for x in out if x.late] == [777]


def test_a_backlog_is_cut_along_its_order(spark):
    r = random.Random(3)
    values = [None, None] + [r.choice([r.randrange(1000), 7]) for _ in range(500)]
    numbers = spark.createDataFrame([(v,) for v in values], "v bigint")
    for df in (numbers, numbers.select(F.timestamp_micros("v").alias("v"))):
        seen = []
        n = backfill(df, "v", lambda batch, i: seen.append((i, batch.collect())), rows_per_batch=60, first_batch=5)
        assert [i for i, _ in seen] == list(range(5, 5 + n)) and n > 4
        flat = [x.v for _, rows in seen for x in rows]
        assert len(flat) == len(values) and max(len(rows) for _, rows in seen[1:]) < 400
        known = [[x.v for x in rows if x.v is not None] for _, rows in seen]
        known = [k for k in known if k]
        assert all(max(a) < min(b) for a, b in zip(known, known[1:]))
        assert {x.v for x in seen[0][1]} >= {None}
    empty = []
    assert backfill(numbers.limit(0), "v", lambda batch, i: empty.append(batch.count()), least_batches=3) == 1 and empty == [0]


UPDATES = "object_id string, type string, status string, reason string, seq bigint"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_conditions_in_any_order(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = []
    for seq in range(160):
        hot = r.random() < 0.4
        status = "True" if hot and r.random() < 0.9 else r.choice(["True", "False", "Unknown", None])
        rows.append(("hot" if hot else f"o{r.randrange(6)}", r.choice(conditions.STICKY) if hot else r.choice(["Ready", "Validated", None]), status, str(seq), seq))
    want = sorted(map(str, conditions.condition_latest(spark.createDataFrame(rows, UPDATES)).collect()))
    r.shuffle(rows)
    spot = str(tmp_path / "table")
    table = levels.LevelledTable(
        spark, spot, spark.createDataFrame([], UPDATES).schema, lambda x: conditions.deciding_updates(x, rows_per_task=20), 2 + seed
    )
    batches = deal(spark, rows, UPDATES, r, 40)
    for i, batch in enumerate(batches):
        table.add(i, batch)
        if r.random() < 0.3:
            table.add(i, batch)
    assert sorted(map(str, conditions.condition_latest(table.rows()).collect())) == want
    assert sorted(map(str, conditions.condition_latest(table.after(len(batches))).collect())) == want


def test_late_row_inside_a_run(spark):
    """Three rows of one status, then one of another between the first two: the second of the three decides."""
    def update(status, seq):
        return ("o", "Validated", status, str(seq), seq)

    first = conditions.deciding_updates(spark.createDataFrame([update("True", s) for s in (1, 3, 5)], UPDATES))
    both = first.unionByName(spark.createDataFrame([update("False", 2)], UPDATES))
    assert [r.seq for r in conditions.condition_latest(both).collect()] == [3]


def test_levels_hold_each_batch_once_in_few_folders():
    for fanout in (2, 3, 5):
        table = levels.LevelledTable(None, "t", None, None, fanout)
        held = {}
        for b in range(300):
            level, slot = levels.slot_of(b, fanout)
            lower = table._slots(b, level)
            place = f"t/level={level}/slot={slot}"
            assert place not in table._slots(b)
            held[place] = [b] + [x for s in lower for x in held[s]]
            assert sorted(x for s in table._slots(b + 1) for x in held[s]) == list(range(b + 1))
        assert len(held) <= (fanout - 1) * (math.floor(math.log(300, fanout)) + 1)


SIGNALS = "buffer_id string, peer string, seq bigint, t bigint, signal string"


def test_timeouts_do_not_depend_on_arrival(spark, tmp_path):
    base = 1_700_000_000
    rows = [
        ("b", "p", 1, base, "PRE_UPDATE"),
        ("b", "p", 2, base + 300, "READY"),
        ("b", "p", 3, base + 400, "PRE_UPDATE"),
        ("b", "p", 4, base + 701, "READY"),
        ("c", "p", 5, base + 10, "PRE_UPDATE"),
    ]
    end = [("z", "p", 9, base + 10**6, k) for k in ("PRE_UPDATE", "READY")]
    folder = str(tmp_path / "in")
    write_batches(spark, folder, [[rows[1], rows[3]], [rows[0], rows[2], rows[4]], end], SIGNALS)
    stream = run.read_events_stream(spark, folder, SIGNALS, files_per_batch=1).withColumn("ts", F.timestamp_seconds("t"))
    got = run.run_available(stream_signals.update_timeouts_stream(stream, "1 hour")).collect()
    assert sorted(r.seq for r in got) == [3, 5]
    batch = spark.createDataFrame(rows, SIGNALS).withColumn("ts", F.timestamp_seconds("t"))
    assert sorted(r.seq for r in update_timeouts(update_windows(batch)).collect()) == [3, 5]


def test_timeouts_at_one_instant_go_by_number(spark, tmp_path):
    base = 1_700_000_000
    rows = [
        ("b", "p", 2, base, "PRE_UPDATE"), ("b", "p", 1, base, "READY"),  # the READY came first
        ("c", "p", 3, base, "PRE_UPDATE"), ("c", "p", 4, base, "READY"),
        ("d", "p", 5, base, "PRE_UPDATE"), ("d", "p", 6, base + 300, "READY"), ("d", "p", 7, base + 1, "PRE_UPDATE"),
        ("e", "p", 8, base, "PRE_UPDATE"), ("e", "p", 9, base + 301, "READY"),
    ]
    end = [("z", "p", 90, base + 10**6, k) for k in ("PRE_UPDATE", "READY")]
    folder = str(tmp_path / "in")
    write_batches(spark, folder, [rows[:4], rows[4:], end], SIGNALS)
    stream = run.read_events_stream(spark, folder, SIGNALS, files_per_batch=1).withColumn("ts", F.timestamp_seconds("t"))
    got = run.run_available(stream_signals.update_timeouts_stream(stream, "1 hour")).collect()
    batch = spark.createDataFrame(rows, SIGNALS).withColumn("ts", F.timestamp_seconds("t"))
    want = update_timeouts(update_windows(batch)).collect()
    assert sorted(r.seq for r in got) == sorted(r.seq for r in want) == [2, 8]


def test_upserts_are_latest(spark, tmp_path):
    schema = "node string, seq bigint, v int"
    folder = str(tmp_path / "in")
    write_batches(spark, folder, [[("a", 1, 1), ("b", 5, 2)], [("a", 3, 3), ("b", 4, 9)], [("c", 6, 6)]], schema)
    stream = run.read_events_stream(spark, folder, schema, files_per_batch=1)
    got = ledger.upsert_stream(stream, ["node"], "seq").collect()
    assert sorted((r.node, r.seq, r.v) for r in got) == [("a", 3, 3), ("b", 5, 2), ("c", 6, 6)]


def test_shared_folder_is_required_on_a_cluster():
    from ballast import session

    class Cluster:
        master = "spark://somewhere"

    class Session:
        conf = {}
        sparkContext = Cluster()

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(Session())

"""The stream queries on events without a time, and the state behind them."""

import inspect
import os
import random

import oracle
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as driver
from quillspark import workers
from quillspark.streaming import feeds
from quillspark.streaming.state import BucketedState

SMALL = "/root/testdata/sf0.001"
STREAMS = ["stream_state_changes", "stream_user_states", "stream_null_states", "stream_ledger", "stream_balance"]


@pytest.fixture(scope="module")
def untimed(tmp_path_factory):
    """The small tables, every fifth event without a time."""
    folder = tmp_path_factory.mktemp("untimed")
    for name in os.listdir(SMALL):
        if name != "events.parquet":
            os.symlink(f"{SMALL}/{name}", folder / name)
    events = pq.read_table(f"{SMALL}/events.parquet")
    timed = pa.array([i % 5 != 0 for i in range(events.num_rows)])
    ts = pc.if_else(timed, events["ts"], pa.scalar(None, events["ts"].type))
    pq.write_table(events.set_column(events.schema.get_field_index("ts"), "ts", ts), folder / "events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", STREAMS)
def test_events_without_a_time(spark, untimed, name):
    assert oracle.compare(spark, oracle.connection(untimed), name, driver.queries()[name], driver.oracle_sql()[name], untimed) is None


def folders(tmp_path):
    return [str(tmp_path / x) for x in ("state", "out", "cp")]


def arrive(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return feeds.read_files(spark, str(tmp_path / "in"), schema)


def test_one_account_is_spread_over_tasks(spark, tmp_path):
    """Half of all events belong to one account: its cells lie in many partitions, and the balance is that of the loop."""
    rng = random.Random(8)
    rows = [(0 if i % 2 else i, i * 10, i, rng.choice([3, -1, -1, -1])) for i in range(4000)]
    schema = "account long, at long, id long, delta long"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts would be put together
    for part in (rows[:2500], rows[2500:]):
        stream = arrive(spark, tmp_path, part, schema)
        out = feeds.ledger_feed(stream, "account", ["at", "id"], "delta", *folders(tmp_path), bucket=F.floor(F.col("at") / 500), start=1)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    balance, want = 1, {}
    for _, _, i, delta in (r for r in rows if r[0] == 0):
        accepted = delta > 0 or balance >= 1
        balance += delta * accepted
        want[i] = (accepted, balance)
    assert {r.id: (r.accepted, r.balance) for r in out.where("account = 0").collect()} == want and out.count() == 4000
    parts = out.where("account = 0").select(F.input_file_name().alias("f")).distinct().count()
    assert parts > 4
    assert "PythonUDF" not in out._jdf.queryExecution().toString() and not hasattr(workers, "sorted_chunks")


def test_a_micro_batch_rewrites_its_buckets_only(spark, tmp_path):
    schema = "k long, at long, v string"
    root = tmp_path / "state"
    feeds.keep_latest(arrive(spark, tmp_path, [(k, 1, "a") for k in range(400)], schema), ["k"], ["at"], str(root), str(tmp_path / "cp"), buckets=64)
    first = {p.parent.name + p.name for p in root.glob("v=0/b=*/*.parquet")}
    out = feeds.keep_latest(arrive(spark, tmp_path, [(3, 5, "b"), (7, 0, "old"), (None, 1, "n")], schema), ["k"], ["at"], str(root), str(tmp_path / "cp"), buckets=64)
    assert len(list(root.glob("v=1/b=*"))) <= 3 < len(first)
    got = {(r.k, r.at, r.v) for r in out.collect()}
    assert got == {(k, 1, "a") for k in range(400) if k != 3} | {(3, 5, "b"), (None, 1, "n")}
    # only what a finished micro-batch has replaced goes, and what the last one started from stays until the next
    assert {p.parent.name + p.name for p in root.glob("v=0/b=*/*.parquet")} == first
    feeds.keep_latest(arrive(spark, tmp_path, [(3, 6, "c")], schema), ["k"], ["at"], str(root), str(tmp_path / "cp"), buckets=64)
    assert len(list(root.glob("v=0/b=*"))) == 63 or len(list(root.glob("v=0/b=*"))) < 64


def test_a_repeated_micro_batch_changes_nothing(spark, tmp_path):
    """A job that lost its checkpoint of the last micro-batch runs it again, from the same state, over its own output."""
    schema = "k long, at long, s string"
    runs = [[(1, 1, "x"), (2, 1, "x")], [(1, 2, "y"), (2, 2, "x")], [(1, 3, "y"), (3, 3, None)]]
    for rows in runs:
        out = feeds.change_feed(arrive(spark, tmp_path, rows, schema), "k", "s", ["at"], *folders(tmp_path))
    want = [(1, 1, "x"), (1, 2, "y"), (2, 1, "x"), (3, 3, None)]
    assert sorted(map(tuple, out.collect())) == want
    for x in ("commits/2", "commits/.2.crc"):
        (tmp_path / "cp" / x).unlink(missing_ok=True)
    stream = feeds.read_files(spark, str(tmp_path / "in"), schema)
    out = feeds.change_feed(stream, "k", "s", ["at"], *folders(tmp_path))
    assert sorted(map(tuple, out.collect())) == want
    assert sorted(map(tuple, BucketedState(spark, str(tmp_path / "state"), ["k"], T.StructType.fromDDL("k long, __shown_state string")).rows().collect())) == [(1, "y"), (2, "x"), (3, None)]


def test_ingest_keeps_no_stream_state(spark, tmp_path):
    schema = "img_path string, split string, label string"
    current = spark.createDataFrame([("a", "train"), ("b", "train")], "img_path string, split string")
    for rows in ([("a", "train", "1"), ("a", "valid", "2"), ("c", "train", "3"), ("c", "train", "3")], [("c", "train", "4"), ("d", "train", "5")], []):
        out = feeds.ingest_feed(arrive(spark, tmp_path, rows, schema), current, *folders(tmp_path))
    assert sorted(map(tuple, out.collect())) == [("a", "valid", "2"), ("c", "train", "3"), ("d", "train", "5")]
    assert not (tmp_path / "cp" / "state").exists()


def test_bytes_bound_a_micro_batch(spark, tmp_path):
    assert inspect.signature(feeds.read_files).parameters["files_per_trigger"].default is None
    for part in range(3):
        spark.range(part * 10, part * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = feeds.read_files(spark, str(tmp_path / "in"), "id long", bytes_per_trigger=1).writeStream.format("noop")
    query = query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [10, 10, 10]


@pytest.mark.parametrize("horizon", [None, 300])
def test_late_rows_are_put_in_their_place(spark, tmp_path, horizon):
    rng = random.Random(11)
    rows = [(rng.choice([1, 1, 1, 2, None]), i * 10, i, rng.choice([3, -1, -1, -1])) for i in range(240)] + [(1, None, 900, -1)]
    late = [r for r in rows[:160] if r[2] % 7 == 3]
    ancient = [(1, 5, 1000, 3)]
    parts = [[r for r in rows[:80] if r not in late], [r for r in rows[80:160] if r not in late] + late[:6], rows[160:] + late[6:], ancient]
    rng.shuffle(parts[1])
    schema = "account long, at long, id long, delta long"
    for part in parts:
        stream = arrive(spark, tmp_path, part, schema)
        out = feeds.late_ledger_feed(stream, "account", "at", "id", "delta", *folders(tmp_path), bucket=F.floor(F.col("at") / 100), start=1, horizon=horizon)
    out = out.collect()
    known = rows + (ancient if horizon is None else [])
    if horizon is not None:  # too old for the history: shown as late, without an outcome, and nothing is changed
        lost = {r.id for r in out if r.balance is None}
        assert 1000 in lost and all(r.kind == "late" for r in out if r.id in lost)
        known = [r for r in rows if r[2] not in lost]
    want = {}
    for account in (1, 2, None):
        balance = 1
        for _, _, i, delta in sorted((r for r in known if r[0] == account), key=lambda r: (r[1] is None, r[1] or 0, r[2])):
            accepted = delta > 0 or balance >= 1
            balance += delta * accepted
            want[i] = (accepted, balance)
    last = {}
    for r in sorted(out, key=lambda r: r.version):
        last[r.id] = (r.accepted, r.balance)
    assert {i: x for i, x in last.items() if x[1] is not None} == want
    first = {}
    for r in sorted(out, key=lambda r: r.version):
        first.setdefault(r.id, r.kind)
    assert {i for i, k in first.items() if k == "late"} >= {r[2] for r in late} | {1000} and first[200] == "kept" and "corrected" not in first.values()
    assert any(r.kind == "corrected" for r in out)

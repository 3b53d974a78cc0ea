import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import ledger, ordered
from quillspark.streaming import feeds


def plain_ledger(deltas, start):
    balance, out = start, []
    for d in deltas:
        if d < 0 and balance < 1:
            out.append((False, balance))
        else:
            balance += d
            out.append((True, balance))
    return out


def events(seed, n, accounts):
    """Most events belong to account 0, and many share a time."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        account = 0 if rng.random() < 0.7 else rng.randrange(accounts)
        rows.append((account, rng.randrange(200_000), i, rng.choice([3, -1, -1, -1, -1])))
    return rows


def expected_ledger(rows, start):
    want = {}
    for account in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == account), key=lambda r: (r[1], r[2]))
        for r, result in zip(mine, plain_ledger([x[3] for x in mine], start)):
            want[r[2]] = result
    return want


@pytest.mark.parametrize("seconds", [1, 3600, 10**6])
@pytest.mark.parametrize("start", [0, 5])
def test_ledger_equals_the_loop(spark, seconds, start):
    rows = events(seconds + start, 4000, 5)
    df = spark.createDataFrame(rows, "account long, sec long, id long, delta long").withColumn("ts", F.timestamp_seconds("sec"))
    out = ledger.balance_ledger(
        df, "account", ["ts", "id"], "delta", ordered.time_bucket(F.col("ts"), seconds), start=start)
    got = {r.id: (r.accepted, r.balance) for r in out.collect()}
    assert got == expected_ledger(rows, start)
    assert any(not ok for ok, _ in got.values())


def test_stream_ledger_over_several_batches(spark, tmp_path):
    rows = sorted(events(9, 1500, 4), key=lambda r: (r[1], r[2]))
    schema = "account long, sec long, id long, delta long"
    for part in range(3):
        chunk = rows[part * 500 : part * 500 + 500]
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = feeds.ledger_feed(
            feeds.read_files(spark, str(tmp_path / "in"), "account long, sec long, id long, delta long"),
            "account", ["sec", "id"], "delta", *[str(tmp_path / x) for x in ("state", "out", "cp")], bucket=F.floor(F.col("sec") / 5000), start=2)
    got = {r.id: (r.accepted, r.balance) for r in out.collect()}
    assert got == expected_ledger(rows, 2)


def test_status_feed_shows_changes_only(spark, tmp_path):
    batches = [[(1, 0, "loading"), (2, 0, "loading")], [(1, 1, "loading"), (2, 1, "response")], [(1, 2, "failed"), (2, 2, "response")]]
    for rows in batches:
        spark.createDataFrame(rows, "id long, version int, status string").coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in"))
        stream = feeds.read_files(spark, str(tmp_path / "in"), "id long, version int, status string")
        out = feeds.change_feed(stream, "id", "status", ["version"], *[str(tmp_path / x) for x in ("state", "out", "cp")])
    assert sorted(tuple(r) for r in out.collect()) == [
        (1, 0, "loading"), (1, 2, "failed"), (2, 0, "loading"), (2, 1, "response")]


def test_change_feed_takes_null_as_a_state(spark, tmp_path):
    for rows in ([(1, 1, None), (1, 2, None), (1, 3, 7)], [(1, 4, 7), (1, 5, None)], [(1, 6, None), (1, 7, 8)]):
        spark.createDataFrame(rows, "id long, version int, status long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = feeds.read_files(spark, str(tmp_path / "in"), "id long, version int, status long")
        out = feeds.change_feed(stream, "id", "status", ["version"], *[str(tmp_path / x) for x in ("state", "out", "cp")])
    assert sorted(r.version for r in out.collect()) == [1, 3, 5, 7]


def test_first_n_is_the_plain_first_n(spark):
    rows = [("a" if i % 5 else "b", i, (i * 7919) % 1000) for i in range(4000)] + [(None, 9999, 1)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(11)
    for n in (3, 1500):
        out = ordered.first_n_per_group(df, ["k"], [F.col("v"), F.col("i")], F.floor(F.col("v") / 50), n)
        want = {r[1] for k in ("a", "b", None) for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1]))[:n]}
        assert {r.i for r in out.collect()} == want
        assert out.columns == ["k", "i", "v"]


def test_number_rows_equals_one_window(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randrange(10_000)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    for descending in (False, True):
        order = [F.col("v").desc(), F.col("i").desc()] if descending else [F.col("v"), F.col("i")]
        out = ordered.number_rows(df, ["k"], order, F.floor(F.col("v") / 100), descending=descending)
        got = {r.i: r.ordinal for r in out.collect()}
        assert len(got) == len(rows)
        for key in ("a", "b", None):
            mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1]), reverse=descending)
            assert [got[r[1]] for r in mine] == list(range(1, len(mine) + 1))


def test_state_changes_equal_a_loop(spark):
    rng = random.Random(5)
    rows = [(0 if rng.random() < 0.6 else rng.randrange(4), i, rng.randrange(50_000), rng.choice(["x", "x", "y", None]))
            for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, i long, t long, s string")
    out = ordered.state_changes(df, ["k"], "s", ["t", "i"], F.floor(F.col("t") / 500))
    want = set()
    for key in range(4):
        shown = object()
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            if r[3] != shown:
                want.add(r[1])
                shown = r[3]
    assert {r.i for r in out.collect()} == want


def test_top_n_is_the_plain_top_n(spark):
    rows = [("a" if i % 5 else "b", i, (i * 7919) % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(11)
    out = ordered.top_n_per_group(df, ["k"], [F.col("v"), F.col("i")], 7, salts=5)
    want = {r[1] for k in "ab" for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1]))[:7]}
    assert {r.i for r in out.collect()} == want


def test_membership_keeps_every_row_once(spark):
    from quillspark.operators import listing

    df = spark.range(5000).select("id", F.when(F.col("id") < 4000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"))
    members = spark.createDataFrame([("hot",), ("hot",), ("k1",)], "key string")
    assert listing.accepted_requests(df, members).count() == 4020 and listing.rejected_requests(df, members).count() == 980


def test_hash_buckets_follow_the_order(spark):
    df = spark.range(2000).select((F.col("id") * 2147483).alias("h"))
    rows = df.select("h", ordered.hash_bucket(F.col("h"), 16).alias("b")).orderBy("h").collect()
    assert [r.b for r in rows] == [r.h >> 28 for r in rows]


def test_deep_pages_are_those_of_one_sort(spark):
    from quillspark.operators import listing

    rng = random.Random(6)
    rows = [(i, "s" if i % 5 else "t", None if i % 37 == 0 else rng.choice([7000, rng.randrange(0, 400_000)])) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, session_id string, sec long").repartition(6)
    df = df.select("id", "session_id", F.timestamp_seconds("sec").alias("at"))
    order = sorted((r for r in rows if r[1] == "s"), key=lambda r: (r[2] is None, -(r[2] or 0), -r[0]))
    for page in (1, 2, 13, 70, 71, 72, 73, 500):
        got = [r.id for r in listing.deep_page(df, "s", "at", page, 10, 1800).collect()]
        assert got == [r[0] for r in order[(page - 1) * 10 : page * 10]]
    assert listing.deep_page(df, "none", "at", 1, 10).count() == 0
    # the scan gets the page's range of time, and one row per bucket is counted
    plan = listing.deep_page(df, "s", "at", 50, 10, 1800)._jdf.queryExecution().optimizedPlan().toString()
    assert ">=" in plan

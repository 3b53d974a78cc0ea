"""Streaming queries: each runs over all files that are there and returns what it wrote."""

from pyspark.sql import functions as F

from quillspark.functions.rules import status
from quillspark.plans import adapters as a
from quillspark.plans.application import LEDGER
from quillspark.session import scratch_folder
from quillspark.streaming import feeds

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _arriving(spark, table, at, job, name, parts=3):
    """What `job(stream, state, out, checkpoint)` gives when the table's rows arrive in `parts` slices of time, a run of the stream after each.

    Rows without a time come in the last slice: they are last in order too.
    """
    numbered = table.withColumn("__at", F.coalesce(at, F.lit(float("inf"))))
    cuts = numbered.where(F.col("__at") < float("inf")).approxQuantile("__at", [i / parts for i in range(1, parts)], 0.01)
    bounds = [float("-inf"), *cuts, float("inf")]
    folder, state, out, checkpoint = (scratch_folder(spark, f"{name}-{x}") for x in ("in", "state", "out", "checkpoint"))
    for low, high in zip(bounds, bounds[1:]):
        part = numbered.where((F.col("__at") > low) & (F.col("__at") <= high)).drop("__at")
        part.write.mode("append").parquet(folder)
        rows = job(feeds.read_files(spark, folder, table.schema), state, out, checkpoint)
    return rows


def _events(spark, sf_dir, job, name):
    """The event stream, in the order of time."""
    return _arriving(spark, a.table(spark, sf_dir, "events"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double"), job, name)


def versions(events):
    """Each generation twice: as it was asked for, and as it stands after the answer."""
    response = F.when(F.col("event_type").isin("view", "click"), F.col("props"))
    answered = F.struct(F.lit(1).alias("version"), status(response, F.col("event_type") == "error").alias("status"))
    asked = F.struct(F.lit(0).alias("version"), F.lit("loading").alias("status"))
    return events.select(F.col("event_id").alias("id"), F.explode(F.array(answered, asked)).alias("v")).select("id", "v.*")


@query(
    "stream_state_changes",
    """SELECT event_id AS id, 'loading' AS status FROM events UNION ALL
 SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'response' END FROM events
 WHERE event_type IN ('error', 'view', 'click')""",
)
def stream_state_changes(spark, sf_dir):
    job = lambda events, *folders: feeds.change_feed(versions(events), "id", "status", ["version"], *folders)
    return _events(spark, sf_dir, job, "status").select("id", "status")


@query(
    "stream_user_states",
    """SELECT user_id, event_id, event_type FROM
 (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type""",
)
def stream_user_states(spark, sf_dir):
    return _user_states(spark, sf_dir, F.col("event_type"), "users")


@query(
    "stream_null_states",
    """SELECT user_id, event_id, event_type FROM
 (SELECT user_id, event_id, nullif(event_type, 'view') AS event_type, lag(nullif(event_type, 'view')) OVER w AS p,
  row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE r = 1 OR p IS DISTINCT FROM event_type""",
)
def stream_null_states(spark, sf_dir):
    return _user_states(spark, sf_dir, F.nullif(F.col("event_type"), F.lit("view")), "nulls")


def _quarter_day(micros):
    return F.floor(F.col(micros) / (6 * 3600 * 1_000_000))


def _user_states(spark, sf_dir, state, name):
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")

    def job(events, *folders):
        timed = events.select("user_id", at, "event_id", state.alias("event_type"))
        return feeds.change_feed(timed, "user_id", "event_type", ["at", "event_id"], *folders, bucket=_quarter_day("at")).drop("at")

    return _events(spark, sf_dir, job, name)


@query(
    "stream_latest_state",
    """SELECT user_id, event_id, event_type FROM
 (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""",
)
def stream_latest_state(spark, sf_dir):
    table = a.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    folder, root, checkpoint = (scratch_folder(spark, f"latest-{x}") for x in ("in", "out", "state"))
    for half in (0, 1):  # the halves come in any order of time
        table.where(F.col("event_id") % 2 == half).write.mode("append").parquet(folder)
        stream = feeds.read_files(spark, folder, table.schema)
        rows = feeds.keep_latest(stream, ["user_id"], ["ts", "event_id"], root, checkpoint)
    return rows.select("user_id", "event_id", "event_type")


def _ledger(feed, spark, sf_dir, name):
    def job(events, *folders):
        rows = a.ledger_events(events).withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))
        return feed(rows, "account", ["ts", "event_id"], "delta", *folders, bucket=_quarter_day("ts"), start=a.START)

    return _events(spark, sf_dir, job, name)


@query(
    "stream_ledger",
    a.sql("", "led").rstrip() + ",\n" + LEDGER + "\nSELECT account, event_id, delta, accepted, balance FROM ledger",
)
def stream_ledger(spark, sf_dir):
    return _ledger(feeds.ledger_feed, spark, sf_dir, "ledger").drop("ts")


@query(
    "stream_balance",
    a.sql("", "led").rstrip() + ",\n" + LEDGER + "\nSELECT account, event_id, balance FROM ledger WHERE accepted",
)
def stream_balance(spark, sf_dir):
    return _ledger(feeds.balance_feed, spark, sf_dir, "balance").select("account", "event_id", "balance")


@query(
    "stream_late_rows",
    a.sql("", "led").rstrip() + ",\n" + LEDGER + "\nSELECT account, event_id, accepted, balance FROM ledger",
)
def stream_late_rows(spark, sf_dir):
    """A tenth of the events comes a slice of time too late; the last version of each event is what the batch run says."""
    table = a.table(spark, sf_dir, "events").withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))
    place = F.coalesce(F.floor(F.col("ts") / (10 * 24 * 3600 * 1_000_000)), F.lit(1 << 40))
    held_back = F.when(F.col("event_id") % 10 == 3, 1.5).otherwise(0.0)

    def job(events, *folders):
        rows = a.ledger_events(events)
        return feeds.late_ledger_feed(rows, "account", "ts", "event_id", "delta", *folders, bucket=_quarter_day("ts"), start=a.START)

    rows = _arriving(spark, table, place + held_back, job, "late")
    newest = F.max_by(F.struct("accepted", "balance"), "version").alias("n")
    return rows.groupBy("account", "event_id").agg(newest).select("account", "event_id", "n.accepted", "n.balance")


@query(
    "stream_ingest",
    a.sql(
        "SELECT img_path, split, length(label) AS chars FROM reg r WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = r.doc_id)", "reg"
    ),
)
def stream_ingest(spark, sf_dir):
    present = a.samples(spark, sf_dir).join(a.scores(spark, sf_dir), "doc_id").select("img_path", "split")
    table = a.table(spark, sf_dir, "documents").select("doc_id", "text")
    twice = table.unionByName(table.where(F.col("doc_id") % 3 == 0))  # keys come again, in the same part and in later ones
    at = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(1000)).cast("double")
    fresh = _arriving(spark, twice, at, lambda docs, *folders: feeds.ingest_feed(a.as_samples(docs), present, *folders), "ingest")
    return fresh.select("img_path", "split", F.length("label").cast("bigint").alias("chars"))

"""Change-only feeds, the credit ledger, ingest and latest state as Structured Streaming jobs.

Each job folds micro-batches into a bucketed state (`state.py`) with the operators that batch queries use: windows run inside cells of the order, so a key with
a third of all rows is spread over tasks, and no Python runs on the workers. A micro-batch is as large as the source allows (`maxBytesPerTrigger`).
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark import fixed
from quillspark.operators import ledger, ordered
from quillspark.operators.registry import KEY, new_entries
from quillspark.streaming.state import BUCKETS, BucketedState, run_folds

_STORED, _LAST = -(1 << 62), (1 << 63) - 1  # buckets of the order before and behind all others


def read_files(spark, folder, schema, pattern="*.parquet", files_per_trigger=None, bytes_per_trigger=1 << 30):
    """Stream of the Parquet files of a folder; files that come later are picked up.

    A micro-batch is bounded by bytes, one file at least, or by `files_per_trigger` in place of that: Spark takes one limit only.
    """
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger" if files_per_trigger else "maxBytesPerTrigger", files_per_trigger or bytes_per_trigger)
        .parquet(folder)
    )


def _placed(batch, stored, order, bucket):
    """Stored rows in front of the rows of a batch, with columns that order them (nulls last) and a bucket that follows that order."""
    rows = batch.withColumn("__new", F.lit(1)).withColumn("__at", F.coalesce(bucket.cast("bigint"), F.lit(_LAST)))
    rows = rows.unionByName(stored.withColumn("__new", F.lit(0)).withColumn("__at", F.lit(_STORED)), allowMissingColumns=True)
    places = {f"__{part}{i}": x for i, c in enumerate(order) for part, x in (("behind", F.col(c).isNull()), ("by", F.col(c)))}
    return rows.withColumns(places), ["__new", *places]


def change_feed(versions, key, state, order, root, out, checkpoint=None, bucket=None, buckets=BUCKETS):
    """A row per key whenever its state differs from the last one shown; states may come back.

    A null is a state like any other. Rows of a micro-batch are taken in `order` inside their key, nulls last; a row that comes
    in a later micro-batch is taken as it arrives, even if it is older: it changes what is shown. `bucket` is a column that follows the order, to
    spread the rows of one key.
    """
    columns = list(dict.fromkeys([key, *order, state]))
    kept = T.StructType([T.StructField(key, versions.schema[key].dataType), T.StructField("__shown_state", versions.schema[state].dataType)])
    bucket = F.lit(0) if bucket is None else bucket

    def fold(batch, stored, _):
        rows, places = _placed(batch, stored.select(key, F.col("__shown_state").alias(state)), order, bucket)
        changes = ordered.state_changes(rows, [key], state, places, F.col("__at")).where("__new = 1").select(*columns)
        last = F.max_by(F.struct(F.col(state).alias("s")), F.struct(*places))
        return changes, rows.groupBy(key).agg(last.alias("__s")).select(key, F.col("__s.s").alias("__shown_state"))

    return run_folds(versions.select(*columns), BucketedState(versions.sparkSession, root, [key], kept, buckets), fold, out, checkpoint)


def ledger_feed(events, account, order, delta, root, out, checkpoint=None, bucket=None, start=fixed.START_BALANCE, buckets=BUCKETS):
    """Every event with `accepted` and the account's `balance` after it.

    The stored balance stands in front of a micro-batch as an event that leads from `start` to it.
    """
    columns = [account, *order, delta]
    kept = T.StructType([T.StructField(account, events.schema[account].dataType), T.StructField("balance", T.LongType())])
    bucket = F.lit(0) if bucket is None else bucket

    def fold(batch, stored, _):
        rows, places = _placed(batch, stored.select(account, (F.col("balance") - start).alias(delta)), order, bucket)
        steps = ledger.balance_ledger(rows, account, places, delta, F.col("__at"), start)
        last = F.max_by("balance", F.struct(*places)).alias("balance")
        return steps.where("__new = 1").select(*columns, "accepted", "balance"), steps.groupBy(account).agg(last)

    return run_folds(events.select(*columns), BucketedState(events.sparkSession, root, [account], kept, buckets), fold, out, checkpoint)


def late_ledger_feed(events, account, at, tie, delta, root, out, checkpoint=None, bucket=None, delay=0, horizon=None, start=fixed.START_BALANCE, buckets=BUCKETS):
    """The ledger of events that come out of order: every event once, and again whenever an event before it changes its outcome.

    Output rows are `kept` (in time), `late` (older than the greatest `at` of earlier micro-batches less `delay`) or `corrected` (shown before, and different now), with the micro-batch's
    number in `version`: the last version of an event is that of a batch run over all events. `at` and `tie` are numbers that order an account's events.

    The state holds the events of the last `horizon` of an account's time (all, if none is given), and one opening balance in front of them. A late event older
    than the opening balance is shown without an outcome and changes nothing. An event without a time is the last of its account.
    """
    columns = [account, at, tie, delta]
    kept = T.StructType([events.schema[c] for c in columns] + [T.StructField("accepted", T.BooleanType()), T.StructField("balance", T.LongType()), T.StructField("opening", T.BooleanType())])
    state = BucketedState(events.sparkSession, root, [account], kept, buckets)
    bucket = F.lit(0) if bucket is None else bucket
    places = ["__later", "__behind", at, tie]

    def fold(batch, stored, number):
        mark = state.marked(number)
        newest = batch.agg(F.max(at)).first()[0]
        state.mark(number, float(max(x for x in (mark, newest, float("-inf")) if x is not None)))
        openings = stored.where("opening").select(account, F.col(at).alias("__opened"))
        rows = batch.withColumn("__new", F.lit(True)).join(openings.withColumnRenamed(account, "__a"), F.col(account).eqNullSafe(F.col("__a")), "left").drop("__a")
        too_old = F.coalesce(F.col(at) <= F.col("__opened"), F.lit(False))
        lost = rows.where(too_old).select(*columns, F.lit(None).cast("boolean").alias("accepted"), F.lit(None).cast("bigint").alias("balance"), F.lit("late").alias("kind"))
        before = stored.withColumnsRenamed({"accepted": "__accepted", "balance": "__balance"}).withColumn("__new", F.lit(False))
        all_ = rows.where(~too_old).drop("__opened").withColumn("opening", F.lit(False)).unionByName(before, allowMissingColumns=True)
        all_ = all_.withColumn(delta, F.when(F.col("opening"), F.col("__balance") - start).otherwise(F.col(delta)))
        all_ = all_.withColumns({"__later": ~F.col("opening"), "__behind": F.col(at).isNull()})
        cell = F.when(F.col("opening"), F.lit(_STORED)).otherwise(F.coalesce(bucket.cast("bigint"), F.lit(_LAST)))
        steps = ledger.balance_ledger(all_, account, places, delta, cell, start)
        steps = steps.withColumn("accepted", F.col("opening") | F.col("accepted"))
        late = F.coalesce(F.col(at) < F.lit(mark - delay), F.lit(False)) if mark is not None else F.lit(False)
        changed = ~F.col("opening") & ~(F.col("accepted").eqNullSafe(F.col("__accepted")) & F.col("balance").eqNullSafe(F.col("__balance")))
        kind = F.when(F.col("__new"), F.when(late, "late").otherwise("kept")).otherwise("corrected")
        shown = steps.where(F.col("__new") | changed).select(*columns, "accepted", "balance", kind.alias("kind")).unionByName(lost)
        shown = shown.withColumn("version", F.lit(number).cast("bigint"))
        after = steps.select(*columns, "accepted", "balance", "opening")
        if horizon is not None:
            ends = steps.groupBy(account).agg((F.max(at) - horizon).alias("__cut")).withColumnRenamed(account, "__a")
            aged = after.join(ends, F.col(account).eqNullSafe(F.col("__a")), "left").drop("__a")
            old = F.coalesce(F.col("opening") | (F.col(at) < F.col("__cut")), F.lit(False))
            last = F.max_by(F.struct(F.col(at), F.col("balance")), F.struct((~F.col("opening")).alias("o"), F.col(at).alias("t"), F.col(tie).alias("i")))
            opened = aged.where(old).groupBy(account).agg(last.alias("l")).select(
                account, F.col(f"l.{at}").alias(at), F.lit(None).cast(kept[tie].dataType).alias(tie), F.lit(None).cast(kept[delta].dataType).alias(delta),
                F.lit(True).alias("accepted"), F.col("l.balance").alias("balance"), F.lit(True).alias("opening"))
            after = aged.where(~old).select(*after.columns).unionByName(opened)
        return shown, after

    return run_folds(events.select(*columns), state, fold, out, checkpoint)


def balance_feed(*args, **options):
    """Balances to show: those that an event changed. Arguments are those of `ledger_feed`."""
    return ledger_feed(*args, **options).where("accepted")


def ingest_feed(incoming, current, root, out, checkpoint=None, buckets=BUCKETS):
    """New files' rows whose key neither the registry nor an earlier row of the stream has.

    Keys of the registry are put into buckets once (when `root` is new); a micro-batch is held against the buckets of its own keys only, and Spark keeps no state.
    """
    schema = T.StructType([incoming.schema[c] for c in KEY])
    known = BucketedState(incoming.sparkSession, root, KEY, schema, buckets)
    if not known.has_versions():
        known.seed(current.select(*KEY).distinct())

    def fold(batch, keys, _):
        fresh = new_entries(batch.dropDuplicates(KEY), keys)
        return fresh.select(*incoming.columns), keys.unionByName(fresh.select(*KEY))

    return run_folds(incoming, known, fold, out, checkpoint)


def keep_latest(stream, keys, order, root, checkpoint=None, buckets=BUCKETS):
    """The latest row per key of all that has come; a micro-batch rewrites the buckets of its keys only."""
    state = BucketedState(stream.sparkSession, root, keys, stream.schema, buckets)

    def fold(batch, stored, _):
        rows = batch.unionByName(stored)
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("__row")).select("__row.*")
        return None, newest

    run_folds(stream, state, fold, None, checkpoint)
    return state.rows()

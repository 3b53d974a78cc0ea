"""Listings, pages, checks and deletes of the session-scoped application tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions.rules import status
from quillspark.functions.text import masked_key
from quillspark.operators.ordered import number_rows, time_bucket


def session_rows(df, session_id, when, number=None, offset=0, ids=None):
    """One session's rows, newest first. No number means all; an empty id list means no filter."""
    rows = df.where(F.col("session_id") == session_id)
    if ids:
        rows = rows.where(F.col("id").isin(*ids))
    rows = rows.orderBy(F.col(when).desc(), F.col("id").desc())
    if offset:
        rows = rows.offset(offset)
    return rows.limit(number) if number else rows


def session_page(df, session_id, when, page, size):
    return session_rows(df, session_id, when, number=size, offset=(page - 1) * size)


def deep_page(df, session_id, when, page, size, bucket_seconds=3600):
    """A page of a session's newest-first rows at any depth, without sorting or carrying the rows before it.

    Counts per time bucket tell which buckets hold the page; the scan then reads only rows of their range of time, and sorts them. The rows without a time
    are one bucket, the last. A page costs as much as its buckets hold, whatever its number.
    """
    offset = (page - 1) * size
    mine = df.where(F.col("session_id") == session_id)
    counts = mine.groupBy(time_bucket(F.col(when), bucket_seconds).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    newest = Window.orderBy(F.col("b").desc_nulls_last())  # a row per bucket of one session
    held = counts.withColumn("end", F.sum("n").over(newest)).withColumn("start", F.col("end") - F.col("n"))
    held = held.where((F.col("end") > offset) & (F.col("start") < offset + size))
    low, high, start, no_time = held.agg(F.min("b"), F.max("b"), F.min("start"), F.max(F.col("b").isNull())).first()
    if start is None:
        return mine.limit(0)
    inside = F.lit(False)
    if low is not None:
        first, last = (F.timestamp_micros(F.lit(int(b) * bucket_seconds * 1_000_000)) for b in (low, high + 1))
        inside = (F.col(when) >= first) & (F.col(when) < last)
    if no_time:
        inside = inside | F.col(when).isNull()
    return mine.where(inside).orderBy(F.col(when).desc(), F.col("id").desc()).offset(offset - start).limit(size)


def rows_by_ids(df, wanted):
    """Rows whose (id, session_id) is in `wanted`: the id filter for lists of any length."""
    return df.join(wanted.select("id", "session_id").distinct(), ["id", "session_id"], "left_semi")


def all_pages(df, when, size, bucket_seconds=3600):
    """Every row with its place in its session's newest-first order and its page from 1."""
    order = [F.col(when).desc(), F.col("id").desc()]
    numbered = number_rows(
        df, ["session_id"], order, time_bucket(F.col(when), bucket_seconds), "age", descending=True
    )
    return numbered.withColumn("page", F.floor((F.col("age") - 1) / size) + 1)


def session_counts(df):
    return df.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_rows"))


def page_flags(df, sessions, shown):
    """For each of `sessions`: whether it has rows, and whether there are more than the `shown` first ones."""
    counts = sessions.select("session_id").distinct().join(session_counts(df), "session_id", "left")
    return counts.withColumn("n_rows", F.coalesce("n_rows", F.lit(0))).select(
        "session_id",
        "n_rows",
        (F.col("n_rows") > 0).alias("present"),
        (F.col("n_rows") > shown).alias("still_more"),
    )


def with_status(gens):
    return gens.withColumn("status", status(F.col("response"), F.col("failed")))


def key_rows(keys):
    """What a key table shows: complete keys only, masked, with the date as text."""
    return keys.where((F.length("key") > 0) & F.col("granted_at").isNotNull()).select(
        "id",
        "session_id",
        masked_key(F.col("key")).alias("short_key"),
        F.date_format("granted_at", "yyyy-MM-dd HH:mm:ss").alias("granted"),
    )


def accepted_requests(requests, keys):
    """Requests whose key was granted. A hot key's requests are split by AQE: its side of the join is one row."""
    return requests.join(keys.select("key").distinct(), "key", "left_semi")


def rejected_requests(requests, keys):
    return requests.join(keys.select("key").distinct(), "key", "left_anti")


def without_session(df, session_id):
    """The table after a session deleted all its rows."""
    return df.where(~F.col("session_id").eqNullSafe(session_id))


def without_selected(df, selected):
    """The table after sessions deleted rows of theirs: both id and session must match."""
    return df.join(selected.select("id", "session_id"), ["id", "session_id"], "left_anti")


def oldest_first(df, when, name="place"):
    """Each row's place in its session, the oldest first; nothing is sorted across sessions."""
    order = [F.col(when).asc(), F.col("id").asc()]
    return number_rows(df, ["session_id"], order, time_bucket(F.col(when)), name)


def latest_state(versions, keys, order, values):
    """The newest version of each row; combines before the shuffle."""
    newest = F.max_by(F.struct(*values), F.struct(*order)).alias("__v")
    return versions.groupBy(*keys).agg(newest).select(*keys, "__v.*")


def shown_ids(*parts):
    """Set union of the ids of several listings."""
    out = parts[0].select("id")
    for part in parts[1:]:
        out = out.union(part.select("id"))
    return out.distinct()

"""Ordered operators that never put a whole hot group into one task.

A plain window over a split, class, session or account gives that group to one task. Here the
group is cut into buckets that follow the order (hash prefixes, hours, id ranges). A small
aggregate per bucket carries what the next bucket must know, and the window runs inside buckets.
Group and bucket travel as plain columns without nulls: they sort fast, and the window and the join
that brings the carried value back share one shuffle.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "__bucket"
_FIRST = -(1 << 63)


def _group(keys):
    return [f"__{part}{i}" for i in range(len(keys)) for part in ("key", "none")]


def cell(keys):
    """Names of the columns that say which group and bucket a row is in."""
    return [*_group(keys), BUCKET]


def with_cell(df, keys, bucket):
    """`df` with its cell columns; rows without a key or bucket have a cell of their own."""

    def filled(key):
        if isinstance(df.schema[key].dataType, T.IntegralType):
            return F.coalesce(F.col(key).cast("bigint"), F.lit(0).cast("bigint"))
        return F.coalesce(F.col(key).cast("string"), F.lit(""))

    columns = [c for k in keys for c in (filled(k), F.col(k).isNull())]
    bucket = F.coalesce(bucket.cast("bigint"), F.lit(_FIRST))
    named = dict(zip(cell(keys), [*columns, bucket], strict=True))
    return df.withColumns(named)


def bucket_window(keys, descending=False):
    """Window over the per-bucket rows of one group, in bucket order."""
    order = F.col(BUCKET).desc() if descending else F.col(BUCKET).asc()
    return Window.partitionBy(*_group(keys)).orderBy(order)


def hash_bucket(hashed, buckets=4096):
    """Bucket that follows the order of a 32-bit hash. `buckets` is a power of two."""
    return F.shiftright(hashed, 32 - (buckets.bit_length() - 1))


def time_bucket(ts, seconds=3600):
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000))


def id_bucket(number, rows=1 << 20):
    """At most `rows` rows per bucket when the numbers are distinct."""
    return F.floor(number / F.lit(rows))


def number_rows(df, keys, order, bucket, name="ordinal", descending=False):
    """Exact row_number over `order` inside `keys`; `bucket` must follow the order."""
    at = cell(keys)
    cells = with_cell(df, keys, bucket)
    sizes = cells.groupBy(*at).agg(F.count(F.lit(1)).alias("__n"))
    before = bucket_window(keys, descending).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*at, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(*at).orderBy(*order))
    return (
        cells.withColumn("__at", inside)
        .join(starts, at)
        .withColumn(name, F.col("__at") + F.col("__start"))
        .drop(*at, "__at", "__start")
    )


def first_n_per_group(df, keys, order, bucket, n):
    """First `n` rows of each group for any `n`, a number or a column of the keys; `bucket` must follow the order.

    Counts per bucket tell where the n-th row lies. Rows behind that bucket go before any sort, and a
    group's winners are sorted in buckets, never in one task.
    """
    at = cell(keys)
    cells = with_cell(df, keys, bucket)
    sizes = cells.groupBy(*keys, *at).agg(F.count(F.lit(1)).alias("__n"))
    before = bucket_window(keys).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    starts = starts.withColumn("__wanted", n if hasattr(n, "cast") else F.lit(n))
    starts = starts.where(F.col("__start") < F.col("__wanted")).select(*at, "__start", "__wanted")
    inside = F.row_number().over(Window.partitionBy(*at).orderBy(*order))
    return (
        cells.join(starts, at)
        .withColumn("__at", inside)
        .where(F.col("__at") + F.col("__start") <= F.col("__wanted"))
        .drop(*at, "__at", "__start", "__wanted")
    )


def top_n_per_group(df, keys, order, n, salts=64):
    """First `n` rows of each group in two steps, for a small `n` (a page): per salted part, then over the winners.

    The salt is the same for all rows of an input partition, and Spark limits each part before its
    shuffle: a task sends at most `n` rows of a group, and the last step sees `salts * n` of them.
    """
    part = Window.partitionBy(*keys, "__salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("__salt", F.spark_partition_id() % F.lit(salts))
        .withColumn("__r", F.row_number().over(part))
        .where(F.col("__r") <= n)
        .withColumn("__r", F.row_number().over(whole))
        .where(F.col("__r") <= n)
        .drop("__salt", "__r")
    )


def state_changes(df, keys, state, order, bucket):
    """Rows whose state differs from the previous one of their key; the first row counts."""
    at = cell(keys)
    cells = with_cell(df, keys, bucket)
    inside = Window.partitionBy(*at).orderBy(*order)
    last = cells.groupBy(*at).agg(
        F.max_by(F.struct(F.col(state).alias("s")), F.struct(*order)).alias("__last")
    )
    carried = last.select(*at, F.lag("__last").over(bucket_window(keys)).alias("__carried"))
    return (
        cells.withColumn("__previous", F.lag(F.struct(F.col(state).alias("s"))).over(inside))
        .join(carried, at)
        .withColumn("__shown", F.coalesce("__previous", "__carried"))
        .where(F.col("__shown").isNull() | ~F.col("__shown.s").eqNullSafe(F.col(state)))
        .drop(*at, "__carried", "__previous", "__shown")
    )

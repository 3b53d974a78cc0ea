"""Credit balance derived from events: purchases add, requests take one or are refused."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark import fixed
from quillspark.operators.ordered import bucket_window, cell, with_cell


def balance_ledger(events, account, order, delta, bucket, start=fixed.START_BALANCE):
    """Events with `accepted` and `balance` after each. `delta` is a credit or -1.

    With S the plain running sum, the balance that never goes below zero is S - min(0, lowest S so
    far). Sums and lowest prefixes per bucket are enough to carry both across buckets, so an account
    with most of the events is still spread over all its buckets.
    """
    at = cell([account])
    cells = with_cell(events, [account], bucket)
    inside = Window.partitionBy(*at).orderBy(*order)
    to_here = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    to_previous = inside.rowsBetween(Window.unboundedPreceding, -1)
    running = cells.withColumn("__sum", F.sum(delta).over(to_here))

    per_bucket = running.groupBy(*at).agg(F.sum(delta).alias("__total"), F.min("__sum").alias("__low"))
    earlier = bucket_window([account]).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        per_bucket.withColumn("__base", start + F.coalesce(F.sum("__total").over(earlier), F.lit(0)))
        .withColumn("__floor", F.min(F.col("__base") + F.col("__low")).over(earlier))
        .select(*at, "__base", F.least(F.lit(0), F.col("__floor")).alias("__floor"))
    )

    level = F.col("__base") + F.col("__sum")
    floor_before = F.least(F.col("__floor"), F.col("__base") + F.col("__low_before"))
    return (
        running.withColumn("__low_before", F.min("__sum").over(to_previous))
        .join(carried, at)
        .withColumn("accepted", (F.col(delta) > 0) | (level >= floor_before))
        .withColumn("balance", level - F.least(floor_before, level))
        .drop(*at, "__sum", "__low_before", "__base", "__floor")
    )

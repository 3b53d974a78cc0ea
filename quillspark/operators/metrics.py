"""Error rates, accuracy and epoch metrics as sums that combine before the shuffle."""

import pandas as pd
from pyspark.sql import functions as F

from quillspark import fixed, workers
from quillspark.functions import text, vectors


def pair_edits(pairs, ref="label", hyp="pred", tokenizer=fixed.LATEX_TOKEN, kernel="arrow"):
    """Per pair: edits between both token lists and the reference's length.

    `tokenizer` is a token pattern, or a function from a text column to an array column.
    `kernel="arrow"` counts many cells per step on Arrow batches, for texts of any length;
    `kernel="jvm"` stays in built-in expressions, for short labels.
    """
    pattern = tokenizer if isinstance(tokenizer, str) else None

    def cut(column):
        return text.tokens(column, pattern) if pattern else tokenizer(column)

    if kernel == "jvm":
        counted = text.bind(
            F.struct(cut(F.col(ref)).alias("r"), cut(F.col(hyp)).alias("h")),
            lambda t: F.struct(
                text.token_edits(t["r"], t["h"]).alias("edits"), F.size(t["r"]).alias("ref_tokens")
            ),
        )
    else:

        @F.pandas_udf("edits bigint, ref_tokens bigint")
        def count(r: pd.Series, h: pd.Series) -> pd.DataFrame:
            return workers.pair_counts(r, h, pattern)

        # a pattern is applied by the worker: texts travel, not lists of their tokens
        counted = count(F.col(ref), F.col(hyp)) if pattern else count(cut(F.col(ref)), cut(F.col(hyp)))
    return (
        pairs.withColumn("__c", counted)
        .withColumn("edits", F.col("__c.edits").cast("bigint"))
        .withColumn("ref_tokens", F.col("__c.ref_tokens").cast("bigint"))
        .drop("__c")
    )


def pooled_error_rate(edits, keys):
    """All edits over all reference tokens; null when there are none. May be over 1."""
    return edits.groupBy(*keys).agg(
        F.sum("edits").alias("edits"),
        F.sum("ref_tokens").alias("ref_tokens"),
        F.try_divide(F.sum("edits"), F.sum("ref_tokens")).alias("error_rate"),
    )


def weighted_means(df, keys, weight, values):
    """Mean of each batch metric weighted by the batch size."""
    return df.groupBy(*keys).agg(
        *[F.try_divide(F.sum(F.col(v) * F.col(weight)), F.sum(weight)).alias(v) for v in values]
    )


def accuracy(df, logits, target, ks=(1, 5)):
    """Percentage of rows whose target is among the k largest entries, for each k."""
    rank = vectors.target_rank(F.col(logits), F.col(target))
    return df.select(rank.alias("__rank")).agg(
        F.count(F.lit(1)).alias("n"),
        *[(F.avg((F.col("__rank") < k).cast("double")) * 100).alias(f"top{k}") for k in ks],
    )


def best_epoch(metrics, keys, metric, decreasing=None):
    """Epoch with the best metric of each group; the earliest one wins a tie. A loss is best when low, all else when high."""
    if decreasing is None:
        decreasing = metric == "loss"
    best = F.min(F.struct((F.col(metric) if decreasing else -F.col(metric)).alias("m"), F.col("epoch").alias("e")))
    value = F.col("__b.m") if decreasing else -F.col("__b.m")
    return (
        metrics.where(F.col(metric).isNotNull())
        .groupBy(*keys)
        .agg(best.alias("__b"))
        .select(*keys, F.col("__b.e").alias("epoch"), value.alias(metric))
    )

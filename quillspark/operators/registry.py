"""Sample registry: one typed row per (img_path, split)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

KEY = ["img_path", "split"]


def new_entries(incoming, current):
    """Rows of `incoming` whose key is not registered yet."""
    return incoming.join(current.select(*KEY), KEY, "left_anti")


def upsert(current, incoming):
    """The registry plus the rows it did not have."""
    return current.unionByName(new_entries(incoming, current), allowMissingColumns=True)


def split_rows(registry, split):
    return registry.where(F.col("split") == split)


def unscored(registry):
    """Rows without a score; a registry that was never scored has only such rows."""
    return registry.where(F.col("score").isNull()) if "score" in registry.columns else registry


def with_score_column(registry):
    if "score" in registry.columns:
        return registry
    return registry.withColumn("score", F.lit(None).cast("int"))


def reset_scores(registry):
    return registry.withColumn("score", F.lit(None).cast("int"))


def merge_scores(registry, scores, reset=False):
    """New scores win, old ones stay where there is no new one. A key scored twice is an error."""
    base = reset_scores(registry) if reset else with_score_column(registry)
    twice = F.raise_error(F.concat(F.lit("scored twice: "), F.max("img_path")))
    fresh = scores.groupBy(*KEY).agg(
        F.when(F.count(F.lit(1)) > 1, twice.cast("int")).otherwise(F.max("score")).alias("__new")
    )
    return (
        base.join(fresh, KEY, "left")
        .withColumn("score", F.coalesce("__new", "score"))
        .drop("__new")
        .select(*base.columns)
    )


def split_counts(registry):
    return registry.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


def class_shares(registry):
    """Rows of each class and their share of all rows in the split, unscored ones included.

    The window runs over one row per (split, class), so it stays small.
    """
    counted = registry.groupBy("split", "score").agg(F.count(F.lit(1)).alias("n_class"))
    return (
        counted.withColumn("n_split", F.sum("n_class").over(Window.partitionBy("split")))
        .where(F.col("score").isNotNull())
        .withColumn("share", F.col("n_class") / F.col("n_split"))
    )


def class_quotas(registry, draws_per_split):
    """Draws per (split, class): the split's number times the class share, truncated."""
    wanted = F.create_map(*[F.lit(x) for pair in draws_per_split.items() for x in pair])
    return class_shares(registry).withColumn(
        "quota", F.coalesce(F.floor(wanted[F.col("split")] * F.col("share")), F.lit(0)).cast("int")
    )


def apply_manifest(df, dataset):
    """Project to a manifest's column names: {name of the trainer: name in our table}."""
    return df.select(*[F.col(ours).alias(theirs) for theirs, ours in dataset["columns"].items()])
